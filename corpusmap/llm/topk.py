"""Exact top-k inner products with MaxScore.

Components are quantised to ``floor(scale * x)``. A dimension is a term, its
posting list the candidates' values in it. Candidates are dealt into shards and
queries into blocks; every shard meets every block in one task of bounded size.

In a task, each query's terms are bounded by the shard's least and largest
value per dimension. Counted from the least possible contribution, a term adds
between 0 and its bound; the terms of smallest bounds whose sum cannot reach
the threshold are non-essential. The essential postings are traversed for all
candidates, and the others are probed, largest bound first, only for candidates
that can still reach the threshold. The threshold starts as the k-th best of
the candidates that look best by the first terms. Ties at the threshold stay in
play. The shards' lists are merged per query.

Vectors that are null or hold a null or non-finite component, and rows without
an id, take no part; missing trailing components count as 0. Rows that repeat
an id are candidates of their own, but never of a query with that id; a query
id that repeats is asked once (with the least of its vectors). Equal scores go to
the smaller id, in the shards and when their lists are merged. Scores must fit
64 bits. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmap.llm.common import prepare

SHARD_ROWS = 8192
BLOCK_ROWS = 2048
#: Terms of the first look, which gives the threshold to start with.
FIRST_TERMS = 16
#: Non-essential terms probed between two checks against the threshold.
PROBE = 8


def quantised(vec: Column, scale: int) -> Column:
    """Integer components, or null if the vector takes no part."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def max_score(terms: np.ndarray, query: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidates, scores) that hold the k best of the ``allowed`` ones.
    ``terms``: [dimension, candidate]."""
    lows, highs = terms.min(axis=1), terms.max(axis=1)
    least = np.minimum(query * lows, query * highs)
    bound = np.maximum(query * lows, query * highs) - least
    order = np.argsort(-bound, kind="stable")                   # largest bound first
    if len(allowed) <= k:
        return allowed, query @ terms[:, allowed]
    look = order[:FIRST_TERMS]
    seen = (query[look] @ terms[look])[allowed]
    best = allowed[np.argpartition(-seen, min(4 * k, len(seen) - 1))[:4 * k]]
    threshold = np.sort(query @ terms[:, best])[-k]
    # Smallest bounds first: while their sum stays below the threshold they are non-essential.
    reach = np.cumsum(bound[order][::-1])
    spare = int(np.searchsorted(reach, threshold - least.sum(), side="left"))
    essential, rest = order[:len(order) - spare], order[len(order) - spare:]
    score = (query[essential] @ terms[essential])[allowed] if len(essential) else np.zeros(len(allowed), np.int64)
    left = allowed
    for at in range(0, len(rest) + 1, PROBE):
        hope = (bound[rest[at:]] + least[rest[at:]]).sum()
        stay = score + hope >= threshold
        left, score = left[stay], score[stay]
        part = rest[at:at + PROBE]
        if len(part):
            score = score + query[part] @ terms[np.ix_(part, left)]
    return left, score


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query.
    ``is_query`` is a condition on the column ``vec_id``."""
    prepare(vectors.sparkSession)
    rows = (vectors.select(vectors[id_col].cast("long").alias("vec_id"), quantised(vectors[vec_col], scale).alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()))
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, n_queries = rows.count(), rows.filter(is_query).select("vec_id").distinct().count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_queries // BLOCK_ROWS))

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    candidates = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"),
                             each(blocks).alias("block"))
    asked = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
                           each(shards).alias("shard"))

    def search(key, cands: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(cands) and len(asks):
            cands = cands.sort_values("vec_id", kind="stable")
            width = max(max(map(len, cands["v"])), max(map(len, asks["v"])), 1)
            terms = np.ascontiguousarray(matrix(cands["v"], width).T)
            ids, everyone = cands["vec_id"].to_numpy(), np.arange(len(cands))
            for q, query in zip(asks["vec_id"], matrix(asks["v"], width)):
                allowed = everyone[ids != q]
                if not len(allowed):
                    continue
                at, score = max_score(terms, query, allowed, k)
                first = np.lexsort((ids[at], -score))[:k]
                found.append(pd.DataFrame({"query_id": q, "vec_id": ids[at][first], "score": score[first]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    merged = (candidates.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
              .applyInPandas(search, "query_id long, vec_id long, score long"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
