"""Zero-shot category (VEC-6) and exact k-nearest points (VEC-7).

``categorize`` multiplies Arrow batches of unit vectors by the label matrix.
The labels are configuration, a part of the model like its weights: the matrix
is taken once and sent to every worker once, and is walked in blocks of
``LABEL_BLOCK`` rows, so any number of labels fits. No join and no shuffle.

``nearest`` is exact top-k by cosine as a block join, with neither side on the
driver nor broadcast. The queries of a group (e.g. a dataset) are hashed into
blocks of about ``QUERY_BLOCK`` rows and its points into shards of about
``POINT_SHARD`` rows; points are copied once per block, queries once per shard,
and each (group, block, shard) meets in one task, which multiplies the two
small matrices and keeps the top k of every query. A group that holds a third
of all points is many shards. Of the candidates, Spark limits each query's
rows to k in every task before they are shuffled (window group limit), and one
window picks the result: "higher cosine first, lower key on ties" (cosines are
compared after rounding to ``COMPARED`` places, since the sums of equal vectors
can differ in the last bit with their place in a matrix).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmap.session import cut_lineage

LABEL_BLOCK = 1024
QUERY_BLOCK = 2048
POINT_SHARD = 16_384
MULTIPLIED = 256            # queries of a block multiplied at once
COMPARED = 12
NEAREST_K = 8
NORM_FLOOR = 1e-12


def label_matrix(labels: DataFrame, vec_col: str = "vector") -> np.ndarray:
    """The configured label vectors as one matrix, in the order of ``idx``."""
    got = labels.select("idx", F.col(vec_col).cast("array<double>").alias("v")).orderBy("idx").toArrow()
    if got["idx"].to_pylist() != list(range(got.num_rows)):
        raise ValueError("category label indexes must be 0..n-1")
    return np.array(got["v"].to_pylist(), dtype=np.float64).reshape(got.num_rows, -1)


def _best_label(unit: np.ndarray, labels: np.ndarray):
    """Index and cosine of each row's most similar label, the lowest on ties."""
    best = np.full(len(unit), -np.inf)
    at = np.full(len(unit), -1, dtype=np.int64)
    for lo in range(0, len(labels), LABEL_BLOCK):
        sims = np.round(unit @ labels[lo:lo + LABEL_BLOCK].T, COMPARED)
        k = sims.argmax(axis=1)
        v = sims[np.arange(len(unit)), k]
        better = v > best
        best[better], at[better] = v[better], k[better] + lo
    return at, best


def categorize(points: DataFrame, labels, vec_col: str = "vector", places: int = 4) -> DataFrame:
    """Adds ``category`` (index of the most similar label, lowest index on ties)
    and ``similarity`` (that cosine, rounded). Labels must be unit vectors;
    ``labels`` is the label table or a matrix already taken from it with
    ``label_matrix`` (so one job can categorise several frames). A null vector,
    or a set without labels, gives nulls."""
    mat = label_matrix(labels) if isinstance(labels, DataFrame) else np.asarray(labels, dtype=np.float64)
    sent = points.sparkSession.sparkContext.broadcast(mat)
    kept = [c for c in points.columns if c not in ("category", "similarity")]

    def run(batches):
        for rows in batches:
            vectors = rows.column(kept.index(vec_col))
            here, matrix = vectors.is_valid().to_numpy(zero_copy_only=False), sent.value
            at, sim = np.full(len(here), -1, np.int64), np.zeros(len(here))
            if here.any() and len(matrix):
                dense = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(here.sum(), -1)
                at[here], sim[here] = _best_label(_unit_rows(dense), matrix)
            none = at < 0
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(at, mask=none), pa.array(sim, mask=none)],
                                             [*kept, "category", "similarity"])

    fields = [points.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField("category", T.LongType()), T.StructField("similarity", T.DoubleType())])
    # a map over whole rows: the other columns pass as they are
    return points.select(*kept).mapInArrow(run, schema).withColumn("similarity", F.round("similarity", places))


def _unit_rows(mat: np.ndarray) -> np.ndarray:
    n = np.sqrt((mat * mat).sum(axis=1, keepdims=True))
    return mat / np.maximum(n, NORM_FLOOR)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return _unit_rows(np.stack(vectors.to_numpy()).astype(np.float64))


def _top_rows(sims: np.ndarray, k: int) -> np.ndarray:
    """Mask of each column's k largest values; of equal values the first rows."""
    m = len(sims)
    if m <= k:
        return sims > -np.inf
    cut = np.partition(sims, m - k, axis=0)[m - k]              # k-th largest per column
    above, level = sims > cut, sims == cut
    return (above | (level & (np.cumsum(level, axis=0) <= k - above.sum(axis=0)))) & (sims > -np.inf)


def _local_top(k: int, key_col: str, names: list[str]):
    """Top k of every query of a block within one shard of points."""
    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if points.empty or queries.empty:
            return pd.DataFrame(columns=names)
        points = points.sort_values(key_col, kind="stable").reset_index(drop=True)
        unit, parts = _matrix(points["_vec"]), []
        for at in range(0, len(queries), MULTIPLIED):
            some = queries.iloc[at:at + MULTIPLIED]
            sims = np.round(unit @ _matrix(some["_vec"]).T, COMPARED)
            sims[np.isnan(sims)] = -np.inf
            row, col = np.nonzero(_top_rows(sims, k))
            part = points.iloc[row].drop(columns="_vec").reset_index(drop=True)
            part["query_id"] = some["query_id"].to_numpy()[col]
            part["cosine"] = sims[row, col]
            parts.append(part)
        return pd.concat(parts, ignore_index=True)[names]
    return run


def _parts(n: Column, size: int) -> Column:
    return F.greatest(F.ceil(n / size), F.lit(1)).cast("int")


def nearest(points: DataFrame, queries: DataFrame, k: int = NEAREST_K, key_col: str = "id",
            vec_col: str = "vector", qvec: str = "vector", group_col: str | None = None,
            extra: list[str] | None = None, places: int = 4, written: bool = False) -> DataFrame:
    """Top-k points per query: ``(query_id, [group], rank, key, *extra, similarity)``.

    ``queries`` needs ``query_id`` and a vector; with ``group_col`` a query is
    only compared with points of its own group (e.g. dataset). Query vectors
    are written once (they are counted and then joined); say ``written`` if they
    come from a written table. Null vectors and null groups take no part.
    """
    extra = list(extra or [])
    group = [group_col] if group_col else []
    qs = queries.select("query_id", *group, F.col(qvec).alias("_vec")).filter(F.col("_vec").isNotNull())
    qs = qs if written else cut_lineage(qs, "queries")
    pts = points.select(key_col, *extra, *group, F.col(vec_col).alias("_vec")).filter(F.col("_vec").isNotNull())
    if group:
        dealt = (qs.groupBy(*group).agg(_parts(F.count(F.lit(1)), QUERY_BLOCK).alias("_blocks"))
                 .join(pts.groupBy(*group).agg(_parts(F.count(F.lit(1)), POINT_SHARD).alias("_shards")), group))
        pts, qs = pts.join(dealt, group), qs.join(dealt, group)
    else:
        sizes = [_parts(F.lit(qs.count()), QUERY_BLOCK).alias("_blocks"), _parts(F.lit(pts.count()), POINT_SHARD).alias("_shards")]
        pts, qs = pts.select("*", *sizes), qs.select("*", *sizes)
    zero = F.lit(0)
    pts = (pts.withColumn("_shard", F.pmod(F.xxhash64(key_col), F.col("_shards")).cast("int"))
           .withColumn("_block", F.explode(F.sequence(zero, F.col("_blocks") - 1))).drop("_blocks", "_shards"))
    qs = (qs.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.col("_blocks")).cast("int"))
          .withColumn("_shard", F.explode(F.sequence(zero, F.col("_shards") - 1))).drop("_blocks", "_shards"))
    schema = T.StructType([points.schema[c] for c in [key_col, *extra, *group]]
                          + [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("cosine", T.DoubleType())])
    meet = [*group, "_block", "_shard"]
    cands = (pts.groupBy(*meet).cogroup(qs.groupBy(*meet))
             .applyInPandas(_local_top(k, key_col, schema.names), schema))
    w = Window.partitionBy("query_id", *group).orderBy(F.desc("cosine"), F.asc(key_col))
    ranked = cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.withColumn("similarity", F.round("cosine", places))
