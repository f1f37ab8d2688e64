"""Text -> vector jobs (EMB-2, EMB-3, EMB-5, AGG-8, VEC-5).

Two encoders ship:

* ``hashing_vectors`` -- a stand-in with no semantic quality claim: the words
  ``[a-z]+`` of the lower-cased text are counted into ``dim`` buckets (bucket =
  first four hex digits of ``md5(word)`` modulo ``dim``) and the count vector is
  L2-normalised. Fully native (explode + two small aggregations), and writable
  in plain SQL, so its output is value-checked.
* ``encode_with`` -- the plug for a real encoder: any object with
  ``encode(list[str]) -> ndarray[n, d]``. It is built once per Python worker and
  fed Arrow batches through ``mapInPandas``.

``bag_of_tokens`` is the non-attention part of a transformer encoder as joins
and aggregates: token ids -> token-table lookup scaled by sqrt(hidden) ->
mean pooling per document -> dense projection -> L2 normalisation.
"""

from __future__ import annotations

import math
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmap.functions.text import truncate_bytes
from corpusmap.functions.vectors import is_valid, l2_normalize
from corpusmap.session import spread_small_input

HASH_DIM = 64
WORD_PATTERN = "[a-z]+"
WIDE = 64                   # buckets counted as columns; more of them as rows


def hash_bucket(word: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 4), 16, 10).cast("long"), F.lit(dim)).cast("int")


def dense_from_counts(counts: DataFrame, key: str, dim: int, out: str = "vector") -> DataFrame:
    """``(key, bucket, cnt)`` -> ``(key, array<double>[dim])`` (cells <= dim per key)."""
    m = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "cnt"))).alias("_m"))
    return m.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                     lambda i: F.coalesce(F.col("_m")[i], F.lit(0)).cast("double")).alias(out))


def bucketed_words(df: DataFrame, key: str, text_col: str, dim: int) -> DataFrame:
    """``(key, bucket)`` of every word of the whole text."""
    src = spread_small_input(df.select(key, text_col))
    words = src.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text_col)),
                                                           F.lit(WORD_PATTERN), 0)).alias("w"))
    return words.select(key, hash_bucket(F.col("w"), dim).alias("bucket"))


def word_buckets(df: DataFrame, key: str, text_col: str, dim: int = HASH_DIM) -> DataFrame:
    """``(key, bucket, cnt)``: per-document bucket counts over the whole text
    (partial-aggregated map side, so at most dim cells per document leave a
    task)."""
    return bucketed_words(df, key, text_col, dim).groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("cnt"))


def hashing_vectors(df: DataFrame, key: str, text_col: str, dim: int = HASH_DIM,
                    out: str = "vector") -> DataFrame:
    """EMB-2 with the hashing encoder: ``(key, vector array<float>)``; texts
    without a word produce no row (FIL-8: nothing to embed)."""
    if dim <= WIDE:         # one row a key, counted in the map tasks, in one shuffle
        counts = [F.count_if(F.col("bucket") == i).cast("double").alias(f"_{i}") for i in range(dim)]
        dense = (bucketed_words(df, key, text_col, dim).groupBy(key).agg(*counts)
                 .select(key, F.array(*[f"_{i}" for i in range(dim)]).alias("_raw")))
    else:
        dense = dense_from_counts(word_buckets(df, key, text_col, dim), key, dim, "_raw")
    return dense.select(key, F.transform(l2_normalize("_raw"), lambda x: x.cast("float")).alias(out))


def embed_labels(labels: DataFrame, dim: int = HASH_DIM, embed=None) -> DataFrame:
    """EMB-5: the category label strings ``(idx, label)`` embedded once with the
    encoder of the points (``embed(df, key, text_col)``) and L2-normalised:
    ``(idx, label, vector)``. A label that gives the encoder nothing is a zero
    vector, which no point is close to; equal labels have equal vectors."""
    vecs = embed(labels, "idx", "label") if embed else hashing_vectors(labels, "idx", "label", dim)
    zero = F.array_repeat(F.lit(0.0), dim)
    return (labels.select("idx", "label").join(vecs.select("idx", l2_normalize("vector").alias("vector")), "idx", "left")
            .withColumn("vector", F.coalesce("vector", zero)))


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Python twin of ``hashing_vectors`` (for the Arrow path and for tests)."""

    def __init__(self, dim: int = HASH_DIM):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        import hashlib
        import re
        pat = re.compile(WORD_PATTERN)
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        for r, t in enumerate(texts):
            for w in pat.findall((t or "").lower()):
                out[r, int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % self.dim] += 1.0
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.maximum(n, 1e-12)).astype(np.float32)


def encode_with(df: DataFrame, key: str, text_col: str, encoder_factory, dim: int,
                out: str = "vector", max_bytes: int | None = None) -> DataFrame:
    """EMB-2 with a pluggable encoder: whole texts (or the first ``max_bytes``
    of a model with an input window), empty text skipped, encoded in Arrow
    batches, only valid vectors kept (VEC-1). If a batch fails, its texts are
    encoded one by one, so that one bad text leaves only itself pending: its
    vector is NULL and ``error`` says why."""
    text = truncate_bytes(text_col, max_bytes) if max_bytes else F.col(text_col)
    src = (spread_small_input(df.select(key, text_col)).select(key, text.alias("_t"))
           .filter(F.col("_t").isNotNull() & (F.length("_t") > 0)))
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField(out, T.ArrayType(T.FloatType())),
                           T.StructField("error", T.StringType())])

    def run(batches):
        enc = encoder_factory()
        for pdf in batches:
            texts = pdf["_t"].tolist()
            try:
                col, errors = list(np.asarray(enc.encode(texts), dtype=np.float32)), [None] * len(texts)
            except Exception:  # some text of the batch: find out which
                col, errors = [], []
                for t in texts:
                    try:
                        col.append(np.asarray(enc.encode([t]), dtype=np.float32)[0])
                        errors.append(None)
                    except Exception as e:
                        col.append(None)
                        errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pd.DataFrame({key: pdf[key].to_numpy(), out: col, "error": errors})

    enc = src.mapInPandas(run, schema=schema)
    valid = is_valid(out, dim)
    return (enc.withColumn("error", F.when(F.col("error").isNotNull(), F.col("error")).when(~valid, "invalid vector"))
            .withColumn(out, F.when(valid, F.col(out))))


# ------------------------------------------------------------ bag of tokens

# A token table is part of the model: its size is fixed (vocabulary x hidden),
# known before the job starts. Up to this many cells it is broadcast once and
# looked up per document in Arrow batches; beyond it the native join is used.
MAX_BROADCAST_TOKEN_CELLS = 64 * 1024 * 1024    # 256 MB of float32
MAX_BROADCAST_TOKEN_ROWS = 1 << 20


def pool_token_vectors(doc_tokens: DataFrame, token_table: DataFrame, key: str, hidden: int,
                       scale: bool = True, method: str = "auto") -> DataFrame:
    """AGG-8: mean over the (scaled) token vectors of each document.

    ``doc_tokens(key, ids array<int>)``, ``token_table(token_id, vector)``;
    token ids missing from the table are skipped. Two plans:

    * ``broadcast`` (default while the table is within the size bound): the
      table goes to every worker once; each Arrow batch of documents gathers
      ``T[ids]`` and averages in numpy. No shuffle at all -- a document's ids
      never leave its task.
    * ``join``: occurrences are counted per (document, token) (partial
      aggregate, so a very common token does not multiply the join), joined to
      the table by id (AQE splits skewed partitions), and averaged with the
      counts as weights per (document, dimension).
    """
    factor = math.sqrt(hidden) if scale else 1.0
    if method == "auto":
        n = token_table.limit(MAX_BROADCAST_TOKEN_ROWS + 1).count()
        method = "broadcast" if n <= MAX_BROADCAST_TOKEN_ROWS and n * hidden <= MAX_BROADCAST_TOKEN_CELLS \
            else "join"
    if method == "broadcast":
        return _pool_broadcast(doc_tokens, token_table, key, factor)
    toks = (doc_tokens.select(key, F.explode("ids").alias("token_id"))
            .groupBy(key, "token_id").agg(F.count(F.lit(1)).alias("cnt")))
    j = toks.join(token_table.select("token_id", "vector"), "token_id")
    cells = (j.select(key, "cnt", F.posexplode("vector").alias("pos", "val"))
             .groupBy(key, "pos")
             .agg((F.sum(F.col("cnt") * F.col("val").cast("double") * factor) / F.sum("cnt")).alias("m")))
    return (cells.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_c"))
            .select(key, F.transform("_c", lambda s: s["m"]).alias("pooled")))


def _pool_broadcast(doc_tokens: DataFrame, token_table: DataFrame, key: str, factor: float) -> DataFrame:
    got = token_table.select("token_id", "vector").orderBy("token_id").limit(MAX_BROADCAST_TOKEN_ROWS + 1).toArrow()
    if got.num_rows > MAX_BROADCAST_TOKEN_ROWS:
        raise ValueError("token table: too many rows to broadcast")
    ids = got["token_id"].to_numpy().astype(np.int64)                      # sorted token ids
    flat = got["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    table = flat.astype(np.float32).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0), np.float32)
    bc = doc_tokens.sparkSession.sparkContext.broadcast((ids, table))
    schema = T.StructType([doc_tokens.schema[key], T.StructField("pooled", T.ArrayType(T.DoubleType(), False))])

    def run(batches):
        known, tab = bc.value
        for pdf in batches:
            keys, out = [], []
            for k, doc_ids in zip(pdf[key].to_numpy(), pdf["ids"]):
                if doc_ids is None or len(known) == 0:
                    continue
                doc_ids = np.asarray(doc_ids, dtype=np.int64)
                pos = np.searchsorted(known, doc_ids)
                pos = np.minimum(pos, len(known) - 1)
                pos = pos[known[pos] == doc_ids]                                # ids missing from the table are skipped
                if len(pos) == 0:
                    continue
                keys.append(k)
                out.append(tab[pos].astype(np.float64).mean(axis=0) * factor)
            if keys:
                yield pd.DataFrame({key: keys, "pooled": out})

    return doc_tokens.select(key, "ids").mapInPandas(run, schema=schema)


def rule_weights(rows: int, cols: int) -> list[list[float]]:
    """A fixed dense layer for the stand-in encoder: ``((7r + 3c) mod 11 - 5) / 10``."""
    return [[((7 * r + 3 * c) % 11 - 5) / 10.0 for c in range(cols)] for r in range(rows)]


def bag_of_tokens(doc_tokens: DataFrame, token_table: DataFrame, key: str, hidden: int,
                  weights: list[list[float]], bias: list[float] | None = None) -> DataFrame:
    """EMB-3: lookup + sqrt(hidden) scale -> mean pool (AGG-8) -> dense (VEC-5)
    -> L2 normalise (VEC-2). ``(key, vector array<float>)``."""
    pooled = pool_token_vectors(doc_tokens, token_table, key, hidden)
    dense = project_dense(pooled, "pooled", weights, bias, out="_d")
    return dense.select(key, F.transform(l2_normalize("_d"), lambda x: x.cast("float")).alias("vector"))


def dense_matrix_literal(weights: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in weights])


def project_dense(df: DataFrame, vec_col: str, weights: list[list[float]], bias: list[float] | None = None,
                  out: str = "projected") -> DataFrame:
    """VEC-5: ``W v + b`` with a small, fixed weight matrix (rows = outputs)."""
    from corpusmap.functions.vectors import dot
    w = dense_matrix_literal(weights)
    b = F.array(*[F.lit(float(x)) for x in (bias or [0.0] * len(weights))])
    return df.withColumn(out, F.zip_with(F.transform(w, lambda row: dot(vec_col, row)), b,
                                         lambda x, y: x + y))


def token_table_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """Stand-in token table: token id = ``vec_id``, vector = ``embedding``."""
    return embeddings.select(F.col("vec_id").cast("int").alias("token_id"), F.col("embedding").alias("vector"))


