"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of at most ``chunk`` characters is encoded where it is read. A longer
one is cut into chunks that overlap by ``overlap`` characters; the chunks are
pre-tokenised in parallel, each from its own start. Where two neighbours put a
pre-token boundary at the same place, everything after it agrees (a match of
the pattern depends only on the text from its own start), so the text is cut
there and the pieces are encoded in parallel. A chunk's last ``GUARD``
characters are not trusted: a pre-token that ends there might have gone on.
Texts with a seam at which the neighbours never agree (one pre-token longer
than the overlap) are encoded in one piece. Decoding concatenates the byte
strings of the ids.

Nulls and empty texts give no ids. Repeated rows give equal rows. One row out
per row in, so an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusmap.llm.common import id_text, prepare

CHUNK = 1 << 16
OVERLAP = 1 << 10
#: Longest look-ahead past the start of a match that can change it.
GUARD = 3


@lru_cache(maxsize=4)
def byte_ranks(path: str) -> dict[bytes, int]:
    """``token bytes -> id`` of a rank file (base64 token, space, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    import tiktoken
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=byte_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """Token bytes by id."""
    ranks = byte_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def encode_one(text: str, path: str, pattern: str) -> bytes:
    """Ids of one text or piece as little-endian unsigned 32-bit integers."""
    return np.asarray(encoder(path, pattern).encode_ordinary(text), dtype="<u4").tobytes()


def boundaries(chunk: str, pattern: str, base: int) -> np.ndarray:
    """Ends of the pre-tokens of ``chunk`` as positions in the whole text."""
    return np.fromiter((m.end() + base for m in regex.finditer(pattern, chunk)), dtype=np.int64)


def _encode_column(path: str, pattern: str):
    @pandas_udf("binary")
    def encode(text: pd.Series) -> pd.Series:
        return text.map(lambda t: encode_one(t, path, pattern))
    return encode


def _chunks(texts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, text) -> (key, k, chunk, head, tail): pre-token boundaries of each
    chunk in the part it shares with the one before and the one after."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, text in zip(b["key"], b["text"]):
                starts = range(0, len(text), chunk)
                yield pd.DataFrame({"key": [key] * len(starts), "k": list(starts),
                                    "chunk": [text[s:s + chunk + overlap] for s in starts]})

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            heads, tails = [], []
            for start, text in zip(b["k"], b["chunk"]):
                cuts = boundaries(text, pattern, start)
                cuts = cuts[cuts <= start + len(text) - GUARD]
                heads.append(cuts[cuts <= start + overlap])
                tails.append(cuts[cuts > start + chunk])
            yield b.assign(head=heads, tail=tails)

    cut = texts.mapInPandas(split, "key binary, k long, chunk string").repartition("key", "k")
    return cut.mapInPandas(mark, "key binary, k long, chunk string, head array<long>, tail array<long>")


def _encode_long(long_docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    keyed = long_docs.withColumn("key", F.unhex(F.sha2("text", 256)))
    texts = keyed.select("key", "text").dropDuplicates(["key"])
    w = Window.partitionBy("key").orderBy("k")
    whole = Window.partitionBy("key")
    stitched = (_chunks(texts, pattern, chunk, overlap)
                .withColumn("next_head", F.lead("head").over(w))
                .withColumn("seam", F.array_min(F.array_intersect("tail", "next_head")))
                .withColumn("start", F.coalesce(F.lag("seam").over(w), F.lit(0).cast("long")))
                .withColumn("agree", F.bool_and(F.col("next_head").isNull() | F.col("seam").isNotNull()).over(whole)))
    lo = (F.col("start") - F.col("k")).cast("int")
    size = F.coalesce(F.col("seam") - F.col("start"), F.length("chunk").cast("long")).cast("int")
    encode = _encode_column(path, pattern)
    # An agreeing chunk gives a piece of its own; the others of a text make one piece.
    pieces = (stitched
              .select("key", F.when(F.col("agree"), F.col("k")).otherwise(F.lit(0)).alias("piece"),
                      F.struct("k", F.when(F.col("agree"), F.col("chunk").substr(lo + 1, size))
                               .otherwise(F.substring("chunk", 1, chunk)).alias("part")).alias("part"))
              .groupBy("key", "piece").agg(F.sort_array(F.collect_list("part")).alias("parts"))
              .select("key", "piece", encode(F.array_join(F.col("parts.part"), "")).alias("ids")))

    @pandas_udf("binary")
    def joined(parts: pd.Series) -> pd.Series:
        return parts.map(b"".join)

    ids = (pieces.groupBy("key")
           .agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
           .select("key", joined(F.col("parts.ids")).alias("ids")))
    return keyed.select("doc_id", "key").join(ids, "key").select("doc_id", "ids")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id`` and ``ids`` (binary, little-endian unsigned 32-bit) of every row."""
    if not 2 * GUARD < overlap <= chunk:
        raise ValueError("overlap must be larger than the look-ahead and at most one chunk")
    prepare(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)
    is_long = F.length("text") > chunk
    short = rows.filter(~is_long).select("doc_id", _encode_column(path, pattern)("text").alias("ids"))
    return short.unionByName(_encode_long(rows.filter(is_long), path, pattern, chunk, overlap))


def decode(ids, path: str):
    """Column of the bytes that a column of ids (as ``encode`` gives) stands for."""
    @pandas_udf("binary")
    def to_bytes(col: pd.Series) -> pd.Series:
        table = token_bytes(path)
        return col.map(lambda b: b"".join(map(table.__getitem__, np.frombuffer(b, dtype="<u4").tolist())))
    return to_bytes(ids)


def token_count(ids):
    """Column of the number of ids."""
    return (F.octet_length(ids) / 4).cast("long")
