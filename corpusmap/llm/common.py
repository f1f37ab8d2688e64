"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmap.session import ensure_checkpoint_dir, ship_package

#: Odd 64-bit multipliers used to mix hashes.
MIX1 = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)

#: Bounds of one Arrow batch handed to a Python worker. Texts can be long, and
#: a worker holds a few copies of its batch.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors, and Arrow batches small."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    for key, most, unit in (("maxRecordsPerBatch", BATCH_ROWS, ""), ("maxBytesPerBatch", BATCH_BYTES, "b")):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, f"{most}{unit}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, as ``doc_id`` and ``text`` (a null
    text is empty). Other columns, whatever their names, are not touched."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def remainder(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as 0, which
    is always the held-out side."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % mod, F.lit(0).cast("long"))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (wraps around, as intended)."""
    h = np.asarray(h, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(32))) * MIX1
    h = (h ^ (h >> np.uint64(29))) * MIX2
    return h ^ (h >> np.uint64(32))


class WordHash(dict):
    """Memo ``bytes word -> 64-bit hash`` of one Python worker. The memo only
    saves time; it is emptied when it has ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
