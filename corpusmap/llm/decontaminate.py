"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: numbers, names (capitalised words inside a
sentence) and units (unit words after a number) are replaced by typed
placeholders, other words are lower-cased, punctuation goes. Windows of
``width`` template tokens with enough literal words are hashed; document
windows are joined to benchmark windows by hash. Along one alignment of a
document and an item the slots must be consistent: one value of the item always
stands for one value of the document, so that questions with other parameters
pass and chance hits do not add up. With ``verbatim`` windows of lower-cased
tokens without placeholders, whatever they are, go through the same join, so
that exact copies in any case pass as well. A document is contaminated by an
item of which consistent windows of one sort cover ``coverage`` or more. With
``excerpts`` a run of ``RUN`` tokens without placeholders is enough as well, and
a slot that is not consistent takes only the windows that hold it from its
alignment, not the whole alignment.

A document window is only sent to the join if its bit is set in a bit map of
fixed size (2 MB whatever the benchmark) of the benchmark's hashes; the join
decides exactly. Items shorter than a window are one window of their length.
Without ``verbatim``, items without a window of enough literal words match
nothing. Null and empty
texts match nothing; rows that repeat with the same id and text count as one. Very
long texts are read whole; a document that holds several items has a row for
each, so there are no ties; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.llm.common import MIX1, id_text, mix, prepare
from corpusmap.session import cut_lineage

WIDTH = 8
#: Share of a window's tokens that must be literal words.
LITERAL_SHARE = 0.5
COVERAGE = 0.5
#: Tokens of an item in a row that are an excerpt.
RUN = 13
MAP_BITS = 1 << 24
MEMO_LIMIT = 500_000

#: Unit words; after a number they are a placeholder.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams ounce ounces pound pounds ton tons "
    "ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days "
    "week weeks month months year years percent dollar dollars euro euros cent cents degree degrees kmh mph".split())

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,]\d+)*|[.!?\n]+")
LITERAL, CAPITAL, NUMBER, END, UNIT = range(5)
KIND = np.uint64(7)
#: Start of the hash of a window without placeholders.
VERBATIM = 1 << 32
NAME_CODE, NUMBER_CODE, UNIT_CODE = (np.uint64(8 * (crc32(w) + 1)) for w in (b"<name>", b"<number>", b"<unit>"))
SCHEMA = "hash long, doc_id long, text_key long, pos int, slots array<string>"


class Codes(dict):
    """Memo ``token -> hash of its lower-case form with its kind in the low bits``."""

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        low, first = token.lower(), token[0]
        if first in ".!?\n":
            kind = END
        elif first.isdigit():
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        else:
            kind = CAPITAL if first.isupper() and not (len(token) > 1 and token.isupper()) else LITERAL
        c = self[token] = (xxhash.xxh3_64_intdigest(low.encode()) & ~7) | kind
        return c


class Batch:
    """Template tokens of a batch of texts."""

    def __init__(self, texts: list[str], codes: Codes):
        tokens = [TOKEN.findall(t) for t in texts]
        self.tokens = [w for ts in tokens for w in ts]
        doc = np.repeat(np.arange(len(texts)), [len(ts) for ts in tokens])
        code = np.fromiter(map(codes.__getitem__, self.tokens), dtype=np.uint64, count=len(self.tokens))
        kind = (code & KIND).astype(np.int8)
        before = np.concatenate([[END], kind[:-1]]) if len(kind) else kind
        before = np.where(np.diff(doc, prepend=-1) != 0, END, before)
        plain = template = code & ~KIND
        slot = ((kind == CAPITAL) & (before != END)) | (kind == NUMBER) | ((kind == UNIT) & (before == NUMBER))
        template = np.where(slot, np.where(kind == CAPITAL, NAME_CODE, np.where(kind == NUMBER, NUMBER_CODE, UNIT_CODE)),
                            template)
        self.at = np.flatnonzero(kind != END)                # token number of each template token
        self.doc, self.template, self.slot = doc[self.at], template[self.at], slot[self.at]
        self.plain = plain[self.at]
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))
        self.size = np.bincount(self.doc, minlength=len(texts)) if len(self.doc) else np.zeros(len(texts), int)

    def windows(self, width: int, verbatim: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the windows with enough literal words, or of all
        windows without placeholders."""
        n = len(self.template) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = self.doc[width - 1:] == self.doc[:n]
        if not verbatim:
            slots = np.concatenate([[0], np.cumsum(self.slot)])
            inside &= slots[width:] - slots[:n] <= width * (1 - LITERAL_SHARE)
        start = np.flatnonzero(inside)
        h = np.full(len(start), width + VERBATIM * verbatim, dtype=np.uint64)
        of = self.plain if verbatim else self.template
        for j in range(width):
            h = h * MIX1 + of[start + j]
        return start, mix(h)

    def slots(self, start: int, width: int) -> list[str]:
        return [self.tokens[self.at[i]].lower() for i in range(start, start + width) if self.slot[i]]


def item_windows(benchmark: DataFrame, width: int, id_col: str, text_col: str, sorts: list[bool]) -> DataFrame:
    """(hash, item_id, item_pos, item_slots, n_windows, width, verbatim) of every item."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        for b in batches:
            for item, text in zip(b["doc_id"], b["text"]):
                t = Batch([text], codes)
                w = min(width, len(t.template))
                if w == 0:
                    continue
                for verbatim in sorts:
                    start, h = t.windows(w, verbatim)
                    if not len(start):
                        continue
                    yield pd.DataFrame({"hash": h.astype(np.int64), "item_id": item, "item_pos": start.astype(np.int32),
                                        "item_slots": [[] if verbatim else t.slots(int(s), w) for s in start],
                                        "n_windows": len(start), "width": w, "verbatim": verbatim})
    rows = id_text(benchmark, id_col, text_col).filter(F.col("doc_id").isNotNull()).distinct()
    return rows.mapInPandas(cut, "hash long, item_id long, item_pos int, item_slots array<string>, "
                                 "n_windows int, width int, verbatim boolean")


def bit_map(items: DataFrame) -> np.ndarray:
    """Bit map of the hashes: at most MAP_BITS / 64 rows reach the driver."""
    bit = F.pmod("hash", F.lit(MAP_BITS))
    words = (items.select((bit / 64).cast("int").alias("word"), F.pmod(bit, F.lit(64)).cast("int").alias("bit"))
             .distinct().groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect())
    out = np.zeros(MAP_BITS // 64, dtype=np.int64)
    for r in words:
        out[r.word] = r.bits
    return out.view(np.uint64)


def document_windows(rows: DataFrame, widths: list[int], bits, sorts: list[bool]) -> DataFrame:
    """Windows of the documents whose bit is set. ``rows``: doc_id, text_key, text."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, words = Codes(), bits.value
        for b in batches:
            t = Batch(b["text"].tolist(), codes)
            ids, keys = b["doc_id"].to_numpy(dtype=object, na_value=None), b["text_key"].to_numpy()
            for w, verbatim in product(widths, sorts):
                start, h = t.windows(w, verbatim)
                at = h % np.uint64(MAP_BITS)
                hit = (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                start, h = start[hit], h[hit]
                if not len(start):
                    continue
                doc = t.doc[start]
                yield pd.DataFrame({"hash": h.astype(np.int64), "doc_id": pd.array(ids[doc], dtype="Int64"),
                                    "text_key": keys[doc], "pos": (start - t.first[doc]).astype(np.int32),
                                    "slots": [[] if verbatim else t.slots(int(s), w) for s in start]})
    return rows.mapInPandas(cut, SCHEMA)


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH,
                  coverage: float = COVERAGE, verbatim: bool = False, excerpts: bool = False) -> DataFrame:
    """(doc_id, text_key, item_id, coverage, n_matched, first_pos, exact) of
    every contaminated document and the item found in it; ``text_key`` is
    xxhash64 of the text, and tells rows with the same id apart. ``exact`` is up
    to case. ``excerpts`` needs ``verbatim``. Figures are those of the template windows if they are enough."""
    spark = docs.sparkSession
    prepare(spark)
    sorts = [False, True] if verbatim else [False]
    items = cut_lineage(item_windows(benchmark, width, item_id_col, item_text_col, sorts), "benchmark-windows")
    widths = sorted(r.width for r in items.select("width").distinct().collect())    # at most ``width`` of them
    bits = spark.sparkContext.broadcast(bit_map(items))
    hits = document_windows(keyed_rows(docs, id_col, text_col), widths, bits, sorts)
    pairs = F.expr("transform(arrays_zip(item_slots, slots), s -> struct(s.item_slots AS a, s.slots AS b))")
    aligned = (hits.join(items, "hash")
               .groupBy("doc_id", "text_key", "item_id", "verbatim", (F.col("pos") - F.col("item_pos")).alias("shift"))
               .agg(F.collect_set(F.struct("item_pos", "pos", pairs.alias("pairs"))).alias("windows"),
                    F.max("n_windows").alias("n_windows"), F.max("width").alias("width"))
               .withColumn("slots", F.expr("array_distinct(flatten(windows.pairs))")))
    consistent = F.size("slots") == F.size(F.array_distinct(F.col("slots.a")))
    if excerpts:
        several = F.expr("filter(array_distinct(slots.a), x -> size(filter(slots, s -> s.a = x)) > 1)")
        kept = F.expr("filter(windows, w -> NOT arrays_overlap(w.pairs.a, several))")
        aligned = (aligned.withColumn("several", several).withColumn("consistent", consistent)
                   .withColumn("windows", F.when(consistent, F.col("windows")).otherwise(kept))
                   .filter(F.size("windows") > 0).withColumn("slots", F.expr("array_distinct(flatten(windows.pairs))")))
    else:
        aligned = aligned.filter(consistent).withColumn("consistent", F.lit(True))
    same = F.col("consistent") & F.forall("slots", lambda s: s["a"] == s["b"])
    aligned = aligned.withColumn("places", F.array_sort(F.array_distinct("windows.item_pos")))
    # Windows in a row: (last place, length of the run that ends there, longest run).
    run = F.aggregate("places", F.expr("named_struct('last', -2, 'now', 0, 'most', 0)"), lambda acc, x: F.struct(
        x.alias("last"), F.when(x == acc["last"] + 1, acc["now"] + 1).otherwise(1).alias("now"),
        F.greatest(acc["most"], F.when(x == acc["last"] + 1, acc["now"] + 1).otherwise(1)).alias("most")),
        lambda acc: acc["most"])
    excerpt = F.lit(excerpts) & F.col("verbatim") & (F.col("run") + F.col("width") - 1 >= RUN)
    found = (aligned.withColumn("run", run)
             .groupBy("doc_id", "text_key", "item_id", "verbatim")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_matched"),
                  F.max("n_windows").alias("n_windows"), F.min(F.array_min("windows.pos")).cast("long").alias("first_pos"),
                  F.bool_and(same).alias("exact"), F.bool_or(excerpt).alias("excerpt"))
             .withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
             .filter((F.col("coverage") >= coverage) | F.col("excerpt")))
    best = F.min(F.struct("verbatim", "coverage", "n_matched", "first_pos", "exact")).alias("best")
    return (found.groupBy("doc_id", "text_key", "item_id").agg(best)
            .select("doc_id", "text_key", "item_id", "best.coverage", "best.n_matched", "best.first_pos", "best.exact"))
