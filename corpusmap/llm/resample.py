"""Resampling of documents towards a target, by importance weights of hashed
word n-grams.

Features are all runs of one to three consecutive words; a feature's bucket is
the crc32 of its bytes modulo ``BUCKETS``. A bucket's gain is the logarithm of
its share in the target texts over its share in the corpus. A document's weight
is the sum of the gains of its features, and a Gumbel variate from its id added
to the weight makes the highest scores a sample without replacement.

Corpora repeat lines, so the counting works on segments. Newlines separate
words, and cut texts into lines:

* equal lines are brought together (with partial counts, so a line that fills
  a third of the corpus is a few rows when it is shuffled). Each distinct line
  is cut into features once; its buckets are kept with the number of its
  occurrences, by which its counts are multiplied;
* n-grams that cross a newline belong to no line. They are found once for each
  document from the outer words of its lines, and added separately;
* a document's weight is put together the same way: the weights of its lines,
  each computed once, and the gains of its crossing n-grams.

Lines are known by 128-bit hashes where documents refer to them. Lines with at
least one in ``HOT_SHARE`` of all occurrences (at most ``HOT_SHARE`` lines,
whatever the corpus) are looked up in a broadcast table; the others meet the
documents' references in a shuffled join, where no key is frequent.

Only vectors of ``BUCKETS`` counts go to the driver.

Defined results: a null text has no words, a document without words has weight
0; a null id draws as the empty string does, and comes first among ties; rows
of equal id have the same variate, and ties of score and id go to fewer
features; repeated rows count as often as they stand; very long texts and
lines are read whole; an empty table gives an empty result, and without target
texts all target counts are 0. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.llm.common import prepare
from corpusmap.session import cut_lineage, dense_index

BUCKETS = 10_000
#: Documents with fewer words are not drawn.
MIN_WORDS = 20
#: A line with at least 1 / HOT_SHARE of all occurrences is looked up by broadcast.
HOT_SHARE = 10_000

#: ASCII letters in lower case, digits and bytes over 127 are kept; the rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Lines without any of these hold no word.
WORD_CHAR = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words_of(line: bytes) -> list[bytes]:
    return line.translate(_FOLD).split()


def feature_buckets(words: list[bytes], segment: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of one, two and three of the words: the buckets, and the
    positions of the runs' first words. A run is given if its first and last
    word have the same ``segment``."""
    spaced = [b" " + w for w in words]
    crc = list(map(zlib.crc32, words))
    for n in (1, 2, 3):
        if n > 1:
            crc = list(map(zlib.crc32, spaced[n - 1:], crc))
        if not crc:
            return
        inside = np.flatnonzero(segment[:len(crc)] == segment[n - 1:])
        yield np.fromiter(crc, np.uint32, len(crc))[inside] % BUCKETS, inside


def buckets_of_lines(lines: list[bytes]) -> list[np.ndarray]:
    """The buckets of all features of each line."""
    cut = [words_of(x) for x in lines]
    segment = np.repeat(np.arange(len(cut)), [len(w) for w in cut])
    values, owners = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    for buckets, first in feature_buckets([w for words in cut for w in words], segment):
        values.append(buckets)
        owners.append(segment[first])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=len(cut)))
    return np.split(np.concatenate(values)[order].astype("<u2"), ends[:-1])


def crossing_buckets(lines: list[list[bytes]]) -> np.ndarray:
    """The buckets of the n-grams that cross a newline, from the lines' words.

    Of a line only its first two and last two words can be in one. Words between
    them are left out, and what spans such a gap stands in one line."""
    words: list[bytes] = []
    owner: list[int] = []
    for k, line in enumerate(lines):
        outer = line if len(line) <= 4 else line[:2] + line[-2:]
        words += outer
        owner += [k] * len(outer)
    if not owner or owner[0] == owner[-1]:
        return np.empty(0, "<u2")
    line = np.asarray(owner)
    # words with a gap between them are of one line, so their runs never cross
    found = []
    crc, spaced = list(map(zlib.crc32, words)), [b" " + w for w in words]
    gap = np.zeros(len(words), bool)
    starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    for at in starts:
        if len(lines[owner[at]]) > 4:
            gap[at + 1] = True           # between the second and the last but one word
    for n in (2, 3):
        crc = list(map(zlib.crc32, spaced[n - 1:], crc))
        if not crc:
            break
        whole = line[:len(crc)] != line[n - 1:]
        for j in range(n - 1):
            whole &= ~gap[j:j + len(crc)]
        found.append(np.fromiter(crc, np.uint32, len(crc))[whole] % BUCKETS)
    return np.concatenate(found).astype("<u2") if found else np.empty(0, "<u2")


def line_key(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def distinct_lines(docs: DataFrame, text: Column) -> DataFrame:
    """``line``, ``occurrences``, ``buckets`` of every distinct line that has a word."""
    lines = (docs.select(F.explode(F.split(text, "\n", -1)).alias("line")).filter(F.col("line").rlike(WORD_CHAR))
             .groupBy("line").agg(F.count(F.lit(1)).alias("occurrences")))

    def run(batches):
        for pdf in batches:
            raw = [x.encode() for x in pdf["line"]]
            yield pd.DataFrame({"line": [line_key(x) for x in raw], "occurrences": pdf["occurrences"],
                                "buckets": [b.tobytes() for b in buckets_of_lines(raw)]})

    return lines.mapInPandas(run, "line binary, occurrences long, buckets binary")


def outlines(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """Of every row: ``row`` (its number), ``doc_id``, ``n_words``, the keys of
    its ``lines`` that have a word, and the ``crossing`` buckets."""
    def run(batches):
        for pdf in batches:
            rows = []
            for x in pdf["text"]:
                raw = x.encode().split(b"\n")
                cut = [words_of(y) for y in raw]
                keep = [k for k, w in enumerate(cut) if w]
                rows.append((sum(map(len, cut)), [line_key(raw[k]) for k in keep], crossing_buckets([cut[k] for k in keep]).tobytes()))
            words, keys, crossing = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"], "n_words": list(words), "lines": list(keys),
                                "crossing": list(crossing)})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), doc_id.cast("string").alias("doc_id"), text.alias("text"))
    # ids pass as text: pandas has no null integers, and doubles do not hold all of them
    return (rows.mapInPandas(run, "row long, doc_id string, n_words long, lines array<binary>, crossing binary")
            .withColumn("doc_id", F.col("doc_id").cast("long")))


def bucket_counts(lines: DataFrame, outline: DataFrame) -> np.ndarray:
    """Counts by bucket of all features: those of each distinct line times its
    occurrences, and the crossing ones."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            parts = [np.frombuffer(b, "<u2") for b in pdf["buckets"]]
            times = np.repeat(pdf["occurrences"].to_numpy(np.int64), [len(p) for p in parts])
            if len(times):               # sums of a batch are far below 2^53, so exact as doubles
                total += np.bincount(np.concatenate(parts), weights=times, minlength=BUCKETS).astype(np.int64)
        full = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": full, "n": total[full]})

    both = (lines.select("buckets", "occurrences")
            .unionByName(outline.select(F.col("crossing").alias("buckets"), F.lit(1).cast("long").alias("occurrences"))))
    counts = np.zeros(BUCKETS, np.int64)
    for r in both.mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def gain_sum(gains: np.ndarray):
    """A function column: the sum of the gains of a row's buckets."""
    @F.pandas_udf("long")
    def run(buckets: pd.Series) -> pd.Series:
        return pd.Series([int(gains[np.frombuffer(b, "<u2")].sum()) for b in buckets], dtype="int64")
    return run


def texts_of(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def weights_of_rows(lines: DataFrame, outline: DataFrame, gains: np.ndarray) -> DataFrame:
    """``row``, ``doc_id``, ``n_words`` and ``weight`` of every outline."""
    total = gain_sum(gains)
    weighed = lines.select("line", "occurrences", total("buckets").alias("weight"))
    everything = lines.agg(F.sum("occurrences")).first()[0] or 0
    hot = F.col("occurrences") * HOT_SHARE >= F.lit(everything)
    frequent = F.broadcast(weighed.filter(hot).select("line", "weight"))
    found = outline.select("row", F.explode("lines").alias("line"))
    parts = [found.join(frequent, "line").select("row", "weight"),
             found.join(frequent, "line", "left_anti").join(weighed.filter(~hot), "line").select("row", "weight")]
    rows = outline.select("row", "doc_id", "n_words", total("crossing").alias("weight"))
    for p in parts:
        rows = rows.unionByName(p.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_words"), "weight"))
    return rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("weight").alias("weight"))


def variate(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel) from the first 32 bits of a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, id_col: str = "doc_id",
             text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``
    (null: not drawn) of every document; ``percent`` of those with ``MIN_WORDS``
    words are drawn."""
    prepare(docs.sparkSession)
    counts, kept = [], None
    for df, ident, col in ((target, F.lit(0).cast("long"), target_col), (docs, docs[id_col].cast("long"), text_col)):
        lines = cut_lineage(distinct_lines(df, texts_of(df, col)), "resample-lines")
        outline = cut_lineage(outlines(df, ident, texts_of(df, col)), "resample-outlines")
        counts.append(bucket_counts(lines, outline))
        kept = (lines, outline)
    rows = weights_of_rows(*kept, gains_of(counts[1], counts[0]))
    w = F.col("n_words")
    rows = rows.select("doc_id", "n_words", (w + F.greatest(w - 1, F.lit(0)) + F.greatest(w - 2, F.lit(0))).alias("n_features"),
                       "weight", (F.col("weight") + variate(F.col("doc_id"), seed)).alias("score"),
                       (w >= MIN_WORDS).alias("eligible"))
    rows = cut_lineage(rows, "resample-scores")
    drawn = rows.filter("eligible").count() * percent // 100
    rows = rows.withColumn("down", -F.col("score"))
    ranked = dense_index(rows, ["down", "doc_id", "n_features"], ["eligible"], name="place", whole_rows=True)
    rank = F.when(F.col("eligible") & (F.col("place") < drawn), F.col("place") + 1)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def drawn_texts(docs: DataFrame, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The drawn documents themselves with ``rank``, for tables whose ids are unique."""
    drawn = ranked.filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn_id"), F.col("rank").alias("_drawn_rank"))
    return docs.join(drawn, docs[id_col].cast("long") == F.col("_drawn_id")).withColumnRenamed("_drawn_rank", "rank").drop("_drawn_id")
