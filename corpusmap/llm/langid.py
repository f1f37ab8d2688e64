"""Language identification with character language models.

One interpolated Kneser-Ney model of character n-grams per language: the
highest order uses counts, the lower ones the number of distinct characters
seen before, every order gives up an absolute discount to the one below and the
lowest to a uniform distribution. A model is, per order, a sorted array of
64-bit n-gram hashes with the log probability of each, and a sorted array of
context hashes with the log weight of backing off. A text goes to the language
of lowest cross-entropy per character.

Calibration, on training documents that the counts did not see: a factor turns
differences of cross-entropy into a probability (least log loss), and a text
whose best cross-entropy lies above the ``REJECT_AT`` quantile of its predicted
language is marked ``rejected`` (the prediction stays).

The models are fitted on a bounded sample of the labelled training rows: per
language at most ``max_docs`` (smallest id hash first) of at most ``max_chars``
characters, and ``max_total`` rows in all. They are applied to every whole
text. Letters are lower-cased and everything else counts as one space. Null
texts and texts without a letter are ``und`` with score 0; so is every text if
nothing could be learned. Ties go to the language first in order. Repeated rows
give equal rows, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusmap.llm.common import MIX1, mix, prepare

ORDER = 4
#: Bounds of the training sample.
MAX_DOCS = 800
MAX_CHARS = 20_000
MAX_TOTAL = 20_000
#: One training document of so many is kept from the counts, for calibration.
CALIBRATE_EACH = 5
REJECT_AT = 0.999
#: Characters scored at a time.
BLOCK_CHARS = 2_000_000
SPACE = 32
FACTORS = (0.5, 1, 2, 4, 8, 16, 32, 64, 128)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code point -> code point of its lower-case letter, or a space."""
    out = np.full(0x110000, SPACE, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def letters(text: str) -> np.ndarray:
    """Codes of a text: lower-case letters, one space for anything between,
    and ``ORDER - 1`` spaces in front."""
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
    codes = np.concatenate([np.full(ORDER - 1, SPACE, np.uint32), codes, np.array([SPACE], np.uint32)])
    keep = np.ones(len(codes), dtype=bool)
    body = codes[ORDER - 1:]
    keep[ORDER:] = (body[1:] != SPACE) | (body[:-1] != SPACE)
    return codes[keep]


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of the n-grams whose characters are the columns."""
    h = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    for c in columns:
        h = h * MIX1 + c.astype(np.uint64) + np.uint64(1)
    return mix(h)


def windows(codes: np.ndarray) -> list[np.ndarray]:
    """Columns of all n-grams of the highest order."""
    n = len(codes) - ORDER + 1
    return [codes[i:i + n] for i in range(ORDER)]


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, value) of hashes in a sorted hash array."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


class Model:
    """``grams[n]`` and ``backoff[n]``: sorted hashes and values of order n + 1."""

    def __init__(self, docs: list[np.ndarray], alphabet: int):
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.backoff: list[tuple[np.ndarray, np.ndarray]] = []
        cols = [np.concatenate(c) for c in zip(*(windows(d) for d in docs))]
        rows = np.stack(cols, axis=1)
        _, first, count = np.unique(gram_hash(cols), return_index=True, return_counts=True)
        levels = [(rows[first], count)]                       # highest order first
        for n in range(ORDER - 1, 0, -1):
            above = levels[-1][0][:, 1:]                      # distinct (n + 1)-grams without their first character
            _, first, count = np.unique(gram_hash(list(above.T)), return_index=True, return_counts=True)
            levels.append((above[first], count))
        below, uniform = None, 1.0 / (alphabet + 1)
        for n, (rows, count) in enumerate(reversed(levels), start=1):
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context = gram_hash(list(rows[:, :-1].T)) if n > 1 else np.zeros(len(rows), np.uint64)
            contexts, of = np.unique(context, return_inverse=True)
            total = np.bincount(of, count)
            weight = discount * np.bincount(of) / total
            lower = np.full(len(rows), uniform) if n == 1 else np.exp(below(rows[:, 1:]))
            p = np.maximum(count - discount, 0) / total[of] + weight[of] * lower
            h = gram_hash(list(rows.T))
            order = np.argsort(h)
            self.grams.append((h[order], np.log(p)[order].astype(np.float32)))
            self.backoff.append((contexts, np.log(weight).astype(np.float32)))
            below = self.log_p
        self.floor = np.float32(np.log(uniform))

    def log_p(self, rows: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each row after the others."""
        top = min(rows.shape[1], len(self.grams))
        out = np.zeros(len(rows), dtype=np.float32)
        left = np.arange(len(rows))
        for n in range(top, 0, -1):
            part = rows[left, rows.shape[1] - n:]
            found, value = look_up(*self.grams[n - 1], gram_hash(list(part.T)))
            out[left[found]] += value[found]
            left, part = left[~found], part[~found]
            if not len(left):
                return out
            context = gram_hash(list(part[:, :-1].T)) if n > 1 else np.zeros(len(left), np.uint64)
            known, weight = look_up(*self.backoff[n - 1], context)
            out[left[known]] += weight[known]
        out[left] += np.float32(getattr(self, "floor", -20.0))
        return out


class Models:
    """All languages, and their calibration."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(lang for lang, texts in samples.items() if texts)
        coded = {lang: [letters(t) for t in samples[lang]] for lang in self.langs}
        alphabet = len(np.unique(np.concatenate([c for cs in coded.values() for c in cs]))) if coded else 0
        fit = {lang: [c for i, c in enumerate(cs) if i % CALIBRATE_EACH or len(cs) < CALIBRATE_EACH]
               for lang, cs in coded.items()}
        self.models = [Model(fit[lang], alphabet) for lang in self.langs]
        held = [(k, c) for k, lang in enumerate(self.langs) for i, c in enumerate(coded[lang])
                if i % CALIBRATE_EACH == 0]
        self.factor, self.limit = 8.0, np.full(len(self.langs), np.inf)
        if held:
            truth = np.array([k for k, _ in held])
            ce = self.cross_entropy([c for _, c in held])
            loss = [-np.log(np.maximum(softmax(-f * ce)[np.arange(len(truth)), truth], 1e-12)).mean() for f in FACTORS]
            self.factor = float(FACTORS[int(np.argmin(loss))])
            for k in range(len(self.langs)):
                own = ce[(truth == k) & (ce.argmin(axis=1) == k), k]
                if len(own):
                    self.limit[k] = np.quantile(own, REJECT_AT)

    def cross_entropy(self, docs: list[np.ndarray]) -> np.ndarray:
        """[document, language] mean of -log p per character."""
        cols = [np.concatenate(c) for c in zip(*(windows(d) for d in docs))]
        size = np.array([len(d) - ORDER + 1 for d in docs])
        code, uniques = pd.factorize(gram_hash(cols))
        first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1) > 0)
        rows = np.stack([c[first] for c in cols], axis=1)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        out = [np.add.reduceat(-m.log_p(rows).astype(np.float64)[code], starts) / size for m in self.models]
        return np.stack(out, axis=1)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        block, where, held = [], [], 0

        def flush():
            if block:
                ce = self.cross_entropy(block)
                best = ce.argmin(axis=1)
                p = softmax(-self.factor * ce)
                for i, k, row, e in zip(where, best, p, ce):
                    out[i] = (self.langs[k], float(row[k]), bool(e[k] > self.limit[k]))
            block.clear()
            where.clear()

        for i, t in enumerate(texts):
            if not t or not self.langs:
                continue
            codes = letters(t)
            if (codes == SPACE).all():
                continue
            block.append(codes)
            where.append(i)
            held += len(codes)
            if held >= BLOCK_CHARS:
                flush()
                held = 0
        flush()
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_sample(docs: DataFrame, train_rows: Column, max_docs: int, max_chars: int, max_total: int) -> DataFrame:
    """(lang, text) of the bounded sample. ``docs`` has doc_id, text, lang."""
    size = F.length("text")
    rows = docs.filter(train_rows & F.col("lang").isNotNull() & (size > 0) & (size <= max_chars))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # At most max_total rows of ids, so they may be broadcast.
    chosen = (rows.select("lang", "doc_id").withColumn("_rank", F.row_number().over(w))
              .filter(F.col("_rank") <= max_docs).orderBy("_rank", "lang", "doc_id").limit(max_total)
              .select("lang", "doc_id").distinct())
    return (rows.join(F.broadcast(chosen), ["lang", "doc_id"])
            .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_total).select("lang", "text"))


def fit(docs: DataFrame, train_rows: Column, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS,
        max_total: int = MAX_TOTAL) -> Models:
    samples: dict[str, list[str]] = {}
    for r in training_sample(docs, train_rows, max_docs, max_chars, max_total).collect():
        samples.setdefault(r.lang, []).append(r.text)
    return Models(samples)


def identify(docs: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Per row: lang_pred, score and rejected. ``train_rows`` is a condition on
    the column ``doc_id``; only the sample's labels are read."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"),
                       docs[lang_col].cast("string").alias("lang"))
    shared = spark.sparkContext.broadcast(fit(rows, train_rows, max_docs, max_chars))

    @pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        models = shared.value
        for col in batches:
            yield pd.DataFrame(models.predict(col.tolist()), columns=["lang_pred", "score", "rejected"])
    return rows.select("doc_id", predict("text").alias("p")).select("doc_id", "p.*")
