"""Toxicity by multiple-instance learning.

Labels say whether a document is toxic, not where. A document is a bag of
sentences; each sentence gets a probability from a logistic model over its
words and word beginnings, and the bag's probability is the noisy-or
1 - prod(1 - p). In a document of n sentences the log odds z of each are less by
a learned multiple, at least 1, of log(n) times the probability 1 - p(z) that it is
harmless: so harmless sentences do not add up, however many there are, and a
sentence that is toxic by itself counts in a document of any length.

Only features that go with the labels beyond chance take part: those whose
log-likelihood ratio over training documents is at least ``MIN_G2`` (about one
false one in 10^8), so the weights cannot learn single documents by heart. The
weights are trained from document labels by gradient ascent through the
noisy-or (AdaGrad, L2). A document's log odds are then moved by the amount that
puts the best cut of the training scores (F1) at 0.5. In a document of score 0.5
or more, the sentences that would reach it by themselves are the offending ones
(at least its strongest).

The model is fitted on at most ``max_docs`` labelled documents (those with the
smallest hash of their id) of any length, in that order up to the one that
reaches ``total_chars`` characters; it is applied to every whole text. A text
without words (null and empty texts too) has the score of the bias alone; very
long texts are read whole; repeated rows have equal scores. Rows with a null
label or id never train. Without any training row, or an empty table to train
on, every score is at most about the prior of the bias, whatever the length.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusmap.llm.common import id_text, prepare

#: Bounds of the training sample (documents, characters of all).
MAX_DOCS = 6000
TOTAL_CHARS = 24_000_000
#: Size of the hashed feature space, and lengths of word beginnings used as features.
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6, 7)
EPOCHS = 60
RATE = 0.3
DECAY = 1.0
#: A feature takes part if it occurs in so many training documents, and its
#: log-likelihood ratio with the labels is so large.
MIN_DOCS = 5
MIN_G2 = 33.0
#: Bounds of the training score that becomes 0.5.
CUTS = (0.05, 0.95)
FIRST_BIAS = -8.0
#: Least and first multiple of log(sentences) that a harmless sentence loses.
LEAST_SLOPE = 1.0
NAN = float("nan")
MEMO_LIMIT = 500_000

#: A word, or the end of a sentence.
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")


class Bias(float):
    """Bias of a sentence, the multiple of log(sentences) that a harmless one
    loses, and what a document's log odds are moved by (none for a plain number)."""

    slope = 0.0
    shift = 0.0

    @classmethod
    def of(cls, value: float, slope: float, shift: float = 0.0) -> Bias:
        out = cls(value)
        out.slope, out.shift = slope, shift
        return out


def lowered(text: str) -> str:
    """Lower-cased, keeping every character's place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def sentences(low: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence that has a word."""
    out: list[tuple[int, int, list[str]]] = []
    words: list[str] = []
    at = end = 0
    for m in TOKEN.finditer(low):
        if m[0][0] in ".!?\n":
            if words:
                out.append((at, end, words))
            words = []
        else:
            if not words:
                at = m.start()
            words.append(m[0])
            end = m.end()
    if words:
        out.append((at, end, words))
    return out


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its beginnings. Each
    beginning's hash goes on from the one before."""
    h = crc32(word[:PREFIXES[0]].encode())
    out = [h % BUCKETS] if len(word) >= PREFIXES[0] else []
    for n in PREFIXES[1:]:
        if len(word) < n:
            break
        h = crc32(word[n - 1].encode(), h)
        out.append(h % BUCKETS)
    out.append(crc32(b"=" + word.encode()) % BUCKETS)
    return out


class WordScores(dict):
    """Memo ``lower-case word -> sum of the weights of its features``; NaN for
    the end of a sentence."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        w = self.weights
        s = self[word] = NAN if word[0] in ".!?\n" else sum([w[i] for i in features(word)])
        return s


def log_likelihood_ratio(with_toxic: np.ndarray, with_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """G2 of each feature's table of documents (with or without it, toxic or not);
    0 for features that go with clean documents."""
    n = toxic + clean

    def part(seen, share):
        return seen * np.log(np.maximum(seen, 1e-9) / np.maximum(share, 1e-9))

    both = with_toxic + with_clean
    g2 = 2 * (part(with_toxic, both * toxic / n) + part(with_clean, both * clean / n)
              + part(toxic - with_toxic, (n - both) * toxic / n) + part(clean - with_clean, (n - both) * clean / n))
    return np.where(with_toxic * n > both * toxic, g2, 0)


def telling_features(texts: list[str], y: np.ndarray) -> np.ndarray:
    """Mask of the buckets that take part."""
    counts = np.zeros((2, BUCKETS))
    for text, label in zip(texts, y):
        words = set(TOKEN.findall(lowered(text)))
        found = {f for w in words if w[0] not in ".!?\n" for f in features(w)}
        counts[int(label), list(found)] += 1
    g2 = log_likelihood_ratio(counts[1], counts[0], int(y.sum()), int((~y).sum()))
    return (counts.sum(axis=0) >= MIN_DOCS) & (g2 >= MIN_G2)


def best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The score, within CUTS, that parts toxic from clean documents with the
    best F1: the middle, in log odds, of the scores around it."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1                       # no cut between equal scores
    k = int(np.argmax(f1))
    if hits[-1] == 0:
        return 0.5
    low = s[k + 1] if k + 1 < len(s) else 0.0
    return float(probability((log_odds(s[k]) + log_odds(low)) / 2).clip(*CUTS))


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, Bias]:
    """Weights by bucket and bias, from whole texts and their labels. Of the
    texts only the words with a feature that takes part are kept."""
    weights = np.zeros(BUCKETS)
    bias, slope = FIRST_BIAS, LEAST_SLOPE
    y = np.asarray(labels, dtype=bool)
    if not y.any() or y.all():
        return weights, Bias.of(bias, slope)
    used = telling_features(texts, y)
    memo: dict[str, tuple[int, ...]] = {}
    flat, sent_of, doc_of = (array("i") for _ in range(3))       # one entry a feature; one a sentence
    for d, text in enumerate(texts):
        for _, _, ws in sentences(lowered(text)) or [(0, 0, [])]:
            for w in ws:
                f = memo.get(w)
                if f is None:
                    if len(memo) >= MEMO_LIMIT:
                        memo.clear()
                    f = memo[w] = tuple(i for i in features(w) if used[i])
                flat.extend(f)
                sent_of.extend([len(doc_of)] * len(f))
            doc_of.append(d)
    n_sent = len(doc_of)
    del memo
    flat, sent_of, doc_of = (np.frombuffer(x, dtype=np.intc) if len(x) else np.empty(0, np.intc) for x in (flat, sent_of, doc_of))
    log_n = np.log(np.bincount(doc_of, minlength=len(y)))[doc_of]
    square, square_bias, square_slope = np.full(BUCKETS, 1e-6), 1e-6, 1e-6

    def forward():
        z = bias + np.bincount(sent_of, weights[flat], n_sent)
        alone = probability(z)
        p = probability(z - slope * log_n * (1 - alone))
        return alone, p, np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))

    for _ in range(epochs):
        alone, p, log_clean = forward()
        up = p * (np.exp(log_clean) / np.maximum(-np.expm1(log_clean), 1e-12))[doc_of]
        grad_p = np.where(y[doc_of], up, -p)
        grad_z = grad_p * (1 + slope * log_n * alone * (1 - alone))
        grad = np.where(used, np.bincount(flat, grad_z[sent_of], BUCKETS) - DECAY * weights, 0)
        square += grad * grad
        weights += RATE * grad / np.sqrt(square)
        g = grad_z.sum()
        square_bias += g * g
        bias += RATE * g / np.sqrt(square_bias)
        g = -(grad_p * log_n * (1 - alone)).sum()
        square_slope += g * g
        slope = max(LEAST_SLOPE, slope + RATE * g / np.sqrt(square_slope))
    cut = best_cut(-np.expm1(forward()[2]), y)
    return weights, Bias.of(float(bias), float(slope), -float(log_odds(cut)))


def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int, total_chars: int, train: Column) -> DataFrame:
    """(toxic, text) of the labelled training rows with the smallest id hash.
    ``train`` is a condition on the column ``doc_id``. An id labelled both ways
    counts as toxic."""
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .dropna().filter(train).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # The chosen ids are at most max_docs rows, so they may be broadcast.
    chosen = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"))
    rows = (docs.filter(F.length("text") > 0).join(F.broadcast(chosen), "doc_id")
            .orderBy(*order).limit(max_docs).select("doc_id", "toxic", "text"))
    # At most max_docs rows are left, so one window over all is bounded.
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
            .filter(F.col("before") < total_chars).select("toxic", "text"))


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, max_docs: int = MAX_DOCS,
          total_chars: int = TOTAL_CHARS) -> tuple[np.ndarray, Bias]:
    """Fit on the bounded sample. ``docs`` has the columns doc_id and text."""
    texts, toxic = [], []
    for r in training_sample(docs, labels, max_docs, total_chars, train_rows).collect():
        texts.append(r.text)
        toxic.append(r.toxic)
    return fit(texts, toxic)


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.log(p) - np.log1p(-p)


def score_text(text: str, scores: WordScores, bias: float, at: float = 0.5) -> tuple[float, list[dict]]:
    """Noisy-or score, moved in log odds, and the offending sentences if it is ``at`` or more."""
    slope, shift = getattr(bias, "slope", 0.0), getattr(bias, "shift", 0.0)
    low = lowered(text)
    tokens = TOKEN.findall(low)
    s = np.fromiter(map(scores.__getitem__, tokens), dtype=float, count=len(tokens))
    ends = np.isnan(s)
    of = np.cumsum(ends)[~ends]
    z = bias + np.bincount(of, s[~ends])[np.bincount(of) > 0] if len(of) else np.array([float(bias)])
    p = probability(z - slope * math.log(len(z)) * (1 - probability(z)))
    doc = -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
    if shift:
        doc = probability(log_odds(doc) + shift)
    if doc < at or not len(of):
        return float(doc), []
    own = probability(z + shift)
    least = min(at, own.max())
    return float(doc), [{"start": a, "end": b, "score": float(x)} for (a, b, _), x in zip(sentences(low), own) if x >= least]


def score_column(text: Column, weights: np.ndarray, bias: float, spark, at: float = 0.5) -> Column:
    """Struct of ``score`` and ``sentences`` (the offending ones if it is >= ``at``)."""
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))

    @pandas_udf("score double, sentences array<struct<start:int,end:int,score:double>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = WordScores(shared.value)
        for col in batches:
            scores, found = [], []
            for t in col:
                s, parts = score_text(t or "", words, bias, at)
                scores.append(min(1.0, max(0.0, s)))
                found.append(parts)
            yield pd.DataFrame({"score": scores, "sentences": found})
    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id",
                   text_col: str = "text", max_docs: int = MAX_DOCS, total_chars: int = TOTAL_CHARS) -> DataFrame:
    """Per row: score, predicted, and the spans of its offending sentences."""
    prepare(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)
    weights, bias = train(rows, labels, train_rows, max_docs, total_chars)
    scored = score_column(F.col("text"), weights, bias, docs.sparkSession)
    return (rows.select("doc_id", scored.alias("s")).select("doc_id", "s.score", "s.sentences")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
