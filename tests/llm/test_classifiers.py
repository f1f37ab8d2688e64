"""Language identification and toxicity: edge cases and held-out accuracy."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmap.llm import langid, toxicity
from corpusmap.llm.common import remainder
from tests.conftest import SF_CHECK, SF_SMALL


def trained():
    return remainder("doc_id", 5) != 0


def test_language_edge_cases(make_docs, edge_rows, no_docs):
    got = langid.identify(make_docs(edge_rows), trained()).collect()
    assert len(got) == len(edge_rows)
    und = {(i, t) for i, t in edge_rows if not any(c.isalpha() for c in t or "")}
    assert sum(r.lang_pred == "und" for r in got) == len(und)
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got} == {"en", "und"}
    assert langid.identify(no_docs, trained()).count() == 0
    assert {r.lang_pred for r in langid.identify(make_docs(edge_rows), F.lit(False)).collect()} == {"und"}


def test_language_accuracy_on_rows_not_trained_on(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    got = langid.identify(docs, trained()).join(docs.select("doc_id", "lang"), "doc_id").collect()
    rest = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.lang_pred == r.lang for r in rest]) >= 0.97
    assert np.mean([r.rejected for r in rest]) < 0.1


def test_model_probabilities_sum_to_one():
    texts = [langid.letters("the cat sat on the mat and the dog ran " * 3), langid.letters("cats and dogs")]
    alphabet = np.unique(np.concatenate(texts))
    m = langid.Model(texts, len(alphabet))
    for context in ("the", "at ", "zzz"):
        rows = np.array([[*map(ord, context), a] for a in alphabet], dtype=np.uint32)
        unseen = np.array([[*map(ord, context), 0x4E00]], dtype=np.uint32)
        assert np.exp(m.log_p(rows)).sum() + np.exp(m.log_p(unseen)).sum() == pytest.approx(1, abs=1e-4)


def test_toxicity_edge_cases(spark, make_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(edge_rows)] + [(10, None), (None, 1)],
                                   "doc_id long, toxic int")
    got = toxicity.score_toxicity(make_docs(edge_rows), labels, trained()).collect()
    assert len(got) == len(edge_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score_toxicity(no_docs, labels, trained()).count() == 0
    plain = toxicity.score_toxicity(make_docs(edge_rows), labels.limit(0), trained()).collect()
    assert {r.predicted for r in plain} == {0}                           # only the bias is left


def test_toxic_sentences_are_located(spark, make_docs):
    clean = [(i, f"A fine day number {i}. We walk to the sea.") for i in range(100)]
    toxic = [(100 + i, f"A fine day number {i}. You grumblefuck {i}! We walk to the sea.") for i in range(100)]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(make_docs(clean + toxic), labels, trained()).collect()}
    assert all(got[i].predicted == int(i >= 100) for i in range(200))
    for i, text in toxic:
        (s,) = got[i].sentences
        assert "grumblefuck" in text[s.start:s.end] and "sea" not in text[s.start:s.end]


def test_toxicity_on_rows_not_trained_on(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels, trained()).join(labels, "doc_id").collect()
    rest = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    hits = [r.predicted for r in rest if r.toxic == 1]
    false = [r.predicted for r in rest if r.toxic == 0]
    assert np.mean(hits) >= 0.85 and np.mean(false) <= 0.02


def plain_score(text, weights, bias):
    """The noisy-or word by word and sentence by sentence."""
    z = []
    for part in re.split(r"[.!?\n]+", toxicity.lowered(text)):
        words = re.findall(r"[^\W\d_]+", part)
        if words:
            z.append(bias + sum(weights[f] for w in words for f in toxicity.features(w)))
    clean = 1.0
    for x in z or [float(bias)]:
        alone = 1 / (1 + math.exp(-x))
        clean *= 1 - 1 / (1 + math.exp(-(x - bias.slope * math.log(max(1, len(z))) * (1 - alone))))
    odds = (1 - clean) / clean * math.exp(bias.shift)
    return odds / (1 + odds)


def test_scores_against_a_plain_loop(spark):
    """Value by value on whole texts, with weights of many sizes; the training on its own definition of F1."""
    texts = [r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    rng = np.random.default_rng(3)
    weights = (rng.normal(size=toxicity.BUCKETS) * (rng.random(toxicity.BUCKETS) < 0.02)).astype(np.float32)
    bias = toxicity.Bias.of(-5.0, 1.3, 0.8)
    words = toxicity.WordScores(weights)
    for t in texts:
        assert toxicity.score_text(t, words, bias)[0] == pytest.approx(plain_score(t, weights.astype(float), bias), abs=1e-9)


def test_best_cut():
    scores, y = np.array([0.9, 0.8, 0.7, 0.3, 0.2, 0.1]), np.array([1, 1, 0, 1, 0, 0], dtype=bool)
    cut = toxicity.best_cut(scores, y)
    f1 = {c: 2 * (y & (scores >= c)).sum() / (y.sum() + (scores >= c).sum()) for c in scores}
    assert 2 * (y & (scores >= cut)).sum() / (y.sum() + (scores >= cut).sum()) == max(f1.values())
    assert toxicity.best_cut(scores, ~y | y) >= toxicity.CUTS[0] and toxicity.best_cut(scores, y & ~y) == 0.5


def test_telling_features():
    """Words of toxic documents take part; rare words, and words of clean ones, do not."""
    texts = ["good day friend"] * 80 + ["good grumblefuck friend"] * 20 + ["seldom"] * 2
    y = np.array([False] * 80 + [True] * 22)
    used = toxicity.telling_features(texts, y)
    assert all(used[f] for f in toxicity.features("grumblefuck"))
    assert not any(used[f] for w in ("day", "good", "friend", "seldom") for f in toxicity.features(w))


def test_noisy_or():
    scores = toxicity.WordScores(np.zeros(toxicity.BUCKETS))
    one, _ = toxicity.score_text("a", scores, -2.0)
    two, _ = toxicity.score_text("a. b", scores, -2.0)
    assert two == pytest.approx(1 - (1 - one) ** 2)


def test_long_harmless_documents_stay(spark, make_docs):
    """With and without labels, however many harmless sentences; long toxic ones are still found."""
    clean = [(i, f"A fine day number {i}. We walk to the sea.") for i in range(100)]
    toxic = [(100 + i, f"A fine day number {i}. You grumblefuck {i}! We walk to the sea.") for i in range(100)]
    long_clean = [(300 + i, "A fine day again. We walk to the sea. " * 6_000) for i in range(6)]
    long_toxic = [(400, "A fine day. " * 200 + "You grumblefuck! " + "We walk. " * 200)]
    docs = make_docs(clean + toxic + long_clean + long_toxic)
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in range(200)] + [(i, 0) for i, _ in long_clean], "doc_id long, toxic int")
    for given in (labels, labels.filter("doc_id < 200")):
        got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, given, trained()).collect()}
        assert got == {i: int(100 <= i < 200 or i == 400) for i in got}
    got = toxicity.score_toxicity(docs, labels.limit(0), trained()).collect()
    assert {r.predicted for r in got} == {0} and max(r.score for r in got) < 0.01


def test_long_documents_train(spark, make_docs):
    docs = make_docs([(i, "word " * (20_000 if i < 3 else 5)) for i in range(20)]).select("doc_id", "text")
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels, 100, toxicity.TOTAL_CHARS, F.lit(True)).collect()
    assert sum(len(r.text) > 40_000 for r in sample) == 3 and len(sample) == 20
    assert toxicity.training_sample(docs, labels, 100, 60, F.lit(True)).count() in (1, 2, 3)
