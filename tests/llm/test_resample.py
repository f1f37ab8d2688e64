"""Importance resampling against a plain loop over all n-grams."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmap.llm import resample as R
from corpusmap.llm.queries import importance_resampling_query
from tests.conftest import SF_SMALL


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def expected(rows, target):
    corpus, wanted = Counter(), Counter()
    for _, t in rows:
        corpus.update(features(t))
    for t in target:
        wanted.update(features(t))
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000))))
            for b in range(10_000)]
    out = []
    for i, t in rows:
        f = features(t)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None,
                    len(words(t)) >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(able[:5 * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = importance_resampling_query(spark, SF_SMALL)
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert found(got) == expected(rows, target)


@pytest.mark.parametrize("seed", range(40))
def test_line_and_crossing_features_are_all_features(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice(["a", "Bc", "dé", "7", " ", " ", "\n", "\n", ". ", "\r\n", "x y z w v u", "\n\n"]) for _ in range(rnd.randint(0, 60)))
    lines = text.encode().split(b"\n")
    inside = [b for part in R.buckets_of_lines(lines) for b in part.tolist()]
    crossing = R.crossing_buckets([w for w in map(R.words_of, lines) if w]).tolist()
    assert Counter(inside + crossing) == Counter(features(text))
    assert [len(p) for p in R.buckets_of_lines(lines)] == [len(features(x.decode())) for x in lines]


def test_frequent_lines(spark, monkeypatch):
    """One line in every document, looked up by broadcast; others are joined; one of five is drawn."""
    monkeypatch.setattr(R, "HOT_SHARE", 20)
    rows = [(i, "the common line of all\n" + f"line {i % 7} with some more of the words that are here\n" * (i % 4) + f"own words {i} " * 8)
            for i in range(200)]
    rows += [(None, "own words"), (2**53 + 1, "own words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("own words of the common line",)], "text string")
    assert found(R.resample(docs, target)) == expected(rows, ["own words of the common line"])


def test_edge_cases(spark, edge_docs, edge_rows, no_docs, make_docs):
    target = ["the Cat sat on the mat", None, "", "été ñandú 42"]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    assert found(R.resample(edge_docs, items)) == expected(edge_rows, target)
    assert R.resample(no_docs, items).count() == 0
    assert found(R.resample(edge_docs, items.limit(0))) == expected(edge_rows, [])


def test_ties_and_texts(spark, make_docs):
    """Equal ids tie in score if the words are the same; drawn texts carry their rank."""
    rows = [(1, "one two three four five " * 5)] * 50 + [(i, f"six {i} seven eight nine ten " * 6) for i in range(2, 52)]
    docs = make_docs(rows)
    items = spark.createDataFrame([("one two three",)], "text string")
    ranked = R.resample(docs, items)
    assert found(ranked) == expected(rows, ["one two three"])
    unique = docs.filter(F.col("doc_id") > 1)
    got = R.drawn_texts(unique, R.resample(unique, items)).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2]
    assert all(r.text == dict(rows)[r.doc_id] for r in got)
