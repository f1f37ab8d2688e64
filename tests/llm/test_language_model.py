"""The backoff automaton against probabilities computed word by word."""

import functools
import math
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmap.llm import lm_automaton as M
from corpusmap.llm.common import remainder


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


class Plain:
    def __init__(self, texts, order):
        seqs = [tokens(t) for t in texts]
        self.c = Counter(w for s in seqs for w in s)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.grams = {}
        for k in range(2, order + 1):
            cs = Counter(tuple(s[i:i + k]) for s in seqs for i in range(len(s) - k + 1))
            self.grams |= cs
        self.after = defaultdict(list)
        for g in self.grams:
            self.after[g[:-1]].append(g[-1])
        self.weight = functools.lru_cache(None)(self._weight)

    def uni(self, w):
        return (self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def count(self, h):
        return self.c[h[0]] if len(h) == 1 else self.grams[h]

    def _weight(self, h):
        if not self.after.get(h):
            return 1.0
        left = 1 - sum((self.grams[h + (w,)] - M.DISCOUNT) / self.count(h) for w in self.after[h])
        return max(left, 1e-9) / max(1 - sum(self.p(h[1:], w) for w in self.after[h]), 1e-9)

    def p(self, h, w):
        if not h:
            return self.uni(w)
        if h + (w,) in self.grams:
            return (self.grams[h + (w,)] - M.DISCOUNT) / self.count(h)
        return self.weight(h) * self.p(h[1:], w)


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


ORDER = 3


@pytest.mark.parametrize("options", [{}, {"word_share": 0.002}, {"part_tokens": 2_000}, {"word_share": 0.002, "part_tokens": 500}])
def test_scores(edge_docs, edge_rows, options):
    """At the default settings; with words that are joined, with many parts, and with split words."""
    want = Plain([t for i, t in edge_rows if not held(i)], ORDER)
    got = M.score_texts(edge_docs, remainder("doc_id", 10) != 0, **options).collect()
    assert len(got) == len(edge_rows)
    expected = []
    for i, t in edge_rows:
        ts = tokens(t)
        base = sum(math.log10(want.uni(w)) for w in ts)
        model = sum(math.log10(want.p(tuple(ts[max(0, k - ORDER + 1):k]), w)) for k, w in enumerate(ts))
        expected.append((i, len(ts), sum(want.c[w] > 0 for w in ts), want.n, base, model))
    key = lambda r: (repr(r[0]), r[1], round(r[4], 3))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key)):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9)


def test_probabilities_sum_to_one(edge_rows):
    m = Plain([t for i, t in edge_rows if not held(i)], ORDER)
    for h in list(m.after)[:20]:
        assert sum(m.p(h, w) for w in m.c) + m.p(h, b"never seen") == pytest.approx(1, abs=1e-6)


def test_empty_table_and_no_training_rows(no_docs, make_docs):
    assert M.score_texts(no_docs, F.lit(True)).count() == 0
    (r,) = M.score_texts(make_docs([(1, "a b")]), F.lit(False)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == pytest.approx(0)


def test_every_gram_is_a_state_at_any_size(make_docs):
    """Pairs that occur once or twice in more than 1e5 tokens count as well."""
    texts = [" ".join(f"w{(7 * i + k) % 5003}" for k in range(4000)) for i in range(60)] + ["odd pair here", "odd pair here"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in M.score_texts(make_docs(rows + [(900, "odd pair w1 w2")]), F.col("doc_id") < 900).collect()}
    want = Plain(texts, ORDER)
    for i, t in ((0, texts[0]), (60, "odd pair here"), (900, "odd pair w1 w2")):
        ts = tokens(t)
        model = sum(math.log10(want.p(tuple(ts[max(0, k - ORDER + 1):k]), w)) for k, w in enumerate(ts))
        assert want.n > 2e5 and got[i].score == pytest.approx(model, rel=1e-9)


def test_packing():
    rng = np.random.default_rng(2)
    for n, most in ((1, 2), (500, 40), (90_000, 80_000)):
        a, b, c = (rng.integers(0, most, n).astype(np.uint64) * np.uint64(2**63 // 40_000) for _ in range(3))
        text = np.sort(rng.integers(0, most, n))
        row = rng.integers(-2**62, 2**62, most)
        trains = row % 3 == 0
        for known in (0, most // 2):
            words = np.arange(known, dtype=np.uint64) * np.uint64(2**63 // 40_000)
            frequent = M.Words(words.view(np.int64), rng.integers(1, 50, known), 10.0)
            ranks = tuple(frequent.ranks(x).astype(np.int32) for x in (b, a, c))
            back = M.unpack(M.pack(ranks, (b, a, c), text, row, trains, known), frequent)
            key = lambda x: sorted(zip(*(y.tolist() for y in x)))
            assert key(back) == key((a, b, c, row[text], trains[text]))


def test_a_word_of_most_tokens_is_split(make_docs):
    """One word is nearly every other token: its parts hold a few states each, and the scores stay."""
    rows = [(i, " ".join(f"the w{(i * 7 + k) % 90}" for k in range(40))) for i in range(60)]
    want = Plain([t for i, t in rows if i % 5], ORDER)
    for r in M.score_texts(make_docs(rows), F.col("doc_id") % 5 != 0, part_tokens=300).collect():
        ts = tokens(dict(rows)[r.doc_id])
        model = sum(math.log10(want.p(tuple(ts[max(0, k - 2):k]), w)) for k, w in enumerate(ts))
        assert r.score == pytest.approx(model, rel=1e-9)


class Table:
    """Stands for a table and keeps the function that its tasks would run."""

    def __getattr__(self, name):
        return lambda *args: self

    def mapInPandas(self, run, schema):
        self.run = run
        return self

    applyInPandas = mapInPandas


def task(operator, *args):
    return operator(*(Table() if x is None else x for x in args)).run


NO_ARCS = pd.DataFrame({"b": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "weight": np.zeros(0)})


def by_tasks(rows, parts, least):
    """The scores of (id, text, trains), by the functions of the tasks; and the steps asked."""
    batches = (pd.DataFrame([(i, False, trains, t)], columns=["id", "no_id", "trains", "text"]) for i, t, trains in rows)
    read = pd.concat(list(task(M.read_chunks, None)(batches)), ignore_index=True)
    read["chunk"] = np.arange(len(read)) * 7
    counts = pd.concat(list(task(M.count_words, None)(iter([read])))).groupby("key")["n"].sum()
    often = counts[counts >= least]
    shared = SimpleNamespace(value=M.Words(often.index.to_numpy(), often.to_numpy(), float(counts.sum() + M.ADD * (len(counts) + 1))))
    rare = pd.concat(list(task(M.rare_words, None, shared)(iter([read]))))
    rare = rare.assign(c=rare["key"].map(counts)).dropna()
    learn = task(M.learn_counts, None, None, shared, parts, 10**9)
    chunks = pd.concat([learn(read[read["chunk"] == k], rare[rare["chunk"] == k]) for k in read["chunk"]], ignore_index=True)
    asked = pd.concat(list(task(M.asks, None, shared, parts, 10**9)(iter([chunks]))))
    answer = task(M.answers, None, None, shared, 10**9)
    answered = pd.concat([answer(own, NO_ARCS) for _, own in asked.groupby("part")]).sample(frac=1, random_state=3)
    walk = task(M.walk, None, None, shared, parts, 10**9)
    scores = pd.concat([walk(chunks[chunks["chunk"] == k], answered[answered["chunk"] == k]) for k in chunks["chunk"]])
    steps = sum(len(M.unpack(blob, shared.value)[0]) for blob in asked["blob"])
    return len(chunks), steps, scores.set_index("id")


@pytest.mark.parametrize("parts, chunk_tokens, slice_steps, placed", [(1, 10**6, 10**6, 2**21), (9, 10**6, 10**6, 2**21), (200, 10**6, 50, 2**21),
                                                                      (9, 300, 20, 2**21), (9, 300, 20, 5)])
def test_chunks_parts_and_slices(spark, edge_rows, monkeypatch, parts, chunk_tokens, slice_steps, placed):
    """The scores stay, and a chunk asks for its distinct steps once, in however many parts."""
    monkeypatch.setattr(M, "CHUNK_TOKENS", chunk_tokens)
    monkeypatch.setattr(M, "SLICE_STEPS", slice_steps)
    monkeypatch.setattr(M, "PLACED_WORDS", placed)
    texts = [t or "" for _, t in edge_rows]
    want = Plain([t for i, t in enumerate(texts) if i % 4], ORDER)
    chunks, steps, got = by_tasks([(i, t, i % 4 > 0) for i, t in enumerate(texts)], parts, 3)
    assert len(got) == len(texts) and (chunks > 3) == (chunk_tokens == 300)
    distinct = {tuple(ts[max(0, k - 2):k + 1]) + (k == 1,) for ts in map(tokens, texts) for k in range(1, len(ts))}
    assert steps == len(distinct) if chunks == 1 else steps > len(distinct)
    for i, t in enumerate(texts):
        ts = tokens(t)
        assert (got.n_tokens[i], got.n_known[i]) == (len(ts), sum(want.c[w] > 0 for w in ts))
        assert got.base_score[i] == pytest.approx(sum(math.log10(want.uni(w)) for w in ts), rel=1e-9)
        assert got.score[i] == pytest.approx(sum(math.log10(want.p(tuple(ts[max(0, k - 2):k]), w)) for k, w in enumerate(ts)), rel=1e-9)


def test_memory_of_a_part():
    """A part of a million steps is worked on within 150 MB (when it was held in one piece, as many tokens took 258)."""
    rng = np.random.default_rng(5)
    words = np.sort(rng.integers(1, 2**62, 60_000))
    frequent = M.Words(words, rng.integers(20, 900, len(words)), 4e7)
    blobs = []
    for _ in range(20):
        b, a, c = (np.sort(rng.integers(0, len(words), 50_000)) if k == 0 else rng.integers(0, len(words), 50_000) for k in range(3))
        ranks = tuple(x.astype(np.int32) for x in (b, a, c))
        hashes = tuple(words[frequent.by_rank[x]].view(np.uint64) for x in ranks)
        blobs.append(M.pack(ranks, hashes, np.zeros(50_000, np.int64), np.array([1]), np.array([True]), len(words)))
    own = pd.DataFrame({"part": 0, "chunk": np.arange(20), "blob": blobs})
    run = task(M.answers, None, None, SimpleNamespace(value=frequent), 10**6)
    tracemalloc.start()
    out = run(own, NO_ARCS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(M.unbox(x)[1]) for x in out["blob"]) == 1_000_000
    assert peak < 150e6, peak
