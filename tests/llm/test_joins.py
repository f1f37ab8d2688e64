"""Jaccard join, decontamination and top-k against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmap.llm import decontaminate, jaccard_join, topk


def shingles(text, n=3):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def near_copies(rnd, n_groups=12, size=25):
    """Groups of texts at all distances from a common one."""
    rows = []
    for g in range(n_groups):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([2, 3, 5, 9, 12, 30, 80, 200]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(50)}"
            rows.append((1000 + len(rows), " ".join(words)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,small", [(1, 16), (2, 3)])
def test_components(make_docs, edge_rows, monkeypatch, seed, small):
    monkeypatch.setattr(jaccard_join, "SMALL_BUCKET", small)
    monkeypatch.setattr(jaccard_join, "BLOCK_ELEMENTS", 500)
    rows = near_copies(random.Random(seed)) + edge_rows
    got = jaccard_join.join_similar(make_docs(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_blocks_are_bounded_by_classes_and_elements(spark):
    """Also where one cluster has very many short classes."""
    nodes = spark.range(30_000).selectExpr("id % 2 AS cluster", "id AS node", "IF(id % 10 = 0, 11 + id % 90, 11) AS size")
    blocks = (jaccard_join._blocks(nodes.union(spark.range(40).selectExpr("2", "100000 + id", "50000")))
              .groupBy("cluster", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements"),
                                               F.min("size").alias("lo"), F.max("size").alias("hi")).collect())
    assert sum(b.n for b in blocks) == 30_040
    assert max(b.n for b in blocks) <= 1.2 * jaccard_join.BLOCK_CLASSES
    assert max(b.elements for b in blocks) <= 2.5 * jaccard_join.BLOCK_ELEMENTS
    for c in range(3):
        row = sorted((b.block, b.lo, b.hi) for b in blocks if b.cluster == c)
        assert all(x[2] <= y[1] for x, y in zip(row, row[1:]))


def test_forest():
    rnd = random.Random(6)
    base = list(range(40))
    sides = [(i, rnd.randrange(30), np.array([x if rnd.random() > 0.03 else 1000 + rnd.randrange(9) for x in base])) for i in range(60)]
    sides = [(i, c, np.unique(e)) for i, c, e in sides]

    def parts(links):
        top = {}
        for a, b in links:
            while a in top: a = top[a]  # noqa: E701
            while b in top: b = top[b]  # noqa: E701
            if a != b:
                top[a] = b
        def root(x):
            while x in top: x = top[x]  # noqa: E701
            return x
        return root

    comp = {i: ("c", c) for i, c, _ in sides}
    similar = [(i, j) for i, _, e in sides for j, _, f in sides if i < j
               and 100 * len(np.intersect1d(e, f)) >= 90 * len(np.union1d(e, f))]
    got = jaccard_join._forest(sides, 90)
    assert set(got) <= set(similar)
    one, two = (parts([(i, c) for i, c in comp.items()] + links) for links in (got, similar))
    assert all((one(i) == one(j)) == (two(i) == two(j)) for i in comp for j in comp)


def test_similar_sets_share_a_signature():
    rnd = np.random.default_rng(3)
    for size in (1, 2, 8, 9, 10, 11, 19, 20, 40, 137, 500, 3000):
        for _ in range(20):
            a = np.unique(jaccard_join.mix(rnd.integers(0, 1 << 62, size, dtype=np.uint64)))
            k = len(a) // 10
            drop = rnd.integers(0, k + 1)
            b = np.unique(np.concatenate([rnd.permutation(a)[drop:],
                                          rnd.integers(0, 1 << 62, rnd.integers(0, k + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                assert set(jaccard_join.signatures(a, 90)) & set(jaccard_join.signatures(b, 90))


def test_connected(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + rnd.randrange(1, 60)) for _ in range(50)] + [(200, 201), (201, 200)]
    got = {r.node: r.comp for r in jaccard_join.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: 0 if n < 100 else 100 if n < 200 else 200 for pair in links for n in pair}


def test_jaccard_empty_table(no_docs):
    assert jaccard_join.join_similar(no_docs).count() == 0


ITEM = "A train leaves Boston at 9 hours and runs 60 miles before it meets the train that Mary took from Chicago at 9 hours."


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "one two"), (None, "no id here at all, really none"),
                                  (5, "the quick brown fox jumps over lazy dogs while seven wizards watch from afar")],
                                 "item_id long, text string")


def test_leaks(make_docs, items, edge_rows):
    pad = "Some words stand here before. "
    rows = [
        (1, pad + ITEM + " And after."),                                                       # exact
        (2, pad + ITEM.replace("9", "17").replace("Boston", "Paris").replace("Mary", "Tom")),  # other parameters
        (3, pad + ITEM.replace("9 hours and", "7 hours and").replace("60 miles", "7 miles")),  # 9 stands for 7 and for 9
        (4, pad * 20),
        (5, ITEM[:30] + pad),                                                                  # a small part only
        (6, ITEM.upper()), (None, ITEM), (7, ITEM), (7, ITEM),
    ]
    rows += [(10 + i, t) for i, (_, t) in enumerate(edge_rows)]
    got = decontaminate.contamination(make_docs(rows), items).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter([(1, 1), (2, 1), (None, 1), (7, 1)])
    assert {r.doc_id: r.exact for r in got} == {1: True, 2: False, None: True, 7: True}
    assert all(0.5 <= r.coverage <= 1 for r in got)


def test_verbatim_leaks(spark, make_docs):
    """Exact copies in any case, of items dense in numbers or names, and of short ones."""
    texts = [ITEM, "Compute 3 * 7 + 2 and 9 * 4 + 18", "War And Peace By Leo Tolstoy In Ten Short Volumes",
             "What is the capital of France?"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(10 * i + k, t) for i, x in enumerate(texts)
            for k, t in enumerate([x, x.upper(), x.lower(), f"Well, they said: {x} So it was."])]
    rows += [(90, "Nothing of it stands in this one."), (91, ITEM[:30]), (92, "It cost 3 and then 7 and 2.")]
    got = decontaminate.contamination(make_docs(rows), items, verbatim=True).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter((d, d // 10) for d, _ in rows if d < 90)
    assert all(r.exact and r.coverage >= 0.5 for r in got)


def test_excerpts(spark, make_docs):
    """Runs of a long item, and copies in which one repeated number was changed."""
    rnd = random.Random(9)
    long = " ".join(f"word{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}{chr(97 + i % 26)}" for i in range(300))
    words = long.split()
    items = spark.createDataFrame([(1, long), (2, ITEM), (3, "short item of six words here")], "item_id long, text string")
    rows = [(1, "before " + " ".join(words[100:200]) + " after"), (2, " ".join(words[40:53])), (3, " ".join(words[40:52])),
            (4, " ".join(words[40:48] + ["other"] + words[50:58] + ["more"] + words[80:88])),
            (5, ITEM.replace("at 9 hours.", "at 7 hours.")), (6, ITEM[:30]), (7, " ".join(words[60:73]).upper())]
    got = decontaminate.contamination(make_docs(rows), items, verbatim=True, excerpts=True).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter([(1, 1), (2, 1), (5, 2), (7, 1)])
    # Where no window without placeholders helps, the consistent ones of an alignment still count.
    item = "on day 3 the old farmer counts sheep and then rests near the river until the day 3 bell rings"
    changed = "on day 5 the young farmer counts sheep and then rests near the river until the day 6 bell rings"
    one = spark.createDataFrame([(1, item)], "item_id long, text string")
    (r,) = decontaminate.contamination(make_docs([(1, changed)]), one, coverage=0.4, verbatim=True, excerpts=True).collect()
    assert r.item_id == 1 and r.coverage < 1


def test_leaks_empty_tables(no_docs, items, edge_docs):
    assert decontaminate.contamination(no_docs, items).count() == 0
    assert decontaminate.contamination(edge_docs, items.limit(0)).count() == 0


def brute_top(rows, k):
    use = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows
           if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, qv in sorted({i: min(v for j, v in use if j == i) for i, _ in use if i % 20 == 0}.items()):
        scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in use if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return out


@pytest.mark.parametrize("shard", [8192, 7])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 2)
    rnd = np.random.default_rng(1)
    vec = [[float(x) for x in rnd.choice([-0.5, -0.1, 0.0, 0.1, 0.3, 0.9], 24)] for _ in range(90)]
    rows = list(enumerate(vec)) + [(200 + i, vec[3]) for i in range(40)] + [
        (None, vec[0]), (300, None), (301, [None] * 24), (302, [float("nan")] * 24), (303, [float("inf")] * 24),
        (320, []), (321, [1.0]), (5, vec[7]), (20, vec[20])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    df = df.withColumn("v", F.lit("x")).withColumn("shard", F.lit("y"))
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=20).collect()]
    want = brute_top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 20)
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
