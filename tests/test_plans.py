"""Plan helpers and composed jobs: distributed row numbers under skew, the
multi-block k-NN path, generation refresh, JSON documents."""

import json

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmap.operators import similarity as SIM
from corpusmap.plans import maps as MAPS
from corpusmap.plans.registry import QUERIES
from corpusmap.session import cut_lineage, dense_index
from corpusmap.sources.manifests import limit_events

from corpusmap.sources.standins import repos

from .conftest import SF_SMALL


def test_dense_index_hot_group(spark):
    # one group holds most rows; the index must still equal row_number - 1
    rows = [("hot", i) for i in range(3000)] + [(f"g{i % 7}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "grp string, id long").repartition(6)
    got = dense_index(df, ["id"], ["grp"], name="idx")
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("grp").orderBy("id")) - 1)
    bad = got.join(want, ["grp", "id"]).filter(F.col("idx") != F.col("want")).count()
    assert bad == 0 and got.count() == len(rows)
    # the hot group is spread over several range partitions before indexing
    assert got.filter("grp = 'hot'").select(F.max("idx")).first()[0] == 2999


def _vectors(spark, mat, key):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(mat)], f"{key} long, vector array<float>")


def _brute(pts, qs, k):
    p, q = (m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True) for m in (pts, qs))
    out = {}
    for j, v in enumerate(q):
        for rank, i in enumerate(np.argsort(-np.round(p @ v, SIM.COMPARED), kind="stable")[:k], 1):
            out[j, rank] = int(i)
    return out


def test_nearest_in_blocks_and_shards(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pts, qs = rng.normal(size=(80, 6)).astype(np.float32), rng.normal(size=(10, 6)).astype(np.float32)
    df, q = _vectors(spark, pts, "id"), _vectors(spark, qs, "query_id")
    one = {(r.query_id, r["rank"]): r.id for r in SIM.nearest(df, q, k=5).collect()}
    monkeypatch.setattr(SIM, "QUERY_BLOCK", 3)
    monkeypatch.setattr(SIM, "POINT_SHARD", 11)
    many = {(r.query_id, r["rank"]): r.id for r in SIM.nearest(df, q, k=5).collect()}
    assert one == many == _brute(pts, qs, 5)


def test_nearest_of_many_queries(spark):
    """20,000 queries, several blocks, equal points (ties go to the lower key)."""
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(300, 8)).astype(np.float32)
    pts[100:200] = pts[:100]
    qs = rng.normal(size=(20_000, 8)).astype(np.float32)
    got = {(r.query_id, r["rank"]): r.id for r in SIM.nearest(_vectors(spark, pts, "id"), _vectors(spark, qs, "query_id"), k=4).collect()}
    assert got == _brute(pts, qs, 4)


def test_nearest_hot_group_and_copies(spark, monkeypatch):
    """One group holds most points, many of them copies of one; null vectors and groups take no part."""
    monkeypatch.setattr(SIM, "POINT_SHARD", 50)
    rows = [("hot", i, [1.0, 0.0] if i % 2 else [float(i), 1.0]) for i in range(600)] + [("cold", 1, [0.0, 1.0])]
    rows += [("hot", 9_999, None), (None, 5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "dataset string, id long, vector array<float>")
    q = spark.createDataFrame([(1, "hot", [2.0, 0.0]), (2, "cold", [1.0, 1.0]), (3, "none", [1.0, 1.0]), (4, None, [1.0, 1.0])],
                              "query_id long, dataset string, vector array<float>")
    got = sorted((r.query_id, r["rank"], r.id) for r in SIM.nearest(df, q, k=3, group_col="dataset").collect())
    assert got == [(1, 1, 1), (1, 2, 3), (1, 3, 5), (2, 1, 1)]
    assert SIM.nearest(df, q.limit(0), k=3, group_col="dataset").count() == 0
    assert SIM.nearest(df.limit(0), q, k=3).count() == 0


def test_many_labels(spark):
    rng = np.random.default_rng(6)
    lab = rng.normal(size=(5_000, 6))
    lab /= np.linalg.norm(lab, axis=1, keepdims=True)
    lab[4_000:4_100] = lab[:100]                                     # equal labels in another block: the lower index counts
    pts = rng.normal(size=(200, 6)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(lab)], "idx long, vector array<double>")
    df = _vectors(spark, pts, "id").unionByName(spark.createDataFrame([(999, None)], "id long, vector array<float>"))
    got = {r.id: (r.category, r.similarity) for r in SIM.categorize(df, rows).collect()}
    sims = np.round(pts.astype(np.float64) / np.linalg.norm(pts.astype(np.float64), axis=1, keepdims=True) @ lab.T, SIM.COMPARED)
    assert got.pop(999) == (None, None)
    assert {i: c for i, (c, _) in got.items()} == dict(enumerate(sims.argmax(axis=1).tolist()))
    assert all(abs(s - sims[i].max()) < 1e-4 for i, (_, s) in got.items())


def test_limit_events(spark):
    ev = spark.createDataFrame([(i, f"h{i}") for i in range(10)], "pos int, host string")
    assert limit_events(ev, -1, ["pos"]).count() == 10
    assert [r.host for r in limit_events(ev, 3, ["pos"]).collect()] == ["h0", "h1", "h2"]


def test_refresh_rebuilds_only_touched(spark):
    rng = np.random.default_rng(8)
    rows = [(ds, i, [float(x) for x in rng.normal(size=4)]) for ds, n in (("a", 12), ("b", 9)) for i in range(n)]
    members = spark.createDataFrame([(ds, "project", i + (100 if ds == "b" else 0), v) for ds, i, v in rows],
                                    "dataset string, kind string, id long, vector array<float>")
    state = spark.createDataFrame([(3, "update"), (4, "unchanged"), (105, "unchanged")], "id long, action string")
    gens = spark.createDataFrame([("a", 5), ("b", 2)], "dataset string, generation long")
    labels = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]]
    points, gen = MAPS.refresh_datasets(members, labels, 4, state, gens, members)
    g = {r.dataset: (r.generation, r.rebuilt) for r in gen.collect()}
    assert g == {"a": (6, True), "b": (2, False)}
    assert {r.dataset for r in points.select("dataset").distinct().collect()} == {"a"}
    assert points.count() == 12


def test_documents_are_json(spark):
    lines = QUERIES["dataset_document"](spark, SF_SMALL).collect()
    heads = [json.loads(r.line) for r in lines if r.idx == -1]
    pts = [json.loads(r.line) for r in lines if r.idx >= 0]
    assert heads and all("categories" in h for h in heads)
    assert pts and list(pts[0]) == sorted(pts[0]) and len(pts[0]["position"]) == 3
    docs = [json.loads(r.document) for r in QUERIES["answer_documents"](spark, SF_SMALL).collect()]
    assert docs and all(len(d["nearest"]) <= 8 and len(d["position"]) == 3 for d in docs)
    cat = json.loads(QUERIES["catalog_document"](spark, SF_SMALL).first().document)
    every = sorted({r.source for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("source").collect()})
    assert cat["github"] == {"label": "GitHub"} and [h["id"] for h in cat["hackathons"]] == every[:-1]
    assert set(cat["hackathons"][0]) == {"id", "label", "years"}


def test_refresh_after_moves(spark):
    """A project that changes hackathon touches both; an emptied dataset gets a
    generation without points."""
    def member(rows):
        return spark.createDataFrame([(ds, "project", i, [float(i), 1.0, 0.5, 0.0]) for ds, i in rows],
                                     "dataset string, kind string, id long, vector array<float>")
    before = member([("a", 1), ("a", 2), ("b", 3), ("c", 4), ("d", 5)])
    after = member([("a", 1), ("b", 2), ("b", 3), ("d", 4), ("d", 5), ("e", 6)])
    state = spark.createDataFrame([(1, "unchanged"), (2, "update"), (3, "unchanged"), (4, "update"), (5, "unchanged"),
                                   (6, "insert")], "id long, action string")
    gens = spark.createDataFrame([(d, 1) for d in "abcd"], "dataset string, generation long")
    labels = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]]
    points, gen = MAPS.refresh_datasets(after, labels, 4, state, gens, before)
    assert {r.dataset: r.generation for r in gen.collect()} == {"a": 2, "b": 2, "c": 2, "d": 2, "e": 1}
    assert sorted((r.dataset, r.id) for r in points.collect()) == [("a", 1), ("b", 2), ("b", 3), ("d", 4), ("d", 5), ("e", 6)]


def test_dense_index_repeated_keys(spark):
    df = spark.createDataFrame([("q", 1), ("q", 1), ("q", 2), (None, 1), (None, 1)], "g string, id long")
    got = sorted(((r.g or "", r.idx) for r in dense_index(df, ["id"], ["g"], name="idx").collect()))
    assert got == [("", 0), ("", 1), ("q", 0), ("q", 1), ("q", 2)]


def test_query_on_a_dataset_without_points(spark):
    vec = "query_id long, dataset string, vector array<float>"
    pts = spark.createDataFrame([("a", "project", i, [float(i), 1.0, 0.0, 0.0]) for i in range(5)],
                                "dataset string, kind string, id long, vector array<float>")
    labels = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]]
    points, proj, _ = MAPS.build_maps(pts, labels, 4)
    q = spark.createDataFrame([(1, "a", [1.0, 0.0, 0.0, 0.0]), (2, "empty", [0.0, 1.0, 0.0, 0.0])], vec)
    got = MAPS.answer_queries(q, points, proj, labels).filter("query_id = 2").collect()
    assert [(r.x, r.y, r.z, r.category, r.nearest_id) for r in got] == [(0.0, 0.0, 0.0, 1, None)]
    docs = MAPS.answer_documents(MAPS.answer_queries(q, points, proj, labels),
                                 spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, description string"))
    assert json.loads(docs.filter("query_id = 2").first().document)["nearest"] == []


def test_cut_lineage_reads_back(spark):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    out = cut_lineage(df)
    assert sorted(r.v for r in out.collect()) == [2 * i for i in range(10)]
    assert "corpusmap-snapshot" in out.inputFiles()[0]


def test_dense_index_stable_under_aqe_coalescing(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")     # tiny data, many partitions: AQE coalesces
    try:
        rows = [("hot" if i % 3 else f"g{i % 11}", i) for i in range(2000)]
        df = spark.createDataFrame(rows, "grp string, id long").repartition(5)
        got = dense_index(df, ["id"], ["grp"], name="idx")
        want = df.withColumn("want", F.row_number().over(Window.partitionBy("grp").orderBy("id")) - 1)
        assert got.join(want, ["grp", "id"]).filter(F.col("idx") != F.col("want")).count() == 0
        assert got.count() == 2000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_dense_index_null_group(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "grp string, id long")
    got = {(r.grp, r.id): r.idx for r in dense_index(df, ["id"], ["grp"]).collect()}
    assert got == {(None, 1): 0, (None, 3): 1, ("a", 2): 0}


def test_latest_generation_and_prizes_import(spark):
    from corpusmap.operators.selection import prizes_from_text
    pts = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("b", 1, 12)], "dataset string, generation long, id long")
    got = sorted((r.dataset, r.generation) for r in MAPS.latest_generation(pts).collect())
    assert got == [("a", 2), ("b", 1)]
    df = spark.createDataFrame([(None,), ("",), ("x\n\ny",)], "p string")
    assert [r.q for r in df.select(prizes_from_text("p").alias("q")).collect()] == [None, [], ["x", "y"]]


def test_dataset_paths(spark):
    from corpusmap.operators.selection import parse_dataset_path
    from corpusmap.sources.standins import registry
    cases = {
        "/datasets/github": ("github", None, True, False), "/datasets/github/embed": ("github", None, True, True),
        "/datasets/github/": (None, None, False, False), "/datasets/src1": ("src1", None, True, False),
        "/datasets/src1/": ("src1", None, True, False), "/datasets/src1/2021/embed": ("src1/2021", 2021, True, True),
        "/datasets/src1/embed": ("src1", None, True, True), "/datasets/src1//embed": ("src1", None, True, True),
        "/datasets/src1/0": (None, None, False, False), "/datasets/src1/-5": (None, None, False, False),
        "/datasets/src1/2021/x": (None, None, False, False), "/datasets/nope": (None, None, False, False),
        "/other/github": (None, None, False, False), "/datasets/src1/embed/embed": (None, None, False, False),
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    got = {r.path: (r.dataset, r.year, r.found, r.embed) for r in parse_dataset_path(df, registry(spark, SF_SMALL)).collect()}
    assert got == cases


def _read_document(path: str, dataset: str) -> list[str]:
    """A dataset's document: its part files in name order (local test files)."""
    import glob
    import os
    out = []
    for f in sorted(glob.glob(os.path.join(path.replace("file:", ""), f"dataset={dataset}", "part-*"))):
        with open(f, encoding="utf-8") as fh:
            out.extend(line.rstrip("\n") for line in fh if line.strip())
    return out


def test_dataset_document_sink(spark):
    from corpusmap.sources.store import write_dataset_documents
    from corpusmap.streaming.ingest import scratch_root
    lines = QUERIES["dataset_document"](spark, SF_SMALL)
    path = f"{scratch_root(spark, 'docs')}/documents"
    write_dataset_documents(lines, path)
    doc = _read_document(path, "github")
    head, pts = json.loads(doc[0]), [json.loads(x) for x in doc[1:]]
    assert head["dataset"] == "github" and "categories" in head
    assert len(pts) == lines.filter("dataset = 'github' AND idx >= 0").count()
    stars = {r.id: r.stars for r in repos(spark, SF_SMALL).select("id", "stars").collect()}
    ids = [p["id"] for p in pts]
    assert ids == sorted(ids, key=lambda i: (-stars[i], i))             # served order: by stars, then id


def test_spread_small_input(spark):
    from corpusmap.session import spread_small_input
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")      # one 25 MB row group
    spread = spread_small_input(big.select("doc_id", "text"))
    assert spread.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    small = spark.read.parquet(f"{SF_SMALL}/documents.parquet")              # below the size floor
    assert spread_small_input(small) is small
    made = spark.range(10)                                                    # no input files at all
    assert spread_small_input(made) is made
