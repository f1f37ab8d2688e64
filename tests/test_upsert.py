"""Upserts against a row-at-a-time model of the original statements, plus
idempotence."""

import random

from pyspark.sql import functions as F

from corpusmap.operators import upsert as U

PSCHEMA = ("id long, slug string, name string, tagline string, likes long, members array<string>, "
           "vector array<float>, hackathon string, year int, winner boolean, prizes array<string>")
BSCHEMA = ("id long, slug string, name string, tagline string, likes long, members array<string>, "
           "hackathon string, year int, winner boolean, ord long")
SCALARS = ["slug", "name", "tagline", "likes", "members", "winner"]


def model_projects(stored: dict, batch: list) -> dict:
    st = {k: dict(v) for k, v in stored.items()}
    for r in sorted(batch, key=lambda r: r["ord"]):
        year = r["year"] if r["year"] is not None and r["year"] > 0 else None
        cur = st.get(r["id"])
        if cur is None:
            st[r["id"]] = {**{c: r[c] for c in SCALARS}, "hackathon": r["hackathon"], "year": year,
                           "vector": None, "prizes": None}
            continue
        diff = any(cur[c] != r[c] for c in SCALARS) \
            or (r["hackathon"] is not None and cur["hackathon"] != r["hackathon"]) \
            or (year is not None and cur["year"] != year)
        if diff:
            for c in SCALARS:
                cur[c] = r[c]
            cur["hackathon"] = r["hackathon"] if r["hackathon"] is not None else cur["hackathon"]
            cur["year"] = year if year is not None else cur["year"]
            cur["prizes"] = cur["prizes"] if r["winner"] else None
    return st


def _rand_rows(seed):
    rnd = random.Random(seed)
    stored = {}
    for i in range(60):
        w = rnd.random() < 0.5
        stored[i] = dict(slug=f"s{i}", name=rnd.choice(["a", "b", None]), tagline="t", likes=rnd.randint(0, 3),
                         members=rnd.choice([["u1"], ["u1", "u2"], []]), vector=[0.5] if i % 2 else None,
                         hackathon=rnd.choice(["h1", "h2", None]), year=rnd.choice([2020, 2021, None]),
                         winner=w, prizes=(["p"] if w and rnd.random() < 0.7 else None))
    batch = []
    for o in range(1, 200):
        i = rnd.randint(0, 80)
        base = stored.get(i) or dict(slug=f"s{i}", name="n", tagline="t", likes=0, members=[], hackathon=None,
                                     year=None, winner=False)
        batch.append(dict(id=i, slug=base["slug"], name=rnd.choice([base["name"], "z"]), tagline=base["tagline"],
                          likes=rnd.choice([base["likes"], base["likes"] + 1]), members=base["members"],
                          hackathon=rnd.choice([None, base["hackathon"], "h3"]), year=rnd.choice([None, 0, 2022]),
                          winner=rnd.choice([True, False, base["winner"]]), ord=o))
    return stored, batch


def test_project_upsert_matches_row_model(spark):
    for seed in (1, 2, 3):
        stored, batch = _rand_rows(seed)
        sdf = spark.createDataFrame([(k, *[v[c] for c in ("slug", "name", "tagline", "likes", "members", "vector",
                                                          "hackathon", "year", "winner", "prizes")])
                                     for k, v in stored.items()], PSCHEMA)
        bdf = spark.createDataFrame([tuple(r[c] for c in ("id", "slug", "name", "tagline", "likes", "members",
                                                          "hackathon", "year", "winner", "ord")) for r in batch],
                                    BSCHEMA)
        got = {r.id: r.asDict() for r in U.upsert_projects(sdf, bdf).collect()}
        want = model_projects(stored, batch)
        assert set(got) == set(want)
        for k, w in want.items():
            g = got[k]
            for c in SCALARS + ["hackathon", "year", "vector", "prizes"]:
                gv = g[c]
                if c == "vector" and gv is not None:
                    gv = [float(x) for x in gv]
                assert gv == w[c], (seed, k, c, gv, w[c])


def test_repo_upsert_and_idempotence(spark):
    stored = spark.createDataFrame([(1, "a/x", "d", 5, ["t"], [0.1]), (2, "b/y", None, 7, [], None)],
                                   "id long, name string, desc string, stars long, topics array<string>, vector array<float>")
    batch = spark.createDataFrame([("a/x", "d", 5, ["t"], 1), ("b/y", "new", 7, [], 1), ("c/z", None, 1, ["q"], 1),
                                   ("c/z", "later", 2, ["q"], 2), (None, "bad", 1, [], 1), ("a/a", None, 0, [], 1)],
                                  "name string, desc string, stars long, topics array<string>, ord long")
    state, rej = U.upsert_repos(stored, batch)
    got = {r.name: r for r in state.collect()}
    assert rej.count() == 1
    assert got["a/x"].action == "unchanged" and got["a/x"].vector is not None
    assert got["b/y"].action == "update" and got["b/y"].desc == "new" and got["b/y"].id == 2
    assert got["c/z"].action == "insert" and got["c/z"].desc == "later" and got["c/z"].stars == 2
    assert (got["a/a"].id, got["c/z"].id) == (3, 4)  # new ids after max(id), in name order
    again, _ = U.upsert_repos(state.drop("action"), batch.filter(F.col("name").isNotNull()))
    assert {r.action for r in again.collect()} == {"unchanged"}


def test_slug_conflicts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, slug string")
    c = U.slug_conflicts(df).collect()
    assert [(r.slug, r.n_ids) for r in c] == [("a", 2)]
    import pytest
    with pytest.raises(ValueError):
        U.assert_no_conflicts(df)


def test_upsert_into_store_touches_only_its_partitions(spark):
    import glob
    import os

    from corpusmap.operators.upsert import upsert_into_store
    from corpusmap.streaming.ingest import scratch_root
    root = scratch_root(spark, "test-store")
    path = f"{root}/store"
    rows = [(i, f"s{i}", "n", "t", 1, ["u"], None, h, 2020, False, None)
            for i, h in enumerate(["a"] * 3 + ["b"] * 3 + ["c"] * 1)]
    spark.createDataFrame(rows, PSCHEMA).write.partitionBy("hackathon").parquet(path)
    path = path.removeprefix("file:")
    files_b = sorted(glob.glob(f"{path}/hackathon=b/*.parquet"))
    assert files_b
    mtimes_b = [os.path.getmtime(f) for f in files_b]
    # id 0 (partition a) gets more likes; id 6 (only row of c) moves to a
    batch = spark.createDataFrame([(0, "s0", "n", "t", 5, ["u"], None, None, False, 1),
                                   (6, "s6", "n", "t", 1, ["u"], "a", None, False, 1),
                                   (9, "s9", "n", "t", 1, ["u"], "a", 2021, True, 1)], BSCHEMA)
    res = upsert_into_store(path, batch)
    assert res["emptied"] == 1 and res["actions"] == {"update": 2, "unchanged": 2, "insert": 1}
    assert sorted(glob.glob(f"{path}/hackathon=b/*.parquet")) == files_b
    assert [os.path.getmtime(f) for f in files_b] == mtimes_b      # b was not rewritten
    assert not os.path.exists(f"{path}/hackathon=c")
    got = {r.id: (r.hackathon, r.likes) for r in spark.read.parquet(path).collect()}
    assert got[0] == ("a", 5) and got[6] == ("a", 1) and got[9] == ("a", 1) and len(got) == 8
    again = upsert_into_store(path, batch)                          # a retried batch changes nothing
    assert again["actions"] == {"unchanged": 5}                      # ids 0, 1, 2, 6, 9 in partition a


def test_upsert_a_then_b_equals_union(spark):
    stored, batch = _rand_rows(7)
    sdf = spark.createDataFrame([(k, *[v[c] for c in ("slug", "name", "tagline", "likes", "members", "vector",
                                                      "hackathon", "year", "winner", "prizes")])
                                 for k, v in stored.items()], PSCHEMA)
    rows = [tuple(r[c] for c in ("id", "slug", "name", "tagline", "likes", "members", "hackathon", "year",
                                 "winner", "ord")) for r in batch]
    a = spark.createDataFrame(rows[:100], BSCHEMA)
    b = spark.createDataFrame(rows[100:], BSCHEMA)
    both = spark.createDataFrame(rows, BSCHEMA)
    step = U.upsert_projects(U.upsert_projects(sdf, a).drop("action"), b).drop("action")
    once = U.upsert_projects(sdf, both).drop("action")
    cols = ["id", "slug", "name", "tagline", "likes", "members", "hackathon", "year", "winner", "prizes"]
    assert sorted(map(tuple, step.select(*cols).collect())) == sorted(map(tuple, once.select(*cols).collect()))


def test_refresh_on_change(spark):
    stored = spark.createDataFrame([(1, "a/x", "d", 5, ["t"], [0.1]), (2, "b/y", "e", 7, [], [0.2])],
                                   "id long, name string, desc string, stars long, topics array<string>, vector array<float>")
    batch = spark.createDataFrame([("a/x", "changed", 5, ["t"], 1), ("b/y", "e", 7, [], 1)],
                                  "name string, desc string, stars long, topics array<string>, ord long")
    keep = {r.name: r.vector for r in U.upsert_repos(stored, batch)[0].collect()}
    redo = {r.name: r.vector for r in U.upsert_repos(stored, batch, refresh_on_change=True)[0].collect()}
    assert keep["a/x"] is not None and redo["a/x"] is None and redo["b/y"] is not None


def test_strict_store_upsert_refuses_slug_conflicts(spark):
    import pytest

    from corpusmap.operators.upsert import upsert_into_store
    from corpusmap.streaming.ingest import scratch_root
    path = f"{scratch_root(spark, 'test-strict')}/store"
    rows = [(1, "s1", "n", "t", 1, ["u"], None, "a", 2020, False, None),
            (2, "s2", "n", "t", 1, ["u"], None, "b", 2020, False, None)]
    spark.createDataFrame(rows, PSCHEMA).write.partitionBy("hackathon").parquet(path)
    clash = spark.createDataFrame([(1, "s2", "n", "t", 1, ["u"], "a", None, False, 1)], BSCHEMA)  # takes id 2's slug
    with pytest.raises(ValueError):
        upsert_into_store(path, clash, strict=True)
    assert {r.slug for r in spark.read.parquet(path).collect()} == {"s1", "s2"}   # nothing written
    fine = spark.createDataFrame([(1, "s9", "n", "t", 1, ["u"], "a", None, False, 1)], BSCHEMA)
    assert upsert_into_store(path, fine, strict=True)["actions"]["update"] == 1


def _files(path):
    import glob
    import os
    found = {f: os.path.getmtime(f) for f in glob.glob(f"{path.removeprefix('file:')}/**/*.parquet", recursive=True)}
    assert found
    return found


def test_hot_hackathon_rewrites_few_parts(spark):
    """A store by hackathon and part: a small batch on the largest hackathon leaves most of its folders alone."""
    from corpusmap.operators import upsert as UP
    from corpusmap.streaming.ingest import scratch_root
    path = f"{scratch_root(spark, 'test-parts')}/store"
    rows = [(i, f"s{i}", "n", "t", 1, ["u"], None, "hot" if i < 180 else "cold", 2020, False, None) for i in range(200)]
    store = spark.createDataFrame(rows, PSCHEMA)
    store.withColumn("part", UP.project_part(16)).write.partitionBy("hackathon", "part").parquet(path)
    before = _files(path)
    batch = spark.createDataFrame([(0, "s0", "n", "t", 5, ["u"], "hot", None, False, 1),
                                   (190, "s190", "n", "t", 1, ["u"], "hot", None, False, 1)], BSCHEMA)
    res = UP.upsert_into_store(path, batch, parts=16)
    after = _files(path)
    untouched = [f for f in before if after.get(f) == before[f]]
    folders = {f.rsplit("/", 1)[0] for f in before} - {f.rsplit("/", 1)[0] for f in untouched}
    assert res["touched_partitions"] <= 4 and len(folders) <= 4 and len({f.rsplit("/", 1)[0] for f in before}) > 16
    got = {r.id: (r.hackathon, r.likes) for r in spark.read.parquet(path).collect()}
    assert len(got) == 200 and got[0] == ("hot", 5) and got[190] == ("hot", 1)
    vecs = spark.createDataFrame([(3, [0.5])], "id long, vector array<float>")
    prizes = spark.createDataFrame([(4, ["First"])], "id long, prizes array<string>")
    state = _files(path)
    assert UP.write_back(path, vecs, prizes, parts=16)["touched_partitions"] <= 2
    assert len({f.rsplit("/", 1)[0] for f, t in _files(path).items() if state.get(f) != t}) <= 2
    now = {r.id: r for r in spark.read.parquet(path).collect()}
    assert now[3].vector == [0.5] and now[4].prizes is None and len(now) == 200     # id 4 is no winner


def test_slug_index_follows_the_store(spark):
    import pytest

    from corpusmap.operators import slugs as SL
    from corpusmap.operators import upsert as UP
    from corpusmap.streaming.ingest import scratch_root
    root = scratch_root(spark, "test-slugs")
    path, index = f"{root}/store", f"{root}/slugs"
    rows = [(i, f"s{i}", "n", "t", 1, ["u"], None, "a" if i % 2 else "b", 2020, False, None) for i in range(40)]
    store = spark.createDataFrame(rows, PSCHEMA)
    store.withColumn("part", UP.project_part()).write.partitionBy("hackathon", "part").parquet(path)
    SL.build_slug_index(store, index)

    def claims():
        return sorted((r.slug, r.id) for r in spark.read.parquet(index).collect())

    def batch(*pairs):
        return spark.createDataFrame([(i, slug, "n", "t", 1, ["u"], "a", None, False, 1) for i, slug in pairs], BSCHEMA)

    before = _files(index)
    for strict_clash in (batch((1, "s2")), batch((50, "new"), (51, "new"))):          # taken by another id; twice in one batch
        with pytest.raises(ValueError):
            UP.upsert_into_store(path, strict_clash, strict=True, index_path=index)
    assert _files(index) == before and spark.read.parquet(path).count() == 40         # nothing written
    UP.upsert_into_store(path, batch((1, "s2"), (2, "s1")), strict=True, index_path=index)   # a swap is no conflict
    UP.upsert_into_store(path, batch((3, "renamed"), (60, "s3")), strict=True, index_path=index)
    want = sorted((r.slug, r.id) for r in spark.read.parquet(path).collect())
    assert claims() == want and ("renamed", 3) in want and ("s3", 60) in want
    untouched = [f for f, t in _files(index).items() if before.get(f) == t]
    assert len(untouched) > len(before) // 2
    UP.upsert_into_store(path, batch((3, "renamed"), (60, "s3")), strict=True, index_path=index)   # a retry changes nothing
    assert claims() == want
    plan = SL.claims(spark, index, spark.createDataFrame([("s5",)], "slug string"))._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_readers_of_few_columns_move_no_texts(spark):
    """F12, F8: the shuffle of an upsert that is asked for slugs holds no names; long texts are compared by digest."""
    from corpusmap.operators import upsert as U
    from corpusmap.sources.store import PROJECTS_SCHEMA, ensure_columns
    long = "x" * 100
    stored = ensure_columns(spark.createDataFrame([(1, "a", long, True, ["p"]), (2, "b", long, False, ["p"]), (3, "c", None, False, ["p"])],
                                                  "id long, slug string, name string, winner boolean, prizes array<string>"), PROJECTS_SCHEMA)
    batch = stored.select("id", *U.PROJECT_SCALARS, "hackathon", "year").withColumn("ord", F.col("id"))
    batch = batch.withColumn("name", F.when(F.col("id") == 2, F.concat("name", F.lit("y"))).otherwise(F.col("name")))
    state = U.upsert_projects(stored, batch)
    got = {r.id: (r.action, r.prizes) for r in state.collect()}
    assert got == {1: ("unchanged", ["p"]), 2: ("update", None), 3: ("unchanged", ["p"])}
    plan = state.select("id", "slug")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "tagline" not in plan
