"""Streaming ingest drains the same rows the batch job computes; gallery walks
keep their place between micro-batches; a failing source leaves the others."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmap.operators.upsert import upsert_projects
from corpusmap.sources import standins as ST
from corpusmap.streaming.ingest import gallery_batch_to_projects, scratch_root, start_upsert, stream_upsert, supervise
from corpusmap.streaming.walk import HELD, PROGRESS, WalkState, advance, card_count

from .conftest import SF_SMALL

GOOD = '<a data-software-id="1"></a><a href="https://devpost.com/software/x">'


def _reached(gp):
    """The pages before each gallery's first failed page."""
    stop = gp.filter("status <> 200").groupBy("hackathon").agg(F.min("page").alias("stop"))
    return gp.join(stop, "hackathon", "left").filter("page < coalesce(stop, page + 1)").drop("stop")


def test_stream_upsert_equals_batch(spark):
    root = scratch_root(spark, "test-stream")
    gp = ST.gallery_pages(spark, SF_SMALL).select("hackathon", "page", "status", "html")
    src = f"{root}/incoming"
    gp.repartition(3, "hackathon", "page").write.mode("overwrite").parquet(src)
    store = ST.projects(spark, SF_SMALL)
    res = stream_upsert(spark, src, gp.schema, store, root, max_files_per_trigger=1)
    streamed = spark.read.parquet(res["path"])
    # the reached pages at once; ord orders the same rows the same way
    batch = upsert_projects(store, gallery_batch_to_projects(_reached(gp))).drop("action")
    cols = ["id", "slug", "name", "likes", "winner", "hackathon"]
    a = sorted(tuple(r) for r in streamed.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert res["generation"] >= 2 and a == b
    assert sum(b["seen"] for b in res["batches"]) == gp.count()
    assert sum(b["accepted"] for b in res["batches"]) == gp.filter("status = 200").count()


def _pages(spark, rows):
    """rows: (hackathon, walk, page, status, html)."""
    return spark.createDataFrame(rows, HELD)


def _walked(batches, policy, cap):
    """The walks one page after another, on everything that has come so far."""
    used, seen, state = [], {}, {}
    for batch in batches:
        for h, w, p, status, html in batch:
            if state.get(h, (w, 1, None))[0] > w:
                continue
            if h not in state or state[h][0] < w:
                state[h] = (w, 1, None)
                for k in [k for k in seen if k[0] == h]:
                    del seen[k]
            if state[h][2] is None and p >= state[h][1]:
                ok = status is not None and 200 <= status < 300
                old = seen.get((h, p))
                if old is None or ok:
                    seen[h, p] = (ok, bool(html) and GOOD in html)
        out = []
        for h, (w, at, ended) in list(state.items()):
            first = at
            while ended is None:
                if cap is not None and at > cap:
                    ended = "cap"
                elif (h, at) not in seen:
                    break
                elif not seen[h, at][0]:
                    ended = "failed"
                elif not seen[h, at][1]:
                    ended = "empty"
                else:
                    at += 1
            if policy == "keep_prefix" or (ended and ended != "failed"):
                out += [(h, p) for p in range(first, at)]
            state[h] = (w, at if policy == "keep_prefix" or ended else first, ended)
        used.append(sorted(out))
    return used, sorted((h, w, at, e) for h, (w, at, e) in state.items())


@pytest.mark.parametrize("policy,cap,seed", [("keep_prefix", None, 1), ("keep_prefix", 4, 2), ("all_or_nothing", None, 3)])
def test_walk_against_a_plain_loop(spark, tmp_path, policy, cap, seed):
    """Pages out of order over three batches, failed, empty, missing, repeated and of a newer walk."""
    rnd = random.Random(seed)
    rows = []
    for h in range(8):
        n, bad, empty, gap = rnd.randint(1, 7), rnd.choice([0, 3, 5]), rnd.choice([0, 4, 6]), rnd.choice([0, 0, 2])
        rows += [(f"h{h}", 0, p, 500 if p == bad else 200, "" if p == empty else GOOD) for p in range(1, n + 1) if p != gap]
    rnd.shuffle(rows)
    cut = len(rows) // 3
    batches = [rows[:cut], rows[cut:2 * cut] + rows[:2], rows[2 * cut:], [("h1", 1, 1, 200, GOOD), ("h2", -1, 1, 200, GOOD)]]
    state = WalkState(spark, f"{tmp_path}/walk", policy, cap)
    used = []
    for batch in batches:
        use, done = state.step(_pages(spark, batch))
        used.append(sorted((r.hackathon, r.page) for r in use.collect()))
        done()
    want, progress = _walked(batches, policy, cap)
    assert used == want
    assert sorted(tuple(r) for r in state.read(99)[1].collect()) == progress
    assert len(state.epochs()) == 2                     # older ones are gone


def test_walk_is_repeatable(spark, tmp_path):
    """An epoch that is run again starts from the state before it."""
    state = WalkState(spark, f"{tmp_path}/walk")
    state.step(_pages(spark, [("a", 0, 2, 200, GOOD)]), 0)[1]()
    for _ in range(2):
        use, done = state.step(_pages(spark, [("a", 0, 1, 200, GOOD), ("a", 0, 4, 200, GOOD)]), 1)
        assert sorted(r.page for r in use.collect()) == [1, 2]
        done()
    assert [tuple(r) for r in state.read(2)[1].collect()] == [("a", 0, 3, None)]
    assert [r.page for r in state.read(2)[0].collect()] == [4]


def test_walk_edge_cases(spark):
    none, fresh = _pages(spark, []), spark.createDataFrame([], PROGRESS)
    use, held, progress = advance(none, none, fresh)
    assert use.count() == held.count() == progress.count() == 0
    odd = _pages(spark, [(None, 0, 1, 200, GOOD), ("a", 0, None, 200, GOOD), ("a", 0, 0, 200, GOOD), ("b", 0, 1, None, None),
                         ("c", 0, 1, 500, GOOD), ("c", 0, 1, 200, GOOD)])
    use, held, progress = advance(odd, none, fresh)
    assert [(r.hackathon, r.page) for r in use.collect()] == [("c", 1)] and held.count() == 0
    assert sorted(tuple(r) for r in progress.collect()) == [("b", 0, 1, "failed"), ("c", 0, 2, None)]
    with pytest.raises(ValueError):
        advance(odd, none, fresh, "some")
    html = spark.createDataFrame([(GOOD * 2,), ('<a data-software-id="1">',), ("",), (None,)], "html string")
    assert [r[0] for r in html.select(card_count(F.col("html"))).collect()] == [2, 0, 0, 0]


def test_supervised_source_recovers(spark):
    """A source that cannot start at first is started again; one that never can is given up; the third drains."""
    root = scratch_root(spark, "test-supervise")
    gp = ST.gallery_pages(spark, SF_SMALL).select("hackathon", "page", "status", "html")
    gp.write.parquet(f"{root}/incoming")
    calls = []

    def late():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("not yet")
        return start_upsert(spark, f"{root}/incoming", gp.schema, ST.projects(spark, SF_SMALL), f"{root}/late")[2]

    def never():
        raise OSError("gone")

    report = supervise({"late": late, "never": never, "good": lambda: start_upsert(
        spark, f"{root}/incoming", gp.schema, ST.projects(spark, SF_SMALL), f"{root}/good")[2]}, attempts=2)
    assert report["good"] == {"ok": True, "attempts": 1, "errors": []}
    assert report["late"] == {"ok": True, "attempts": 2, "errors": ["not yet"]}
    assert report["never"] == {"ok": False, "attempts": 2, "errors": ["gone", "gone"]}
    a, b = (sorted(r.id for r in spark.read.parquet(f"{root}/{x}/store").select("id").collect()) for x in ("late", "good"))
    assert a == b


def test_restart_keeps_the_store(spark):
    root = scratch_root(spark, "test-restart")
    gp = ST.gallery_pages(spark, SF_SMALL).select("hackathon", "page", "status", "html")
    src, store = f"{root}/incoming", ST.projects(spark, SF_SMALL)
    gp.coalesce(1).write.parquet(src)
    cols = ["id", "slug", "name", "likes", "winner"]
    first = stream_upsert(spark, src, gp.schema, store, root)
    a = sorted(tuple(r) for r in spark.read.parquet(first["path"]).select(*cols).collect())
    again = stream_upsert(spark, src, gp.schema, store, root)          # nothing new to read
    assert again["batches"] == []
    assert sorted(tuple(r) for r in spark.read.parquet(again["path"]).select(*cols).collect()) == a


def test_stream_upsert_repos_buckets(spark):
    from corpusmap.streaming.ingest import stream_upsert_repos
    root = scratch_root(spark, "test-repos")
    pages = ST.repo_listing_pages(spark, SF_SMALL)
    src = f"{root}/incoming"
    pages.filter("page <= 5").coalesce(1).write.parquet(src)
    pages.filter("page > 5").coalesce(1).write.mode("append").parquet(src)
    res = stream_upsert_repos(spark, src, pages.schema, ST.repos(spark, SF_SMALL), root, buckets=8)
    store = spark.read.parquet(res["path"])
    assert len(res["batches"]) == 2
    assert store.select("name").distinct().count() == store.count()            # one row per name
    ids = [r.id for r in store.select("id").collect()]
    assert len(set(ids)) == len(ids)                                            # ids stay unique across batches
    assert store.select("bucket").distinct().count() <= 8
