"""The composed service pass: store upsert, embedding, map refresh, snapshots."""

from pyspark.sql import functions as F

from corpusmap.operators import similarity as SIM
from corpusmap.plans import sync as SYNC
from corpusmap.sources import standins as ST
from corpusmap.streaming.ingest import scratch_root

from .conftest import SF_SMALL


def test_two_passes(spark):
    root = scratch_root(spark, "test-sync")
    store = ST.projects(spark, SF_SMALL)
    store = store.withColumn("vector", F.when(F.col("hackathon") != "src1", F.col("vector")))  # src1 pending
    SYNC.init_store(store, root)
    gp = ST.gallery_pages(spark, SF_SMALL).select("hackathon", "page", "status", "html")
    texts = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    labels = SIM.label_matrix(ST.category_labels(spark, SF_SMALL))
    repos, reg = ST.repos(spark, SF_SMALL), ST.registry(spark, SF_SMALL)

    first = SYNC.sync_pass(spark, root, gp.filter("hackathon = 'src1'"), texts, repos, reg, labels, 64)
    points, proj, units = SYNC.read_maps(spark, root)
    gens = {r.dataset: r.generation for r in proj.select("dataset", "generation").collect()}
    assert set(gens.values()) == {1} and "github" in gens and first["vectors_written"] > 0
    assert points.count() == units.count()

    second = SYNC.sync_pass(spark, root, gp.filter("hackathon = 'src2'"), texts, repos, reg, labels, 64)
    _, proj2, _ = SYNC.read_maps(spark, root)
    gens2 = {r.dataset: r.generation for r in proj2.select("dataset", "generation").collect()}
    touched = {d for d, g in gens2.items() if g == 2}
    assert touched and all(d.startswith("src2") for d in touched)     # only src2 maps were rebuilt
    assert gens2["github"] == 1 and second["vectors_written"] == 0
    after = spark.read.parquet(f"{root}/projects")
    assert after.filter("hackathon = 'src1' AND vector IS NULL").count() == 0          # all embedded
    assert first["vectors_written"] == store.filter("hackathon = 'src1'").count()


def test_read_maps_before_first_pass(spark):
    root = scratch_root(spark, "test-empty-maps")
    assert SYNC.read_maps(spark, root) == (None, None, None)


def test_statistics_follow_every_pass(spark):
    """Moves, new vectors and an emptied dataset: the stored statistics equal those of the members as they are."""
    import numpy as np
    from corpusmap.operators.projection import gram_rows
    from corpusmap.operators.selection import dataset_members
    root = scratch_root(spark, "test-statistics")
    store = ST.projects(spark, SF_SMALL).filter("id < 60")
    SYNC.init_store(store, root)
    reg = spark.createDataFrame([(0, "src1", "1"), (1, "src2", "2"), (2, "src3", "3")], "pos int, hackathon string, label string")
    texts = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    labels = SIM.label_matrix(ST.category_labels(spark, SF_SMALL))
    repos = ST.repos(spark, SF_SMALL)

    def page(hackathon, number, ids, walk):
        cards = "".join(f'<div data-software-id="{i}"><a href="https://devpost.com/software/s{i}"><h5>n{i} w{walk}</h5></div>' for i in ids)
        return (hackathon, walk, number, 200, cards)

    moved = [r.id for r in store.filter("hackathon = 'src3'").select("id").collect()]
    rounds = [[page("src1", 1, [1, 2, 900], 0)], [page("src2", 1, moved[:2] + [901], 0), page("src1", 1, moved[2:], 1)], []]
    for pages in rounds:
        df = spark.createDataFrame(pages, "hackathon string, walk long, page long, status int, html string")
        SYNC.sync_pass(spark, root, df, texts, repos, reg, labels, 64)
        members = dataset_members(repos, spark.read.parquet(f"{root}/projects"), reg)
        want = {(r.dataset, r.i): r for r in gram_rows(members).collect()}
        got = {(r.dataset, r.i): r for r in SYNC.read_statistics(spark, root).collect()}
        assert set(got) == set(want)
        for k, r in want.items():
            assert got[k].n == r.n and abs(got[k].s - r.s) < 1e-9 and np.allclose(got[k].row, r.row, atol=1e-9)
    assert not any(d == "src3" for d, _ in got)          # every project moved away
    newest = {r.dataset: r.generation for r in SYNC.read_generations(spark, root).collect()}
    assert newest["src3"] == 2 and newest["github"] == 1


def test_failed_window_is_dropped_whole(spark):
    pages = spark.createDataFrame([(0, 1, 200, '{"items": [{"full_name": "a/b"}]}'), (0, 2, 500, None),
                                   (1, 1, 200, '{"items": [{"full_name": "c/d"}, {"full_name": null}]}'), (2, 1, 200, "no json")],
                                  "window long, page long, status int, body string")
    good, failed = SYNC.whole_windows(pages)
    assert [r.window for r in good.collect()] == [1] and sorted(r.window for r in failed.collect()) == [0, 2]
    batch, n = SYNC.repo_batch(pages)
    assert [r.name for r in batch.collect()] == ["c/d"] and n == 2
