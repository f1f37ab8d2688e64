"""One pass of the service loop as Spark jobs (STR-1 .. STR-4 composed).

``sync_pass`` takes a store folder and the responses gathered since the last
pass and:

1. repo source: upserts the search windows that came whole (SRC-13, a window
   with a failed page is dropped and the repos of this pass are not embedded)
   into the ``repos`` store, and embeds the pending ones among the top by stars
   (FIL-4);
2. hackathon source: moves the gallery walks on (SRC-13, ``streaming.walk``) and
   upserts the pages whose turn has come into the ``projects`` store, rewriting
   only the partitions they touch (JOIN-2);
3. embeds the pending projects of registered hackathons and writes vectors and
   prizes back in one partition-scoped rewrite (EMB-4, JOIN-3, JOIN-4): prizes
   go to the winners embedded now and to those whose prizes are still missing
   (FIL-5);
4. brings the maps of the datasets holding a changed row up to date and
   publishes them as a new generation of the snapshot tables ``points``,
   ``projection``, ``unit_vectors`` and ``statistics`` (partitioned by ``dataset,
   generation``). The statistic a map is fitted from follows the changed rows
   only (``refresh_statistics``). "Changed" covers the membership before and
   after, and the table ``generations`` names the newest generation of each
   dataset.

A source that has nothing, or whose window failed, leaves the others as they
are. Everything runs against the store on shared storage; nothing is held on
the driver beyond counters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmap.functions.vectors import is_valid
from corpusmap.operators.encoders import hashing_vectors
from corpusmap.operators.projection import fit_statistics
from corpusmap.operators.selection import TOP_REPOS, dataset_members, pending_prizes, pending_projects, pending_repos
from corpusmap.operators.slugs import build_slug_index
from corpusmap.operators.upsert import (project_part, repo_bucket, upsert_into_store, upsert_repos_into_store, write_back,
                                       write_vectors_into_store)
from corpusmap.plans.maps import build_maps, refresh_statistics, touched_datasets
from corpusmap.session import cut_lineage
from corpusmap.sources.listings import parse_repo_listing
from corpusmap.sources.store import PROJECTS_SCHEMA, REPOS_SCHEMA, ensure_columns
from corpusmap.streaming.ingest import gallery_batch_to_projects
from corpusmap.streaming.walk import WalkState, accepted

TABLES = ("points", "projection", "unit_vectors", "statistics")


def init_store(store: DataFrame, root: str, repos: DataFrame | None = None) -> str:
    path = f"{root}/projects"
    (ensure_columns(store, PROJECTS_SCHEMA).withColumn("part", project_part())
     .write.mode("overwrite").partitionBy("hackathon", "part").parquet(path))
    build_slug_index(store, f"{root}/slugs")
    if repos is not None:
        (ensure_columns(repos, REPOS_SCHEMA).withColumn("bucket", repo_bucket("name"))
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/repos"))
    return path


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # no snapshot published yet
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def read_generations(spark: SparkSession, root: str) -> DataFrame | None:
    """(dataset, generation): the newest published generation of every dataset
    ever served; a dataset that became empty has one without points."""
    df = _read_or_none(spark, f"{root}/maps/generations")
    return None if df is None else df.groupBy("dataset").agg(F.max("generation").alias("generation"))


def read_maps(spark: SparkSession, root: str) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """The newest generation of every dataset's snapshot tables."""
    newest = read_generations(spark, root)
    if newest is None:
        return None, None, None
    return tuple(spark.read.parquet(f"{root}/maps/{name}").join(newest, ["dataset", "generation"], "left_semi")
                 for name in TABLES[:3])


def read_statistics(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest statistic of every dataset (see ``operators.projection``)."""
    newest = read_generations(spark, root)
    stored = None if newest is None else _read_or_none(spark, f"{root}/maps/statistics")
    return None if stored is None else stored.join(newest, ["dataset", "generation"], "left_semi")


def whole_windows(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-13 ``all_or_nothing`` on search pages ``(window, page, status, body)``:
    the pages of windows without a failed or unreadable page, and the windows
    that have one."""
    _, rejects = parse_repo_listing(listings.filter(accepted()), keys=["window", "page"])
    failed = (listings.filter(~accepted()).select("window")
              .unionByName(rejects.select("window"))).distinct()
    return listings.join(failed, "window", "left_anti"), failed


def repo_batch(listings: DataFrame) -> tuple[DataFrame, int]:
    """Incoming repo rows of the windows that came whole, and how many did not.
    A later window or page says what a repo is like now."""
    listings = cut_lineage(listings.select("window", "page", "status", "body"), "listings")
    good, failed = whole_windows(listings)
    rows, _ = parse_repo_listing(good, keys=["window", "page"])
    place = F.col("window") * (1 << 40) + F.col("page") * (1 << 20) + F.col("pos")
    batch = rows.filter("name IS NOT NULL").select("name", "desc", "stars", "topics", place.cast("long").alias("ord"))
    return cut_lineage(batch, "repo-batch"), failed.count()


def embed_repos(store: str, readmes: DataFrame, dim: int, embed=None, n: int = TOP_REPOS) -> DataFrame:
    """FIL-4: the pending repos of the top ``n`` get vectors; their names and vectors are returned."""
    pending = pending_repos(readmes.sparkSession.read.parquet(store), n).select("name")
    chosen = readmes.join(pending, "name", "left_semi")
    vecs = embed(chosen, "name", "text") if embed else hashing_vectors(chosen, "name", "text", dim)
    vecs = cut_lineage(vecs.select("name", "vector"), "repo-vectors")
    write_vectors_into_store(store, vecs, "bucket", "name")
    return vecs


def sync_pass(spark: SparkSession, root: str, responses: DataFrame, texts: DataFrame, repos: DataFrame | None,
              registry: DataFrame, labels, dim: int, embed=None, listings: DataFrame | None = None,
              readmes: DataFrame | None = None, prizes: DataFrame | None = None) -> dict:
    """Run one pass.

    ``responses(hackathon, page, status, html[, walk])`` are the gallery pages
    fetched since the last pass, ``texts(id, text)`` the write-ups and
    ``prizes(id, prizes)`` the prize lists of project pages. ``listings(window,
    page, status, body)`` are repo search pages and ``readmes(name, text)`` their
    read-mes; with ``repos=None`` the repo table is the store at ``root/repos``.
    ``labels`` is the category label matrix (or table), ``embed(df, key, text_col)``
    another encoder than the hashing one. Returns the pass counters."""
    store, own = f"{root}/projects", repos is None

    def repos_now() -> DataFrame:
        return spark.read.parquet(f"{root}/repos").drop("bucket") if own else repos

    walk = WalkState(spark, f"{root}/walk")
    use, walked = walk.step(responses)
    batch = cut_lineage(gallery_batch_to_projects(use), "batch")

    found, failed = repo_batch(listings) if own and listings is not None else (None, 0)

    # the rows that may change, as they are before
    ids = batch.select(F.lit("project").alias("kind"), "id").distinct()
    maybe = ids
    if found is not None:
        maybe = ids.unionByName(repos_now().join(found.select("name"), "name", "left_semi").select(F.lit("repo").alias("kind"), "id"))
    members = dataset_members(repos_now(), spark.read.parquet(store), registry)
    before = cut_lineage(members.select("dataset", "kind", "id", is_valid("vector", dim).alias("valid")), "before")
    gone = members.filter(is_valid("vector", dim)).join(maybe, ["kind", "id"], "left_semi")
    gone = cut_lineage(gone.select("dataset", "kind", "id", "vector"), "gone")

    report, changed = {"failed_windows": failed}, ids
    if found is not None:                                                             # step 1
        report["repos"] = upsert_repos_into_store(f"{root}/repos", found)
        names = found.select("name")
        if not failed and readmes is not None:
            vecs = embed_repos(f"{root}/repos", readmes, dim, embed)
            report["repo_vectors_written"] = vecs.count()
            names = names.unionByName(vecs.select("name"))
        changed = changed.unionByName(repos_now().join(names, "name", "left_semi").select(F.lit("repo").alias("kind"), "id"))
    report["upsert"] = upsert_into_store(store, batch, index_path=f"{root}/slugs")        # step 2
    walked()

    projects = spark.read.parquet(store)
    pending = pending_projects(projects, registry).select("id")
    chosen = texts.join(pending, "id", "left_semi")
    vecs = embed(chosen, "id", "text") if embed else hashing_vectors(chosen, "id", "text", dim)
    vecs = cut_lineage(vecs.select("id", "vector"), "vectors")
    if prizes is None:
        report["embedded"] = write_vectors_into_store(store, vecs)                    # step 3
    else:
        due = pending_prizes(projects, registry).select("id").unionByName(vecs.select("id")).distinct()
        fetched = cut_lineage(prizes.select("id", "prizes").join(due, "id", "left_semi"), "prizes")
        report["embedded"] = write_back(store, vecs, fetched)

    members = dataset_members(repos_now(), spark.read.parquet(store), registry)
    after = cut_lineage(members.select("dataset", "kind", "id"), "after")
    changed = changed.unionByName(vecs.select(F.lit("project").alias("kind"), "id"))
    changed = cut_lineage(changed.distinct(), "changed")
    touched = touched_datasets(changed, before.drop("valid"), after)
    gens = read_generations(spark, root)
    if gens is None:
        gens = spark.createDataFrame([], "dataset string, generation long")
    never_built = after.select("dataset").distinct().join(gens, "dataset", "left_anti")
    touched = cut_lineage(touched.unionByName(never_built).distinct(), "touched")
    new_gen = cut_lineage(touched.join(gens, "dataset", "left").select(
        "dataset", (F.coalesce(F.col("generation"), F.lit(0)) + 1).cast("long").alias("generation")), "generations")

    members = cut_lineage(members.join(touched, "dataset", "left_semi"), "members")     # step 4
    stored = read_statistics(spark, root)
    if stored is None:
        stored = spark.createDataFrame([], "dataset string, i int, row array<double>, s double, n long")
    # a stored statistic counts if it is of as many points as there were; else the dataset is folded whole
    counts = before.groupBy("dataset").agg(F.count_if("valid").alias("now"))
    had = stored.filter("i = 0").select("dataset", "n")
    known = (gens.join(counts, "dataset", "left").join(had, "dataset", "left")
             .filter(F.coalesce("now", F.lit(0)) == F.coalesce("n", F.lit(0))).select("dataset"))
    known = cut_lineage(known.join(touched, "dataset", "left_semi"), "known")
    statistics = cut_lineage(refresh_statistics(stored.join(known, "dataset", "left_semi"), gone,
                                                members.filter(is_valid("vector", dim)), changed, known), "statistics")
    points, proj, quarantine = build_maps(members, labels, dim, projection=fit_statistics(statistics))
    points = points.join(new_gen, "dataset")
    w = {"partitionOverwriteMode": "dynamic"}
    tables = {"points": points.drop("unit"), "unit_vectors": points.select("dataset", "generation", "idx", "unit"),
              "projection": proj.join(new_gen, "dataset"), "statistics": statistics.join(new_gen, "dataset")}
    for name in TABLES:
        (tables[name].write.mode("overwrite").options(**w).partitionBy("dataset", "generation")
         .parquet(f"{root}/maps/{name}"))
    # Last, so that readers only see generations whose tables are written; a dataset that lost all
    # its rows gets one without points.
    new_gen.write.mode("append").parquet(f"{root}/maps/generations")
    return report | {"vectors_written": vecs.count(), "datasets_rebuilt": touched.count(), "quarantined": quarantine.count()}
