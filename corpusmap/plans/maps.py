"""Dataset maps and query answers (STR-3, STR-4, STR-5, VEC-8, SRC-17).

``build_maps`` refreshes every dataset in one job:

  membership (SET-2) -> validity (VEC-1, bad rows to quarantine)
    -> per-dataset mean / scatter / basis (AGG-1..3, one grouped pass)
    -> point index (AGG-7) -> position (VEC-3/4) -> category (VEC-6)

``answer_queries`` places new vectors on the *stored* maps: position with the
stored mean and basis (old points do not move), the k nearest stored points by
cosine in the full dimension, and the category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.vectors import invalid_reason, is_valid, l2_normalize
from corpusmap.operators.encoders import hashing_vectors
from corpusmap.operators.projection import changed_statistics, fit_projection, merge_statistics, project
from corpusmap.operators.selection import parse_dataset_path, point_columns, point_index, validate_queries
from corpusmap.operators.similarity import NEAREST_K, categorize, nearest
from corpusmap.session import cut_lineage


def build_maps(members: DataFrame, labels, dim: int, materialize: bool = True,
               projection: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns ``(points, projection, quarantine)``.

    points: ``(dataset, idx, id, x, y, z, category, similarity, unit)`` plus the
    membership's other columns; projection: ``(dataset, n, mean, basis,
    eigenvalues)``; quarantine: member rows with an invalid vector.

    The valid members are read three times (Gram pass, positions, categories),
    so by default they are written once -- range-partitioned and numbered in
    the same pass (AGG-7) -- to the shared checkpoint folder, which also cuts
    the lineage of the joins that produced them; the projection (one small row
    per dataset) is written right after the fit, so every later reader --
    positions now, query answers later -- reuses it instead of refitting. A
    ``projection`` fitted elsewhere (from stored statistics) is used as it is.
    """
    ok = is_valid("vector", dim)
    good = members.filter(ok)
    quarantine = members.filter(~ok).withColumn("reason", invalid_reason("vector", dim))
    indexed = point_index(good, whole_rows=materialize)
    proj = fit_projection(indexed.drop("idx")) if projection is None else projection
    if materialize:
        proj = cut_lineage(proj)
    placed = project(indexed, proj)
    points = (categorize(placed, labels)
              .withColumn("unit", F.transform(l2_normalize("vector"), lambda x: x.cast("float"))).drop("vector"))
    return points, proj, quarantine


def with_point_fields(points: DataFrame, repos: DataFrame, projects: DataFrame) -> DataFrame:
    """STR-4: what is served about each point besides its place -- the stored
    columns of its kind (PRJ-1) as a struct ``repo`` or ``project``. Joined when
    served, so that the map tables stay narrow."""
    def fields(df: DataFrame, kind: str) -> DataFrame:
        cols = [c for c in point_columns(df).columns if c not in ("id", "hackathon", "year")]
        return point_columns(df).select(F.lit(kind).alias("kind"), "id", F.struct(*sorted(cols)).alias(kind))
    return (points.join(fields(repos, "repo"), ["kind", "id"], "left")
            .join(fields(projects, "project"), ["kind", "id"], "left"))


def touched_datasets(changed: DataFrame, *memberships: DataFrame) -> DataFrame:
    """STR-3: datasets that hold, or held before, one of the rows
    ``changed(kind, id)``. Pass the membership before and after the upsert: a
    project that moved to another hackathon touches both."""
    found = [m.select("dataset", "kind", "id").join(changed, ["kind", "id"], "left_semi").select("dataset")
             for m in memberships]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def refresh_statistics(stored: DataFrame, gone: DataFrame, members: DataFrame, changed: DataFrame,
                       known: DataFrame) -> DataFrame:
    """STR-3: bring stored statistics ``(dataset, i, row, s, n)`` up to date.

    ``gone`` are rows as they were, ``members`` the touched datasets as they are
    (both ``(dataset, kind, id, vector)``, valid vectors only), ``changed(kind,
    id)`` the rows that may differ; ``gone`` has every one of them that was there. In the ``known`` datasets only changed rows
    are folded, and of those only the ones whose place or vector differs; a
    dataset without a stored statistic is folded whole."""
    come = members.select("dataset", "kind", "id", "vector")
    rows = come.join(known, "dataset", "left_semi").join(changed, ["kind", "id"], "left_semi")
    gone = gone.select("dataset", "kind", "id", "vector").join(known, "dataset", "left_semi")

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        key = ["dataset", "kind", "id"]
        return (a.withColumn("v", F.xxhash64("vector"))
                .join(b.select(*key, F.xxhash64("vector").alias("v")), [*key, "v"], "left_anti").select("dataset", "vector"))

    come = differing(rows, gone).unionByName(come.join(known, "dataset", "left_anti").select("dataset", "vector"))
    change = changed_statistics(differing(gone, rows), come)
    return merge_statistics(stored, change)


def refresh_datasets(members: DataFrame, labels, dim: int, state: DataFrame, generations: DataFrame,
                     before: DataFrame, kind: str = "project") -> tuple[DataFrame, DataFrame]:
    """STR-3: rebuild only the maps whose rows changed; bump their generation.

    ``before`` is the membership before the upsert that gave ``state``;
    ``generations(dataset, generation)`` is the stored counter (missing = 0).
    Returns ``(points of rebuilt datasets, new generations)``; a reader takes the
    highest generation of each dataset, which has no points if the dataset
    became empty.
    """
    members = cut_lineage(members)
    before = cut_lineage(before.select("dataset", "kind", "id"))
    changed = state.filter(F.col("action").isin("insert", "update")).select(F.lit(kind).alias("kind"), "id")
    touched = cut_lineage(touched_datasets(changed, before, members), "touched")
    all_ds = members.select("dataset").union(before.select("dataset")).distinct()
    gen = (all_ds.join(generations, "dataset", "left")
           .join(touched.withColumn("_t", F.lit(True)), "dataset", "left")
           .select("dataset", (F.coalesce(F.col("generation"), F.lit(0))
                               + F.when(F.col("_t"), 1).otherwise(0)).cast("long").alias("generation"),
                   F.coalesce(F.col("_t"), F.lit(False)).alias("rebuilt")))
    # one row per dataset: AQE broadcasts these from their runtime size
    sub = members.join(touched, "dataset", "left_semi")
    points, _, _ = build_maps(sub, labels, dim, materialize=False)
    points = points.join(gen.filter("rebuilt").select("dataset", "generation"), "dataset")
    return points, gen


def answer_queries(queries: DataFrame, points: DataFrame, projection: DataFrame, labels,
                   k: int = NEAREST_K) -> DataFrame:
    """VEC-8: ``queries(query_id, dataset, vector)`` -> one row per (query,
    rank): ``x, y, z, rank, nearest_idx, nearest_id, category, similarity``
    (``nearest_similarity`` is the cosine of that neighbour). A query on a
    dataset without points is answered too: at the origin, with its category
    and no neighbour."""
    queries = cut_lineage(queries.select("query_id", "dataset", "vector"), "queries")
    placed = project(queries, projection, how="left")
    cat = categorize(placed, labels)
    nn = nearest(points.select("dataset", "id", "idx", F.col("unit").alias("vector")), queries, k=k, key_col="id",
                 group_col="dataset", extra=["idx"], written=True)
    nn = nn.select("query_id", "dataset", "rank", F.col("idx").alias("nearest_idx"),
                   F.col("id").alias("nearest_id"), F.col("similarity").alias("nearest_similarity"))
    return cat.drop("vector").join(nn, ["query_id", "dataset"], "left")


def answer_documents(answers: DataFrame, descriptions: DataFrame) -> DataFrame:
    """VEC-8 as JSON: ``{"category", "description", "nearest", "position",
    "similarity"}`` per query (keys sorted; ``nearest`` holds at most k)."""
    g = answers.groupBy("query_id", "dataset", "x", "y", "z", "category", "similarity").agg(
        F.sort_array(F.collect_list(F.struct("rank", "nearest_idx"))).alias("_nn"))
    j = g.join(descriptions, "query_id")
    return j.select("query_id", "dataset", F.to_json(F.struct(
        F.col("category"), F.col("description"),
        F.transform(F.filter("_nn", lambda s: s["nearest_idx"].isNotNull()), lambda s: s["nearest_idx"]).alias("nearest"),
        F.array("x", "y", "z").alias("position"), F.col("similarity"))).alias("document"))


def answer_text_queries(requests: DataFrame, points: DataFrame, projection: DataFrame, labels,
                        registry: DataFrame, dim: int, k: int = NEAREST_K, embed=None) -> tuple[DataFrame, DataFrame]:
    """STR-5: ``requests(query_id, path, description)`` -> answers + rejects.

    FIL-1 resolves the path (must be an ``/embed`` path of a known dataset),
    FIL-7 validates the text, EMB-2 embeds it (``embed(df, key, text_col)``, the
    hashing encoder by default), VEC-8 answers.
    """
    parsed = parse_dataset_path(requests, registry)
    checked = validate_queries(parsed, "description")
    reason = F.when(~F.col("found"), F.lit("not found")).when(~F.col("embed"), F.lit("not an embed path")) \
        .otherwise(F.col("reason"))
    tagged = checked.withColumn("reason", reason)
    rejects = tagged.filter(F.col("reason").isNotNull()).select("query_id", "path", "reason")
    good = tagged.filter(F.col("reason").isNull())
    vecs = (embed(good, "query_id", "description") if embed
            else hashing_vectors(good, "query_id", "description", dim)).select("query_id", "vector")
    q = good.select("query_id", "path", "dataset").join(vecs, "query_id", "left")
    empty = (q.filter(F.col("vector").isNull())        # the encoder found nothing to embed
             .select("query_id", "path", F.lit("nothing to embed").alias("reason")))
    q = q.filter(F.col("vector").isNotNull()).drop("path")
    return answer_queries(q, points, projection, labels, k), rejects.unionByName(empty)


def latest_generation(points: DataFrame) -> DataFrame:
    """Readers see, per dataset, only the newest generation."""
    w = points.groupBy("dataset").agg(F.max("generation").alias("_g"))
    return points.join(w, "dataset").filter(F.col("generation") == F.col("_g")).drop("_g")
