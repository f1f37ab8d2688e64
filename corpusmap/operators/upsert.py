"""Upserts and write-backs (JOIN-1, JOIN-2, JOIN-3, JOIN-4, JOIN-7).

An upsert is one shuffle: the stored rows (tagged ``ord = 0``) and the incoming
batch rows (``ord >= 1``, unique per key) are unioned and grouped by the key.
Every output column is a partial aggregate (``max_by``, ``min``, ``max``,
``bool_and``, counts), so rows are combined map-side and a key with millions of
incoming rows never has to be held in one buffer.

Folding a batch in ``ord`` order reproduces the row-at-a-time rules:

* repos (key ``name``): ``desc, stars, topics`` take the last row's values;
  ``id`` and ``vector`` are never touched; new names get ids after the current
  maximum in arrival order (their first ``ord``; name breaks ties), as an
  auto-increment key would.
* projects (key ``id``): scalars take the last row's values; ``hackathon`` and
  ``year`` take the last non-null incoming value, else the stored one (a
  ``year <= 0`` counts as null); ``prizes`` survive only when every incoming
  row is a winner or no incoming row differs from the stored one.

``action`` is ``insert`` / ``update`` / ``unchanged`` against the stored row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.session import dense_index

REPO_FIELDS = ["desc", "stars", "topics"]
PROJECT_SCALARS = ["slug", "name", "tagline", "likes", "members", "winner"]


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def _short(c: Column, text: bool) -> Column:
    """A text of 64 or more characters as its sha256 (64 characters, which no
    shorter text equals): comparisons then carry no long texts."""
    return F.when(F.length(c) >= 64, F.sha2(c, 256)).otherwise(c) if text else c


def _all_equal_to(col: str, stored: Column, only_non_null: bool = False, text: bool = False) -> Column:
    """Aggregate: every incoming (``ord > 0``) value of ``col`` equals ``stored``
    null-safely (or, with ``only_non_null``, every non-null incoming value)."""
    inc = F.col("_inc")
    v, stored = F.when(inc, _short(F.col(col), text)), _short(stored, text)
    n_in = F.count_if(inc)
    n_nn = F.count(v)
    same_val = (F.min(v).eqNullSafe(stored)) & (F.max(v).eqNullSafe(stored))
    if only_non_null:
        return (n_nn == 0) | same_val
    return ((n_nn == 0) & stored.isNull()) | ((n_nn == n_in) & same_val)


def upsert_repos(stored: DataFrame, batch: DataFrame, refresh_on_change: bool = False,
                 max_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """JOIN-1. Returns ``(state, rejects)``; ``state`` has every stored and new
    repo with ``action``. Rows with a NULL name are rejected. An edited repo
    keeps its vector unless ``refresh_on_change`` (then it is embedded again).
    New ids follow ``max_id`` (default: the largest id in ``stored``; pass the
    whole store's maximum when ``stored`` is only part of it)."""
    rejects = batch.filter(F.col("name").isNull()).withColumn("reason", F.lit("null name"))
    s = stored.select("name", "id", *REPO_FIELDS, "vector", F.lit(0).cast("long").alias("ord"))
    b = (batch.filter(F.col("name").isNotNull())
         .select("name", F.lit(None).cast("long").alias("id"), *REPO_FIELDS,
                 F.lit(None).cast(stored.schema["vector"].dataType).alias("vector"),
                 F.col("ord").cast("long")))
    u = s.unionByName(b).withColumn("_inc", F.col("ord") > 0)
    # one aggregate a column, so that the numbering of new names moves no texts
    old = {c: F.max_by(c, F.when(~F.col("_inc"), F.lit(1))) for c in ["id", *REPO_FIELDS, "vector"]}
    last = {c: F.max_by(c, F.when(F.col("_inc"), F.col("ord"))) for c in REPO_FIELDS}
    g = u.groupBy("name").agg(*[v.alias(f"_old_{c}") for c, v in old.items()], *[v.alias(f"_last_{c}") for c, v in last.items()],
                              F.min(F.when(F.col("_inc"), F.col("ord"))).alias("_first_ord"),
                              F.count_if(~F.col("_inc")).alias("n_old"), F.count_if("_inc").alias("n_new"))
    fields = {f: F.when(F.col("n_new") > 0, F.col(f"_last_{f}")).otherwise(F.col(f"_old_{f}")) for f in REPO_FIELDS}
    changed = F.lit(False)
    for f in REPO_FIELDS:
        changed = changed | _differs(F.col(f"_old_{f}"), F.col(f"_last_{f}"))
    action = (F.when(F.col("n_old") == 0, "insert")
              .when((F.col("n_new") > 0) & changed, "update").otherwise("unchanged"))
    vector = F.col("_old_vector")
    if refresh_on_change:
        vector = F.when(action != "update", vector)
    state = g.select("name", F.col("_old_id").alias("id"), *[c.alias(f) for f, c in fields.items()],
                     vector.alias("vector"), action.alias("action"))
    if max_id is None:
        max_id = stored.agg(F.max("id")).first()[0] or 0
    # new names are not null and stand once in g, so they can be looked up
    new = g.filter(F.col("n_old") == 0).select("name", "_first_ord")
    ids = dense_index(new, ["_first_ord", "name"], name="_new_id", start=int(max_id) + 1).select("name", "_new_id")
    state = state.join(ids, "name", "left").withColumn("id", F.when(F.col("action") == "insert", F.col("_new_id")).otherwise(F.col("id")))
    return state.select("id", "name", *REPO_FIELDS, "vector", "action"), rejects


def upsert_projects(stored: DataFrame, batch: DataFrame, refresh_on_change: bool = False) -> DataFrame:
    """JOIN-2 final state with ``action`` (stored rows untouched by the batch
    come out ``unchanged``). An edited project keeps its vector unless
    ``refresh_on_change`` (then its vector is cleared and it is pending again)."""
    vec_t = stored.schema["vector"].dataType
    prize_t = stored.schema["prizes"].dataType
    s = stored.select("id", *PROJECT_SCALARS, "hackathon", "year", "vector", "prizes",
                      F.lit(0).cast("long").alias("ord"))
    b = batch.select("id", *PROJECT_SCALARS, "hackathon",
                     F.when(F.col("year") > 0, F.col("year")).cast("int").alias("year"),
                     F.lit(None).cast(vec_t).alias("vector"), F.lit(None).cast(prize_t).alias("prizes"),
                     F.col("ord").cast("long"))
    u = s.unionByName(b).withColumn("_inc", F.col("ord") > 0)
    inc = F.col("_inc")
    # one aggregate a column, so that a reader of few columns moves no others;
    # all follow the same order, so they take their values from the same row
    fields = PROJECT_SCALARS + ["hackathon", "year", "vector", "prizes"]
    stored_of = {c: F.max_by(c, F.when(~inc, F.lit(1))) for c in fields}
    last = {c: F.max_by(c, F.when(inc, F.col("ord"))) for c in PROJECT_SCALARS}
    last_h = F.max_by("hackathon", F.when(inc & F.col("hackathon").isNotNull(), F.col("ord")))
    last_y = F.max_by("year", F.when(inc & F.col("year").isNotNull(), F.col("ord")))
    # Per-column "every incoming value equals the stored one": the stored value
    # is itself an aggregate, so compare min/max of incoming values against the
    # stored row's value taken with max_by.
    texts = {f.name for f in s.schema.fields if f.dataType.simpleString() == "string"}
    same = F.lit(True)
    for c in PROJECT_SCALARS:
        same = same & _all_equal_to(c, stored_of[c], text=c in texts)
    for c in ("hackathon", "year"):
        same = same & _all_equal_to(c, stored_of[c], only_non_null=True, text=c in texts)
    g = u.groupBy("id").agg(
        *[v.alias(f"_old_{c}") for c, v in stored_of.items()], *[v.alias(f"_last_{c}") for c, v in last.items()], last_h.alias("last_h"), last_y.alias("last_y"),
        F.count_if(~inc).alias("n_old"), F.count_if(inc).alias("n_new"),
        F.coalesce(F.bool_and(F.when(inc, F.coalesce(F.col("winner"), F.lit(False)))), F.lit(True)).alias("all_win"),
        same.alias("no_diff"))
    has_new = F.col("n_new") > 0
    out = {c: F.when(has_new, F.col(f"_last_{c}")).otherwise(F.col(f"_old_{c}")) for c in PROJECT_SCALARS}
    out["hackathon"] = F.coalesce(F.col("last_h"), F.col("_old_hackathon"))
    out["year"] = F.coalesce(F.col("last_y"), F.col("_old_year"))
    out["vector"] = F.col("_old_vector")
    keep_prizes = (~has_new) | F.col("all_win") | F.col("no_diff")
    out["prizes"] = F.when((F.col("n_old") > 0) & keep_prizes, F.col("_old_prizes"))
    compared = PROJECT_SCALARS + ["hackathon", "year", "prizes"]
    sel = g.select("id", *[c.alias(k) for k, c in out.items()], "n_old", *[f"_old_{c}" for c in compared])
    changed = F.lit(False)
    for c in compared:
        changed = changed | _differs(F.col(c), F.col(f"_old_{c}"))
    action = F.when(F.col("n_old") == 0, "insert").when(changed, "update").otherwise("unchanged")
    out_df = sel.withColumn("action", action).drop("n_old", *[f"_old_{c}" for c in compared])
    if refresh_on_change:
        out_df = out_df.withColumn("vector", F.when(F.col("action") != "update", F.col("vector")))
    return out_df


def slug_conflicts(projects: DataFrame) -> DataFrame:
    """JOIN-7: slugs claimed by more than one id (the UNIQUE constraint).
    Two aggregates on ``slug``; no group is ever collected."""
    g = projects.groupBy("slug").agg(F.countDistinct("id").alias("n_ids"),
                                     F.min("id").alias("min_id"), F.max("id").alias("max_id"))
    return g.filter(F.col("n_ids") > 1)


def assert_no_conflicts(projects: DataFrame) -> None:
    bad = slug_conflicts(projects).limit(1).collect()
    if bad:
        raise ValueError(f"slug {bad[0]['slug']!r} is claimed by {bad[0]['n_ids']} ids")


def write_vectors(store: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """JOIN-3: ``vector = coalesce(new, old)`` by key (left join on the key)."""
    v = vectors.select(key, F.col("vector").alias("_new"))
    return (store.join(v, key, "left")
            .withColumn("vector", F.coalesce(F.col("_new"), F.col("vector"))).drop("_new"))


def write_prizes(projects: DataFrame, fetched: DataFrame, only_winners: bool = True) -> DataFrame:
    """JOIN-4: prizes written back by id; during the embedding pass only onto
    winners, in the catch-up pass onto every pre-selected id. A failed fetch
    (NULL prizes) leaves the stored value, so it is retried."""
    f = fetched.select("id", F.col("prizes").alias("_new"))
    j = projects.join(f, "id", "left")
    ok = F.col("_new").isNotNull()
    if only_winners:
        ok = ok & F.coalesce(F.col("winner"), F.lit(False))
    return j.withColumn("prizes", F.when(ok, F.col("_new")).otherwise(F.col("prizes"))).drop("_new")


PARTS = 4


def project_part(parts: int = PARTS, key: str = "id"):
    """Part of a project within its hackathon's folder: a hash of its id. Few
    parts suffice for small stores; the number is fixed when a store is made."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")


def _layout(store_path: str, spark, partition_col: str, parts: int) -> list[str]:
    """The partition columns of a store: with parts, if it was written so."""
    return [partition_col, "part"] if "part" in spark.read.parquet(store_path).columns else [partition_col]


def upsert_into_store(store_path: str, batch: DataFrame, partition_col: str = "hackathon",
                      key: str = "id", strict: bool = False, index_path: str | None = None, parts: int = PARTS) -> dict:
    """JOIN-2 applied to a Parquet store partitioned by ``partition_col``, and by
    ``part`` if the store was written so, rewriting only the partitions the
    batch touches: those holding a stored row whose key is in the batch, plus
    those the batch's rows name (see ``rewrite_partitions``). The upsert is
    idempotent, so a retried micro-batch leaves the same store.

    With ``strict`` a batch that would leave two ids claiming one slug (JOIN-7)
    is refused before anything is written. With ``index_path`` the slug index
    there answers that, reading only the buckets of the slugs in question, and
    follows the change (before the store, so a retry finds the same
    difference); without it all slugs of the store are read. Returns
    touched-partition and per-action counts."""
    from corpusmap.operators.slugs import check_claims, slug_changes, update_slug_index
    from corpusmap.sources.store import rewrite_partitions
    cols = _layout(store_path, batch.sparkSession, partition_col, parts)
    two = len(cols) == 2

    def change(current: DataFrame) -> DataFrame:
        state = upsert_projects(current, batch)
        return state.withColumn("part", project_part(parts, key)) if two else state

    def check(new_state: DataFrame, stored: DataFrame, touched: DataFrame, current: DataFrame) -> None:
        if index_path:
            removed, added = slug_changes(current, new_state, key)
            if strict:
                check_claims(index_path, removed, added)
            update_slug_index(index_path, removed, added)
        elif strict:
            # the batch's final slugs against every other row of the store: the
            # rewritten partitions from the new state, the rest as stored
            # (only the slug and id columns are read)
            slugs = new_state.join(batch.select(key).distinct(), key, "left_semi").select("slug").distinct()
            same = stored[cols[0]].eqNullSafe(touched[cols[0]])
            for c in cols[1:]:
                same = same & stored[c].eqNullSafe(touched[c])
            rows = new_state.select("slug", key).unionByName(stored.join(touched, same, "left_anti").select("slug", key))
            assert_no_conflicts(rows.join(slugs, "slug", "left_semi"))

    named = batch.withColumn("part", project_part(parts, key)) if two else batch
    return rewrite_partitions(store_path, batch, change, cols, key, extra_partitions=named, check=check,
                              bucket=("part", project_part(parts, key), parts) if two else None)


REPO_BUCKETS = 64


def repo_bucket(name_col: str = "name", buckets: int = REPO_BUCKETS):
    """Storage bucket of a repo: a hash of its name (the repo table has no
    natural partition key)."""
    return F.pmod(F.xxhash64(F.col(name_col)), F.lit(buckets)).cast("int")


def upsert_repos_into_store(store_path: str, batch: DataFrame, buckets: int = REPO_BUCKETS) -> dict:
    """JOIN-1 on a repo store partitioned by ``bucket`` (hash of the name):
    only the buckets holding the batch's names are rewritten. New ids come
    after the largest id of the whole store (read from the ``id`` column
    only)."""
    from corpusmap.sources.store import rewrite_partitions
    spark = batch.sparkSession
    max_id = spark.read.parquet(store_path).agg(F.max("id")).first()[0] or 0
    keyed = batch.filter(F.col("name").isNotNull()).withColumn("bucket", repo_bucket("name", buckets))

    def change(current):
        state, _ = upsert_repos(current.drop("bucket"), keyed.drop("bucket"), max_id=int(max_id))
        return state.withColumn("bucket", repo_bucket("name", buckets))

    return rewrite_partitions(store_path, keyed, change, partition_col="bucket", key="name",
                              extra_partitions=keyed)


def write_vectors_into_store(store_path: str, vectors: DataFrame, partition_col: str = "hackathon",
                             key: str = "id", parts: int = PARTS) -> dict:
    """JOIN-3 on a partitioned store: only partitions holding a written id are
    rewritten."""
    return write_back(store_path, vectors, None, partition_col, key, parts)


def write_back(store_path: str, vectors: DataFrame, prizes: DataFrame | None = None, partition_col: str = "hackathon",
               key: str = "id", parts: int = PARTS) -> dict:
    """JOIN-3 and, with ``prizes``, JOIN-4 in one rewrite of the partitions that
    hold a row of either."""
    from corpusmap.sources.store import rewrite_partitions
    cols = _layout(store_path, vectors.sparkSession, partition_col, parts)
    keys = vectors.select(key) if prizes is None else vectors.select(key).unionByName(prizes.select(key))

    def change(current: DataFrame) -> DataFrame:
        state = write_vectors(current, vectors, key)
        return state if prizes is None else write_prizes(state, prizes)

    return rewrite_partitions(store_path, keys, change, cols, key,
                              bucket=("part", project_part(parts, key), parts) if len(cols) == 2 else None)
