"""The slug index (JOIN-7): which ids claim which slug.

The projects are stored by hackathon, so the UNIQUE rule on slugs would need
every slug of the store for each batch. The index is a table ``(slug, id)``
partitioned by a hash of the slug: a batch asks, and changes, only the buckets
of the slugs it removes or adds. A slug is claimed by every id that has it, so
the index also answers for stores that hold conflicts already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmap.session import bounded_rows, cut_lineage

SLUG_BUCKETS = 64


def slug_bucket(buckets: int = SLUG_BUCKETS, slug: str = "slug") -> Column:
    return F.pmod(F.xxhash64(F.col(slug)), F.lit(buckets)).cast("int")


def build_slug_index(projects: DataFrame, path: str, buckets: int = SLUG_BUCKETS) -> None:
    """The index of a whole store, for its first time."""
    (projects.select("slug", "id").filter("slug IS NOT NULL AND id IS NOT NULL").distinct()
     .withColumn("bucket", slug_bucket(buckets)).repartition("bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def slug_changes(before: DataFrame, after: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The claims ``(slug, id)`` that go and come between two states of the same
    partitions. A slug that stays with its id is in neither."""
    a, b = (cut_lineage(df.select("slug", F.col(key).alias("id")).filter("slug IS NOT NULL AND id IS NOT NULL").distinct(), name)
            for df, name in ((before, "slugs-before"), (after, "slugs-after")))       # each state is computed once
    return (cut_lineage(a.join(b, ["slug", "id"], "left_anti"), "slugs-gone"),
            cut_lineage(b.join(a, ["slug", "id"], "left_anti"), "slugs-come"))


def claims(spark: SparkSession, path: str, slugs: DataFrame, buckets: int = SLUG_BUCKETS) -> DataFrame:
    """The stored claims on ``slugs(slug)``. Their buckets -- at most as many as
    there are -- go into the scan as a partition filter."""
    asked = slugs.select("slug").distinct()
    found = [r[0] for r in bounded_rows(asked.select(slug_bucket(buckets).alias("b")).distinct(), buckets, "slug buckets")]
    index = spark.read.schema("slug string, id long, bucket int").parquet(path)
    return index.filter(F.col("bucket").isin(found)).join(asked, "slug", "left_semi").select("slug", "id")


def conflicting_claims(path: str, removed: DataFrame, added: DataFrame, buckets: int = SLUG_BUCKETS) -> DataFrame:
    """JOIN-7: ``(slug, n_ids, min_id, max_id)`` of the slugs in ``added`` that more
    than one id would claim after the change."""
    kept = claims(added.sparkSession, path, added, buckets).join(removed, ["slug", "id"], "left_anti")
    rows = kept.unionByName(added.select("slug", "id")).distinct()
    g = rows.groupBy("slug").agg(F.count(F.lit(1)).alias("n_ids"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))
    return g.filter("n_ids > 1")


def check_claims(path: str, removed: DataFrame, added: DataFrame, buckets: int = SLUG_BUCKETS) -> None:
    bad = conflicting_claims(path, removed, added, buckets).limit(1).collect()
    if bad:
        raise ValueError(f"slug {bad[0]['slug']!r} is claimed by {bad[0]['n_ids']} ids")


def update_slug_index(path: str, removed: DataFrame, added: DataFrame, buckets: int = SLUG_BUCKETS) -> dict:
    """Rewrite the buckets of the claims that go or come, and no other."""
    from corpusmap.sources.store import rewrite_partitions
    moved = removed.select("slug").unionByName(added.select("slug")).distinct()
    come = added.select("slug", "id").withColumn("bucket", slug_bucket(buckets))

    def change(current: DataFrame) -> DataFrame:
        left = current.join(removed.select("slug", "id"), ["slug", "id"], "left_anti")
        return left.select("slug", "id", "bucket").unionByName(come).distinct()

    return rewrite_partitions(path, moved, change, "bucket", "slug", extra_partitions=come,
                              bucket=("bucket", slug_bucket(buckets), buckets))
