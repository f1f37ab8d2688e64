"""The gallery walk as state that outlives micro-batches (STR-1, SRC-13).

A walk asks for page 1, 2, 3 ... of a gallery and ends at the first failed page,
the first page without a card, or a cap. What counts are the pages before its
end. Responses land in any order and over many batches, so a page can only be
used once every page before it is known to be good:

* ``progress`` has one row per gallery: its newest ``walk``, the ``next_page`` it
  waits for, and ``ended`` (``failed``, ``empty``, ``cap`` or null);
* ``held`` has the pages that came before their turn.

``advance`` joins a batch with both and splits it: pages to use now, pages to
hold, and the new progress. A page after the end of its walk, of an older walk, or
one that was used already, is dropped. With ``all_or_nothing`` a walk's pages are
held until it ends well and dropped if it fails.

The state is a pair of tables per epoch under a shared folder. An epoch that is
run again reads the state before it, so it takes the same pages again, which the
idempotent upsert does not mind. A gallery with very many pages is many rows
that any number of tasks share; nothing is kept in a task between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmap.functions.text import regex_literal, text_between
from corpusmap.session import cut_lineage
from corpusmap.sources.manifests import contiguous_pages
from corpusmap.sources.pages import CARD, SLUG

HELD = "hackathon string, walk long, page long, status int, html string"
PROGRESS = "hackathon string, walk long, next_page long, ended string"


def card_count(html) -> "F.Column":
    """Cards with a project link on a gallery page: what ends a walk when 0."""
    parts = F.split(html, regex_literal(CARD))
    linked = F.filter(parts, lambda t, i: (i > 0) & text_between(t, SLUG, '"').isNotNull())
    return F.coalesce(F.size(linked), F.lit(0)).cast("long")


def accepted() -> "F.Column":
    return F.coalesce(F.col("status").between(200, 299), F.lit(False))


def advance(pages: DataFrame, held: DataFrame, progress: DataFrame, policy: str = "keep_prefix",
            cap: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(use, held, progress)`` after ``pages(hackathon, page, status, html[, walk])``.

    A page that came more than once in a walk counts once, an accepted response
    before a failed one. Pages without a gallery or number are dropped."""
    if policy not in ("keep_prefix", "all_or_nothing"):
        raise ValueError(policy)
    walk = F.col("walk").cast("long") if "walk" in pages.columns else F.lit(0).cast("long")
    new = pages.select("hackathon", walk.alias("walk"), F.col("page").cast("long"), F.col("status").cast("int"), "html")
    rows = (held.unionByName(new).filter("hackathon IS NOT NULL AND page > 0 AND walk IS NOT NULL")
            .groupBy("hackathon", "walk", "page")
            .agg(F.max_by(F.struct("status", "html"), F.struct(accepted(), F.xxhash64("html"))).alias("r"))
            .select("hackathon", "walk", "page", "r.*"))
    before = progress.select("hackathon", F.col("walk").alias("_walk"), F.col("next_page").alias("_next"), F.col("ended").alias("_ended"))
    newest = rows.groupBy("hackathon").agg(F.max("walk").alias("_newest"))
    later = F.col("_walk").isNull() | (F.col("walk") > F.col("_walk"))
    rows = (rows.join(newest, "hackathon").join(before, "hackathon", "left")
            .filter((F.col("walk") == F.col("_newest")) & F.coalesce(F.col("walk") >= F.col("_walk"), F.lit(True)))
            .withColumn("first", F.when(later, 1).otherwise(F.col("_next")).cast("long"))
            .filter((later | F.col("_ended").isNull()) & (F.col("page") >= F.col("first")))
            .select("hackathon", "walk", "page", "status", "html", "first", accepted().alias("ok"),
                    card_count(F.col("html")).alias("cards")))
    rows = cut_lineage(rows, "walk-pages")

    # the stop rule of SRC-13 on pages counted from the one the walk waits for
    narrow = rows.select("hackathon", (F.col("page") - F.col("first") + 1).alias("page"), "ok", "cards")
    stops = contiguous_pages(narrow, "hackathon").select("hackathon", "stop_page").distinct()
    judged = rows.join(stops, "hackathon").withColumn("stop", F.col("stop_page") + F.col("first") - 1).drop("stop_page")
    if cap is not None:
        judged = judged.withColumn("stop", F.least(F.col("stop"), F.lit(cap + 1).cast("long")))
    at_stop = F.col("page") == F.col("stop")
    bad = ~F.col("ok") | (F.col("cards") <= 0)
    walks = judged.groupBy("hackathon", "walk", "first", "stop").agg(
        F.max(F.when(at_stop & bad, F.when(~F.col("ok"), "failed").otherwise("empty"))).alias("ended"))
    if cap is not None:
        walks = walks.withColumn("ended", F.coalesce("ended", F.when(F.col("stop") > cap, F.lit("cap"))))
    walks = cut_lineage(walks, "walks")
    ended = F.col("ended").isNotNull()
    if policy == "keep_prefix":
        at, use, wait = F.col("stop"), F.col("page") < F.col("stop"), (F.col("page") > F.col("stop")) & ~ended
    else:
        at = F.when(ended, F.col("stop")).otherwise(F.col("first"))
        use, wait = (F.col("page") < F.col("stop")) & F.coalesce(F.col("ended") != "failed", F.lit(False)), ~ended
    rows = rows.join(walks.select("hackathon", "stop", "ended"), "hackathon")
    columns = ["hackathon", "walk", "page", "status", "html"]
    moved = walks.select("hackathon", "walk", at.alias("next_page"), "ended")
    kept = progress.join(moved, "hackathon", "left_anti")
    return rows.filter(use).select(*columns), rows.filter(wait).select(*columns), kept.unionByName(moved)


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class WalkState:
    """The epochs of ``held`` and ``progress`` under ``root``."""

    def __init__(self, spark: SparkSession, root: str, policy: str = "keep_prefix", cap: int | None = None):
        self.spark, self.root, self.policy, self.cap = spark, root, policy, cap

    def epochs(self) -> list[int]:
        """Whole epochs, ascending (``progress`` is written last)."""
        where, fs = _fs(self.spark, self.root)
        if not fs.exists(where):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        found = sorted(int(n.split("=")[1]) for n in names if n.startswith("epoch="))
        return [e for e in found if fs.exists(_fs(self.spark, f"{self.root}/epoch={e}/progress/_SUCCESS")[0])]

    def read(self, before: int) -> tuple[DataFrame, DataFrame]:
        """The state that epoch ``before`` starts from."""
        last = [e for e in self.epochs() if e < before]
        if not last:
            return self.spark.createDataFrame([], HELD), self.spark.createDataFrame([], PROGRESS)
        path = f"{self.root}/epoch={last[-1]}"
        return self.spark.read.schema(HELD).parquet(f"{path}/held"), self.spark.read.schema(PROGRESS).parquet(f"{path}/progress")

    def step(self, pages: DataFrame, epoch: int | None = None) -> tuple[DataFrame, "callable"]:
        """Pages to use now, and ``done()``, which writes the epoch's state;
        call it after the pages were used. Epochs before the last one go."""
        known = self.epochs()
        epoch = (known[-1] + 1 if known else 0) if epoch is None else epoch
        use, held, progress = advance(pages, *self.read(epoch), self.policy, self.cap)

        def done():
            held.write.mode("overwrite").parquet(f"{self.root}/epoch={epoch}/held")
            progress.write.mode("overwrite").parquet(f"{self.root}/epoch={epoch}/progress")
            for old in [e for e in known if e < epoch][:-1]:
                where, fs = _fs(self.spark, f"{self.root}/epoch={old}")
                fs.delete(where, True)
        return use, done
