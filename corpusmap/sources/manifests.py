"""Crawl manifests and page bookkeeping (SRC-7, SRC-10, SRC-11, SRC-13, SET-1,
PRJ-2, TOP-4).

There is no network here: a manifest is the table of URLs a crawler would
request, computed from what earlier responses said (page counts, totals).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endpoint formats and limits of the two remote listings.
REPO_SEARCH_URL = ("https://api.github.com/search/repositories?q=stars:%s&sort=stars&order=desc"
                   "&per_page=100&page=%d")
README_URL = "https://api.github.com/repos/%s/readme"
EVENT_LISTING_URL = "https://devpost.com/api/hackathons?page=%d&per_page=%d"
EVENT_SEARCH_URL = EVENT_LISTING_URL + "&search=%s"
GALLERY_URL = "https://%s.devpost.com/project-gallery?page=%d"
PROJECT_URL = "https://devpost.com/software/%s"
STAR_WINDOWS = [(50000, None), (40000, 49999), (30000, 39999)]
EVENT_PAGE_SIZE = 40
GALLERY_CARDS_PER_PAGE = 24


def star_range(lo: Column, hi: Column) -> Column:
    """``a..*`` for an open window, ``a..b`` otherwise."""
    return F.when(hi.isNull(), F.concat(lo.cast("string"), F.lit("..*"))) \
        .otherwise(F.concat(lo.cast("string"), F.lit(".."), hi.cast("string")))


def windows_frame(spark, windows=STAR_WINDOWS) -> DataFrame:
    return spark.createDataFrame([(lo, hi) for lo, hi in windows], "lo long, hi long")


def repo_manifest(windows: DataFrame, cap: int | None = None) -> DataFrame:
    """SRC-10: ``windows(lo, hi, page_count)`` -> one row per search page
    ``1 .. page_count`` with its URL; ``cap`` is the host's limit on pages of
    one search (the public search serves 10 pages of 100), none by default."""
    w = windows.withColumn("window", star_range(F.col("lo"), F.col("hi")))
    pages = F.sequence(F.lit(1), F.greatest(F.col("page_count") if cap is None else F.least(F.col("page_count"), F.lit(cap)),
                                          F.lit(1)))
    return (w.select("window", "lo", "hi", F.explode(pages).alias("page"))
            .withColumn("url", F.format_string(REPO_SEARCH_URL, F.col("window"), F.col("page"))))


def star_windows_union(rows: DataFrame, windows=STAR_WINDOWS, stars_col: str = "stars") -> DataFrame:
    """SET-1: the rows of each star window, unioned; the windows are disjoint,
    a name in two windows (stars moved between passes) is resolved later by
    the upsert."""
    out = None
    for lo, hi in windows:
        cond = F.col(stars_col) >= lo if hi is None else F.col(stars_col).between(lo, hi)
        part = rows.filter(cond).withColumn("window", star_range(F.lit(lo), F.lit(hi).cast("long")))
        out = part if out is None else out.unionByName(part)
    return out


def readme_urls(repos: DataFrame) -> DataFrame:
    """PRJ-2: README request per repo name."""
    return repos.select("name", F.format_string(README_URL, F.col("name")).alias("url"))


def project_urls(projects: DataFrame) -> DataFrame:
    """PRJ-2: project page per slug."""
    return projects.select("id", "slug", F.format_string(PROJECT_URL, F.col("slug")).alias("url"))


def gallery_manifest(hosts: DataFrame, cap: int | None = None) -> DataFrame:
    """SRC-11: ``hosts(host, cards)`` -> gallery pages ``1 .. ceil(cards/24)+1``
    (the walk reads one page past the end, which comes back empty), at most
    ``cap`` if the caller sets one."""
    n = (F.ceil(F.col("cards") / F.lit(GALLERY_CARDS_PER_PAGE)) + 1).cast("int")
    pages = F.sequence(F.lit(1), n if cap is None else F.least(n, F.lit(cap)))
    return (hosts.select("host", F.explode(pages).alias("page"))
            .withColumn("url", F.format_string(GALLERY_URL, F.col("host"), F.col("page"))))


def listing_manifest(listings: DataFrame, per_page_col: str = "per_page", total_col: str = "total_count") -> DataFrame:
    """SRC-11: every page of the event listing, from what page 1 reported:
    ``1 .. ceil(total / per_page)`` (the page size *served*, at least 1 page)."""
    per = F.greatest(F.col(per_page_col), F.lit(1))
    n = F.greatest(F.ceil(F.col(total_col) / per).cast("int"), F.lit(1))
    return (listings.select(F.explode(F.sequence(F.lit(1), n)).alias("page"))
            .withColumn("url", F.format_string(EVENT_LISTING_URL, F.col("page"), F.lit(EVENT_PAGE_SIZE))))


def search_manifest(names: DataFrame, name_col: str = "label") -> DataFrame:
    """SRC-11: first search page per hackathon name (search term = SCA-9 form;
    later pages follow from the total that page reports, like the listing)."""
    from corpusmap.functions.text import query_form
    term = query_form(F.col(name_col))
    return names.select(F.col(name_col).alias("name"), F.lit(1).alias("page"),
                        F.format_string(EVENT_SEARCH_URL, F.lit(1), F.lit(EVENT_PAGE_SIZE), term).alias("url"))


def is_last_page(page: Column, per_page: Column, total: Column) -> Column:
    """SRC-7: a listing is done when ``per_page <= 0`` or ``page * per_page >= total``."""
    return (per_page <= 0) | (page * per_page >= total)


def limit_events(events: DataFrame, max_hackathons: int, order_cols: list[str]) -> DataFrame:
    """TOP-4: at most ``max_hackathons`` events (negative = all)."""
    return events if max_hackathons < 0 else events.orderBy(*order_cols).limit(max_hackathons)


def contiguous_pages(pages: DataFrame, group_col: str = "host", policy: str = "keep_prefix",
                     cap: int | None = None) -> DataFrame:
    """SRC-13: which fetched pages count.

    ``pages(group, page, ok, cards)``. A walk starts at page 1 and stops at the
    first failed page, the first page with no cards, the first missing page
    number, or past ``cap`` (none by default). ``keep_prefix`` keeps the pages before the stop;
    ``all_or_nothing`` drops a group whole when any of its pages failed.

    Computed with aggregates and one anti join (no per-group window), so a
    group with millions of pages is still spread over many tasks.
    """
    bad = F.when(~F.col("ok") | (F.col("cards") <= 0), F.col("page"))
    first_bad = pages.groupBy(group_col).agg(F.min(bad).alias("first_bad"),
                                             F.max(F.when(~F.col("ok"), F.lit(1))).alias("any_failed"),
                                             F.min("page").alias("first_page"))
    present = pages.select(group_col, "page").distinct()
    nxt = present.select(group_col, (F.col("page") + 1).alias("page"))
    missing = (nxt.join(present, [group_col, "page"], "left_anti")
               .groupBy(group_col).agg(F.min("page").alias("first_gap")))
    stops = first_bad.join(missing, group_col, "left")
    beyond = F.lit((1 << 62) if cap is None else cap + 1).cast("long")
    stop = F.least(F.coalesce(F.col("first_bad").cast("long"), beyond), F.coalesce(F.col("first_gap").cast("long"), beyond),
                   beyond)
    stop = F.when(F.col("first_page") != 1, F.lit(1)).otherwise(stop)
    j = pages.join(stops.select(group_col, stop.alias("stop_page"), "any_failed"), group_col)
    keep = F.col("page") < F.col("stop_page")
    if policy == "all_or_nothing":
        keep = keep & F.col("any_failed").isNull()
    elif policy != "keep_prefix":
        raise ValueError(policy)
    return j.withColumn("kept", keep).drop("any_failed")
