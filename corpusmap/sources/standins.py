"""Store tables derived from the driver's parquet tables (FIXTURES.md section 3).

Each stand-in is written twice: as a DataFrame builder (what the jobs read)
and as a DuckDB ``WITH`` fragment (what the independent SQL checks read). The
two must stay in step; ``tests/test_oracle.py`` compares them.

All stand-ins cover whole tables. ``doc_id % n`` only decides *which value* a
row gets (a synthetic edit), never whether a row is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

INSERT_ID_OFFSET = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- repos

def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "embeddings")
    return (d.join(e, d.doc_id == e.vec_id, "left")
            .select(d.doc_id.cast("long").alias("id"),
                    F.concat(d.source, F.lit("/"), d.doc_id.cast("string")).alias("name"),
                    d.text.alias("desc"),
                    d.n_chars.cast("long").alias("stars"),
                    F.array(d.lang, d.source).alias("topics"),
                    e.embedding.alias("vector")))


REPOS_SQL = """
repos AS (
  SELECT d.doc_id::BIGINT AS id, d.source || '/' || CAST(d.doc_id AS VARCHAR) AS name,
         d.text AS "desc", d.n_chars::BIGINT AS stars,
         [d.lang, d.source] AS topics, e.embedding AS vector
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""


def repo_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an incoming repo row (ord 1) and a later repeat (ord 2).

    Documents without a vector are new names (inserts)."""
    d = table(spark, sf_dir, "documents")
    base = d.select(
        F.concat(d.source, F.lit("/"), d.doc_id.cast("string")).alias("name"),
        F.when(d.doc_id % 4 == 0, F.lit(None).cast("string")).otherwise(d.text).alias("desc"),
        (d.n_chars + d.doc_id % 3).cast("long").alias("stars"),
        F.when(d.doc_id % 5 == 0, F.array(d.source, d.lang)).otherwise(F.array(d.lang, d.source)).alias("topics"),
        d.doc_id.alias("_doc"))
    first = base.withColumn("ord", F.lit(1).cast("long"))
    second = (base.withColumn("stars", (F.col("stars") + F.col("_doc") % 2).cast("long"))
              .withColumn("ord", F.lit(2).cast("long")))
    return first.unionByName(second).drop("_doc")


REPO_BATCH_SQL = """
repo_base AS (
  SELECT d.source || '/' || CAST(d.doc_id AS VARCHAR) AS name,
         CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.text END AS "desc",
         (d.n_chars + d.doc_id % 3)::BIGINT AS stars,
         CASE WHEN d.doc_id % 5 = 0 THEN [d.source, d.lang] ELSE [d.lang, d.source] END AS topics,
         d.doc_id AS doc
  FROM documents d),
repo_batch AS (
  SELECT name, "desc", stars, topics, 1::BIGINT AS ord FROM repo_base
  UNION ALL
  SELECT name, "desc", (stars + doc % 2)::BIGINT, topics, 2::BIGINT FROM repo_base)"""


# ---------------------------------------------------------------- projects

def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "embeddings")
    lab = table(spark, sf_dir, "labels")
    j = d.join(e, d.doc_id == e.vec_id, "left").join(lab, d.doc_id == lab.doc_id, "left")
    winner = (lab.quality == 1)
    return j.select(
        d.doc_id.cast("long").alias("id"),
        F.concat(F.lit("p-"), d.doc_id.cast("string")).alias("slug"),
        d.text.alias("name"),
        d.lang.alias("tagline"),
        (d.n_chars % 500).cast("long").alias("likes"),
        F.array(F.concat(F.lit("u"), (d.doc_id % 50).cast("string")),
                F.concat(F.lit("u"), (d.doc_id % 7).cast("string"))).alias("members"),
        e.embedding.alias("vector"),
        d.source.alias("hackathon"),
        (F.lit(2020) + d.doc_id % 5).cast("int").alias("year"),
        winner.alias("winner"),
        F.when(winner & (d.doc_id % 2 == 0), F.array(F.concat(F.lit("Best "), d.lang)))
         .otherwise(F.lit(None).cast("array<string>")).alias("prizes"))


PROJECTS_SQL = """
projects AS (
  SELECT d.doc_id::BIGINT AS id, 'p-' || CAST(d.doc_id AS VARCHAR) AS slug,
         d.text AS name, d.lang AS tagline, (d.n_chars % 500)::BIGINT AS likes,
         ['u' || CAST(d.doc_id % 50 AS VARCHAR), 'u' || CAST(d.doc_id % 7 AS VARCHAR)] AS members,
         e.embedding AS vector, d.source AS hackathon, (2020 + d.doc_id % 5)::INTEGER AS year,
         (l.quality = 1) AS winner,
         CASE WHEN l.quality = 1 AND d.doc_id % 2 = 0 THEN ['Best ' || d.lang] END AS prizes
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
                   LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def project_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming project rows: every document twice (ord 1, ord 2) with edits,
    plus every labelled document again under a new id (inserts)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, d.doc_id == lab.doc_id, "left")
    winner = F.when(d.doc_id % 7 == 0, ~(lab.quality == 1)).otherwise(lab.quality == 1)
    base = j.select(
        d.doc_id.cast("long").alias("id"),
        F.concat(F.lit("p-"), d.doc_id.cast("string")).alias("slug"),
        d.text.alias("name"),
        d.lang.alias("tagline"),
        (d.n_chars % 500 + d.doc_id % 2).cast("long").alias("likes"),
        F.array(F.concat(F.lit("u"), (d.doc_id % 50).cast("string")),
                F.concat(F.lit("u"), (d.doc_id % 7).cast("string"))).alias("members"),
        F.when(d.doc_id % 5 == 0, F.lit(None).cast("string")).otherwise(d.source).alias("hackathon"),
        (F.lit(2020) + d.doc_id % 5).cast("int").alias("year"),
        winner.alias("winner"),
        d.doc_id.alias("_doc"),
        lab.doc_id.isNotNull().alias("_labelled"))
    first = base.withColumn("ord", F.lit(1).cast("long"))
    second = (base
              .withColumn("likes", (F.col("likes") + F.col("_doc") % 3).cast("long"))
              .withColumn("hackathon", F.when(F.col("_doc") % 4 == 0, F.lit(None).cast("string"))
                          .otherwise(F.col("hackathon")))
              .withColumn("year", F.when(F.col("_doc") % 6 == 0, F.lit(0)).otherwise(F.col("year")).cast("int"))
              .withColumn("slug", F.when(F.col("_doc") % 13 == 0,
                                         F.concat(F.lit("p-"), (F.col("_doc") + 1).cast("string")))
                          .otherwise(F.col("slug")))
              .withColumn("ord", F.lit(2).cast("long")))
    inserts = (base.filter(F.col("_labelled"))
               .withColumn("id", (F.col("id") + INSERT_ID_OFFSET).cast("long"))
               .withColumn("slug", F.concat(F.lit("p-"), F.col("id").cast("string")))
               .withColumn("ord", F.lit(1).cast("long")))
    return first.unionByName(second).unionByName(inserts).drop("_doc", "_labelled")


PROJECT_BATCH_SQL = f"""
project_base AS (
  SELECT d.doc_id::BIGINT AS id, 'p-' || CAST(d.doc_id AS VARCHAR) AS slug,
         d.text AS name, d.lang AS tagline,
         (d.n_chars % 500 + d.doc_id % 2)::BIGINT AS likes,
         ['u' || CAST(d.doc_id % 50 AS VARCHAR), 'u' || CAST(d.doc_id % 7 AS VARCHAR)] AS members,
         CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE d.source END AS hackathon,
         (2020 + d.doc_id % 5)::INTEGER AS year,
         CASE WHEN d.doc_id % 7 = 0 THEN NOT (l.quality = 1) ELSE (l.quality = 1) END AS winner,
         d.doc_id AS doc, l.doc_id IS NOT NULL AS labelled
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
project_batch AS (
  SELECT id, slug, name, tagline, likes, members, hackathon, year, winner, 1::BIGINT AS ord FROM project_base
  UNION ALL
  SELECT id, CASE WHEN doc % 13 = 0 THEN 'p-' || CAST(doc + 1 AS VARCHAR) ELSE slug END,
         name, tagline, (likes + doc % 3)::BIGINT,
         members, CASE WHEN doc % 4 = 0 THEN NULL ELSE hackathon END,
         (CASE WHEN doc % 6 = 0 THEN 0 ELSE year END)::INTEGER, winner, 2::BIGINT FROM project_base
  UNION ALL
  SELECT id + {INSERT_ID_OFFSET}, 'p-' || CAST(id + {INSERT_ID_OFFSET} AS VARCHAR), name, tagline, likes,
         members, hackathon, year, winner, 1::BIGINT FROM project_base WHERE labelled)"""


# ---------------------------------------------------------------- registry, labels

def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source but the last in name order, which stays unregistered so
    that the registry's filter has something to drop."""
    w = Window.orderBy("source")                 # one row per source
    names = (table(spark, sf_dir, "documents").select("source").filter(F.col("source").isNotNull()).distinct()
             .withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
             .withColumn("last", F.lead("source").over(w).isNull()))
    return names.filter(~F.col("last")).select(
        "pos", F.col("source").alias("hackathon"),
        F.concat(F.lit("Source "), F.regexp_replace("source", "^src", "")).alias("label"))


REGISTRY_SQL = """
registry AS (
  SELECT (rn - 1)::INTEGER AS pos, source AS hackathon, 'Source ' || regexp_replace(source, '^src', '') AS label
  FROM (SELECT source, row_number() OVER (ORDER BY source) AS rn, count(*) OVER () AS n
        FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
  WHERE rn < n)"""


def category_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-``label`` mean of ``embeddings.embedding``, L2-normalised
    (the stand-in for embedding the fixed category strings once)."""
    from corpusmap.operators.projection import mean_vectors
    from corpusmap.functions.vectors import l2_normalize
    e = table(spark, sf_dir, "embeddings")
    means = mean_vectors(e.select(F.col("label").cast("int").alias("idx"), F.col("embedding").alias("vector")),
                         ["idx"], "vector")
    return means.select("idx", F.concat(F.lit("label "), F.col("idx").cast("string")).alias("label"),
                        l2_normalize("mean").alias("vector"))


CATEGORY_LABELS_SQL = """
lab_cells AS (
  SELECT e.label::INTEGER AS idx, u.pos, avg(u.val::DOUBLE) AS m
  FROM embeddings e, unnest(e.embedding) WITH ORDINALITY AS u(val, pos)
  GROUP BY ALL),
lab_norm AS (SELECT idx, greatest(sqrt(sum(m * m)), 1e-12) AS nrm FROM lab_cells GROUP BY idx),
cat_labels AS (
  SELECT c.idx, list(c.m / n.nrm ORDER BY c.pos) AS vector
  FROM lab_cells c JOIN lab_norm n USING (idx) GROUP BY c.idx)"""


def with_sql(*fragments: str) -> str:
    return "WITH " + ",\n".join(f.strip() for f in fragments)


# ---------------------------------------------------------------- responses built from tables
# Each document becomes one listing item / card; the modulo tests choose which
# edge case a row exercises (a number where a string belongs, a missing link,
# ...). Every document is used.

LISTING_PAGE_ROWS = 20
EVENT_PAGE_ROWS = 40
CRLF = "\r\n"


def _js(c):
    from corpusmap.sources.listings import json_string
    return json_string(c)


def _pages_of(items, key: str, page_rows: int, group_cols=()):
    """Concatenate item strings into pages of ``page_rows`` (by ``key`` order).
    A page holds a fixed number of items, so each group is bounded."""
    from corpusmap.session import dense_index
    idx = dense_index(items, [key], list(group_cols), name="_i", whole_rows=True)
    paged = idx.withColumn("page", (F.floor(F.col("_i") / page_rows) + 1).cast("long"))
    return (paged.groupBy(*group_cols, "page")
            .agg(F.sort_array(F.collect_list(F.struct(key, "item"))).alias("_items"),
                 F.count(F.lit(1)).alias("n_items"))
            .withColumn("items", F.transform("_items", lambda s: s["item"])).drop("_items"))


def repo_listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search-result pages ``(page, status, body)``: 20 documents per page as
    repo items. Page bodies on pages 5 mod 17 are not JSON; pages 7 mod 19 lack
    ``items``."""
    d = table(spark, sf_dir, "documents")
    desc = F.when(d.doc_id % 4 == 0, F.lit("null")).when(d.doc_id % 9 == 0, d.doc_id.cast("string")) \
        .otherwise(_js(d.text))
    stars = F.when(d.doc_id % 10 == 0, F.lit('"n/a"')).otherwise(d.n_chars.cast("string"))
    topics = F.when(d.doc_id % 6 == 0, F.concat(F.lit("["), _js(d.lang), F.lit(",7,"), _js(d.source), F.lit("]"))) \
        .otherwise(F.to_json(F.array(d.lang, d.source)))
    item = F.concat(F.lit('{"full_name":'), _js(F.concat(d.source, F.lit("/"), d.doc_id.cast("string"))),
                    F.lit(',"description":'), desc, F.lit(',"stargazers_count":'), stars,
                    F.lit(',"topics":'), topics, F.lit("}"))
    items = d.select(d.doc_id.alias("doc_id"), item.alias("item"))
    total = d.count()
    pages = _pages_of(items, "doc_id", LISTING_PAGE_ROWS)
    body = (F.when(F.col("page") % 17 == 5, F.lit("not json {"))
            .when(F.col("page") % 19 == 7, F.lit('{"total_count": ' + str(total) + "}"))
            .otherwise(F.concat(F.lit('{"total_count": ' + str(total) + ', "items": ['),
                                F.array_join("items", ","), F.lit("]}"))))
    return pages.select("page", F.lit(200).alias("status"), body.alias("body"))


def event_listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hackathon-listing pages ``(page, body)``: one entry per document, 40 per
    page. Entries 5 mod 6 sit on their own domain (no gallery host)."""
    d = table(spark, sf_dir, "documents")
    host = F.concat(F.lit("h"), d.doc_id.cast("string"))
    url = F.when(d.doc_id % 6 == 5, F.concat(F.lit("https://"), host, F.lit(".example/"))) \
        .otherwise(F.concat(F.lit("https://"), host, F.lit(".devpost.com/")))
    title = F.when(d.doc_id % 8 == 3, F.lit("null")).otherwise(_js(d.text))
    year_txt = (F.lit(2018) + d.doc_id % 7).cast("string")
    dates = (F.when(d.doc_id % 9 == 4, F.lit('"TBA"'))
             .when(d.doc_id % 10 == 7, F.lit("null"))
             .when(d.doc_id % 11 == 2, F.lit("2024"))
             .otherwise(F.concat(F.lit('"Jan 17 - 18, '), year_txt, F.lit('"'))))
    item = F.concat(F.lit('{"url":'), _js(url), F.lit(',"title":'), title,
                    F.lit(',"submission_period_dates":'), dates, F.lit("}"))
    total = d.count()
    pages = _pages_of(d.select(d.doc_id.alias("doc_id"), item.alias("item")), "doc_id", EVENT_PAGE_ROWS)
    body = F.concat(F.lit('{"meta": {"total_count": ' + str(total) + ', "per_page": ' + str(EVENT_PAGE_ROWS)
                          + '}, "hackathons": ['), F.array_join("items", ","), F.lit("]}"))
    return pages.select("page", body.alias("body"))


def gallery_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gallery pages ``(hackathon, page, status, html)``: the projects of each
    source as cards, 20 per page. Cards 3 mod 11 have no project link; 4 mod 13
    no tagline; 2 mod 17 no like counter. Pages whose number plus the doc count
    is 0 mod 7 answer HTTP 500 (the walk stops there)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, d.doc_id == lab.doc_id, "left")
    doc = d.doc_id
    likes = F.format_number((d.n_chars % 500) * 7, 0)
    link = F.when(doc % 11 == 3, F.lit("<p>no link</p>")).otherwise(
        F.concat(F.lit('<a href="https://devpost.com/software/p-'), doc.cast("string"), F.lit('">')))
    card = F.concat(
        F.lit('<div data-software-id="'), doc.cast("string"), F.lit('">'), link,
        F.lit("<h5> "), d.text, F.lit(" &amp; co </h5>"),
        F.when(doc % 13 == 4, F.lit("")).otherwise(
            F.concat(F.lit('<p class="small tagline"> <b>'), d.lang, F.lit("</b> </p>"))),
        F.when(lab.quality == 1, F.lit('<img class="winner">')).otherwise(F.lit("")),
        F.lit('<span data-url="https://devpost.com/u'), (doc % 50).cast("string"), F.lit('"></span>'),
        F.lit('<span data-url="https://devpost.com/u'), (doc % 7).cast("string"), F.lit('"></span>'),
        F.when(doc % 17 == 2, F.lit("")).otherwise(
            F.concat(F.lit('<span data-count="like"> '), likes, F.lit(" </span>"))),
        F.lit("</a></div>\n"))
    items = j.select(doc.alias("doc_id"), d.source.alias("hackathon"), card.alias("item"))
    pages = _pages_of(items, "doc_id", LISTING_PAGE_ROWS, ["hackathon"])
    html = F.concat(F.lit("<html><body><div class=\"gallery\">\n"), F.array_join("items", ""),
                    F.lit("</div></body></html>"))
    status = F.when((F.col("page") + F.col("n_items")) % 7 == 0, F.lit(500)).otherwise(F.lit(200))
    return pages.select("hackathon", "page", status.alias("status"), html.alias("html"), "n_items")


def project_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project pages ``(page_id, html)`` around ``pages.html`` as the write-up:
    pages 0 mod 4 have no built-with block, 9 mod 10 no markers at all, 0 mod 3
    no submissions section."""
    p = table(spark, sf_dir, "pages")
    pid = p.page_id
    details = F.concat(F.lit('<div id="app-details-left">'), p.html,
                       F.when(pid % 4 == 0, F.lit("")).otherwise(F.lit('<div id="built-with"><p>Go</p></div>')),
                       F.lit('</div>\n<div id="app-details-right"></div>'))
    subs = F.when(pid % 3 == 0, F.lit("")).otherwise(F.concat(
        F.lit('<div id="submissions"><ul><li><span class="winner label radius">Winner</span> Prize '),
        pid.cast("string"), F.lit(' &amp; more </li><li><span class="winner label radius">Winner</span>'
                                  '&nbsp;<br> </li><li>plain</li>'
                                  '<li><span class="winner label radius">Winner</span>\n<b>Runner</b> up</li></ul></div>')))
    html = F.when(pid % 10 == 9, F.concat(F.lit("<html>"), p.html, F.lit("</html>"))).otherwise(F.concat(details, subs))
    return p.select(pid.alias("page_id"), html.alias("html"))


def response_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl log ``(event_id, status, headers, body, attempt, now)`` from
    ``events``: status from ``event_type``, header values from ``value``,
    ``user_id`` and ``props.k``."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object(e.props, "$.k").try_cast("long")
    status = (F.when(e.event_type.isin("view", "click"), F.lit(200))
              .when(e.event_type == "purchase", F.lit(403))
              .when(e.event_type == "error", F.lit(429))
              .when(e.value < 5, F.lit(0)).otherwise(F.lit(404)))
    now = F.unix_timestamp(e.ts)
    link = (F.when(e.event_id % 4 == 0, F.concat(
        F.lit('Link: <https://api.github.com/search/repositories?q=x&per_page=100&page=2>; rel="next", '
              '<https://api.github.com/search/repositories?q=x&per_page=100&page='),
        (k + 2).cast("string"), F.lit('>; rel="last"' + CRLF)))
        .when(e.event_id % 4 == 1, F.concat(
            F.lit('link: <https://api.github.com/search/repositories?q=x&per_page=100&page='),
            k.cast("string"), F.lit('>; rel="prev"' + CRLF)))
        .otherwise(F.lit("")))
    headers = F.concat(
        F.lit("HTTP/2 "), status.cast("string"), F.lit(" " + CRLF), F.lit("content-type: application/json" + CRLF),
        link,
        F.when(e.event_id % 3 == 0, F.concat(F.lit("X-RateLimit-Remaining: "), (e.user_id % 5).cast("string"),
                                             F.lit(CRLF))).otherwise(F.lit("")),
        F.when(e.event_id % 5 != 0, F.concat(F.lit("x-ratelimit-reset: "), (now + (e.user_id % 90)).cast("string"),
                                             F.lit(CRLF))).otherwise(F.lit("")),
        F.when(e.event_type == "error", F.concat(F.lit("retry-after:\t"), F.floor(e.value).cast("string"),
                                                 F.lit(CRLF))).otherwise(F.lit("")),
        F.lit("x-note: link: not-a-header" + CRLF))
    body = F.when(e.event_id % 2 == 0, F.lit("API rate limit exceeded")).otherwise(F.lit("{}"))
    return e.select(e.event_id.alias("event_id"), status.alias("status"), headers.alias("headers"),
                    body.alias("body"), (e.event_id % 4).alias("attempt"), now.alias("now"))
