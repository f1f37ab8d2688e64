"""Ingest queries: listing JSON, galleries, project pages, response headers and throttling, crawl manifests, request paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmap.plans.queries.base import (DOC_PAGES_SQL, EVENTS_EXPECTED_SQL, GALLERY_EXPECTED_SQL, L, M,
                                          PATHS_SQL, PG, PROJECTS_SQL, PROJECT_PAGE_SQL, R, REGISTRY_SQL,
                                          REPOS_SQL, REPO_BATCH_SQL, RESPONSE_EXPECTED_SQL, S, ST, TX,
                                          between_sql, register, table, with_sql)  # noqa: F401


@register("parse_repo_listing", with_sql(DOC_PAGES_SQL) + """
SELECT (idx // 20 + 1)::BIGINT AS page, (idx % 20)::BIGINT AS pos, source || '/' || CAST(doc_id AS VARCHAR) AS name,
       CASE WHEN doc_id % 4 = 0 OR doc_id % 9 = 0 THEN NULL ELSE text END AS "desc",
       CASE WHEN doc_id % 10 = 0 THEN 0 ELSE n_chars END::BIGINT AS stars,
       lang || ' ' || source AS topics
FROM doc_pages WHERE NOT ((idx // 20 + 1) % 17 = 5 OR (idx // 20 + 1) % 19 = 7)""")
def q_parse_repo_listing(spark, sf_dir):
    rows, _ = L.parse_repo_listing(ST.repo_listing_pages(spark, sf_dir), keys=["page"])
    return rows.select("page", "pos", "name", "desc", "stars", F.array_join("topics", " ").alias("topics"))


@register("listing_rejects", with_sql(DOC_PAGES_SQL) + """
SELECT DISTINCT (idx // 20 + 1)::BIGINT AS page,
       CASE WHEN (idx // 20 + 1) % 17 = 5 THEN 'not JSON' ELSE 'no items array' END AS reject_reason
FROM doc_pages WHERE (idx // 20 + 1) % 17 = 5 OR (idx // 20 + 1) % 19 = 7""")
def q_listing_rejects(spark, sf_dir):
    _, rej = L.parse_repo_listing(ST.repo_listing_pages(spark, sf_dir), keys=["page"])
    return rej.select("page", "reject_reason")


@register("parse_event_listing", with_sql(DOC_PAGES_SQL, EVENTS_EXPECTED_SQL) + """
SELECT page, pos, host, title, year FROM ev""")
def q_parse_event_listing(spark, sf_dir):
    hosts, _, _ = L.parse_event_listing(ST.event_listing_pages(spark, sf_dir), keys=["page"])
    return hosts.select("page", "pos", "host", "title", "year")


@register("listing_progress", with_sql(DOC_PAGES_SQL) + """
SELECT DISTINCT (idx // 40 + 1)::BIGINT AS page, (SELECT count(*) FROM documents)::BIGINT AS total_count,
       40::BIGINT AS per_page, ((idx // 40 + 1) * 40 >= (SELECT count(*) FROM documents)) AS is_last_page
FROM doc_pages""")
def q_listing_progress(spark, sf_dir):
    _, pages, _ = L.parse_event_listing(ST.event_listing_pages(spark, sf_dir), keys=["page"])
    return pages.select("page", "total_count", "per_page",
                        M.is_last_page(F.col("page"), F.col("per_page"), F.col("total_count")).alias("is_last_page"))


@register("match_events", with_sql(DOC_PAGES_SQL, EVENTS_EXPECTED_SQL, """
wanted AS (SELECT * FROM (VALUES ('the', 0), ('le', 2020), ('in', 2022), ('un', 0)) t(name, year))""") + """
SELECT w.name, w.year::BIGINT AS year_filter, e.host, e.year
FROM ev e JOIN wanted w ON starts_with(lower(e.title), lower(w.name)) AND (w.year <= 0 OR e.year = w.year)""")
def q_match_events(spark, sf_dir):
    hosts, _, _ = L.parse_event_listing(ST.event_listing_pages(spark, sf_dir), keys=["page"])
    # a fixed list of (name, year) filters: each event is tested against every
    # entry of the list (an explode of a literal array, no join)
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(y).cast("long").alias("year_filter"))
                       for n, y in [("the", 0), ("le", 2020), ("in", 2022), ("un", 0)]])
    j = hosts.select("*", F.inline(wanted))
    return S.match_events(j, name_col="name", year_col="year_filter").select("name", "year_filter", "host", "year")


@register("parse_gallery", with_sql(GALLERY_EXPECTED_SQL) + f"""
SELECT hackathon, page, card, id, slug, {TX.html_to_text_sql("' ' || text || ' &amp; co '")} AS name,
       CASE WHEN doc_id % 13 = 4 THEN NULL ELSE lang END AS tagline,
       (CASE WHEN doc_id % 17 = 2 THEN 0 ELSE (n_chars % 500) * 7 END)::BIGINT AS likes,
       coalesce(quality = 1, false) AS winner,
       'u' || CAST(doc_id % 50 AS VARCHAR) || ' u' || CAST(doc_id % 7 AS VARCHAR) AS members
FROM gcards WHERE has_link""")
def q_parse_gallery(spark, sf_dir):
    rows, _ = PG.parse_gallery(ST.gallery_pages(spark, sf_dir), keys=["hackathon", "page"])
    return rows.select("hackathon", "page", "card", "id", "slug", "name", "tagline", "likes", "winner",
                       F.array_join("members", " ").alias("members"))


@register("contiguous_pages", with_sql(GALLERY_EXPECTED_SQL, """
gp AS (SELECT hackathon, page, any_value(n_items) AS n_items, count_if(has_link) AS cards FROM gcards GROUP BY ALL),
gs AS (SELECT hackathon, page, cards, NOT ((page + n_items) % 7 = 0) AS ok FROM gp),
stops AS (SELECT hackathon, min(CASE WHEN NOT ok OR cards <= 0 THEN page END) AS first_bad,
                 max(CASE WHEN NOT ok THEN 1 END) AS any_failed FROM gs GROUP BY hackathon)""") + """
SELECT g.hackathon, g.page, g.cards::BIGINT AS cards, g.ok,
       g.page < coalesce(s.first_bad, g.page + 1) AS kept_prefix,
       g.page < coalesce(s.first_bad, g.page + 1) AND s.any_failed IS NULL AS kept_whole
FROM gs g JOIN stops s USING (hackathon)""")
def q_contiguous_pages(spark, sf_dir):
    from corpusmap.session import cut_lineage
    gp = cut_lineage(ST.gallery_pages(spark, sf_dir))  # the stored bronze pages
    rows, counts = PG.parse_gallery(gp, keys=["hackathon", "page"])
    pages = cut_lineage(gp.select("hackathon", "page", (F.col("status") == 200).alias("ok"))
                        .join(counts, ["hackathon", "page"], "left")
                        .withColumn("cards", F.coalesce(F.col("cards"), F.lit(0)).cast("long")))
    a = M.contiguous_pages(pages, "hackathon", "keep_prefix").withColumnRenamed("kept", "kept_prefix")
    b = M.contiguous_pages(pages, "hackathon", "all_or_nothing").select("hackathon", "page",
                                                                         F.col("kept").alias("kept_whole"))
    return a.join(b, ["hackathon", "page"]).select("hackathon", "page", "cards", "ok", "kept_prefix", "kept_whole")


@register("page_writeup", with_sql(PROJECT_PAGE_SQL) + f"""
SELECT page_id, {TX.html_to_text_sql("coalesce(" + between_sql("h", 'id="app-details-left">', 'id="built-with"') + ", "
                                       + between_sql("h", 'id="app-details-left">', 'id="app-details-right"') + ")")}
       AS writeup FROM pp""")
def q_page_writeup(spark, sf_dir):
    return PG.page_writeup(ST.project_pages(spark, sf_dir)).select("page_id", "writeup")


@register("page_prizes", """
SELECT page_id::BIGINT AS page_id,
       CASE WHEN page_id % 10 = 9 OR page_id % 3 = 0 THEN ''
            ELSE 'Prize ' || CAST(page_id AS VARCHAR) || ' & more' || chr(10) || 'Runner up' END AS prizes,
       (CASE WHEN page_id % 10 = 9 OR page_id % 3 = 0 THEN 0 ELSE 2 END)::BIGINT AS n_prizes
FROM pages""")
def q_page_prizes(spark, sf_dir):
    p = PG.page_prizes(ST.project_pages(spark, sf_dir))
    return p.select(F.col("page_id").cast("long"), F.array_join("prizes", "\n").alias("prizes"),
                    F.size("prizes").cast("long").alias("n_prizes"))


@register("header_fields", with_sql(RESPONSE_EXPECTED_SQL) + """
SELECT event_id, status, page_count, ratelimit_remaining, ratelimit_reset, retry_after FROM hf""")
def q_header_fields(spark, sf_dir):
    f = R.header_fields(ST.response_log(spark, sf_dir))
    return f.select("event_id", "status", "page_count", "ratelimit_remaining", "ratelimit_reset", "retry_after")


@register("throttle_plan", with_sql(RESPONSE_EXPECTED_SQL, """
lim AS (
  SELECT *, (status = 429 OR (status = 403 AND (ratelimit_remaining = 0 OR retry_after >= 0 OR says_limit))) AS limited,
         CASE WHEN retry_after >= 0 THEN retry_after ELSE 60 << attempt END AS base,
         ratelimit_reset - now + 1 AS until FROM hf)""") + """
SELECT event_id, limited, limited AND attempt >= 3 AS give_up,
       CASE WHEN limited AND attempt < 3 THEN greatest(
            CASE WHEN ratelimit_remaining = 0 AND ratelimit_reset > 0 AND (retry_after < 0 OR until > base)
                 THEN until ELSE base END, 1) END::BIGINT AS delay_s,
       (CASE WHEN status BETWEEN 200 AND 299 AND ratelimit_remaining = 0 AND ratelimit_reset > 0 AND until > 0
             THEN until ELSE 0 END)::BIGINT AS wait_s
FROM lim""")
def q_throttle_plan(spark, sf_dir):
    t = R.throttle_plan(ST.response_log(spark, sf_dir))
    return t.select("event_id", "limited", "give_up", F.col("delay_s").cast("long"), "wait_s")


@register("accept_responses", with_sql(RESPONSE_EXPECTED_SQL) + """
SELECT event_id, status BETWEEN 200 AND 299 AS accepted,
       CASE WHEN status = 0 THEN 'no response' WHEN status NOT BETWEEN 200 AND 299
            THEN 'HTTP ' || CAST(status AS VARCHAR) END AS reject_reason
FROM rl""")
def q_accept_responses(spark, sf_dir):
    good, bad = R.accept_responses(ST.response_log(spark, sf_dir))
    return (good.select("event_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reject_reason"))
            .unionByName(bad.select("event_id", F.lit(False).alias("accepted"), "reject_reason")))


@register("repo_manifest", with_sql(REPOS_SQL, REPO_BATCH_SQL, """
wins AS (SELECT * FROM (VALUES (4000, NULL), (2000, 3999), (0, 1999)) t(lo, hi)),
pc AS (SELECT w.lo, w.hi, CASE WHEN w.hi IS NULL THEN CAST(w.lo AS VARCHAR) || '..*'
                              ELSE CAST(w.lo AS VARCHAR) || '..' || CAST(w.hi AS VARCHAR) END AS star_window,
              (SELECT count(*) FROM repo_batch b WHERE b.ord = 1 AND b.stars >= w.lo
                 AND (w.hi IS NULL OR b.stars <= w.hi)) AS n
       FROM wins w)""") + """
SELECT star_window, page::BIGINT AS page,
       'https://api.github.com/search/repositories?q=stars:' || star_window || '&sort=stars&order=desc&per_page=100&page='
       || CAST(page AS VARCHAR) AS url
FROM (SELECT star_window, unnest(generate_series(1, greatest(CAST(ceil(n / 100) AS BIGINT), 1))) AS page FROM pc)""")
def q_repo_manifest(spark, sf_dir):
    b = ST.repo_batch(spark, sf_dir).filter(F.col("ord") == 1)
    wins = [(4000, None), (2000, 3999), (0, 1999)]
    u = M.star_windows_union(b, wins)
    counts = u.groupBy("window").agg(F.count(F.lit(1)).alias("n"))
    w = (M.windows_frame(spark, wins).withColumn("window", M.star_range(F.col("lo"), F.col("hi")))
         .join(counts, "window", "left")
         .withColumn("page_count", F.ceil(F.coalesce(F.col("n"), F.lit(0)) / 100).cast("int")).drop("window"))
    return M.repo_manifest(w).select(F.col("window").alias("star_window"), F.col("page").cast("long"), "url")


@register("event_manifest", with_sql(PROJECTS_SQL) + """
SELECT host, page::BIGINT AS page, 'https://' || host || '.devpost.com/project-gallery?page=' || CAST(page AS VARCHAR) AS url
FROM (SELECT hackathon AS host, unnest(generate_series(1, CAST(ceil(count(*) / 24) AS BIGINT) + 1)) AS page
      FROM projects GROUP BY hackathon)""")
def q_event_manifest(spark, sf_dir):
    hosts = ST.projects(spark, sf_dir).groupBy(F.col("hackathon").alias("host")).agg(F.count(F.lit(1)).alias("cards"))
    return M.gallery_manifest(hosts).select("host", F.col("page").cast("long"), "url")


@register("listing_manifest", with_sql(REGISTRY_SQL) + """
SELECT 'listing' AS kind, NULL AS name, page::BIGINT AS page,
       'https://devpost.com/api/hackathons?page=' || CAST(page AS VARCHAR) || '&per_page=40' AS url
FROM (SELECT unnest(generate_series(1, greatest(CAST(ceil((SELECT count(*) FROM documents) / 40) AS BIGINT), 1))) AS page)
UNION ALL
SELECT 'search', label, 1, 'https://devpost.com/api/hackathons?page=1&per_page=40&search=' || replace(lower(label), ' ', '+')
FROM registry""")
def q_listing_manifest(spark, sf_dir):
    """SRC-11: the listing pages implied by what listing page 1 reported, and
    the first search page per registered hackathon name."""
    _, pages, _ = L.parse_event_listing(ST.event_listing_pages(spark, sf_dir), keys=["page"])
    first = pages.filter(F.col("page") == 1)
    listing = M.listing_manifest(first).select(F.lit("listing").alias("kind"), F.lit(None).cast("string").alias("name"),
                                               F.col("page").cast("long"), "url")
    search = M.search_manifest(ST.registry(spark, sf_dir)).select(F.lit("search").alias("kind"), "name",
                                                          F.col("page").cast("long"), "url")
    return listing.unionByName(search)


@register("project_urls", with_sql(PROJECTS_SQL, REPOS_SQL) + """
SELECT 'project' AS kind, slug AS key, 'https://devpost.com/software/' || slug AS url FROM projects
UNION ALL SELECT 'readme', name, 'https://api.github.com/repos/' || name || '/readme' FROM repos""")
def q_project_urls(spark, sf_dir):
    p = M.project_urls(ST.projects(spark, sf_dir)).select(F.lit("project").alias("kind"), F.col("slug").alias("key"), "url")
    r = M.readme_urls(ST.repos(spark, sf_dir)).select(F.lit("readme").alias("kind"), F.col("name").alias("key"), "url")
    return p.unionByName(r)


@register("parse_dataset_path", with_sql(REGISTRY_SQL, PATHS_SQL, """
steps AS (
  SELECT doc_id, path, starts_with(path, '/datasets/') AS ok,
         ends_with(path[11:], '/embed') AS q,
         CASE WHEN ends_with(path[11:], '/embed') THEN path[11:length(path) - 6] ELSE path[11:] END AS rest
  FROM req),
split AS (
  SELECT *, CASE WHEN strpos(rest, '/') > 0 THEN rest[1:strpos(rest, '/') - 1] ELSE rest END AS hid,
         CASE WHEN strpos(rest, '/') > 0 THEN rest[strpos(rest, '/') + 1:] ELSE '' END AS y
  FROM steps),
cls AS (
  SELECT s.*, ok AND rest = 'github' AS is_gh,
         ok AND rest <> 'github' AND r.hackathon IS NOT NULL
            AND (y = '' OR coalesce(regexp_full_match(y, '[0-9]+') AND TRY_CAST(y AS INTEGER) > 0, false)) AS is_hk
  FROM split s LEFT JOIN registry r ON s.hid = r.hackathon)""") + """
SELECT doc_id, path,
       CASE WHEN is_gh THEN 'github' WHEN is_hk AND y <> '' THEN hid || '/' || CAST(TRY_CAST(y AS INTEGER) AS VARCHAR)
            WHEN is_hk THEN hid END AS dataset,
       (CASE WHEN is_hk AND y <> '' THEN TRY_CAST(y AS INTEGER) END)::BIGINT AS year,
       (is_gh OR is_hk) AS found, q AND (is_gh OR is_hk) AS embed
FROM cls""")
def q_parse_dataset_path(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    suffix = (F.when(doc % 5 == 0, F.lit("")).when(doc % 5 == 1, F.concat(F.lit("/"), (F.lit(2019) + doc % 7).cast("string")))
              .when(doc % 5 == 2, F.lit("/")).when(doc % 5 == 3, F.concat(F.lit("/x"), doc.cast("string")))
              .otherwise(F.lit("/0")))
    gh = F.when(doc % 2 == 1, F.lit("/datasets/github/")).otherwise(F.lit("/datasets/github"))
    path = F.concat(F.when(doc % 9 == 0, gh).otherwise(F.concat(F.lit("/datasets/"), F.col("source"), suffix)),
                    F.when(doc % 3 == 0, F.lit("/embed")).otherwise(F.lit("")))
    req = d.select("doc_id", path.alias("path"))
    out = S.parse_dataset_path(req, ST.registry(spark, sf_dir))
    return out.select("doc_id", "path", "dataset", F.col("year").cast("long"), "found", "embed")


@register("validate_queries", """
SELECT conv_id, turn, text IS NOT NULL AND strlen(text) BETWEEN 1 AND 32768 AS valid,
       CASE WHEN text IS NULL THEN 'missing' WHEN strlen(text) < 1 THEN 'empty'
            WHEN strlen(text) > 32768 THEN 'too long' END AS reason
FROM conversations""")
def q_validate_queries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return S.validate_queries(c, "text").select("conv_id", "turn", "valid", "reason")


@register("limit_events", with_sql(DOC_PAGES_SQL, EVENTS_EXPECTED_SQL) + """
SELECT page, pos, host FROM ev ORDER BY page, pos LIMIT 100""")
def q_limit_events(spark, sf_dir):
    """TOP-4: the first 100 events of the listing (the limit is the feature)."""
    hosts, _, _ = L.parse_event_listing(ST.event_listing_pages(spark, sf_dir), keys=["page"])
    return M.limit_events(hosts, 100, ["page", "pos"]).select("page", "pos", "host")
