"""Map and serving queries: dataset maps, refresh, query answers, streams, the composed service pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmap.plans.queries.base import (BENCH_QD_SQL, CATEGORY_LABELS_SQL, DOC_PAGES_SQL,
                                          GALLERY_BATCH_SQL, GALLERY_EXPECTED_SQL, MAPS, MEMBERS_SQL, MEMBER_INDEX_SQL,
                                          ORACLE_SQL, PROJECTS_SQL, PROJECT_STATE_SQL, PROJECT_UPSERT_SQL,
                                          QUERY_NEIGHBOURS_SQL, REGISTRY_SQL, REPOS_SQL, REPO_UPSERT_SQL, S,
                                          SIM, ST, STORE, TEXT_REQ_SQL, TX, WORDY_SQL, _bench_queries, _maps,
                                          _projects_after, cut_lineage_bronze, hash_sql, register, table, E, PG, U,
                                          with_sql)  # noqa: F401


@register("build_map")
def q_build_map(spark, sf_dir):
    points, _, _ = _maps(spark, sf_dir)
    return points.select("dataset", "idx", "id", "x", "y", "z", "category", "similarity")


@register("dataset_document")
def q_dataset_document(spark, sf_dir):
    points, _, _ = _maps(spark, sf_dir)
    ds = points.select("dataset", "hackathon", "year").distinct() \
        .groupBy("dataset").agg(F.max("hackathon").alias("hackathon"), F.max("year").alias("year"))
    cats = [r["label"] for r in ST.category_labels(spark, sf_dir).select("idx", "label").orderBy("idx").collect()]
    points = MAPS.with_point_fields(points.drop("unit"), ST.repos(spark, sf_dir), ST.projects(spark, sf_dir))
    return STORE.dataset_lines(points, ds, cats)


@register("dataset_points", with_sql(REPOS_SQL, PROJECTS_SQL, REGISTRY_SQL, MEMBERS_SQL, MEMBER_INDEX_SQL) + """
SELECT m.dataset, m.idx::BIGINT AS idx, m.id::BIGINT AS id, coalesce(r.name, p.slug) AS name,
       md5(coalesce(r."desc", p.name)) AS text_md5, coalesce(r.stars, p.likes)::BIGINT AS score,
       array_to_string(coalesce(r.topics, p.members), ' ') AS tags, p.tagline,
       CASE WHEN p.id IS NOT NULL THEN coalesce(p.winner, false) END AS winner,
       CASE WHEN p.id IS NOT NULL THEN array_to_string(coalesce(p.prizes, []), ',') END AS prizes
FROM mi m LEFT JOIN repos r ON m.dataset = 'github' AND r.id = m.id
     LEFT JOIN projects p ON m.dataset <> 'github' AND p.id = m.id""")
def q_dataset_points(spark, sf_dir):
    """STR-4: every point in served order with the stored fields of its kind."""
    from corpusmap.operators.selection import point_index
    repos, projects = ST.repos(spark, sf_dir), ST.projects(spark, sf_dir)
    members = S.dataset_members(repos, projects, ST.registry(spark, sf_dir))
    p = MAPS.with_point_fields(point_index(members.drop("vector")), repos, projects)
    return p.select("dataset", "idx", "id", F.coalesce("repo.name", "project.slug").alias("name"),
                    F.md5(F.coalesce("repo.desc", "project.name")).alias("text_md5"),
                    F.coalesce("repo.stars", "project.likes").alias("score"),
                    F.array_join(F.coalesce("repo.topics", "project.members"), " ").alias("tags"),
                    F.col("project.tagline").alias("tagline"), F.col("project.winner").alias("winner"),
                    F.array_join("project.prizes", ",").alias("prizes"))


@register("dataset_document_fields", with_sql(REPOS_SQL, PROJECTS_SQL, REGISTRY_SQL, MEMBERS_SQL, MEMBER_INDEX_SQL,
                                              CATEGORY_LABELS_SQL, """
sims AS (SELECT m.dataset, m.id, m.idx, c.idx AS cat, list_cosine_similarity(m.vector::DOUBLE[], c.vector) AS sim
         FROM mi m, cat_labels c),
best AS (SELECT *, row_number() OVER (PARTITION BY dataset, id ORDER BY sim DESC, cat) AS rn FROM sims)""") + """
SELECT m.dataset, m.idx::BIGINT AS idx, m.id::BIGINT AS id, coalesce(r.name, p.slug) AS name,
       coalesce(r.stars, p.likes)::BIGINT AS score, p.tagline, p.winner IS NOT NULL AND p.winner AS winner,
       CASE WHEN p.id IS NOT NULL THEN len(coalesce(p.prizes, [])) END::BIGINT AS n_prizes, b.cat::BIGINT AS category,
       NULL::BIGINT AS n_categories
FROM mi m JOIN best b ON b.rn = 1 AND b.dataset = m.dataset AND b.id = m.id
     LEFT JOIN repos r ON m.dataset = 'github' AND r.id = m.id LEFT JOIN projects p ON m.dataset <> 'github' AND p.id = m.id
UNION ALL
SELECT dataset, -1, NULL, max(hackathon), max(year), NULL, false, NULL, NULL, (SELECT count(*) FROM cat_labels)
FROM members GROUP BY dataset""")
def q_dataset_document_fields(spark, sf_dir):
    """SRC-17: the lines of every dataset's document parsed back: the header's
    hackathon, year and number of categories, each point's stored fields and category."""
    lines = q_dataset_document(spark, sf_dir)
    at = lambda path: F.get_json_object("line", path)
    header = F.col("idx") == -1
    prizes = F.from_json(at("$.prizes"), "array<string>")
    return lines.select(
        "dataset", "idx", at("$.id").cast("long").alias("id"),
        F.when(header, at("$.hackathon")).otherwise(F.when(F.col("dataset") == "github", at("$.name")).otherwise(at("$.slug"))).alias("name"),
        F.when(header, at("$.year")).otherwise(F.coalesce(at("$.stars"), at("$.likes"))).cast("long").alias("score"),
        at("$.tagline").alias("tagline"), F.coalesce(at("$.winner").cast("boolean"), F.lit(False)).alias("winner"),
        F.when(prizes.isNotNull(), F.size(prizes)).cast("long").alias("n_prizes"), at("$.category").cast("long").alias("category"),
        F.when(header, F.size(F.from_json(at("$.categories"), "array<string>"))).cast("long").alias("n_categories"))


@register("refresh_datasets")
def q_refresh_datasets(spark, sf_dir):
    """STR-3: after the project upsert, only the datasets holding inserted or
    changed rows are rebuilt and get a new generation."""
    from corpusmap.session import cut_lineage
    pr = cut_lineage(_projects_after(spark, sf_dir))   # the store snapshot after the upsert
    repos, reg = ST.repos(spark, sf_dir), ST.registry(spark, sf_dir)
    members = S.dataset_members(repos, pr, reg)
    before = S.dataset_members(repos, ST.projects(spark, sf_dir), reg)
    gens = before.select("dataset").distinct().withColumn("generation", F.lit(1).cast("long"))
    labels = SIM.label_matrix(ST.category_labels(spark, sf_dir))
    points, gen = MAPS.refresh_datasets(members, labels, 64, pr, gens, before, kind="project")
    counts = points.groupBy("dataset").agg(F.count(F.lit(1)).alias("points"))
    return gen.join(counts, "dataset", "left").select("dataset", "generation", "rebuilt",
                                                      F.coalesce("points", F.lit(0)).cast("long").alias("points"))


ORACLE_SQL["refresh_datasets"] = PROJECT_STATE_SQL + ",\n" + ",\n".join(f.strip() for f in (
    REPOS_SQL, REGISTRY_SQL, MEMBERS_SQL.replace("FROM projects p", "FROM projects_state p"),
    MEMBERS_SQL.replace("members AS", "old_members AS"), """
changes AS (
  SELECT s.id, s.hackathon AS h1, s.year AS y1, p.hackathon AS h0, p.year AS y0, s.vector IS NOT NULL AS v
  FROM projects_state s LEFT JOIN projects p ON p.id = s.id WHERE s.action IN ('insert', 'update')),
named AS (
  SELECT unnest([h0, h0 || '/' || CAST(y0 AS VARCHAR), h1, h1 || '/' || CAST(y1 AS VARCHAR)]) AS dataset,
         unnest([h0, h0, h1, h1]) AS hackathon FROM changes WHERE v),
touched AS (SELECT DISTINCT dataset FROM named
            WHERE dataset IS NOT NULL AND hackathon IN (SELECT hackathon FROM registry)),
known AS (SELECT DISTINCT dataset FROM old_members),
now AS (SELECT dataset, count(*) AS n FROM members GROUP BY dataset),
everything AS (SELECT dataset FROM known UNION SELECT dataset FROM now)""")) + """
SELECT e.dataset, (CASE WHEN k.dataset IS NOT NULL THEN 1 ELSE 0 END
                   + CASE WHEN t.dataset IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS generation,
       t.dataset IS NOT NULL AS rebuilt,
       (CASE WHEN t.dataset IS NOT NULL THEN coalesce(n.n, 0) ELSE 0 END)::BIGINT AS points
FROM everything e LEFT JOIN known k ON k.dataset = e.dataset LEFT JOIN touched t ON t.dataset = e.dataset
     LEFT JOIN now n ON n.dataset = e.dataset"""


@register("answer_queries")
def q_answer_queries(spark, sf_dir):
    points, proj, labels = _maps(spark, sf_dir)
    q = _bench_queries(spark, sf_dir)
    ans = MAPS.answer_queries(q.select("query_id", "dataset", "vector"), points, proj, labels)
    return ans.select("query_id", "dataset", "x", "y", "z", "category", "similarity", "rank",
                      "nearest_idx", "nearest_id", "nearest_similarity")


@register("answer_documents")
def q_answer_documents(spark, sf_dir):
    points, proj, labels = _maps(spark, sf_dir)
    q = _bench_queries(spark, sf_dir)
    ans = MAPS.answer_queries(q.select("query_id", "dataset", "vector"), points, proj, labels)
    return MAPS.answer_documents(ans, q.select("query_id", "description"))


@register("answer_text_queries")
def q_answer_text_queries(spark, sf_dir):
    points, proj, labels = _maps(spark, sf_dir)
    c = table(spark, sf_dir, "conversations")
    cid = F.col("conv_id") * 1000 + F.col("turn")
    path = (F.when(F.col("conv_id") % 4 == 0, F.lit("/datasets/github/embed"))
            .when(F.col("conv_id") % 4 == 1, F.lit("/datasets/src1/embed"))
            .when(F.col("conv_id") % 4 == 2, F.lit("/datasets/src3/2023/embed"))
            .otherwise(F.lit("/datasets/nowhere/embed")))
    req = c.select(cid.alias("query_id"), path.alias("path"), F.col("text").alias("description"))
    ans, rej = MAPS.answer_text_queries(req, points, proj, labels, ST.registry(spark, sf_dir), dim=64)
    return (ans.select("query_id", "dataset", "rank", "nearest_id", "category", F.lit(None).cast("string").alias("reason"))
            .unionByName(rej.select("query_id", F.lit(None).cast("string").alias("dataset"),
                                    F.lit(None).cast("int").alias("rank"), F.lit(None).cast("long").alias("nearest_id"),
                                    F.lit(None).cast("long").alias("category"), "reason")))


def _pages_out_of_order(spark, sf_dir, src):
    """The gallery pages as files in three rounds: page 2, 5, 8 ..., then 3, 6 ..., then 1, 4 ..."""
    gp = cut_lineage_bronze(ST.gallery_pages(spark, sf_dir).select("hackathon", "page", "status", "html"))
    for k in (2, 0, 1):
        gp.filter(F.col("page") % 3 == k).write.mode("append").parquet(src)
    files = len(spark.read.schema(gp.schema).parquet(src).inputFiles())
    return gp.schema, max(1, -(-files // 3))                # and the files of a round


@register("stream_upsert", with_sql(PROJECTS_SQL, GALLERY_EXPECTED_SQL, GALLERY_BATCH_SQL, PROJECT_UPSERT_SQL) + """
SELECT id, slug, name, likes, winner, vector IS NOT NULL AS has_vector FROM projects_state""")
def q_stream_upsert(spark, sf_dir):
    """STR-1, SRC-13: gallery responses land as files, out of order; the stream
    holds pages until the walk reaches them, drops those behind a failed page,
    and drains the others into the store (upsert per micro-batch)."""
    from corpusmap.streaming.ingest import scratch_root, stream_upsert
    root = scratch_root(spark, "stream-upsert")
    schema, files = _pages_out_of_order(spark, sf_dir, f"{root}/incoming")
    res = stream_upsert(spark, f"{root}/incoming", schema, ST.projects(spark, sf_dir), root, max_files_per_trigger=files)
    store = spark.read.parquet(res["path"])
    return store.select("id", "slug", "name", "likes", "winner", F.col("vector").isNotNull().alias("has_vector"))


@register("walk_progress", with_sql(GALLERY_EXPECTED_SQL, GALLERY_BATCH_SQL) + """
SELECT hackathon, coalesce(stop, last + 1)::BIGINT AS next_page, ended FROM gend""")
def q_walk_progress(spark, sf_dir):
    """STR-1, SRC-13: where every gallery walk stands after four batches of pages
    out of order: the page it waits for, or what ended it."""
    from corpusmap.streaming.ingest import scratch_root
    from corpusmap.streaming.walk import WalkState
    root = scratch_root(spark, "walk")
    walk = WalkState(spark, f"{root}/walk")
    gp = cut_lineage_bronze(ST.gallery_pages(spark, sf_dir).select("hackathon", "page", "status", "html"))
    for k in (3, 1, 0, 2):
        walk.step(gp.filter(F.col("page") % 4 == k))[1]()
    return walk.read(99)[1].select("hackathon", "next_page", "ended")


@register("supervised_sources", with_sql(PROJECTS_SQL, GALLERY_EXPECTED_SQL, GALLERY_BATCH_SQL, PROJECT_UPSERT_SQL) + """
SELECT 'galleries' AS source, true AS ok, 1::BIGINT AS attempts, id, likes FROM projects_state
UNION ALL SELECT 'repos', false, 2::BIGINT, NULL, NULL""")
def q_supervised_sources(spark, sf_dir):
    """STR-1: one stream per source under a supervisor. The folder of the repo
    source holds a file that cannot be read: that stream fails, is started again
    and given up; the gallery source drains all its files meanwhile."""
    from corpusmap.streaming.ingest import scratch_root, start_upsert, start_upsert_repos, supervise
    root = scratch_root(spark, "sources")
    schema, files = _pages_out_of_order(spark, sf_dir, f"{root}/galleries")
    pages = cut_lineage_bronze(ST.repo_listing_pages(spark, sf_dir))
    pages.select(F.col("body").alias("value")).write.text(f"{root}/listings")       # not Parquet
    repos, projects = ST.repos(spark, sf_dir), ST.projects(spark, sf_dir)
    report = supervise({
        "repos": lambda: start_upsert_repos(spark, f"{root}/listings", pages.schema, repos, f"{root}/a")[2],
        "galleries": lambda: start_upsert(spark, f"{root}/galleries", schema, projects, f"{root}/b", max_files_per_trigger=files)[2]},
        attempts=2)
    told = spark.createDataFrame([(k, v["ok"], v["attempts"]) for k, v in report.items()], "source string, ok boolean, attempts long")
    rows = spark.read.parquet(f"{root}/b/store").select(F.lit("galleries").alias("source"), "id", "likes")
    return told.join(rows, "source", "left").select("source", "ok", "attempts", "id", "likes")


@register("stream_embed")
def q_stream_embed(spark, sf_dir):
    """STR-2: pending project ids arrive as files; each micro-batch embeds and
    writes back, publishing progress."""
    from corpusmap.streaming.ingest import scratch_root, stream_embed
    root = scratch_root(spark, "stream-embed")
    pr = ST.projects(spark, sf_dir)
    store_path = f"{root}/store"
    pr.write.mode("overwrite").partitionBy("hackathon").parquet(store_path)
    pend = f"{root}/pending"
    pr.filter(F.col("vector").isNull()).select("id").repartition(3).write.mode("overwrite").parquet(pend)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    res = stream_embed(spark, pend, texts, store_path, root, dim=64)
    out = spark.read.parquet(res["path"])
    return out.select("id", F.col("vector").isNotNull().alias("has_vector"))


ORACLE_SQL["stream_embed"] = with_sql(PROJECTS_SQL, WORDY_SQL) + """
SELECT p.id, (p.vector IS NOT NULL OR w.doc_id IS NOT NULL) AS has_vector
FROM projects p LEFT JOIN wordy w ON w.doc_id = p.id"""


@register("map_categories", with_sql(REPOS_SQL, PROJECTS_SQL, REGISTRY_SQL, MEMBERS_SQL, MEMBER_INDEX_SQL,
                                     CATEGORY_LABELS_SQL, """
sims AS (SELECT m.dataset, m.id, m.idx, c.idx AS cat, list_cosine_similarity(m.vector::DOUBLE[], c.vector) AS sim
         FROM mi m, cat_labels c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset, id ORDER BY sim DESC, cat) AS rn FROM sims)""") + """
SELECT dataset, idx::BIGINT AS idx, id::BIGINT AS id, cat::BIGINT AS category, (round(sim, 4) + 0.0) AS similarity
FROM ranked WHERE rn = 1""")
def q_map_categories(spark, sf_dir):
    """STR-4's non-PCA columns: every point's index and category in its map."""
    points, _, _ = _maps(spark, sf_dir)
    return points.select("dataset", "idx", F.col("id").cast("long"), "category", "similarity")


@register("answer_neighbours", with_sql(REPOS_SQL, PROJECTS_SQL, REGISTRY_SQL, MEMBERS_SQL, MEMBER_INDEX_SQL,
                                        CATEGORY_LABELS_SQL, hash_sql("q", "benchmark", "item_id", "text"),
                                        BENCH_QD_SQL, QUERY_NEIGHBOURS_SQL) + """
SELECT n.query_id::BIGINT AS query_id, n.dataset, n.rank::BIGINT AS rank, n.idx::BIGINT AS nearest_idx,
       n.id::BIGINT AS nearest_id, c.cat::BIGINT AS category, (round(c.sim, 4) + 0.0) AS similarity
FROM nranked n JOIN qcat c ON c.query_id = n.query_id AND c.rn = 1
WHERE n.rank <= 8""")
def q_answer_neighbours(spark, sf_dir):
    """VEC-8's non-PCA part: each query's 8 nearest points of its dataset
    (index and id) and its category."""
    points, proj, labels = _maps(spark, sf_dir)
    q = _bench_queries(spark, sf_dir)
    ans = MAPS.answer_queries(q.select("query_id", "dataset", "vector"), points, proj, labels)
    return ans.select(F.col("query_id").cast("long"), "dataset", F.col("rank").cast("long"),
                      F.col("nearest_idx").cast("long"), F.col("nearest_id").cast("long"), "category", "similarity")


ORACLE_SQL["answer_text_queries"] = with_sql(REPOS_SQL, PROJECTS_SQL, REGISTRY_SQL, MEMBERS_SQL, MEMBER_INDEX_SQL,
                                          CATEGORY_LABELS_SQL, TEXT_REQ_SQL,
                                          hash_sql("q", "tvalid", "query_id", "text"), """
qd AS (SELECT DISTINCT q.k AS query_id, t.dataset FROM q_vec q JOIN tvalid t ON t.query_id = q.k)""",
                                          QUERY_NEIGHBOURS_SQL) + """
SELECT n.query_id::BIGINT AS query_id, n.dataset, n.rank::INTEGER AS rank, n.id::BIGINT AS nearest_id,
       c.cat::BIGINT AS category, NULL::VARCHAR AS reason
FROM nranked n JOIN qcat c ON c.query_id = n.query_id AND c.rn = 1 WHERE n.rank <= 8
UNION ALL
SELECT query_id::BIGINT, NULL, NULL, NULL, NULL, reason FROM tcheck WHERE reason IS NOT NULL
UNION ALL
SELECT t.query_id::BIGINT, NULL, NULL, NULL, NULL, 'nothing to embed' FROM tvalid t
WHERE t.query_id NOT IN (SELECT k FROM q_vec)"""


@register("sync_pass")
def q_sync_pass(spark, sf_dir):
    """STR-1..4 composed: two passes of the service loop over a store folder
    (the gallery pages split in two halves by page number, as two fetch
    rounds); returns the newest generation of every dataset's points."""
    from corpusmap.plans import sync as SYNC
    from corpusmap.streaming.ingest import scratch_root
    root = scratch_root(spark, "sync")
    SYNC.init_store(ST.projects(spark, sf_dir), root)
    gp = cut_lineage_bronze(ST.gallery_pages(spark, sf_dir).select("hackathon", "page", "status", "html"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = SIM.label_matrix(ST.category_labels(spark, sf_dir))
    repos = ST.repos(spark, sf_dir)
    for half in (F.col("page") % 2 == 1, F.col("page") % 2 == 0):   # two rounds of fetched pages
        SYNC.sync_pass(spark, root, gp.filter(half), texts, repos, ST.registry(spark, sf_dir), labels, dim=64)
    points, _, _ = SYNC.read_maps(spark, root)
    return points.select("dataset", "generation", "idx", F.col("id").cast("long"), "category", "similarity")


EMBEDDED_SQL = """
dvec AS (SELECT k AS id, list(val ORDER BY bucket) AS v, list(bucket ORDER BY bucket) AS b FROM d_vec GROUP BY k),
ddense AS (SELECT id, [coalesce(v[list_position(b, i)], 0.0::FLOAT) FOR i IN range(64)] AS vec FROM dvec),
embedded AS (
  SELECT s.id, s.hackathon, s.year, s.winner, s.prizes, s.likes,
         CASE WHEN s.vector IS NOT NULL THEN s.vector
              WHEN s.hackathon IN (SELECT hackathon FROM registry) THEN d.vec END AS vector,
         s.vector IS NULL AND s.hackathon IN (SELECT hackathon FROM registry) AND d.vec IS NOT NULL AS now
  FROM projects_state s LEFT JOIN ddense d ON d.id = s.id)"""


ORACLE_SQL["sync_pass"] = with_sql(PROJECTS_SQL, REGISTRY_SQL, REPOS_SQL, GALLERY_EXPECTED_SQL, CATEGORY_LABELS_SQL,
                                   hash_sql("d", "documents", "doc_id", "text"), GALLERY_BATCH_SQL, PROJECT_UPSERT_SQL,
                                   EMBEDDED_SQL, MEMBERS_SQL.replace("FROM projects p", "FROM embedded p"), MEMBER_INDEX_SQL, """
sims AS (SELECT m.dataset, m.id, m.idx, c.idx AS cat, list_cosine_similarity(m.vector::DOUBLE[], c.vector) AS sim
         FROM mi m, cat_labels c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset, id ORDER BY sim DESC, cat) AS rn FROM sims),
second AS (SELECT DISTINCT m.dataset FROM members m JOIN gbatch g ON g.id = m.id
           WHERE m.dataset <> 'github' AND g.page > 1)""") + """
SELECT r.dataset, (CASE WHEN s.dataset IS NOT NULL THEN 2 ELSE 1 END)::BIGINT AS generation, r.idx::BIGINT AS idx,
       r.id::BIGINT AS id, r.cat::BIGINT AS category, (round(r.sim, 4) + 0.0) AS similarity
FROM ranked r LEFT JOIN second s ON s.dataset = r.dataset WHERE r.rn = 1"""


@register("incremental_scatter", PROJECT_STATE_SQL + ",\n" + ",\n".join(f.strip() for f in (
    REGISTRY_SQL, REPOS_SQL, hash_sql("d", "documents", "doc_id", "text"), EMBEDDED_SQL,
    MEMBERS_SQL.replace("FROM projects p", "FROM embedded p"), """
cells AS (SELECT m.dataset, m.id, u.pos - 1 AS i, u.val::DOUBLE AS v
          FROM members m, unnest(m.vector) WITH ORDINALITY AS u(val, pos)),
mu AS (SELECT dataset, i, avg(v) AS mu FROM cells GROUP BY ALL),
c AS (SELECT cells.dataset, cells.id, cells.i, cells.v - mu.mu AS cv FROM cells JOIN mu USING (dataset, i))""")) + """
SELECT a.dataset, a.i::BIGINT AS i, b.i::BIGINT AS j, (round(sum(a.cv * b.cv), 6) + 0.0) AS value
FROM c a JOIN c b ON a.dataset = b.dataset AND a.id = b.id GROUP BY ALL""")
def q_incremental_scatter(spark, sf_dir):
    """STR-3, AGG-2: the stored statistics of all maps follow two changes of the
    store -- an upsert that moves projects between hackathons, then the
    embedding of pending ones -- from the changed rows alone."""
    from corpusmap.operators.projection import gram_rows, scatter_of
    from corpusmap.session import cut_lineage
    repos, reg = ST.repos(spark, sf_dir), ST.registry(spark, sf_dir)
    project = F.lit("project").alias("kind")
    stored = cut_lineage(gram_rows(S.dataset_members(repos, ST.projects(spark, sf_dir), reg)), "statistics")
    now, old = cut_lineage(_projects_after(spark, sf_dir), "state"), ST.projects(spark, sf_dir)
    ids = cut_lineage(now.filter("action <> 'unchanged'").select(project, "id"), "changed")
    for step in range(2):
        if step:
            pending = S.pending_projects(now, reg).select("id")
            texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
            vecs = cut_lineage(E.hashing_vectors(texts.join(pending, "id", "left_semi"), "id", "text"), "vectors")
            old, now, ids = now, U.write_vectors(now, vecs), vecs.select(project, "id")
        gone = S.dataset_members(repos.limit(0), old, reg).join(ids, ["kind", "id"], "left_semi")
        come = S.dataset_members(repos, now, reg)
        known = stored.select("dataset").distinct().unionByName(come.select("dataset").distinct()).distinct()
        stored = cut_lineage(MAPS.refresh_statistics(stored, gone, come, ids, known), "statistics")
    return scatter_of(stored).select("dataset", F.col("i").cast("long"), F.col("j").cast("long"),
                                     F.round("value", 6).alias("value"))


@register("service_pass", with_sql(PROJECTS_SQL, REGISTRY_SQL, REPOS_SQL, GALLERY_EXPECTED_SQL, DOC_PAGES_SQL, WORDY_SQL,
                                   hash_sql("d", "documents", "doc_id", "text"), GALLERY_BATCH_SQL, PROJECT_UPSERT_SQL,
                                   EMBEDDED_SQL, """
repo_pages AS (SELECT *, (idx // 20 + 1) AS page, (idx // 20) // 10 AS win FROM doc_pages),
bad_windows AS (SELECT DISTINCT win FROM repo_pages WHERE page % 17 = 5 OR page % 19 = 7),
repo_batch AS (
  SELECT source || '/' || CAST(doc_id AS VARCHAR) AS name,
         CASE WHEN doc_id % 4 = 0 OR doc_id % 9 = 0 THEN NULL ELSE text END AS "desc",
         (CASE WHEN doc_id % 10 = 0 THEN 0 ELSE n_chars END)::BIGINT AS stars, [lang, source] AS topics,
         (page * 1000 + idx % 20)::BIGINT AS ord
  FROM repo_pages WHERE win NOT IN (SELECT win FROM bad_windows))""", REPO_UPSERT_SQL, """
rtop AS (SELECT * FROM repos_after ORDER BY stars DESC NULLS LAST, id LIMIT 1000),
won AS (SELECT page_id AS id, CASE WHEN page_id % 10 = 9 OR page_id % 3 = 0 THEN ''
               ELSE 'Prize ' || CAST(page_id AS VARCHAR) || ' & more' || chr(10) || 'Runner up' END AS prizes FROM pages)""") + """
SELECT 'repo' AS kind, r.id, r.name, r.stars AS score,
       r.vector IS NOT NULL OR (w.name IS NOT NULL AND r.id IN (SELECT id FROM rtop)) AS has_vector, NULL AS prizes
FROM repos_after r LEFT JOIN wordy w ON w.name = r.name
UNION ALL
SELECT 'project', e.id, NULL, e.likes, e.vector IS NOT NULL,
       CASE WHEN coalesce(e.winner, false) AND w.id IS NOT NULL
                 AND (e.now OR (e.prizes IS NULL AND e.hackathon IN (SELECT hackathon FROM registry)))
            THEN w.prizes ELSE array_to_string(e.prizes, chr(10)) END
FROM embedded e LEFT JOIN won w ON w.id = e.id""")
def q_service_pass(spark, sf_dir):
    """STR-1..4 with all sources: repo windows (one with a bad page is dropped and
    no repo is embedded in that pass), galleries, vectors and prizes. The second
    pass has the whole windows only, so its pending repos are embedded. Returns
    the stores."""
    from corpusmap.plans import sync as SYNC
    from corpusmap.streaming.ingest import scratch_root
    root = scratch_root(spark, "service")
    SYNC.init_store(ST.projects(spark, sf_dir), root, ST.repos(spark, sf_dir))
    d = table(spark, sf_dir, "documents")
    texts = d.select(F.col("doc_id").alias("id"), "text")
    readmes = d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("name"), "text")
    listings = cut_lineage_bronze(ST.repo_listing_pages(spark, sf_dir)).withColumn("window", F.floor((F.col("page") - 1) / 10))
    bad = listings.filter("page % 17 = 5 OR page % 19 = 7").select("window")
    prizes = PG.page_prizes(ST.project_pages(spark, sf_dir)).select(F.col("page_id").cast("long").alias("id"), "prizes")
    gp = cut_lineage_bronze(ST.gallery_pages(spark, sf_dir).select("hackathon", "page", "status", "html"))
    labels = SIM.label_matrix(ST.category_labels(spark, sf_dir))
    for pages, lists in ((gp, listings), (gp.limit(0), listings.join(bad, "window", "left_anti"))):
        SYNC.sync_pass(spark, root, pages, texts, None, ST.registry(spark, sf_dir), labels, 64, listings=lists,
                       readmes=readmes, prizes=prizes)
    repos = spark.read.parquet(f"{root}/repos").select(
        F.lit("repo").alias("kind"), "id", "name", F.col("stars").alias("score"), F.col("vector").isNotNull().alias("has_vector"),
        F.lit(None).cast("string").alias("prizes"))
    return repos.unionByName(spark.read.parquet(f"{root}/projects").select(
        F.lit("project").alias("kind"), "id", F.lit(None).cast("string").alias("name"), F.col("likes").alias("score"),
        F.col("vector").isNotNull().alias("has_vector"), F.array_join("prizes", "\n").alias("prizes")))


@register("stream_upsert_repos", with_sql(REPOS_SQL, DOC_PAGES_SQL, """
repo_batch AS (
  SELECT source || '/' || CAST(doc_id AS VARCHAR) AS name,
         CASE WHEN doc_id % 4 = 0 OR doc_id % 9 = 0 THEN NULL ELSE text END AS "desc",
         (CASE WHEN doc_id % 10 = 0 THEN 0 ELSE n_chars END)::BIGINT AS stars, [lang, source] AS topics,
         ((idx // 20 + 1) * 1000 + idx % 20)::BIGINT AS ord
  FROM doc_pages WHERE NOT ((idx // 20 + 1) % 17 = 5 OR (idx // 20 + 1) % 19 = 7))""", REPO_UPSERT_SQL) + """
SELECT id, name, "desc", stars, array_to_string(topics, ' ') AS topics, vector IS NOT NULL AS has_vector, action
FROM repos_after""")
def q_stream_upsert_repos(spark, sf_dir):
    """STR-1 for the repo source: search-result pages arrive as files (three
    fetch rounds, in page order); each micro-batch is parsed and upserted into
    the bucketed repo store. Returns the final store."""
    from corpusmap.streaming.ingest import scratch_root, stream_upsert_repos
    root = scratch_root(spark, "stream-repos")
    pages = cut_lineage_bronze(ST.repo_listing_pages(spark, sf_dir))
    src = f"{root}/incoming"
    n = pages.agg(F.max("page")).first()[0] or 0
    res, known = None, 0
    for lo in range(0, n, max(1, -(-n // 3))):             # three rounds, one after another; a round is one micro-batch
        hi = lo + max(1, -(-n // 3))
        pages.filter((F.col("page") > lo) & (F.col("page") <= hi)).write.mode("append").parquet(src)
        files = len(spark.read.schema(pages.schema).parquet(src).inputFiles())
        res = stream_upsert_repos(spark, src, pages.schema, ST.repos(spark, sf_dir), root, max_files_per_trigger=max(1, files - known))
        known = files
    store = spark.read.parquet(res["path"])
    before = ST.repos(spark, sf_dir).select("name", F.col("desc").alias("_d0"), F.col("stars").alias("_s0"),
                                            F.col("topics").alias("_t0"), F.lit(True).alias("_was"))
    out = store.join(before, "name", "left")
    changed = (~F.col("desc").eqNullSafe(F.col("_d0")) | ~F.col("stars").eqNullSafe(F.col("_s0"))
               | ~F.col("topics").eqNullSafe(F.col("_t0")))
    action = F.when(F.col("_was").isNull(), "insert").when(changed, "update").otherwise("unchanged")
    return out.select("id", "name", "desc", "stars", F.array_join("topics", " ").alias("topics"),
                      F.col("vector").isNotNull().alias("has_vector"), action.alias("action"))
