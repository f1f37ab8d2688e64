"""Store queries: top-k, upserts, pending filters, write-backs, catalog and run reports, vector codec, column probing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmap.plans.queries.base import (ORACLE_SQL, E, GALLERY_EXPECTED_SQL, M, PG, PROJECTS_SQL, PROJECT_STATE_SQL,
                                          REGISTRY_SQL, REPOS_SQL, REPO_BATCH_SQL, REPO_UPSERT_SQL, S, ST,
                                          STORE, U, WORDY_SQL, _projects_after, _repos_after, register,
                                          table, with_sql)  # noqa: F401


@register("top_repos", with_sql(REPOS_SQL) + """
SELECT id, name, stars FROM repos ORDER BY stars DESC NULLS LAST, id LIMIT 1000""")
def q_top_repos(spark, sf_dir):
    return S.top_repos(ST.repos(spark, sf_dir)).select("id", "name", "stars")


@register("upsert_repos", with_sql(REPOS_SQL, REPO_BATCH_SQL, REPO_UPSERT_SQL) + """
SELECT id, name, "desc", stars, array_to_string(topics, ' ') AS topics, vector IS NOT NULL AS has_vector, action
FROM repos_after""")
def q_upsert_repos(spark, sf_dir):
    st = _repos_after(spark, sf_dir)
    return st.select("id", "name", "desc", "stars", F.array_join("topics", " ").alias("topics"),
                     F.col("vector").isNotNull().alias("has_vector"), "action")


@register("pending_repos", with_sql(REPOS_SQL, REPO_BATCH_SQL, REPO_UPSERT_SQL) + """
SELECT id, name, stars FROM (SELECT * FROM repos_after ORDER BY stars DESC NULLS LAST, id LIMIT 1000) t
WHERE vector IS NULL""")
def q_pending_repos(spark, sf_dir):
    return S.pending_repos(_repos_after(spark, sf_dir)).select("id", "name", "stars")


@register("union_windows", with_sql(REPOS_SQL, REPO_BATCH_SQL, """
windows AS (
  SELECT * FROM repo_batch WHERE stars >= 4000
  UNION ALL SELECT * FROM repo_batch WHERE stars BETWEEN 2000 AND 3999
  UNION ALL SELECT * FROM repo_batch WHERE stars BETWEEN 0 AND 1999)""") + """
SELECT CASE WHEN stars >= 4000 THEN '4000..*' WHEN stars >= 2000 THEN '2000..3999' ELSE '0..1999' END AS star_window,
       count(*)::BIGINT AS rows, count(DISTINCT name)::BIGINT AS names FROM windows GROUP BY 1""")
def q_union_windows(spark, sf_dir):
    from corpusmap.sources.manifests import star_windows_union
    b = ST.repo_batch(spark, sf_dir)
    u = star_windows_union(b, [(4000, None), (2000, 3999), (0, 1999)])
    return u.groupBy(F.col("window").alias("star_window")).agg(F.count(F.lit(1)).alias("rows"),
                                                               F.countDistinct("name").alias("names"))


@register("upsert_projects", PROJECT_STATE_SQL + """
SELECT id, slug, name, tagline, likes, array_to_string(members, ' ') AS members, hackathon, year::BIGINT AS year,
       winner, array_to_string(prizes, chr(10)) AS prizes, vector IS NOT NULL AS has_vector, action
FROM projects_state""")
def q_upsert_projects(spark, sf_dir):
    st = _projects_after(spark, sf_dir)
    return st.select("id", "slug", "name", "tagline", "likes", F.array_join("members", " ").alias("members"),
                     "hackathon", F.col("year").cast("long"), "winner",
                     F.array_join("prizes", "\n").alias("prizes"),
                     F.col("vector").isNotNull().alias("has_vector"), "action")


@register("slug_conflicts", PROJECT_STATE_SQL + """
SELECT slug, count(DISTINCT id)::BIGINT AS n_ids, min(id)::BIGINT AS min_id, max(id)::BIGINT AS max_id
FROM projects_state GROUP BY slug HAVING count(DISTINCT id) > 1""")
def q_slug_conflicts(spark, sf_dir):
    return U.slug_conflicts(_projects_after(spark, sf_dir)).select(
        "slug", F.col("n_ids").cast("long"), F.col("min_id").cast("long"), F.col("max_id").cast("long"))


@register("slug_index_conflicts", ORACLE_SQL["slug_conflicts"])
def q_slug_index_conflicts(spark, sf_dir):
    """JOIN-7 from the slug index: built from the stored projects, asked only for
    the buckets of the slugs that the upsert adds."""
    from corpusmap.operators import slugs as SL
    from corpusmap.streaming.ingest import scratch_root
    path = f"{scratch_root(spark, 'slugs')}/index"
    stored = ST.projects(spark, sf_dir)
    SL.build_slug_index(stored, path)
    removed, added = SL.slug_changes(stored, _projects_after(spark, sf_dir))
    return SL.conflicting_claims(path, removed, added).select(
        "slug", F.col("n_ids").cast("long"), F.col("min_id").cast("long"), F.col("max_id").cast("long"))


@register("sync_report", PROJECT_STATE_SQL + """
SELECT hackathon, count(*)::BIGINT AS rows, count_if(action = 'insert')::BIGINT AS inserted,
       count_if(action = 'update')::BIGINT AS updated, count_if(vector IS NOT NULL)::BIGINT AS with_vector,
       count_if(vector IS NULL)::BIGINT AS pending
FROM projects_state GROUP BY hackathon""")
def q_sync_report(spark, sf_dir):
    r = S.sync_report(_projects_after(spark, sf_dir), ["hackathon"])
    return r.select("hackathon", *[F.col(c).cast("long") for c in ("rows", "inserted", "updated",
                                                                   "with_vector", "pending")])


@register("pending_projects", with_sql(PROJECTS_SQL, REGISTRY_SQL) + """
SELECT id, hackathon FROM projects WHERE vector IS NULL AND hackathon IN (SELECT hackathon FROM registry)""")
def q_pending_projects(spark, sf_dir):
    return S.pending_projects(ST.projects(spark, sf_dir), ST.registry(spark, sf_dir)).select("id", "hackathon")


@register("pending_prizes", with_sql(PROJECTS_SQL, REGISTRY_SQL) + """
SELECT id, hackathon FROM projects
WHERE coalesce(winner, false) AND prizes IS NULL AND hackathon IN (SELECT hackathon FROM registry)""")
def q_pending_prizes(spark, sf_dir):
    return S.pending_prizes(ST.projects(spark, sf_dir), ST.registry(spark, sf_dir)).select("id", "hackathon")


@register("dataset_rows", with_sql(PROJECTS_SQL, REGISTRY_SQL) + """
SELECT p.hackathon, p.year::BIGINT AS year, count(*)::BIGINT AS points, min(p.id)::BIGINT AS first_id
FROM projects p JOIN registry r ON p.hackathon = r.hackathon
WHERE p.vector IS NOT NULL GROUP BY ALL""")
def q_dataset_rows(spark, sf_dir):
    out = S.dataset_rows_all(ST.projects(spark, sf_dir), ST.registry(spark, sf_dir))
    return out.groupBy("hackathon", F.col("year").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("points"), F.min("id").cast("long").alias("first_id"))


@register("point_columns", with_sql(PROJECTS_SQL) + """
SELECT id, slug, coalesce(winner, false) AS winner,
       array_to_string(coalesce(list_filter(prizes, lambda x: x <> ''), []), chr(10)) AS prizes,
       len(coalesce(list_filter(prizes, lambda x: x <> ''), []))::BIGINT AS n_prizes
FROM projects""")
def q_point_columns(spark, sf_dir):
    pc = S.point_columns(ST.projects(spark, sf_dir))
    return pc.select("id", "slug", "winner", F.array_join("prizes", "\n").alias("prizes"),
                     F.size("prizes").cast("long").alias("n_prizes"))


@register("hackathon_years", with_sql(PROJECTS_SQL) + """
SELECT hackathon, array_to_string(list_sort(list(DISTINCT year), 'DESC'), ' ') AS years
FROM projects WHERE vector IS NOT NULL AND year IS NOT NULL AND hackathon IS NOT NULL GROUP BY hackathon""")
def q_hackathon_years(spark, sf_dir):
    y = S.hackathon_years(ST.projects(spark, sf_dir))
    return y.select("hackathon", F.array_join("years", " ").alias("years"))


@register("catalog", with_sql(PROJECTS_SQL, REGISTRY_SQL, """
yrs AS (SELECT hackathon, list_sort(list(DISTINCT year), 'DESC') AS years FROM projects
        WHERE vector IS NOT NULL AND year IS NOT NULL GROUP BY hackathon)""") + """
SELECT 0::BIGINT AS pos, 'github' AS id, 'GitHub' AS label, '' AS years
UNION ALL
SELECT (r.pos + 1)::BIGINT, r.hackathon, r.label, coalesce(array_to_string(y.years, ' '), '')
FROM registry r LEFT JOIN yrs y ON r.hackathon = y.hackathon""")
def q_catalog(spark, sf_dir):
    c = S.catalog(ST.projects(spark, sf_dir), ST.registry(spark, sf_dir))
    return c.select(F.col("pos").cast("long"), "id", "label", F.array_join("years", " ").alias("years"))


@register("join_lists", with_sql(PROJECTS_SQL) + """
SELECT id, CASE WHEN len(members) > 0 THEN array_to_string(members, ' ') END AS members,
       CASE WHEN len([x FOR x IN members IF x = 'u0']) > 0 THEN array_to_string([x FOR x IN members IF x = 'u0'], ' ') END AS u0
FROM projects""")
def q_join_lists(spark, sf_dir):
    p = ST.projects(spark, sf_dir).select("id", "members",
                                          F.filter("members", lambda x: x == F.lit("u0")).alias("u0"))
    return S.join_lists(p, ["members", "u0"]).select("id", "members", "u0")


@register("write_prizes", with_sql(PROJECTS_SQL, """
fetched AS (SELECT doc_id::BIGINT AS id,
                   CASE WHEN toxic = 1 THEN NULL ELSE ['Prize ' || CAST(quality AS VARCHAR)] END AS prizes
            FROM labels)""") + """
SELECT p.id, array_to_string(CASE WHEN f.prizes IS NOT NULL AND coalesce(p.winner, false) THEN f.prizes
                                  ELSE p.prizes END, chr(10)) AS prizes
FROM projects p LEFT JOIN fetched f ON p.id = f.id""")
def q_write_prizes(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    fetched = lab.select(F.col("doc_id").cast("long").alias("id"),
                         F.when(F.col("toxic") == 1, F.lit(None).cast("array<string>"))
                         .otherwise(F.array(F.concat(F.lit("Prize "), F.col("quality").cast("string"))))
                         .alias("prizes"))
    out = U.write_prizes(ST.projects(spark, sf_dir), fetched, only_winners=True)
    return out.select("id", F.array_join("prizes", "\n").alias("prizes"))


@register("write_vectors", with_sql(PROJECTS_SQL, WORDY_SQL) + """
SELECT p.id, (p.vector IS NOT NULL OR w.doc_id IS NOT NULL) AS has_vector,
       (CASE WHEN p.vector IS NOT NULL OR w.doc_id IS NOT NULL THEN 64 END)::BIGINT AS dim
FROM projects p LEFT JOIN wordy w ON w.doc_id = p.id""")
def q_write_vectors(spark, sf_dir):
    pr = ST.projects(spark, sf_dir)
    d = table(spark, sf_dir, "documents")
    pending = pr.filter(F.col("vector").isNull()).select("id")
    new = E.hashing_vectors(d.withColumnRenamed("doc_id", "id").join(pending, "id", "left_semi"), "id", "text")
    out = U.write_vectors(pr, new)
    has = F.col("vector").isNotNull()
    return out.select("id", has.alias("has_vector"), F.when(has, F.size("vector")).cast("long").alias("dim"))


@register("decode_vectors", """
SELECT vec_id::BIGINT AS vec_id, (u.pos - 1)::BIGINT AS pos, u.val::DOUBLE AS value
FROM embeddings e, unnest(e.embedding) WITH ORDINALITY AS u(val, pos)""")
def q_decode_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    enc = STORE.encode_vectors(e, "embedding", "blob")
    dec = STORE.decode_vectors(enc, "blob", dim=64, out="back")
    return dec.select(F.col("vec_id").cast("long"), F.posexplode("back").alias("pos", "value")) \
        .select("vec_id", F.col("pos").cast("long"), F.col("value").cast("double"))


@register("encode_vectors")
def q_encode_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    enc = STORE.encode_vectors(e, "embedding", "blob")
    return enc.select("vec_id", F.octet_length("blob").alias("n_bytes"), F.sha2("blob", 256).alias("digest"))


@register("ensure_columns", """
SELECT doc_id::BIGINT AS id, NULL::VARCHAR AS slug, source AS hackathon, NULL::BIGINT AS year,
       NULL::BOOLEAN AS winner, lang AS extra FROM documents""")
def q_ensure_columns(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("hackathon"),
                                                 F.col("lang").alias("extra"))
    out = STORE.ensure_columns(d, STORE.PROJECTS_SCHEMA)
    return out.select("id", "slug", "hackathon", F.col("year").cast("long"), "winner", "extra")


@register("catalog_document", with_sql(PROJECTS_SQL, REGISTRY_SQL, """
yrs AS (SELECT hackathon, list_sort(list(DISTINCT year), 'DESC') AS years FROM projects
        WHERE vector IS NOT NULL AND year IS NOT NULL AND hackathon IS NOT NULL GROUP BY hackathon),
entries AS (
  SELECT 0 AS pos, 'github' AS id, 'GitHub' AS label, []::INTEGER[] AS years
  UNION ALL
  SELECT r.pos + 1, r.hackathon, r.label, coalesce(y.years, []::INTEGER[])
  FROM registry r LEFT JOIN yrs y ON r.hackathon = y.hackathon)""") + """
SELECT CAST(to_json({'github': {'label': (SELECT label FROM entries WHERE pos = 0)},
                     'hackathons': list({'id': id, 'label': label, 'years': years} ORDER BY pos)}) AS VARCHAR) AS document
FROM entries WHERE pos > 0""")
def q_catalog_document(spark, sf_dir):
    """AGG-5 as the single JSON document the catalog request returns (one
    entry per registered hackathon plus github: a configuration-sized list)."""
    c = S.catalog(ST.projects(spark, sf_dir), ST.registry(spark, sf_dir))
    return S.catalog_document(c)


@register("pass_report", with_sql(PROJECTS_SQL, REGISTRY_SQL, WORDY_SQL, GALLERY_EXPECTED_SQL, """
gp AS (SELECT hackathon, page, count_if(has_link) AS cards, NOT ((page + any_value(n_items)) % 7 = 0) AS ok
       FROM gcards GROUP BY hackathon, page),
gstop AS (SELECT hackathon, min(CASE WHEN NOT ok OR cards <= 0 THEN page END) AS first_bad FROM gp GROUP BY hackathon),
walk AS (SELECT g.hackathon, count_if(g.page < coalesce(s.first_bad, g.page + 1))::BIGINT AS pages_walked,
                coalesce(sum(CASE WHEN g.page < coalesce(s.first_bad, g.page + 1) THEN g.cards END), 0)::BIGINT AS cards_found
         FROM gp g JOIN gstop s USING (hackathon) GROUP BY g.hackathon),
emb AS (SELECT p.hackathon,
               count_if(p.vector IS NULL AND p.hackathon IN (SELECT hackathon FROM registry)
                        AND w.doc_id IS NOT NULL)::BIGINT AS vectors_written,
               count_if(p.vector IS NULL AND NOT (p.hackathon IN (SELECT hackathon FROM registry)
                        AND w.doc_id IS NOT NULL))::BIGINT AS pending_left
        FROM projects p LEFT JOIN wordy w ON w.doc_id = p.id GROUP BY p.hackathon)""") + """
SELECT coalesce(w.hackathon, e.hackathon) AS hackathon, coalesce(w.pages_walked, 0)::BIGINT AS pages_walked,
       coalesce(w.cards_found, 0)::BIGINT AS cards_found, coalesce(e.vectors_written, 0)::BIGINT AS vectors_written,
       coalesce(e.pending_left, 0)::BIGINT AS pending_left
FROM walk w FULL OUTER JOIN emb e ON w.hackathon IS NOT DISTINCT FROM e.hackathon""")
def q_pass_report(spark, sf_dir):
    """AGG-9: one pass over every hackathon -- the gallery walk (pages kept by
    SRC-13, cards found on them), then the embedding of pending projects of
    registered hackathons (vectors written, rows still pending)."""
    from corpusmap.session import cut_lineage
    gp = cut_lineage(ST.gallery_pages(spark, sf_dir))          # the stored bronze pages
    _, counts = PG.parse_gallery(gp, keys=["hackathon", "page"])
    pages = (gp.select("hackathon", "page", (F.col("status") == 200).alias("ok"))
             .join(counts, ["hackathon", "page"], "left")
             .withColumn("cards", F.coalesce(F.col("cards"), F.lit(0)).cast("long")))
    walk = M.contiguous_pages(pages, "hackathon", "keep_prefix")
    before = ST.projects(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    pending = S.pending_projects(before, ST.registry(spark, sf_dir)).select("id")
    vecs = E.hashing_vectors(d.join(pending, "id", "left_semi"), "id", "text")
    after = U.write_vectors(before, vecs)
    return S.pass_report(walk, before, after)


@register("selection_rows", with_sql(REPOS_SQL, PROJECTS_SQL) + """
SELECT 'github' AS selection, id FROM (
  SELECT id FROM repos WHERE vector IS NOT NULL ORDER BY stars DESC NULLS LAST, id LIMIT 1000)
UNION ALL SELECT 'src1', id FROM projects WHERE vector IS NOT NULL AND hackathon = 'src1'
UNION ALL SELECT 'src2/2023', id FROM projects WHERE vector IS NOT NULL AND hackathon = 'src2' AND year = 2023""")
def q_selection_rows(spark, sf_dir):
    """FIL-6 one selection at a time: top repos, a hackathon, a hackathon's year."""
    repos, projects = ST.repos(spark, sf_dir), ST.projects(spark, sf_dir)
    parts = {"github": S.dataset_rows(repos, None), "src1": S.dataset_rows(None, projects, "src1"),
             "src2/2023": S.dataset_rows(None, projects, "src2", 2023)}
    out = None
    for name, rows in parts.items():
        part = rows.select(F.lit(name).alias("selection"), "id")
        out = part if out is None else out.unionByName(part)
    return out
