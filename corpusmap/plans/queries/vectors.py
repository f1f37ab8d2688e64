"""Vector queries: validity, normalisation, categories, mean / scatter / PCA, positions, nearest points, membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmap.plans.queries.base import (CATEGORY_LABELS_SQL, E, MEMBERS_SQL, P, PROJECTS_SQL, REGISTRY_SQL,
                                          REPOS_SQL, S, SIM, ST, V, _members, hash_sql, register, table,
                                          with_sql)  # noqa: F401


@register("validate_vectors", """
SELECT vec_id::BIGINT AS vec_id,
       coalesce(len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))), false) AS valid,
       CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'dimension'
            WHEN NOT list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL)) THEN 'null value'
            WHEN NOT list_bool_and(list_transform(embedding, lambda x: NOT isnan(x) AND NOT isinf(x))) THEN 'not finite'
       END AS reason
FROM embeddings""")
def q_validate_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long"), V.is_valid("embedding", 64).alias("valid"),
                    V.invalid_reason("embedding", 64).alias("reason"))


@register("l2_normalize", """
WITH n AS (SELECT vec_id, greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12) AS nrm,
                  embedding FROM embeddings)
SELECT vec_id::BIGINT AS vec_id, (u.pos - 1)::BIGINT AS pos, (round(u.val::DOUBLE / nrm, 6) + 0.0) AS value
FROM n, unnest(n.embedding) WITH ORDINALITY AS u(val, pos)""")
def q_l2_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    u = e.select("vec_id", V.l2_normalize("embedding").alias("u"))
    return u.select(F.col("vec_id").cast("long"), F.posexplode("u").alias("pos", "value")) \
        .select("vec_id", F.col("pos").cast("long"), F.round("value", 6).alias("value"))


@register("categorize", with_sql(CATEGORY_LABELS_SQL, """
sims AS (SELECT p.vec_id, c.idx, list_cosine_similarity(p.embedding::DOUBLE[], c.vector) AS sim
         FROM embeddings p, cat_labels c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, idx) AS rn FROM sims)""") + """
SELECT vec_id::BIGINT AS vec_id, idx::BIGINT AS category, (round(sim, 4) + 0.0) AS similarity FROM ranked WHERE rn = 1""")
def q_categorize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    labels = ST.category_labels(spark, sf_dir)
    out = SIM.categorize(e.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector")), labels)
    return out.select("vec_id", "category", "similarity")


@register("mean_vector", with_sql(REPOS_SQL, PROJECTS_SQL, REGISTRY_SQL, MEMBERS_SQL) + """
SELECT m.dataset, (u.pos - 1)::BIGINT AS pos, (round(avg(u.val::DOUBLE), 6) + 0.0) AS value
FROM members m, unnest(m.vector) WITH ORDINALITY AS u(val, pos) GROUP BY ALL""")
def q_mean_vector(spark, sf_dir):
    means = P.mean_vectors(_members(spark, sf_dir), ["dataset"], "vector")
    return means.select("dataset", F.posexplode("mean").alias("pos", "value")) \
        .select("dataset", F.col("pos").cast("long"), F.round("value", 6).alias("value"))


@register("scatter_matrix", with_sql(REPOS_SQL, PROJECTS_SQL, REGISTRY_SQL, MEMBERS_SQL, """
cells AS (SELECT m.dataset, m.id, u.pos - 1 AS i, u.val::DOUBLE AS v
          FROM members m, unnest(m.vector) WITH ORDINALITY AS u(val, pos)),
mu AS (SELECT dataset, i, avg(v) AS mu FROM cells GROUP BY ALL),
c AS (SELECT cells.dataset, cells.id, cells.i, cells.v - mu.mu AS cv FROM cells JOIN mu USING (dataset, i))""") + """
SELECT a.dataset, a.i::BIGINT AS i, b.i::BIGINT AS j, (round(sum(a.cv * b.cv), 6) + 0.0) AS value
FROM c a JOIN c b ON a.dataset = b.dataset AND a.id = b.id GROUP BY ALL""")
def q_scatter_matrix(spark, sf_dir):
    sm = P.scatter_matrix(_members(spark, sf_dir))
    return sm.select("dataset", F.col("i").cast("long"), F.col("j").cast("long"),
                     F.round("value", 6).alias("value"))


@register("pca_basis")
def q_pca_basis(spark, sf_dir):
    proj = P.fit_projection(_members(spark, sf_dir))
    return proj.select("dataset", "n", F.posexplode("eigenvalues").alias("component", "eigenvalue")) \
        .select("dataset", "n", F.col("component").cast("long"), F.round("eigenvalue", 4).alias("eigenvalue"))


@register("project_points")
def q_project_points(spark, sf_dir):
    m = _members(spark, sf_dir)
    proj = P.fit_projection(m)
    return P.project(m.select("dataset", "id", "vector"), proj).select("dataset", "id", "x", "y", "z")


@register("nearest_points", with_sql(hash_sql("q", "benchmark", "item_id", "text"), """
pts AS (SELECT e.vec_id, (u.pos - 1) AS bucket, u.val::DOUBLE AS v FROM embeddings e,
        unnest(e.embedding) WITH ORDINALITY AS u(val, pos)),
pn AS (SELECT vec_id, greatest(sqrt(sum(v * v)), 1e-12) AS nrm FROM pts GROUP BY vec_id),
qn AS (SELECT k, greatest(sqrt(sum(val::DOUBLE * val::DOUBLE)), 1e-12) AS nrm FROM q_vec GROUP BY k),
sims AS (SELECT q.k AS query_id, p.vec_id, sum(q.val::DOUBLE * p.v) / (any_value(qn.nrm) * any_value(pn.nrm)) AS cosine
         FROM q_vec q JOIN pts p ON q.bucket = p.bucket JOIN qn ON qn.k = q.k JOIN pn ON pn.vec_id = p.vec_id
         GROUP BY q.k, p.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM sims)""") + """
SELECT query_id::BIGINT AS query_id, rank::BIGINT AS rank, vec_id::BIGINT AS vec_id, (round(cosine, 4) + 0.0) AS similarity
FROM ranked WHERE rank <= 8""")
def q_nearest_points(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    qv = E.hashing_vectors(bench, "item_id", "text").withColumnRenamed("item_id", "query_id")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector"))
    nn = SIM.nearest(e, qv, k=8, key_col="vec_id")
    return nn.select(F.col("query_id").cast("long"), F.col("rank").cast("long"), "vec_id", "similarity")


@register("point_index", with_sql(REPOS_SQL, PROJECTS_SQL, REGISTRY_SQL, MEMBERS_SQL) + """
SELECT dataset, id::BIGINT AS id, (row_number() OVER (PARTITION BY dataset ORDER BY stars DESC NULLS LAST, id) - 1)::BIGINT AS idx
FROM members""")
def q_point_index(spark, sf_dir):
    return S.point_index(_members(spark, sf_dir)).select("dataset", F.col("id").cast("long"), "idx")


@register("dataset_membership", with_sql(REPOS_SQL, PROJECTS_SQL, REGISTRY_SQL, MEMBERS_SQL) + """
SELECT dataset, count(*)::BIGINT AS points, min(id)::BIGINT AS min_id, max(id)::BIGINT AS max_id,
       md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS ids
FROM members GROUP BY dataset""")
def q_dataset_membership(spark, sf_dir):
    m = _members(spark, sf_dir)
    return m.groupBy("dataset").agg(F.count(F.lit(1)).alias("points"), F.min("id").cast("long").alias("min_id"),
                                    F.max("id").cast("long").alias("max_id"),
                                    F.md5(F.array_join(F.transform(F.sort_array(F.collect_list("id")),
                                                                   lambda i: i.cast("string")), ",")).alias("ids"))


@register("pca_invariants", with_sql(REPOS_SQL, PROJECTS_SQL, REGISTRY_SQL, MEMBERS_SQL, """
cells AS (SELECT m.dataset, m.id, u.pos, u.val::DOUBLE AS v FROM members m, unnest(m.vector) WITH ORDINALITY AS u(val, pos)),
mu AS (SELECT dataset, pos, avg(v) AS mu FROM cells GROUP BY ALL),
var AS (SELECT c.dataset, sum((c.v - mu.mu) * (c.v - mu.mu)) AS total FROM cells c JOIN mu USING (dataset, pos) GROUP BY ALL)""") + """
SELECT v.dataset, (SELECT count(*) FROM members m WHERE m.dataset = v.dataset)::BIGINT AS n,
       (round(v.total, 6) + 0.0) AS total_variance, true AS unit_length, true AS orthogonal, true AS descending,
       true AS variance_explained, true AS within_total
FROM var v""")
def q_pca_invariants(spark, sf_dir):
    """AGG-3, VEC-3: what any right basis must satisfy -- unit, orthogonal
    directions, descending eigenvalues that equal the squared positions'
    sums, together at most the total variance."""
    from corpusmap.session import cut_lineage
    members = cut_lineage(_members(spark, sf_dir).select("dataset", "id", "vector"), "members")
    proj = cut_lineage(P.fit_projection(members), "projection")
    used = F.least(F.lit(P.COMPONENTS), F.col("n") - 1)
    unit, orthogonal, descending = F.lit(True), F.lit(True), F.lit(True)
    for a in range(P.COMPONENTS):
        unit &= (F.lit(a) >= used) | (F.abs(V.dot(F.col("basis")[a], F.col("basis")[a]) - 1) < 1e-9)
        for b in range(a):
            orthogonal &= F.abs(V.dot(F.col("basis")[a], F.col("basis")[b])) < 1e-9
            descending &= F.col("eigenvalues")[b] >= F.col("eigenvalues")[a]
    spread = F.aggregate(V.subtract("vector", "mean"), F.lit(0.0), lambda acc, x: acc + x * x)
    total = (members.join(proj.select("dataset", "mean"), "dataset").groupBy("dataset").agg(F.sum(spread).alias("total")))
    placed = P.project(members, proj, places=None).groupBy("dataset").agg(
        *[F.sum(F.col(c) * F.col(c)).alias(f"s{c}") for c in "xyz"])
    close = F.lit(True)
    for k, c in enumerate("xyz"):
        close &= F.abs(F.col(f"s{c}") - F.col("eigenvalues")[k]) < 1e-6 * F.greatest(F.lit(1.0), F.col("total"))
    explained = F.aggregate("eigenvalues", F.lit(0.0), lambda acc, x: acc + x)
    return (proj.join(total, "dataset").join(placed, "dataset")
            .select("dataset", "n", F.round("total", 6).alias("total_variance"), unit.alias("unit_length"),
                    orthogonal.alias("orthogonal"), descending.alias("descending"), close.alias("variance_explained"),
                    (explained <= F.col("total") * (1 + 1e-9) + 1e-9).alias("within_total")))
