"""Shared pieces of the registered queries: the registry itself, the stand-in
builders reused by several queries, and the DuckDB SQL fragments the
independent checks are assembled from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Modules and SQL fragments below are also re-exported to the topic modules.
from corpusmap.functions import text as TX  # noqa: F401
from corpusmap.functions import vectors as V  # noqa: F401
from corpusmap.operators import encoders as E
from corpusmap.operators import projection as P  # noqa: F401
from corpusmap.operators import selection as S
from corpusmap.operators import similarity as SIM
from corpusmap.operators import tokenizer as TOK  # noqa: F401
from corpusmap.operators import upsert as U
from corpusmap.plans import maps as MAPS
from corpusmap.sources import listings as L  # noqa: F401
from corpusmap.sources import manifests as M  # noqa: F401
from corpusmap.sources import pages as PG  # noqa: F401
from corpusmap.sources import responses as R  # noqa: F401
from corpusmap.sources import standins as ST
from corpusmap.sources import store as STORE  # noqa: F401
from corpusmap.sources.standins import (CATEGORY_LABELS_SQL, PROJECT_BATCH_SQL, PROJECTS_SQL,  # noqa: F401
                                        REGISTRY_SQL, REPO_BATCH_SQL, REPOS_SQL, table, with_sql)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


MEMBERS_SQL = """
members AS (
  SELECT 'github' AS dataset, id, vector, NULL::VARCHAR AS hackathon, NULL::INTEGER AS year, stars FROM (
    SELECT id, vector, stars FROM repos WHERE vector IS NOT NULL) g
  UNION ALL
  SELECT x.dataset, x.id, x.vector, x.hackathon, x.year, NULL::BIGINT AS stars FROM (
    SELECT p.id, p.vector, p.hackathon, p.year,
           unnest([p.hackathon, p.hackathon || '/' || CAST(p.year AS VARCHAR)]) AS dataset
    FROM projects p WHERE p.vector IS NOT NULL AND p.hackathon IN (SELECT hackathon FROM registry)) x
  WHERE x.dataset IS NOT NULL)"""


HASH_SQL = """
{name}_words AS (
  SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '[a-z]+')) AS w FROM {src}),
{name}_cells AS (
  SELECT k, (('0x' || substr(md5(w), 1, 4))::INTEGER % {dim}) AS bucket, count(*)::DOUBLE AS cnt
  FROM {name}_words GROUP BY ALL),
{name}_norm AS (SELECT k, greatest(sqrt(sum(cnt * cnt)), 1e-12) AS nrm FROM {name}_cells GROUP BY k),
{name}_vec AS (
  SELECT c.k, c.bucket, (c.cnt / n.nrm)::FLOAT AS val FROM {name}_cells c JOIN {name}_norm n USING (k))"""


def hash_sql(name: str, src: str, key: str, text: str, dim: int = E.HASH_DIM) -> str:
    """Sparse hashing-encoder cells ``{name}_vec(k, bucket, val)`` of a table."""
    return HASH_SQL.format(name=name, src=src, key=key, text=text, dim=dim)


def truncate_sql(x: str, n: int = 32768) -> str:
    cuts = ", ".join(f"try(decode(encode({x})[1:{n - i}]))" for i in range(4))
    return f"(CASE WHEN strlen({x}) <= {n} THEN {x} ELSE coalesce({cuts}) END)"


def _members(spark, sf_dir):
    return S.dataset_members(ST.repos(spark, sf_dir), ST.projects(spark, sf_dir), ST.registry(spark, sf_dir))


REPO_UPSERT_SQL = """
rb_last AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord DESC) AS rn FROM repo_batch WHERE name IS NOT NULL)
  WHERE rn = 1),
repo_first AS (SELECT name, min(ord) AS first_ord FROM repo_batch WHERE name IS NOT NULL GROUP BY name),
repo_ids AS (
  SELECT name, coalesce((SELECT max(id) FROM repos), 0) + row_number() OVER (ORDER BY first_ord, name) AS id
  FROM repo_first WHERE name NOT IN (SELECT name FROM repos)),
repos_after AS (
  SELECT coalesce(r.id, n.id)::BIGINT AS id, coalesce(r.name, b.name) AS name,
         CASE WHEN b.name IS NULL THEN r."desc" ELSE b."desc" END AS "desc",
         CASE WHEN b.name IS NULL THEN r.stars ELSE b.stars END AS stars,
         CASE WHEN b.name IS NULL THEN r.topics ELSE b.topics END AS topics,
         r.vector,
         CASE WHEN r.name IS NULL THEN 'insert'
              WHEN b.name IS NOT NULL AND (r."desc" IS DISTINCT FROM b."desc" OR r.stars IS DISTINCT FROM b.stars
                   OR r.topics IS DISTINCT FROM b.topics) THEN 'update'
              ELSE 'unchanged' END AS action
  FROM repos r FULL OUTER JOIN rb_last b ON r.name = b.name LEFT JOIN repo_ids n ON b.name = n.name)"""


def _repos_after(spark, sf_dir):
    state, _ = U.upsert_repos(ST.repos(spark, sf_dir), ST.repo_batch(spark, sf_dir))
    return state


PROJECT_UPSERT_SQL = """
pb AS (SELECT id, slug, name, tagline, likes, members, hackathon,
              CASE WHEN year > 0 THEN year END AS year, winner, ord FROM project_batch),
per_row AS (
  SELECT b.*, (p.id IS NOT NULL AND (b.slug IS DISTINCT FROM p.slug OR b.name IS DISTINCT FROM p.name
         OR b.tagline IS DISTINCT FROM p.tagline OR b.likes IS DISTINCT FROM p.likes
         OR b.members IS DISTINCT FROM p.members OR b.winner IS DISTINCT FROM p.winner
         OR (b.hackathon IS NOT NULL AND b.hackathon IS DISTINCT FROM p.hackathon)
         OR (b.year IS NOT NULL AND b.year IS DISTINCT FROM p.year))) AS diff
  FROM pb b LEFT JOIN projects p ON b.id = p.id),
last_row AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM per_row) WHERE rn = 1),
fold AS (
  SELECT id, arg_max(hackathon, ord) FILTER (WHERE hackathon IS NOT NULL) AS last_h,
         arg_max(year, ord) FILTER (WHERE year IS NOT NULL) AS last_y,
         bool_and(coalesce(winner, false)) AS all_win, NOT bool_or(diff) AS no_diff
  FROM per_row GROUP BY id),
projects_after AS (
  SELECT coalesce(p.id, l.id)::BIGINT AS id,
         CASE WHEN l.id IS NULL THEN p.slug ELSE l.slug END AS slug,
         CASE WHEN l.id IS NULL THEN p.name ELSE l.name END AS name,
         CASE WHEN l.id IS NULL THEN p.tagline ELSE l.tagline END AS tagline,
         CASE WHEN l.id IS NULL THEN p.likes ELSE l.likes END AS likes,
         CASE WHEN l.id IS NULL THEN p.members ELSE l.members END AS members,
         CASE WHEN l.id IS NULL THEN p.winner ELSE l.winner END AS winner,
         coalesce(f.last_h, p.hackathon) AS hackathon, coalesce(f.last_y, p.year) AS year, p.vector,
         CASE WHEN p.id IS NOT NULL AND (l.id IS NULL OR f.all_win OR f.no_diff) THEN p.prizes END AS prizes,
         p.id IS NULL AS is_new, p.slug AS o_slug, p.name AS o_name, p.tagline AS o_tagline, p.likes AS o_likes,
         p.members AS o_members, p.winner AS o_winner, p.hackathon AS o_hackathon, p.year AS o_year,
         p.prizes AS o_prizes
  FROM projects p FULL OUTER JOIN last_row l ON p.id = l.id LEFT JOIN fold f ON f.id = l.id),
projects_state AS (
  SELECT id, slug, name, tagline, likes, members, winner, hackathon, year, vector, prizes,
         CASE WHEN is_new THEN 'insert'
              WHEN slug IS DISTINCT FROM o_slug OR name IS DISTINCT FROM o_name OR tagline IS DISTINCT FROM o_tagline
                OR likes IS DISTINCT FROM o_likes OR members IS DISTINCT FROM o_members
                OR winner IS DISTINCT FROM o_winner OR hackathon IS DISTINCT FROM o_hackathon
                OR year IS DISTINCT FROM o_year OR prizes IS DISTINCT FROM o_prizes THEN 'update'
              ELSE 'unchanged' END AS action
  FROM projects_after)"""


def _projects_after(spark, sf_dir):
    return U.upsert_projects(ST.projects(spark, sf_dir), ST.project_batch(spark, sf_dir))


PROJECT_STATE_SQL = with_sql(PROJECTS_SQL, PROJECT_BATCH_SQL, PROJECT_UPSERT_SQL)


WORDY_SQL = """
wordy AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) AS name FROM documents
          WHERE len(regexp_extract_all(lower(text), '[a-z]+')) > 0)"""


def between_sql(x: str, open_m: str, close_m: str) -> str:
    o = open_m.replace("'", "''")
    c = close_m.replace("'", "''")
    rest = f"substring({x}, strpos({x}, '{o}') + {len(open_m)})"
    return (f"(CASE WHEN strpos({x}, '{o}') > 0 AND strpos({rest}, '{c}') > 0 "
            f"THEN substring({rest}, 1, strpos({rest}, '{c}') - 1) END)")


DOC_PAGES_SQL = """
doc_pages AS (
  SELECT d.*, (row_number() OVER (ORDER BY doc_id) - 1) AS idx FROM documents d)"""


EVENTS_EXPECTED_SQL = """
ev AS (
  SELECT (idx // 40 + 1)::BIGINT AS page, (idx % 40)::BIGINT AS pos, doc_id, 'h' || CAST(doc_id AS VARCHAR) AS host,
         CASE WHEN doc_id % 8 = 3 THEN '' ELSE text END AS title,
         (CASE WHEN doc_id % 9 = 4 THEN 0 WHEN doc_id % 10 = 7 THEN 0 WHEN doc_id % 11 = 2 THEN 0
               ELSE 2018 + doc_id % 7 END)::BIGINT AS year
  FROM doc_pages WHERE doc_id % 6 <> 5)"""


GALLERY_EXPECTED_SQL = """
gdocs0 AS (
  SELECT d.*, l.quality, (row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1) AS gi
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
gdocs AS (SELECT *, count(*) OVER (PARTITION BY source, gi // 20) AS n_items FROM gdocs0),
gcards AS (
  SELECT source AS hackathon, (gi // 20 + 1)::BIGINT AS page, (gi % 20 + 1)::BIGINT AS card, doc_id::BIGINT AS id,
         'p-' || CAST(doc_id AS VARCHAR) AS slug, text, lang, n_chars, quality, n_items,
         doc_id % 11 <> 3 AS has_link, doc_id
  FROM gdocs)"""


# the pages that a gallery walk reaches: those before the first failed page or page without a card (SRC-13)
GALLERY_BATCH_SQL = f"""
gwalk AS (SELECT hackathon, page, NOT ((page + any_value(n_items)) % 7 = 0) AS ok, count_if(has_link) AS cards
          FROM gcards GROUP BY hackathon, page),
gend AS (SELECT hackathon, min(CASE WHEN NOT ok OR cards = 0 THEN page END) AS stop,
                arg_min(CASE WHEN NOT ok THEN 'failed' ELSE 'empty' END, page) FILTER (WHERE NOT ok OR cards = 0) AS ended,
                max(page) AS last FROM gwalk GROUP BY hackathon),
gbatch AS (
  SELECT c.id, c.slug, {TX.html_to_text_sql("' ' || c.text || ' &amp; co '")} AS name,
         CASE WHEN c.doc_id % 13 = 4 THEN NULL ELSE c.lang END AS tagline,
         (CASE WHEN c.doc_id % 17 = 2 THEN 0 ELSE (c.n_chars % 500) * 7 END)::BIGINT AS likes,
         ['u' || CAST(c.doc_id % 50 AS VARCHAR), 'u' || CAST(c.doc_id % 7 AS VARCHAR)] AS members,
         c.hackathon, NULL::INTEGER AS year, coalesce(c.quality = 1, false) AS winner,
         (c.page * 1000 + c.card)::BIGINT AS ord, c.page
  FROM gcards c JOIN gend s USING (hackathon) WHERE c.has_link AND c.page < coalesce(s.stop, c.page + 1)),
project_batch AS (SELECT * EXCLUDE (page) FROM gbatch)"""


PROJECT_PAGE_SQL = """
pp AS (
  SELECT page_id,
         CASE WHEN page_id % 10 = 9 THEN '<html>' || html || '</html>'
              ELSE '<div id="app-details-left">' || html ||
                   CASE WHEN page_id % 4 = 0 THEN '' ELSE '<div id="built-with"><p>Go</p></div>' END ||
                   '</div>' || chr(10) || '<div id="app-details-right"></div>' END AS h
  FROM pages)"""


RESPONSE_EXPECTED_SQL = """
rl AS (
  SELECT event_id, event_type, user_id, value, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         epoch(date_trunc('second', ts))::BIGINT AS now, event_id % 4 AS attempt,
         CASE WHEN event_type IN ('view', 'click') THEN 200 WHEN event_type = 'purchase' THEN 403
              WHEN event_type = 'error' THEN 429 WHEN value < 5 THEN 0 ELSE 404 END AS status,
         event_id % 2 = 0 AS says_limit
  FROM events),
hf AS (
  SELECT *, (CASE WHEN event_id % 4 = 0 THEN k + 2 WHEN event_id % 4 = 1 THEN k + 1 ELSE 1 END)::BIGINT AS page_count,
         (CASE WHEN event_id % 3 = 0 THEN user_id % 5 ELSE -1 END)::BIGINT AS ratelimit_remaining,
         (CASE WHEN event_id % 5 <> 0 THEN now + user_id % 90 ELSE -1 END)::BIGINT AS ratelimit_reset,
         (CASE WHEN event_type = 'error' THEN floor(value) ELSE -1 END)::BIGINT AS retry_after
  FROM rl)"""


PATHS_SQL = """
req AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN
          CASE WHEN doc_id % 2 = 1 THEN '/datasets/github/' ELSE '/datasets/github' END
        ELSE '/datasets/' || source ||
        CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/' || CAST(2019 + doc_id % 7 AS VARCHAR) WHEN 2 THEN '/'
                        WHEN 3 THEN '/x' || CAST(doc_id AS VARCHAR) ELSE '/0' END END ||
        CASE WHEN doc_id % 3 = 0 THEN '/embed' ELSE '' END AS path FROM documents)"""


def token_vocab(spark, sf_dir) -> int:
    """Size of the stand-in token table: ids 0 .. largest ``vec_id``."""
    return table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1


HIDDEN = 64
DENSE_OUT = 16


TOKENS_SQL = """
toks AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 4))::INTEGER % (SELECT max(vec_id) + 1 FROM embeddings) AS token_id
         FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)),
tc AS (SELECT doc_id, token_id, count(*) AS cnt FROM toks GROUP BY ALL),
pooled AS (SELECT t.doc_id, u.pos - 1 AS pos, sum(t.cnt * u.val::DOUBLE * 8.0) / sum(t.cnt) AS m
           FROM tc t JOIN embeddings e ON e.vec_id = t.token_id, unnest(e.embedding) WITH ORDINALITY AS u(val, pos)
           GROUP BY ALL)"""


DENSE_SQL = """
w AS (SELECT r.r, c.c, (((7 * r.r + 3 * c.c) % 11) - 5) / 10.0 AS w FROM range(16) r(r), range(64) c(c)),
proj AS (SELECT p.doc_id, w.r AS pos, sum(w.w * p.m) AS v FROM pooled p JOIN w ON w.c = p.pos GROUP BY ALL),
pn AS (SELECT doc_id, greatest(sqrt(sum(v * v)), 1e-12) AS nrm FROM proj GROUP BY doc_id)"""


def _token_table(spark, sf_dir):
    return E.token_table_from_embeddings(table(spark, sf_dir, "embeddings"))


def _maps(spark, sf_dir):
    """The dataset maps of the stand-in store (members and projection are
    materialised inside ``build_maps``)."""
    members = _members(spark, sf_dir)
    labels = SIM.label_matrix(ST.category_labels(spark, sf_dir))  # fixed-size label matrix, taken once
    points, proj, _ = MAPS.build_maps(members, labels, dim=64)
    return points, proj, labels


def _bench_queries(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    ds = (F.when(F.col("item_id") % 3 == 0, F.lit("github")).when(F.col("item_id") % 3 == 1, F.lit("src1"))
          .otherwise(F.lit("src2")))
    vecs = E.hashing_vectors(b, "item_id", "text")
    return (b.select(F.col("item_id").alias("query_id"), ds.alias("dataset"), F.col("text").alias("description"))
            .join(vecs.withColumnRenamed("item_id", "query_id"), "query_id"))


MEMBER_INDEX_SQL = """
mi AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY stars DESC NULLS LAST, id) - 1 AS idx FROM members)"""


BENCH_QD_SQL = """
qd AS (SELECT DISTINCT k AS query_id,
              CASE k % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'src1' ELSE 'src2' END AS dataset FROM q_vec)"""


QUERY_NEIGHBOURS_SQL = """
pc AS (SELECT m.dataset, m.id, m.idx, u.pos - 1 AS bucket, u.val::DOUBLE AS v
       FROM mi m, unnest(m.vector) WITH ORDINALITY AS u(val, pos)),
pcn AS (SELECT dataset, id, greatest(sqrt(sum(v * v)), 1e-12) AS nrm FROM pc GROUP BY ALL),
qn AS (SELECT k, greatest(sqrt(sum(val::DOUBLE * val::DOUBLE)), 1e-12) AS nrm FROM q_vec GROUP BY k),
nsims AS (
  SELECT d.query_id, d.dataset, p.id, any_value(p.idx) AS idx,
         sum(q.val::DOUBLE * p.v) / (any_value(qn.nrm) * any_value(pcn.nrm)) AS cosine
  FROM qd d JOIN q_vec q ON q.k = d.query_id JOIN pc p ON p.dataset = d.dataset AND p.bucket = q.bucket
       JOIN qn ON qn.k = d.query_id JOIN pcn ON pcn.dataset = p.dataset AND pcn.id = p.id
  GROUP BY d.query_id, d.dataset, p.id),
nranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM nsims),
qvec AS (SELECT k, list(val::DOUBLE ORDER BY bucket) AS v, list(bucket ORDER BY bucket) AS b FROM q_vec GROUP BY k),
qdense AS (SELECT k, [coalesce(v[list_position(b, i)], 0.0) FOR i IN range(64)] AS vec FROM qvec),
qcat AS (SELECT q.k AS query_id, c.idx AS cat, list_cosine_similarity(q.vec, c.vector) AS sim,
                row_number() OVER (PARTITION BY q.k ORDER BY list_cosine_similarity(q.vec, c.vector) DESC, c.idx) AS rn
         FROM qdense q, cat_labels c)"""


# text-query answers (STR-5) read the neighbour SQL defined above
TEXT_REQ_SQL = """
treq AS (SELECT conv_id * 1000 + turn AS query_id, text,
                CASE conv_id % 4 WHEN 0 THEN 'github' WHEN 1 THEN 'src1' WHEN 2 THEN 'src3/2023' END AS dataset
         FROM conversations),
tcheck AS (SELECT *, CASE WHEN dataset IS NULL THEN 'not found' WHEN text IS NULL THEN 'missing'
                          WHEN strlen(text) < 1 THEN 'empty' WHEN strlen(text) > 32768 THEN 'too long' END AS reason
           FROM treq),
tvalid AS (SELECT * FROM tcheck WHERE reason IS NULL)"""


def cut_lineage_bronze(df):
    from corpusmap.session import cut_lineage
    return cut_lineage(df, "bronze")
