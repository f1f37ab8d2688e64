"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmap.llm.common import id_text, prepare, remainder, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn
    return add


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


TOKEN_LIMIT = 2048


@register("op5_token_counts")
def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmap.llm.token_counts import count_tokens
    prepare(spark)
    docs = id_text(table(spark, sf_dir, "documents"))
    return (docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                        count_tokens(F.col("text"), tokenizer_file("word_bpe_49k.json")).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT))


@register("op8_byte_bpe")
def byte_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from corpusmap.llm.bpe import decode, encode, token_count
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    ids = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return ids.select("doc_id", token_count("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"))


@register("op1_license_scan")
def license_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmap.llm.license_scan import scan_licenses
    return scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


@register("op10_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmap.llm.toxicity import score_toxicity
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                            remainder("doc_id", 5) != 0)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted",
                         F.size("sentences").alias("n_offending"))


@register("op4_language_id")
def language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmap.llm.langid import identify
    found = identify(table(spark, sf_dir, "documents"), remainder("doc_id", 5) != 0)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


@register("op9_decontaminate")
def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmap.llm.decontaminate import contamination
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                         verbatim=True, excerpts=True).drop("text_key")


@register("op7_jaccard_join")
def jaccard_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmap.llm.jaccard_join import join_similar
    return join_similar(table(spark, sf_dir, "documents")).drop("text_key", "component_key")


@register("op3_personal_data")
def personal_data_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmap.llm.pii import BASE_KINDS, find_personal_data, listing
    from corpusmap.session import cut_lineage
    found = find_personal_data(table(spark, sf_dir, "documents"), keep=lambda df: cut_lineage(df, "proposed-spans"))
    base = F.filter("spans", lambda s: s["base"])

    def count(k: int) -> Column:        # a second argument of the lambda would be the span's position
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE_KINDS[k]}")

    return found.select("doc_id", *map(count, range(len(BASE_KINDS))), F.sha2(listing(base), 256).alias("base_sha256"),
                        listing(F.col("spans")).alias("spans"))


@register("op2_language_model")
def language_model_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmap.llm.lm_automaton import score_texts
    scored = score_texts(table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0)
    return scored.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
WHERE rank <= 20"""


@register("op6_top_k", TOP_K_SQL)
def top_k_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmap.llm.topk import top_k
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


SHARDS = 24


@register("op13_sharding")
def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmap.llm.sharding import shard_documents
    return shard_documents(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


#: Every level by recursion; crc32 of the id's digits bit by bit.
MERKLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars,
         COALESCE(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || COALESCE(strlen(source) || ':' || source, '-')
           || COALESCE(strlen(lang) || ':' || lang, '-') AS before,
         COALESCE(strlen(text) || ':' || text, '-') AS after,
         xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)],
               [CAST(ascii(x) AS UBIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
             LAMBDA a, b: list_reduce(list_concat([xor(a, b)], CAST(range(8) AS UBIGINT[])),
               LAMBDA u, k: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END)), 4294967295) AS crc
  FROM documents),
h AS (
  SELECT doc_id, lang, sha256(before || COALESCE(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || after) AS leaf,
         CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN sha256(before || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':'
              || (n_chars + 1) || after) END AS changed FROM d),
l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n FROM h),
up AS (
  SELECT tree, 0 AS lvl, r, leaf AS digest, n FROM l
  UNION ALL
  SELECT tree, lvl + 1, r // 2, sha256(string_agg(digest, '' ORDER BY r)), (n + 1) // 2
  FROM up WHERE n > 1 GROUP BY tree, lvl, r // 2, n),
tops AS (SELECT tree AS r, digest, (SELECT count(DISTINCT tree) FROM l) AS n FROM up WHERE n = 1),
over AS (
  SELECT 0 AS lvl, r, digest, n FROM tops
  UNION ALL
  SELECT lvl + 1, r // 2, sha256(string_agg(digest, '' ORDER BY r)), (n + 1) // 2
  FROM over WHERE n > 1 GROUP BY lvl, r // 2, n),
walk AS (
  SELECT tree, r AS rank, 0 AS lvl, r, n, COALESCE(changed, leaf) AS cur, '' AS sibs FROM l
  UNION ALL
  SELECT w.tree, rank, w.lvl + 1, w.r // 2, (w.n + 1) // 2,
         sha256(CASE WHEN w.r % 2 = 1 THEN u.digest || cur ELSE cur || COALESCE(u.digest, '') END), sibs || COALESCE(u.digest, '')
  FROM walk w LEFT JOIN up u ON u.tree = w.tree AND u.lvl = w.lvl AND u.r = xor(w.r, 1) WHERE w.n > 1),
more AS (
  SELECT tree, rank, 0 AS lvl, tree AS r, (SELECT count(*) FROM tops) AS n, cur, sibs FROM walk WHERE n = 1
  UNION ALL
  SELECT w.tree, rank, w.lvl + 1, w.r // 2, (w.n + 1) // 2,
         sha256(CASE WHEN w.r % 2 = 1 THEN u.digest || cur ELSE cur || COALESCE(u.digest, '') END), sibs || COALESCE(u.digest, '')
  FROM more w LEFT JOIN over u ON u.lvl = w.lvl AND u.r = xor(w.r, 1) WHERE w.n > 1)
SELECT l.doc_id, l.leaf, tops.digest AS subroot, top.digest AS root, sha256(m.sibs) AS proof_sha256,
       m.cur AS folded_root, m.cur = top.digest AS verified
FROM l JOIN tops ON tops.r = l.tree JOIN more m ON m.n = 1 AND m.tree = l.tree AND m.rank = l.r
CROSS JOIN (SELECT digest FROM over WHERE n = 1) top"""


@register("op12_merkle_manifest", MERKLE_SQL)
def merkle_manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmap.llm.manifest import manifest
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest(table(spark, sf_dir, "documents"), tampered).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@register("op11_importance_resampling")
def importance_resampling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmap.llm.resample import resample
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")
