"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; the first four return the columns of ``documents``. ``run`` writes every
stage's result as Parquet under the session's shared checkpoint folder and reads
it back. SQL cannot express the trained stages, so ``ORACLE_SQL`` is None and
the tests compare each stage with a brute-force version.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusmap.llm import bpe, decontaminate, jaccard_join, pii, toxicity  # noqa: E402
from corpusmap.llm.common import id_text, prepare, remainder, table  # noqa: E402
from corpusmap.llm.queries import tokenizer_file  # noqa: E402
from corpusmap.session import cut_lineage  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and a hash of the text, which with the id tells rows apart."""
    return docs.select(*COLUMNS).withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is 0.5 or more go."""
    prepare(spark)
    weights, bias = toxicity.train(id_text(docs), table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    score = toxicity.score_column(F.col("text"), weights, bias, spark)["score"]
    return docs.select(*COLUMNS, score.alias("_score")).filter("_score < 0.5").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 3-word shingles (90 %), the one of smallest id
    stays; documents without words all stay."""
    found = jaccard_join.join_similar(docs)
    keep = (found.filter("n_shingles > 0").groupBy("component_key")
            .agg(F.min(F.struct("doc_id", "text_key")).alias("row")).select("row.*")
            .withColumnsRenamed({"doc_id": "_id", "text_key": "_text"}))
    rows = _keyed(docs)
    has_words = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    w = Window.partitionBy("_id", "_text").orderBy("lang", "source", "n_chars")
    kept = (rows.filter(has_words).join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")))
            .withColumn("_copy", F.row_number().over(w)).filter("_copy = 1"))
    return kept.select(*COLUMNS).unionByName(rows.filter(~has_words).select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (or the item with other parameters) go."""
    leaks = (decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), verbatim=True, excerpts=True)
             .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text"))
    return _keyed(docs).join(leaks, same, "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every personal span gives way to its kind in brackets; all documents stay."""
    rows = docs.select(*COLUMNS)
    found, weights = pii.with_spans(rows)
    clean = pii.redact(F.col("text"), pii.accepted(F.col("candidates"), weights))
    return (found.withColumn("text", clean).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))
            .select(*COLUMNS))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document that is left."""
    import public_tokenizers
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN)
    return ids.select("doc_id", bpe.token_count("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("byte_bpe", encode_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
