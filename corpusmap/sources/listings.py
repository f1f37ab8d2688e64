"""Listing documents -> rows (SRC-1, SRC-2, SRC-7) with the VARIANT type.

A typed ``from_json`` would turn the number 7 into the string "7"; the
original reader only accepts a field when its JSON type is right. So the body
is parsed once into a VARIANT and each field is taken only when
``schema_of_variant`` says it has the expected type. Unparsable documents, or
ones without the expected array, go to a reject output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.text import atoi, text_between

NUMBER_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == F.lit("STRING")


def _is_number(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return t.isin(*NUMBER_TYPES) | t.startswith("DECIMAL")


def _string_field(item: Column, path: str) -> Column:
    v = F.try_variant_get(item, path, "variant")
    return F.when(_is_string(v), F.try_variant_get(v, "$", "string"))


def _number_field(item: Column, path: str, default=0) -> Column:
    v = F.try_variant_get(item, path, "variant")
    num = F.try_variant_get(v, "$", "double")
    # cJSON reads numbers as doubles and truncates towards zero
    return F.when(_is_number(v), F.when(num >= 0, F.floor(num)).otherwise(F.ceil(num)).cast("long")) \
        .otherwise(F.lit(default).cast("long"))


def parse_repo_listing(responses: DataFrame, body_col: str = "body",
                       keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-1. Returns ``(rows, rejects)``: rows ``(*keys, pos, name, desc, stars,
    topics, total_count)``; a body that is not JSON or has no ``items`` array
    is rejected whole."""
    keys = list(keys or [])
    v = responses.select(*keys, F.try_parse_json(body_col).alias("_v"))
    items = F.try_variant_get("_v", "$.items", "array<variant>")
    tagged = v.withColumn("_items", items).withColumn(
        "reject_reason", F.when(F.col("_v").isNull(), F.lit("not JSON"))
        .when(F.col("_items").isNull(), F.lit("no items array")))
    rejects = tagged.filter(F.col("reject_reason").isNotNull()).select(*keys, "reject_reason")
    good = tagged.filter(F.col("reject_reason").isNull()).withColumn(
        "total_count", _number_field(F.col("_v"), "$.total_count"))
    it = good.select(*keys, "total_count", F.posexplode("_items").alias("pos", "_it"))
    topics = F.try_variant_get("_it", "$.topics", "array<variant>")
    rows = it.select(
        *keys, F.col("pos").cast("long"),
        _string_field(F.col("_it"), "$.full_name").alias("name"),
        _string_field(F.col("_it"), "$.description").alias("desc"),
        _number_field(F.col("_it"), "$.stargazers_count").alias("stars"),
        F.coalesce(F.transform(F.filter(topics, lambda t: _is_string(t)),
                               lambda t: F.try_variant_get(t, "$", "string")),
                   F.array().cast("array<string>")).alias("topics"),
        "total_count")
    return rows, rejects


def host_of(url: Column) -> Column:
    """Subdomain between ``https://`` and ``.devpost.com``; NULL otherwise."""
    return text_between(url, "https://", ".devpost.com")


def year_of_dates(dates: Column) -> Column:
    """``atoi`` of the last four characters; 0 when absent or shorter."""
    return F.when(F.length(dates) >= 4, atoi(F.substring(dates, -4, 4))).otherwise(F.lit(0).cast("long"))


def parse_event_listing(responses: DataFrame, body_col: str = "body",
                        keys: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-2 + SRC-7. Returns ``(hosts, pages, rejects)``:
    hosts ``(*keys, pos, host, title, year)`` (entries without a gallery host
    dropped), pages ``(*keys, total_count, per_page)``."""
    keys = list(keys or [])
    v = responses.select(*keys, F.try_parse_json(body_col).alias("_v"))
    raw_items = F.try_variant_get("_v", "$.hackathons", "variant")
    tagged = v.withColumn("reject_reason", F.when(F.col("_v").isNull(), F.lit("not JSON"))
                          .when(raw_items.isNull(), F.lit("no hackathons array")))
    rejects = tagged.filter(F.col("reject_reason").isNotNull()).select(*keys, "reject_reason")
    good = tagged.filter(F.col("reject_reason").isNull())
    pages = good.select(*keys, _number_field(F.col("_v"), "$.meta.total_count").alias("total_count"),
                        _number_field(F.col("_v"), "$.meta.per_page").alias("per_page"))
    items = F.coalesce(F.try_variant_get("_v", "$.hackathons", "array<variant>"), F.array())
    it = good.select(*keys, F.posexplode(items).alias("pos", "_it"))
    url = _string_field(F.col("_it"), "$.url")
    title = _string_field(F.col("_it"), "$.title")
    dates = _string_field(F.col("_it"), "$.submission_period_dates")
    hosts = (it.select(*keys, F.col("pos").cast("long"), host_of(url).alias("host"),
                       F.coalesce(title, F.lit("")).alias("title"),
                       F.coalesce(year_of_dates(dates), F.lit(0).cast("long")).alias("year"))
             .filter(F.col("host").isNotNull()))
    return hosts, pages, rejects


def json_string(c: Column) -> Column:
    """A value as a JSON literal (``null`` for NULL), via ``to_json(array(x))``."""
    return F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)
