"""Selections, projections, dataset membership and small aggregates
(FIL-1..8, PRJ-1, TOP-1, SET-1..3, AGG-4..7, AGG-9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.text import join_list, split_lines
from corpusmap.session import dense_index

TOP_REPOS = 1000          # points per repo dataset
MAX_QUERY_BYTES = 32768   # FIL-7
GITHUB = "github"


def top_repos(repos: DataFrame, n: int = TOP_REPOS) -> DataFrame:
    """TOP-1: ``ORDER BY stars DESC NULLS LAST, id LIMIT n`` -- a top-k report
    (each task keeps n rows, one task merges tasks x n)."""
    return repos.orderBy(F.desc_nulls_last("stars"), F.asc("id")).limit(n)


def pending_repos(repos: DataFrame, n: int = TOP_REPOS) -> DataFrame:
    """FIL-4: the top n by stars first, *then* those without a vector."""
    return top_repos(repos, n).filter(F.col("vector").isNull())


def pending_projects(projects: DataFrame, registry: DataFrame) -> DataFrame:
    """FIL-3 for every registered hackathon at once: ``vector IS NULL``."""
    return projects.filter(F.col("vector").isNull()).join(registry.select("hackathon"), "hackathon", "left_semi")


def pending_prizes(projects: DataFrame, registry: DataFrame) -> DataFrame:
    """FIL-5: registered hackathon, winner, prizes not fetched yet."""
    return (projects.filter(F.coalesce(F.col("winner"), F.lit(False)) & F.col("prizes").isNull())
            .join(registry.select("hackathon"), "hackathon", "left_semi"))


def dataset_rows(repos: DataFrame | None, projects: DataFrame | None, hackathon: str | None = None,
                 year: int | None = None, n: int = TOP_REPOS) -> DataFrame:
    """FIL-6 for one selection: repos filter *then* top n; projects filter by
    hackathon (and year when given), ordered by id."""
    if hackathon is None:
        return top_repos(repos.filter(F.col("vector").isNotNull()), n)
    p = projects.filter(F.col("vector").isNotNull() & (F.col("hackathon") == hackathon))
    if year:
        p = p.filter(F.col("year") == year)
    return p.orderBy("id")


def dataset_rows_all(projects: DataFrame, registry: DataFrame) -> DataFrame:
    """FIL-6 for every registered hackathon selection in one scan: embedded
    projects of registered hackathons (order by id where served)."""
    return projects.filter(F.col("vector").isNotNull()).join(registry.select("hackathon"), "hackathon", "left_semi")


def dataset_members(repos: DataFrame, projects: DataFrame, registry: DataFrame,
                    n: int | None = None) -> DataFrame:
    """SET-2: every selection at once -> ``(dataset, kind, id, vector, hackathon, year, served)``
    (``kind`` is ``repo`` or ``project``: the two tables have separate ids;
    ``served`` then ``id`` is the order in which a dataset is served: repos by
    stars, most first and unknown last, projects by id).

    Embedded repos feed ``github`` (all, or the top ``n``); each embedded project of a
    registered hackathon feeds ``<hackathon>`` and ``<hackathon>/<year>`` --
    one scan of the projects and an ``explode`` (a hand-written grouping set).
    """
    embedded = repos.filter(F.col("vector").isNotNull())
    gh = ((embedded if n is None else top_repos(embedded, n))
          .select(F.lit(GITHUB).alias("dataset"), F.lit("repo").alias("kind"), "id", "vector",
                  F.lit(None).cast("string").alias("hackathon"), F.lit(None).cast("int").alias("year"),
                  F.coalesce(-F.col("stars"), F.lit((1 << 63) - 1)).cast("long").alias("served")))
    pj = projects.filter(F.col("vector").isNotNull()).join(registry.select("hackathon"), "hackathon", "left_semi")
    names = F.filter(F.array(F.col("hackathon"),
                             F.concat(F.col("hackathon"), F.lit("/"), F.col("year").cast("string"))),
                     lambda x: x.isNotNull())
    pm = pj.select(F.explode(names).alias("dataset"), F.lit("project").alias("kind"), "id", "vector",
                   "hackathon", "year", F.lit(0).cast("long").alias("served"))
    return gh.unionByName(pm)


def point_index(members: DataFrame, whole_rows: bool = False) -> DataFrame:
    """AGG-7: position of each point inside its dataset in the order served
    (``whole_rows``: the indexed rows are written once, see ``dense_index``)."""
    order = [c for c in ("served", "id") if c in members.columns]
    return dense_index(members, order, ["dataset"], name="idx", whole_rows=whole_rows).drop("served")


def parse_dataset_path(requests: DataFrame, registry: DataFrame, path_col: str = "path") -> DataFrame:
    """FIL-1: request path -> selection. The path must start with
    ``/datasets/``; one trailing ``/embed`` marks a query and is removed; the
    rest is ``github`` exactly, or ``<id>`` / ``<id>/<year>`` where ``<id>`` (the
    text before the first ``/``) is a registered hackathon and ``<year>`` (all
    the text after it) is empty -- every year -- or a positive integer with
    nothing else. Anything else is not found. Native string functions only."""
    p = F.col(path_col)
    prefix = "/datasets/"
    has_prefix = F.coalesce(F.startswith(p, F.lit(prefix)), F.lit(False))
    rest0 = F.substring(p, len(prefix) + 1, 1 << 30)
    embed = F.coalesce(F.endswith(rest0, F.lit("/embed")), F.lit(False))
    rest = F.when(embed, F.expr(f"substring({path_col}, {len(prefix) + 1}, "
                                f"char_length({path_col}) - {len(prefix)} - 6)")).otherwise(rest0)
    slash = F.instr(rest, "/")
    req = requests.select("*", has_prefix.alias("_ok"), embed.alias("_embed"), rest.alias("_rest"))
    req = (req.withColumn("_id", F.when(F.instr("_rest", "/") > 0, F.substring_index("_rest", "/", 1))
                          .otherwise(F.col("_rest")))
              .withColumn("_y", F.when(F.instr("_rest", "/") > 0,
                                       F.expr("substring(_rest, instr(_rest, '/') + 1)")).otherwise(F.lit(""))))
    reg = registry.select(F.col("hackathon").alias("_rid"))
    j = req.join(reg, F.col("_id") == F.col("_rid"), "left")
    year_num = F.when(F.col("_y").rlike("^[0-9]+$"), F.col("_y").try_cast("int"))
    year_ok = (F.col("_y") == "") | F.coalesce(year_num > 0, F.lit(False))
    is_gh = F.col("_ok") & (F.col("_rest") == F.lit(GITHUB))
    is_hk = F.col("_ok") & ~is_gh & F.col("_rid").isNotNull() & year_ok
    year = F.when(is_hk & (F.col("_y") != ""), year_num)
    dataset = (F.when(is_gh, F.lit(GITHUB))
               .when(is_hk & year.isNotNull(), F.concat(F.col("_id"), F.lit("/"), year.cast("string")))
               .when(is_hk, F.col("_id")))
    return (j.withColumn("dataset", dataset)
            .withColumn("hackathon", F.when(is_hk, F.col("_id")))
            .withColumn("year", year)
            .withColumn("found", F.coalesce(dataset.isNotNull(), F.lit(False)))
            .withColumn("embed", F.col("_embed") & F.col("found"))
            .drop("_ok", "_embed", "_rest", "_id", "_y", "_rid"))


def validate_queries(queries: DataFrame, col: str = "description") -> DataFrame:
    """FIL-7: description present, 1..32768 bytes; ``reason`` for rejects."""
    n = F.octet_length(F.col(col))
    reason = (F.when(F.col(col).isNull(), F.lit("missing"))
              .when(n < 1, F.lit("empty"))
              .when(n > MAX_QUERY_BYTES, F.lit("too long")))
    return queries.withColumn("reason", reason).withColumn("valid", reason.isNull())


def match_events(events: DataFrame, name: str | None = None, year: int = 0,
                 name_col: str | None = None, year_col: str | None = None) -> DataFrame:
    """FIL-2: title starts with the name (case-insensitive) and
    ``year <= 0 or event.year = year``. Name/year may be literals or columns."""
    nm = F.col(name_col) if name_col else F.lit(name)
    yr = F.col(year_col) if year_col else F.lit(year)
    return events.filter(F.startswith(F.lower(F.col("title")), F.lower(nm))
                         & ((yr <= 0) | (F.col("year") == yr)))


def point_columns(df: DataFrame) -> DataFrame:
    """PRJ-1: all columns but ``vector``; ``winner`` NULL -> false; ``prizes``
    NULL -> empty list, empty entries dropped."""
    out = df.drop("vector")
    if "winner" in out.columns:
        out = out.withColumn("winner", F.coalesce(F.col("winner"), F.lit(False)))
    if "prizes" in out.columns:
        out = out.withColumn("prizes", F.coalesce(F.filter("prizes", lambda x: x != F.lit("")),
                                                  F.array().cast("array<string>")))
    return out


def prizes_from_text(c) -> "F.Column":
    """SCA-7 for imported newline text: NULL -> NULL, '' -> [], else lines."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isNotNull(), split_lines(col))


def hackathon_years(projects: DataFrame) -> DataFrame:
    """AGG-4: distinct non-null years having a vector, newest first.
    ``collect_set`` holds at most the distinct years of one hackathon."""
    has = projects.filter(F.col("vector").isNotNull() & F.col("year").isNotNull() & F.col("hackathon").isNotNull())
    return has.groupBy("hackathon").agg(F.sort_array(F.collect_set("year"), asc=False).alias("years"))


def catalog(projects: DataFrame, registry: DataFrame) -> DataFrame:
    """AGG-5: the github entry plus every registered hackathon in registry
    order with label and years (empty list when none). One row per entry."""
    years = hackathon_years(projects)
    reg = registry.join(years, "hackathon", "left")
    hk = reg.select((F.col("pos") + 1).alias("pos"), F.col("hackathon").alias("id"), "label",
                    F.coalesce(F.col("years"), F.array().cast("array<int>")).alias("years"))
    gh = projects.sparkSession.createDataFrame([(0, GITHUB, "GitHub")], "pos int, id string, label string") \
        .withColumn("years", F.array().cast("array<int>"))
    return gh.unionByName(hk)


def catalog_document(entries: DataFrame) -> DataFrame:
    """The catalog as one JSON document: ``{"github": {"label": ..},
    "hackathons": [{"id", "label", "years"}, ..]}`` in registry order. The
    catalog has one row per registered hackathon -- configuration, not data."""
    is_gh = F.col("id") == GITHUB
    listed = F.sort_array(F.collect_list(F.when(~is_gh, F.struct("pos", "id", "label", "years"))))
    return entries.agg(F.to_json(F.struct(
        F.struct(F.max(F.when(is_gh, F.col("label"))).alias("label")).alias("github"),
        F.transform(listed, lambda s: F.struct(s["id"].alias("id"), s["label"].alias("label"),
                                               s["years"].alias("years"))).alias("hackathons"))).alias("document"))


def join_lists(df: DataFrame, cols: list[str]) -> DataFrame:
    """AGG-6 on each list column."""
    for c in cols:
        df = df.withColumn(c, join_list(c))
    return df


def sync_report(state: DataFrame, key_cols: list[str]) -> DataFrame:
    """AGG-9: run counters per group: rows, inserts, updates, with vector,
    pending vector."""
    return state.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("action") == "insert").alias("inserted"),
        F.count_if(F.col("action") == "update").alias("updated"),
        F.count_if(F.col("vector").isNotNull()).alias("with_vector"),
        F.count_if(F.col("vector").isNull()).alias("pending"))


def pass_report(walk: DataFrame, before: DataFrame, after: DataFrame, group_col: str = "hackathon") -> DataFrame:
    """AGG-9: counters of one sync pass per hackathon.

    ``walk(group, page, cards, kept)`` is the gallery walk (SRC-13 decides
    ``kept``); ``before`` / ``after`` are the store around the embedding step.
    Reports pages walked, cards found on them, vectors written in the pass and
    rows still pending -- aggregates only, one shuffle per input.
    """
    w = walk.groupBy(group_col).agg(
        F.count_if("kept").cast("long").alias("pages_walked"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("cards"))), F.lit(0)).cast("long").alias("cards_found"))
    b = before.select("id", F.col("vector").isNull().alias("_was_pending"))
    e = (after.join(b, "id", "left")
         .groupBy(group_col).agg(
             F.count_if(F.coalesce(F.col("_was_pending"), F.lit(True)) & F.col("vector").isNotNull())
             .cast("long").alias("vectors_written"),
             F.count_if(F.col("vector").isNull()).cast("long").alias("pending_left")))
    out = w.join(e, w[group_col].eqNullSafe(e[group_col]), "full")
    return out.select(F.coalesce(w[group_col], e[group_col]).alias(group_col),
                      *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                        for c in ("pages_walked", "cards_found", "vectors_written", "pending_left")])
