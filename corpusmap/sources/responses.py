"""HTTP response log: gate, header fields, throttle decisions (SRC-8, SRC-9, SRC-12).

A crawler (outside this package) appends one row per exchange to a bronze
``responses`` table ``(url, kind, source_key, page, status, headers, body,
fetched_at)``. Everything here is a native projection over that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RETRIES = 3
BASE_DELAY_S = 60


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def accept_responses(responses: DataFrame, status_col: str = "status") -> tuple[DataFrame, DataFrame]:
    """SRC-8: only 2xx responses carry data; the rest go to a reject table
    with a reason (status 0 = the exchange never completed)."""
    st = F.col(status_col)
    ok = st.between(200, 299)
    reason = (F.when(st.isNull() | (st == 0), F.lit("no response"))
              .when(~ok, F.concat(F.lit("HTTP "), st.cast("string"))))
    tagged = responses.withColumn("reject_reason", F.when(~F.coalesce(ok, F.lit(False)), reason))
    return (tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            tagged.filter(F.col("reject_reason").isNotNull()))


def header_value(headers, name: str) -> Column:
    """Value of header ``name``: matched case-insensitively at a line start,
    leading spaces/tabs skipped; NULL when absent."""
    h = _c(headers)
    pat = r"(?im)^" + name + r":[ \t]*([^\r\n]*)"
    found = F.regexp_extract(h, pat, 0) != ""
    return F.when(found, F.regexp_extract(h, pat, 1))


def header_number(headers, name: str) -> Column:
    """``atoi`` of a header's value; -1 when the header is absent."""
    v = header_value(headers, name)
    digits = F.regexp_extract(v, r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)", 1)
    return F.when(v.isNull(), F.lit(-1).cast("long")).otherwise(
        F.coalesce(digits.try_cast("long"), F.lit(0).cast("long")))


def page_count(headers) -> Column:
    """SRC-9: number in the ``page=`` parameter (after ``?`` or ``&``) of the
    ``rel="last"`` link, else the ``rel="prev"`` page + 1, else 1."""
    link = header_value(headers, "link")
    last = F.regexp_extract(link, r'^.*[?&]page=([0-9]+)[^\n]*?rel="last"', 1)
    prev = F.regexp_extract(link, r'^.*[?&]page=([0-9]+)[^\n]*?rel="prev"', 1)
    return (F.when(link.isNull(), F.lit(1).cast("long"))
            .when(last != "", last.try_cast("long"))
            .when(prev != "", prev.try_cast("long") + 1)
            .otherwise(F.lit(1).cast("long")))


def header_fields(responses: DataFrame, headers_col: str = "headers") -> DataFrame:
    return (responses
            .withColumn("page_count", page_count(headers_col))
            .withColumn("ratelimit_remaining", header_number(headers_col, "x-ratelimit-remaining"))
            .withColumn("ratelimit_reset", header_number(headers_col, "x-ratelimit-reset"))
            .withColumn("retry_after", header_number(headers_col, "retry-after")))


def throttle_plan(responses: DataFrame, now_col: str = "now", attempt_col: str = "attempt") -> DataFrame:
    """SRC-12: per response, whether it is rate limited, whether to give up
    (after three retries), and how long to wait before the next attempt.

    limited = 429, or 403 with (remaining = 0, a retry-after, or a body that
    says "rate limit"). delay = retry-after, else 60 << attempt; when
    remaining = 0 and reset > 0, ``reset - now + 1`` replaces it if there is no
    retry-after or it is longer; never below 1 s.
    """
    f = header_fields(responses)
    st, rem, reset, ra = F.col("status"), F.col("ratelimit_remaining"), F.col("ratelimit_reset"), F.col("retry_after")
    att = F.col(attempt_col).cast("long")
    limited = (st == 429) | ((st == 403) & ((rem == 0) | (ra >= 0)
                                            | F.coalesce(F.col("body").contains("rate limit"), F.lit(False))))
    base = F.when(ra >= 0, ra).otherwise((F.lit(BASE_DELAY_S) * F.pow(F.lit(2), att)).cast("long"))
    until = reset - F.col(now_col).cast("long") + 1
    delay = F.when((rem == 0) & (reset > 0) & ((ra < 0) | (until > base)), until).otherwise(base)
    delay = F.greatest(delay, F.lit(1).cast("long"))
    give_up = limited & (att >= MAX_RETRIES)
    return (f.withColumn("limited", F.coalesce(limited, F.lit(False)))
            .withColumn("give_up", F.coalesce(give_up, F.lit(False)))
            .withColumn("delay_s", F.when(F.col("limited") & ~F.col("give_up"), delay))
            .withColumn("wait_s", wait_after_success(now_col)))


def wait_after_success(now_col: str = "now") -> Column:
    """Plain wait after a good (2xx) page when the window is spent:
    ``reset - now + 1`` seconds when remaining = 0 and reset > 0 (else 0).
    Reads the columns ``header_fields`` adds."""
    rem, reset = F.col("ratelimit_remaining"), F.col("ratelimit_reset")
    w = reset - F.col(now_col).cast("long") + 1
    good = F.col("status").between(200, 299)
    return F.when(good & (rem == 0) & (reset > 0) & (w > 0), w).otherwise(F.lit(0).cast("long"))
