"""Native string expressions (SCA-1 .. SCA-10).

All functions return Columns built from built-in expressions (regexp, substring,
translate), so they run in whole-stage code next to the scan. No Python UDFs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TEXT_BYTES = 32768  # text handed to the encoder (SCA-6)
MAX_TOKENS = 2048

# Private-use code points used as markers inside the HTML -> text chain.
# They are removed from the input first, so they can never be confused.
BREAK, NBSP, GONE, OPEN, CLOSE = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
MARKERS = "[\ue000-\ue004]"

# Block tags that end a line, and the seven entities decoded.
BLOCK_TAGS = ["p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table"]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&amp;", "&")]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex_literal(s: str) -> str:
    """Escape a literal for a regex understood by both Java and RE2."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)


def text_between(c, open_marker: str, close_marker: str) -> Column:
    """SCA-1: text between the first ``open_marker`` and the first
    ``close_marker`` after it; NULL when either is missing."""
    c = _c(c)
    start = F.locate(open_marker, c)
    rest = F.substring(c, start + len(open_marker), F.lit(1 << 30))
    end = F.locate(close_marker, rest)
    return F.when((start > 0) & (end > 0), F.substring(rest, F.lit(1), end - 1))


def parse_number(c) -> Column:
    """SCA-2: digits of a span read as one number (separators skipped); 0 when
    the span is missing or holds no digit."""
    digits = F.regexp_replace(_c(c), "[^0-9]", "")
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


def atoi(c) -> Column:
    """SCA-8: leading integer (after whitespace, optional sign), else 0."""
    digits = F.regexp_extract(_c(c), r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)", 1)
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


def decode_entities(c) -> Column:
    """SCA-4: the seven entities, one pass (``&amp;`` last, so ``&amp;lt;``
    gives ``&lt;``); unknown entities are kept."""
    out = _c(c)
    for ent, txt in ENTITIES:
        out = F.regexp_replace(out, regex_literal(ent), txt.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def html_to_text(c) -> Column:
    """SCA-3: markup to the text it renders as.

    A tag runs from ``<`` to the first ``>``; a ``<`` with no ``>`` after it
    drops the rest. Block tags (open or close) end a line; other tags vanish.
    A run of whitespace and breaks becomes one newline if it holds a break,
    else one space; leading runs and trailing spaces/newlines are dropped.
    Entities are decoded once, never across a tag; ``&nbsp;`` is a space that
    counts as a character.
    """
    s = F.regexp_replace(_c(c), MARKERS, "")
    s = F.regexp_replace(s, r"<[^>]*\z", "")                                 # truncated markup
    s = F.regexp_replace(s, r"<([^>]*)>", OPEN + "$1" + CLOSE)                # mark tag extents
    blocks = "|".join(t for t in BLOCK_TAGS)
    s = F.regexp_replace(s, "(?i)" + OPEN + "/?(?:" + blocks + ")(?:[ \t\n\r/][^" + CLOSE + "]*)?" + CLOSE,
                         BREAK)
    s = F.regexp_replace(s, OPEN + "[^" + CLOSE + "]*" + CLOSE, GONE)
    for ent, txt in ENTITIES:
        rep = NBSP if ent == "&nbsp;" else txt
        s = F.regexp_replace(s, regex_literal(ent), rep.replace("\\", "\\\\").replace("$", "\\$"))
    s = F.regexp_replace(s, GONE, "")
    s = F.regexp_replace(s, "[ \t\n\r]*" + BREAK + "[ \t\n\r" + BREAK + "]*", BREAK)
    s = F.regexp_replace(s, "[ \t\n\r]+", " ")
    s = F.regexp_replace(s, "^[ " + BREAK + "]+", "")
    s = F.translate(s, BREAK + NBSP, "\n ")
    return F.regexp_replace(s, "[ \n]+\\z", "")


def html_to_text_sql(x: str) -> str:
    """The same chain as DuckDB SQL over expression ``x`` (for the checks)."""
    def rr(e, pat, rep, flags="g"):
        pat = pat.replace("'", "''")
        rep = rep.replace("'", "''")
        return f"regexp_replace({e}, '{pat}', '{rep}', '{flags}')"
    s = rr(x, MARKERS, "")
    s = rr(s, r"<[^>]*\z", "")
    s = rr(s, r"<([^>]*)>", OPEN + r"\1" + CLOSE)
    blocks = "|".join(BLOCK_TAGS)
    s = rr(s, "(?i)" + OPEN + "/?(?:" + blocks + ")(?:[ \t\n\r/][^" + CLOSE + "]*)?" + CLOSE, BREAK)
    s = rr(s, OPEN + "[^" + CLOSE + "]*" + CLOSE, GONE)
    for ent, txt in ENTITIES:
        rep = NBSP if ent == "&nbsp;" else txt
        s = rr(s, regex_literal(ent), rep.replace("\\", "\\\\"))
    s = rr(s, GONE, "")
    s = rr(s, "[ \t\n\r]*" + BREAK + "[ \t\n\r" + BREAK + "]*", BREAK)
    s = rr(s, "[ \t\n\r]+", " ")
    s = rr(s, "^[ " + BREAK + "]+", "")
    s = f"translate({s}, '{BREAK}{NBSP}', chr(10) || ' ')"
    return rr(s, "[ \n]+\\z", "")


def truncate_bytes(c, max_bytes: int = MAX_TEXT_BYTES) -> Column:
    """SCA-6: the longest prefix of at most ``max_bytes`` UTF-8 bytes that ends
    on a code-point boundary (a code point cut by the limit is dropped)."""
    c = _c(c)
    cut = F.make_valid_utf8(F.substring(c.cast("binary"), 1, max_bytes).cast("string"))
    trimmed = F.regexp_replace(cut, "\ufffd+\\z", "")
    return F.when(F.octet_length(c) <= max_bytes, c).otherwise(trimmed)


def split_lines(c) -> Column:
    """SCA-7: split on newline, drop empty lines."""
    return F.filter(F.split(_c(c), "\n"), lambda x: x != F.lit(""))


def query_form(c) -> Column:
    """SCA-9: lower case, space -> '+'."""
    return F.translate(F.lower(_c(c)), " ", "+")


def trim_spaces_newlines(c) -> Column:
    """SCA-10: strip spaces and newlines at both ends."""
    return F.regexp_replace(F.regexp_replace(_c(c), "^[ \n]+", ""), "[ \n]+\\z", "")


def join_list(c, sep: str = " ") -> Column:
    """AGG-6: entries joined in order with one space; NULL for an empty list."""
    c = _c(c)
    return F.when(F.size(c) > 0, F.array_join(c, sep))
