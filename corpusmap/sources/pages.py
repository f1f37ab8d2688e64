"""Markup pages -> rows (SRC-3 gallery cards, SRC-4 write-up, SRC-5 prizes).

Every field is cut out with native string expressions. A gallery page is split
into cards with ``split`` + ``posexplode`` (a card runs from one card marker to
the next), so every field is searched only inside its own card.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.text import html_to_text, parse_number, text_between, trim_spaces_newlines
from corpusmap.functions.text import regex_literal

# The literal markers the site's markup carries.
CARD = 'data-software-id="'
SLUG = 'href="https://devpost.com/software/'
MEMBER = 'data-url="https://devpost.com/'
LIKES = 'data-count="like">'
WINNER_BADGE = 'class="winner"'
SUBMISSIONS = 'id="submissions"'
PRIZE = 'class="winner label'
DETAILS = 'id="app-details-left">'
BUILT_WITH = 'id="built-with"'
DETAILS_END = 'id="app-details-right"'


def parse_gallery(pages: DataFrame, html_col: str = "html", keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-3. Returns ``(projects, page_counts)``.

    projects: ``(*keys, card, id, slug, name, tagline, likes, winner, members)``;
    a card without a project link is skipped. page_counts: ``(*keys, cards)``
    -- the number of cards found, which is what ends a gallery walk.
    """
    keys = list(keys or [])
    parts = pages.select(*keys, F.posexplode(F.split(F.col(html_col), regex_literal(CARD))).alias("card", "_t"))
    cards = parts.filter(F.col("card") > 0)
    t = F.col("_t")
    slug = text_between(t, SLUG, '"')
    name = text_between(t, "<h5>", "</h5>")
    tagline = text_between(t, 'class="small tagline">', "</p>")
    members = F.regexp_extract_all(t, F.lit(regex_literal(MEMBER) + '([^"]*)"'), 1)
    rows = cards.select(
        *keys, F.col("card").cast("long"),
        parse_number(F.when(F.locate('"', t) > 0, F.substring_index(t, '"', 1))).alias("id"),
        slug.alias("slug"),
        html_to_text(name).alias("name"),
        html_to_text(tagline).alias("tagline"),
        parse_number(text_between(t, LIKES, "</span>")).alias("likes"),
        t.contains(WINNER_BADGE).alias("winner"),
        members.alias("members"))
    projects = rows.filter(F.col("slug").isNotNull())
    counts = projects.groupBy(*keys).agg(F.count(F.lit(1)).alias("cards")) if keys else None
    return projects, counts


def page_writeup(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """SRC-4: write-up between the details marker and the built-with block,
    else up to the right column; NULL (-> reject) when neither is there."""
    h = F.col(html_col)
    raw = F.coalesce(text_between(h, DETAILS, BUILT_WITH), text_between(h, DETAILS, DETAILS_END))
    return pages.withColumn("writeup", html_to_text(raw))


def page_prizes(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """SRC-5: after the submissions marker, for each prize badge the text
    between the next ``</span>`` and ``</li>``, as text, trimmed, empties
    dropped. No section -> empty list (fetched, none won)."""
    h = F.col(html_col)
    at = F.locate(SUBMISSIONS, h)
    section = F.when(at > 0, F.substring(h, at, F.lit(1 << 30))).otherwise(F.lit(""))
    spans = F.regexp_extract_all(section, F.lit(regex_literal(PRIZE) + r"[\s\S]*?</span>([\s\S]*?)</li>"), 1)
    texts = F.transform(spans, lambda s: trim_spaces_newlines(html_to_text(s)))
    return pages.withColumn("prizes", F.filter(texts, lambda s: F.length(s) > 0))
