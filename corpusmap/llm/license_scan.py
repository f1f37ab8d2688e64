"""License notices in texts: exact phrases, and short notices with a few edits.

Texts are lower-cased (A-Z) and reduced to their words joined by single spaces.
Exact phrases are counted where their words stand consecutively. A notice that
may have ``k`` edits is split into ``k + 1`` pieces: whatever the edits, one
piece stays whole (pigeonhole), so one pass of an Aho-Corasick automaton over
the pieces finds every candidate place. Only the stretch around a candidate is
matched with the regex library's bounded-error matching, which verifies the
edits and gives the span.

Null and empty texts have no words and no labels. Repeated rows give equal rows.
Very long texts are searched whole, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusmap.llm.common import id_text, prepare

#: Exact phrases (words) and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices searched with edits, and their labels.
NOTICES = {
    "licensed under the mit license": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "provided as is without warranty of any kind": "no-warranty",
}

#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 10

NOT_WORD = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
TO_SPACE = bytes.maketrans(NOT_WORD, b" " * len(NOT_WORD))
WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")   # of the text before lower-casing

RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, matches array<struct<label:string,start:int,end:int,edits:int>>")


def words(text: str) -> list[bytes]:
    return text.encode().lower().translate(TO_SPACE).split()


def edits_allowed(notice: str) -> int:
    return len(notice) // CHARS_PER_EDIT


def pieces(notice: str) -> list[tuple[int, str]]:
    """``k + 1`` pieces of nearly equal length, with their offsets."""
    n = edits_allowed(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str]):
        import ahocorasick
        import regex
        self.labels = notices
        self.exact = [(label, re.compile(rb"(?<![^ ])" + re.escape(p.encode()) + rb"(?![^ ])"))
                      for p, label in phrases.items()]
        self.fuzzy = {n: regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={edits_allowed(n)}}}") for n in notices}
        seeds: dict[str, list[tuple[str, int]]] = {}
        for n in notices:
            for at, piece in pieces(n):
                seeds.setdefault(piece, []).append((n, at))
        self.seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def windows(self, norm: str) -> dict[str, list[list[int]]]:
        """Per notice, the merged stretches in which it can lie."""
        out: dict[str, list[list[int]]] = {}
        for last, (size, places) in self.seeds.iter(norm):
            for notice, at in places:
                k = edits_allowed(notice)
                lo = last + 1 - size - at - k
                hi = lo + len(notice) + 2 * k
                found = out.setdefault(notice, [])
                if found and lo <= found[-1][1]:
                    found[-1][1] = max(found[-1][1], hi)
                    found[-1][0] = min(found[-1][0], lo)
                else:
                    found.append([lo, hi])
        return out

    def near(self, norm: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, edits, similarity) of fuzzy notices; of those
        that overlap, the most similar, then the longest, then the first."""
        found = []
        for notice, stretches in self.windows(norm).items():
            for lo, hi in stretches:
                # The best match of a part, then what is left before and after it.
                parts = [(max(0, lo), min(len(norm), hi))]
                while parts:
                    a, b = parts.pop()
                    m = self.fuzzy[notice].search(norm, a, b)
                    if m is None:
                        continue
                    parts += [(a, m.start()), (m.end(), b)]
                    edits = sum(m.fuzzy_counts)
                    found.append((m.start(), m.end(), self.labels[notice], edits, 1 - edits / len(notice)))
        kept: list[tuple[int, int, str, int, float]] = []
        for f in sorted(found, key=lambda f: (-f[4], f[0] - f[1], f[0], f[2])):
            if not any(k[0] < f[1] and f[0] < k[1] for k in kept):
                kept.append(f)
        return sorted(kept)

    def scan(self, text: str) -> tuple:
        ws = words(text)
        joined = b" ".join(ws)
        base = [(joined.count(b" ", 0, m.start()), label) for label, p in self.exact for m in p.finditer(joined)]
        base_labels = {label for _, label in base}
        norm = joined.decode()
        near = self.near(norm)
        spans = []
        if near:
            places = [m.span() for m in WORD.finditer(text)]
            starts = [0]
            for a, b in places:
                starts.append(starts[-1] + b - a + 1)
            for a, b, label, edits, _ in near:
                i, j = norm.count(" ", 0, a), norm.count(" ", 0, max(a, b - 1))
                spans.append({"label": label, "start": min(places[i][0] + a - starts[i], places[i][1]),
                              "end": min(places[j][0] + b - starts[j], places[j][1]), "edits": edits})
        at = [i for i, _ in base]
        return (len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)),
                ",".join(sorted(base_labels | {f[2] for f in near})),
                1.0 if base else max((f[4] for f in near), default=0.0), spans)


@lru_cache(maxsize=4)
def scanner(phrases: tuple, notices: tuple) -> Scanner:
    return Scanner(dict(phrases), dict(notices))


def scan_column(text: Column, phrases: dict[str, str], notices: dict[str, str]) -> Column:
    key = (tuple(phrases.items()), tuple(notices.items()))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]

    @pandas_udf(RESULT)
    def scan(col: pd.Series) -> pd.DataFrame:
        s = scanner(*key)
        out = pd.DataFrame([s.scan(t or "") for t in col], columns=names)
        return out.astype({"first_word": "Int64", "last_word": "Int64"})
    return scan(text)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of words, exact places, labels, score, and the fuzzy
    matches with code-point spans of the original text."""
    prepare(docs.sparkSession)
    found = scan_column(F.col("text"), PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    return id_text(docs, id_col, text_col).select("doc_id", found.alias("found")).select("doc_id", "found.*")
