"""License scan against a search of every notice in the whole text."""

import random
import re

import regex

from corpusmap.llm import license_scan as L


def plain(text):
    """The contract's base columns, word by word."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), " ".join(words)


def noisy(rnd, text, edits):
    for _ in range(edits):
        i = rnd.randrange(len(text))
        text = rnd.choice([text[:i] + text[i + 1:], text[:i] + "q" + text[i:], text[:i] + "q" + text[i + 1:]])
    return text


def rows_with_notices():
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        notice = rnd.choice(list(L.NOTICES))
        rows.append((100 + i, "Été. " * rnd.randint(0, 3) + noisy(rnd, notice, rnd.randint(0, 5)) + rnd.choice(["", " 4.0 xyz", "!"])))
    return rows + [(300, "cc by cc by CC-BY"), (301, "All rights\nreserved all RIGHTS reserved"), (302, "ccby cc bye acc by")]


def test_base_columns_and_labels(edge_rows, make_docs):
    rows = edge_rows + rows_with_notices()
    got = {(r.doc_id, r.n_words): r for r in L.scan_licenses(make_docs(rows)).collect()}
    for i, text in rows:
        n_words, n_base, first, last, labels, norm = plain(text)
        r = got[i, n_words]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (n_base, first, last, labels)
        found = {label for n, label in L.NOTICES.items() if regex.search(f"(?:{regex.escape(n)}){{e<={L.edits_allowed(n)}}}", norm)}
        method = {m.label for m in r.matches}
        base = set(filter(None, labels.split(",")))
        # Overlapping notices keep the best one, so labels are some of those found, and none only if nothing is there.
        assert method <= found and bool(method) == bool(found)
        assert set(filter(None, r.labels.split(","))) == method | base
        assert 0 <= r.score <= 1 and (r.score == 1 or not base) and (r.score > 0) == bool(method | base)


def test_spans_of_the_original_text(make_docs):
    text = "Ünï. Released under -- the\nMIT  Licence; done"
    (r,) = L.scan_licenses(make_docs([(1, text)])).collect()
    (m,) = r.matches
    assert m.label == "mit" and m.edits == 1
    assert text[m.start:m.end].startswith("Released under") and "Licence" in text[m.start:m.end]


def test_pieces_cover_a_notice_and_one_survives():
    for n in L.NOTICES:
        cut = L.pieces(n)
        assert "".join(p for _, p in cut) == n and len(cut) == L.edits_allowed(n) + 1


def test_empty_table(no_docs):
    assert L.scan_licenses(no_docs).count() == 0


def test_worse_copy_before_a_better_one(make_docs):
    text = "licensed under the mit lisense and licensed under the mit license and licensed under the mit licence"
    (r,) = L.scan_licenses(make_docs([(1, text)])).collect()
    assert [(m.label, m.edits) for m in r.matches] == [("mit", 1), ("mit", 0), ("mit", 1)]
    assert [text[m.start:m.end].strip() for m in r.matches] == text.split(" and ")
