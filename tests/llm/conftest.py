import random

import pytest

#: Extra columns with names that operators use inside.
CLASHES = ["key", "node", "ids", "row", "text_key", "c", "n", "sig", "hash", "doc", "spans", "candidates", "_key", "score"]

LONG = " ".join(f"word{i % 977} and{i % 31}." for i in range(12_000))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns of clashing names."""
    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
        full = [(i, t, "en", "s", len(t) if t is not None else None) + ("x",) * len(CLASHES) for i, t in rows]
        return spark.createDataFrame(full, schema)
    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Null ids and texts, empty, blank, one-word and very long texts, repeated rows."""
    rnd = random.Random(7)
    words = ["the", "Cat", "sat", "on", "été", "ñandú", "don't", "x1", "42", "CC-BY", "mail", "東京", "  ", "\n"]
    rows = [(None, "a text without id"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, LONG),
            (6, "the same row"), (6, "the same row"), (7, "the same row"), (8, "!?.,"), (9, "a b")]
    rows += [(10 + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(make_docs, edge_rows):
    return make_docs(edge_rows)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


def by_row(rows):
    """Rows as a sorted list, for comparisons that keep repeats."""
    return sorted(rows, key=repr)
