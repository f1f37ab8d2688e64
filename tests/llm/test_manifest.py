"""The Merkle manifest against a plain recursion over all levels, and SQL."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmap.llm import manifest as M
from corpusmap.llm.queries import merkle_manifest_query
from tests.conftest import SF_CHECK, SF_SMALL


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def halve(level):
    return [sha("".join(level[i:i + 2])) for i in range(0, len(level), 2)]


def root_of(level):
    while len(level) > 1:
        level = halve(level)
    return level[0]


def climb(level, k, now):
    """The siblings over node k, and the root that ``now`` in its place leads to."""
    siblings = []
    while len(level) > 1:
        pair = list(level[k // 2 * 2:k // 2 * 2 + 2])
        siblings += pair[:k % 2] + pair[k % 2 + 1:]
        pair[k % 2] = now
        now, level, k = sha("".join(pair)), halve(level), k // 2
    return siblings, now


def expected(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {x: sorted(trees[x], key=lambda t: t[:3]) for x in langs}
    subroots = [root_of([t[2] for t in ordered[x]]) for x in langs]
    root, out = root_of(subroots), []
    for j, x in enumerate(langs):
        level = [t[2] for t in ordered[x]]
        for k, (*_, d, r) in enumerate(ordered[x]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            first, now = climb(level, k, leaf((*r[:3], r[3] + 1, r[4])) if hit else d)
            more, now = climb(subroots, j, now)
            out.append((r[0], d, subroots[j], root, sha("".join(first + more)), now, now == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
def tampered():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 0


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf", [SF_SMALL, SF_CHECK])
def test_query(spark, sf):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = found(merkle_manifest_query(spark, sf))
    assert got == expected(rows)
    assert {g[-1] for g in got} == {True, False}


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_many_buckets(spark, levels):
    """Blocks of two to eight nodes, trees of 1 to 40 leaves and more languages than a block holds."""
    rows = [(i, "s", f"l{k:02d}", i, f"text {i}") for k, n in enumerate([1, 2, 3, 5, 8, 9, 17, 40, 1]) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(M.manifest(docs, tampered(), levels=levels)) == expected(rows)


def test_edge_cases(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in edge_docs.collect()]
    assert found(M.manifest(edge_docs, tampered())) == expected(rows)
    assert M.manifest(no_docs).count() == 0


def test_null_fields_and_largest_counts(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "s", None, 3, ""), (14, "s", "ß", 2**63 - 1, "x"),
            (2**53 + 1, "s", "z", 2**63 - 1, "x"), (None, "s", "z", 1, "x"), (3, "s", "", 0, "-"), (4, "", "é", 0, "1:-")]
    rows += [(i, "s", "z", 2**63 - 1, "y") for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(M.manifest(docs, tampered())) == expected(rows)


def test_no_language_or_one_leaf(spark):
    rows = [(5, "s", None, 1, "only")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = M.manifest(docs, with_path=True).first()
    assert got.leaf == got.subroot == got.root == got.folded_root and got.path == [] and got.proof_sha256 == sha("")


def test_proofs_and_nodes(spark):
    """Proofs lead to the root, and the node table nests without gaps."""
    docs = spark.range(45).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"),
                                  F.lit(1).cast("long").alias("n_chars"), F.concat(F.lit("t"), "id").alias("text"))
    for r in M.manifest(docs, with_path=True, levels=3).collect():
        assert M.fold(r.leaf, r.path) == r.root == r.folded_root and r.verified
        assert M.fold(sha("forged"), r.path) != r.root
    leaves, most, _ = M.forest(docs)
    nodes = M.nodes_over(leaves, most, levels=3).collect()
    by = defaultdict(list)
    for x in nodes:
        by[x.level].append((x.lo, x.hi))
    assert sorted(by) == list(range(7)) and by[6] == [(0, 45)]
    for level, spans in by.items():
        spans.sort()
        assert [s[0] for s in spans] == list(range(0, 45, 1 << level)) and spans[-1][1] == 45
