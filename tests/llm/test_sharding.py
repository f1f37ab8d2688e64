"""Sharding by differencing: brute force on small cases, balance on the tables."""

import itertools
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmap.llm import sharding
from corpusmap.llm.queries import sharding_query
from corpusmap.llm.sharding import differencing, shard_documents, write_shards
from tests.conftest import SF_CHECK, SF_SMALL


def plain_differencing(sizes, parts):
    """Sums only, with lists that are sorted anew each time."""
    held = [[0] * (parts - 1) + [s] for s in sizes]
    while len(held) > 1:
        held.sort(key=lambda t: t[0] - t[-1])
        a, b, *held = held
        held.append(sorted(x + y for x, y in zip(a, reversed(b))))
    return held[0] if held else [0] * parts


def sums(sizes, parts, k):
    out = [0] * k
    for s, p in zip(sizes, parts):
        out[p] += s
    return out


@pytest.mark.parametrize("seed", range(6))
def test_differencing_equals_the_plain_form(seed):
    rnd = random.Random(seed)
    sizes = rnd.sample(range(1, 100_000), 60)
    for k in (2, 3, 7):
        got = differencing(sizes, k)
        assert set(got) <= set(range(k))
        want = plain_differencing(sizes, k)
        # ties of equal spread may be taken in another order; the spread is what counts
        assert max(sums(sizes, got, k)) - min(sums(sizes, got, k)) <= want[-1] - want[0] + 1_000


def test_known_partition():
    got = differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sums([8, 7, 6, 5, 4], got, 2)) == [14, 16]


def test_near_the_optimum_of_small_cases():
    rnd = random.Random(3)
    for _ in range(10):
        sizes = [rnd.randint(1, 50) for _ in range(8)]
        best = min(max(sums(sizes, p, 3)) for p in itertools.product(range(3), repeat=8))
        assert max(sums(sizes, differencing(sizes, 3), 3)) <= best * 7 / 6 + 1


def test_no_and_single_units():
    assert differencing([], 4) == [] and differencing([5], 4) == [3] and differencing([5, 6], 1) == [0, 0]


def check(rows, shards=24):
    """Slots without gaps, groups whole; the bytes of each shard."""
    slots, total = defaultdict(list), [0] * shards
    for r in rows:
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return total


@pytest.mark.parametrize("sf", [SF_SMALL, SF_CHECK])
def test_query(spark, sf):
    got = sharding_query(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    text = {r.doc_id: r.text or "" for r in docs}
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs)
    where = defaultdict(set)
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        where[raw].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    groups = defaultdict(int)
    for r in got:
        groups[text[r.doc_id]] += r.size
    total, mean = check(got), sum(groups.values()) / 24
    assert max(total) <= max(mean * 1.02, max(groups.values()))


def test_bundles_keep_the_balance(spark, monkeypatch):
    """Far more groups than units, and one group of a third of all bytes."""
    monkeypatch.setattr(sharding, "OWN_UNIT", 64)
    monkeypatch.setattr(sharding, "BUNDLES", 32)
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"),
                                      F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(
                                          F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    found = sharding.units(docs.select(F.xxhash64("text").alias("g"), F.lit(9).cast("long").alias("n")), "g", "n")
    assert found.count() <= 64 + 5 * 32
    total = check(shard_documents(docs, 8).collect(), 8)
    rest = sorted(total)[:-1]
    assert max(rest) - min(rest) <= 0.01 * sum(rest) / 7
    assert max(total) == 10_000 * 21


def test_edge_cases(spark, edge_docs, edge_rows, no_docs):
    got = shard_documents(edge_docs, 3, carry=["key", "text"]).collect()
    assert len(got) == len(edge_rows) and all(r.key == "x" for r in got)
    check(got, 3)
    assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 8 for _, t in edge_rows)
    assert len({r.shard for r in got if not r.text}) == 1              # null and empty texts are one group
    assert len({r.shard for r in got if r.text == "the same row"}) == 1
    assert shard_documents(no_docs).count() == 0


def test_written_shards(spark, edge_docs, edge_rows, tmp_path):
    sharded = shard_documents(edge_docs, 3, carry=["text"])
    write_shards(sharded, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back))) == sorted(map(repr, edge_rows))
    check(back, 3)
