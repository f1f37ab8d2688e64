"""Balanced shards of whole groups of rows, by Karmarkar-Karp differencing.

Rows with the same text are one group, and a group is never split. The law is
``bytes``: the shards' sums of sizes are to be near equal.

Differencing holds partial partitions: tuples of as many sums as there are
shards. It starts with one tuple ``(0, ..., 0, size)`` for each unit, takes
the two tuples of largest spread again and again, and adds them in opposite
order, the largest sum of one to the smallest of the other. One tuple is left;
the way it came together tells the shard of every unit.

At scale the groups are a table, found by one aggregation with partial sums,
and only units go through the differencing, whose number has a fixed bound:

* a group of at least ``1 / OWN_UNIT`` of all bytes is a unit of its own (so
  there are at most ``OWN_UNIT`` of those, however skewed the groups are);
* every other group falls by the hash of its text into one of ``BUNDLES``
  bundles of one of five scales. Each scale gets an eighth of the bytes of the
  one before, so that small bundles are there to fill the last differences.

With few groups each is a unit of its own, and the result is the plain
differencing of all groups; the rule is the same for every size of the input.
A group larger than a shard's equal part fills its shard beyond it; no
partition of whole groups can avoid that, and the rest stays even.

Slots number the rows of a shard from 0 without gaps in the order of
``doc_id``. Rows are range-partitioned by (shard, id) for that, so a shard
that holds a third of all rows is spread over many tasks.

Defined results: a null text has no bytes and is grouped with the empty text;
a null id is placed by its text like any other and comes first in its shard;
repeated rows are in one shard, with a slot each; rows of equal id are ordered
by size and hash of the text; very long texts are rows like others; an empty
table gives an empty result. Other columns are dropped unless named in
``carry``; names beginning with ``_shard_`` are reserved.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.llm.common import prepare
from corpusmap.session import cut_lineage, dense_index

#: A group of at least this part of all bytes is a unit of its own.
OWN_UNIT = 4096
#: Bundles of each scale of the other groups, and the number of scales.
BUNDLES = 1024
SCALES = 5
#: Added to the bytes of every text (its length field in a shard).
ROW_BYTES = 8


def differencing(sizes: Sequence[int], parts: int) -> list[int]:
    """The part (0 to ``parts`` - 1) of each size. Ties go by position."""
    heap = []
    for k, size in enumerate(sizes):
        sums = [0] * (parts - 1) + [size]
        heap.append((-(size if parts > 1 else 0), k, sums, [()] * (parts - 1) + [k]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, k, a, held = heapq.heappop(heap)
        _, _, b, more = heapq.heappop(heap)
        both = sorted(((x + y, i) for i, (x, y) in enumerate(zip(a, reversed(b)))))
        joined = [(held[i], more[parts - 1 - i]) for _, i in both]
        sums = [s for s, _ in both]
        heapq.heappush(heap, (sums[0] - sums[-1], k, sums, joined))
    out = [0] * len(sizes)
    for part, node in enumerate(heap[0][3] if heap else ()):
        stack = [node]
        while stack:                       # nodes are pairs of nodes, or the position of a unit
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            else:
                out[node] = part
    return out


def bundle(group: Column) -> Column:
    """Scale and bundle of a group's hash, as one number below SCALES * BUNDLES."""
    low = F.pmod(group, F.lit(8 ** (SCALES - 1)))
    at = F.when(low >= 8 ** (SCALES - 2), 0)
    for k in range(1, SCALES - 1):
        at = at.when(low >= 8 ** (SCALES - 2 - k), k)
    at = at.otherwise(SCALES - 1)
    return at * BUNDLES + F.pmod(F.shiftright(group, 3 * (SCALES - 1)), F.lit(BUNDLES))


def units(rows: DataFrame, group: str, size: str) -> DataFrame:
    """``own`` (a group's hash, or null), ``bundle`` (or null) and ``total``:
    at most OWN_UNIT + SCALES * BUNDLES rows."""
    everything = rows.agg(F.sum(size)).first()[0] or 0
    groups = rows.groupBy(group).agg(F.sum(size).alias("total"))
    large = F.col("total") * OWN_UNIT >= F.lit(everything)
    return (groups.select(F.when(large, F.col(group)).alias("own"),
                          F.when(~large, bundle(F.col(group))).cast("long").alias("bundle"), "total")
            .groupBy("own", "bundle").agg(F.sum("total").alias("total")))


def place(rows: DataFrame, group: str, size: str, shards: int) -> DataFrame:
    """Adds ``_shard_id`` to rows that have a group (long) and a size (long)."""
    spark = rows.sparkSession
    found = sorted(units(rows, group, size).collect(), key=lambda u: (-u.total, u.own is None, u.own or 0, u.bundle or 0))
    parts = differencing([u.total for u in found], shards)
    own = [(u.own, p) for u, p in zip(found, parts) if u.own is not None]
    rest = [(u.bundle, p) for u, p in zip(found, parts) if u.own is None]
    own = spark.createDataFrame(own, "_shard_group long, _shard_own int")
    rest = spark.createDataFrame(rest, "_shard_bundle long, _shard_rest int")
    return (rows.join(F.broadcast(own), F.col(group) == F.col("_shard_group"), "left")
            .join(F.broadcast(rest), bundle(F.col(group)) == F.col("_shard_bundle"), "left")
            .withColumn("_shard_id", F.coalesce("_shard_own", "_shard_rest"))
            .drop("_shard_group", "_shard_own", "_shard_bundle", "_shard_rest"))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                    carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every
    row, and the columns named in ``carry`` (the text itself, to write the
    shards with ``write_shards``)."""
    prepare(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    names = {c: f"_shard_c{k}" for k, c in enumerate(carry)}
    rows = docs.select(docs[id_col].cast("long").alias("_shard_doc"),
                       (F.octet_length(text) + ROW_BYTES).cast("long").alias("_shard_size"),
                       F.crc32(text).cast("long").alias("_shard_crc"), F.xxhash64(text).alias("_shard_hash"),
                       *[docs[c].alias(n) for c, n in names.items()])
    rows = cut_lineage(rows, "shard-rows")
    placed = place(rows, "_shard_hash", "_shard_size", shards)
    order = ["_shard_doc", "_shard_size", "_shard_hash"]
    numbered = dense_index(placed, order, ["_shard_id"], name="_shard_slot", whole_rows=True)
    return numbered.select(F.col("_shard_doc").alias("doc_id"), F.col("_shard_size").alias("size"),
                           F.col("_shard_crc").alias("text_crc32"), F.col("_shard_id").cast("int").alias("shard"),
                           F.col("_shard_slot").alias("slot"), *[F.col(n).alias(c) for c, n in names.items()])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder ``shard=K`` for each shard, rows in the order of their slots
    within files and from file to file."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
