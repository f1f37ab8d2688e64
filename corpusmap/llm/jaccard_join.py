"""N-gram Jaccard join with PartEnum signatures.

A text's set is its distinct word shingles. Sizes fall into bands such that
sets of Jaccard similarity ``percent`` lie in the same band or in neighbours;
each band has an instance for itself and the band below, with a bound ``k`` on
the size of their symmetric difference. An instance hashes the elements into
``n1`` groups of ``n2`` cells. A difference of at most ``k`` leaves one group
with at most one changed cell, so two sets that similar agree on one of the
subsets of ``n2 - 1`` cells of some group: the hash of each subset is a
signature, and similar sets share one.

Equal sets form one class and are joined once. Classes that share a signature
are candidates; they are compared exactly (set intersection), but not all with
all. In each bucket the class with most candidates is compared with the others,
and links are merged into components. Of buckets that still span several
components, those of at most ``SMALL_BUCKET`` classes are finished by pairs
across components, and larger ones by comparing blocks of classes inside a task
that returns a spanning forest. So the components are those of all links, and
no group is expanded into its pairs.

Words are split at ASCII white space after lower-casing A-Z. A text with fewer
words than a shingle has its whole sequence as one element; null, empty and
blank texts have an empty set and are linked with nothing. Elements are 64-bit
hashes of word sequences, and classes are told apart by a 64-bit hash of the
whole set. A row's component is the smallest ``doc_id`` in it (null only if all
are null). One row out per row in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmap.llm.common import MIX1, MIX2, WordHash, id_text, mix, prepare
from corpusmap.session import cut_lineage

SHINGLE = 3
PERCENT = 90
#: Cells of each group; one of them may have changed.
CELLS = 3
#: Buckets of at most so many classes are finished by pairs, others by blocks.
SMALL_BUCKET = 16
#: Elements and classes in one block, about (classes are dealt by hash).
BLOCK_ELEMENTS = 200_000
BLOCK_CLASSES = 2_000


def element_hashes(text: str, words: WordHash, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles."""
    h = words.of(text.encode().lower().split())
    if len(h) == 0:
        return h
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = out * MIX1 + h[j:len(h) - width + 1 + j]
    return np.unique(mix(out))


@lru_cache(maxsize=100_000)
def band(size: int, percent: int) -> tuple[int, int, int]:
    """(number, smallest, largest size) of the band of a size."""
    i, lo = 0, 1
    while True:
        hi = lo * 100 // percent
        if size <= hi:
            return i, lo, hi
        i, lo = i + 1, hi + 1


@lru_cache(maxsize=100_000)
def groups(below: int, top: int, percent: int) -> int:
    """Number of groups ``n1`` of the instance for sizes ``below`` to ``top``:
    0 if only equal sets are similar enough."""
    k = 0
    for total in range(2 * below, 2 * top + 1):
        common = -(-percent * total // (100 + percent))         # least intersection of two sets with so many elements
        k = max(k, total - 2 * common)
    return math.ceil((k + 1) / 2) if k else 0


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of one set in the instances of its band and the next."""
    i, lo, hi = band(len(elements), percent)
    below = band(lo - 1, percent)[1] if lo > 1 else lo
    nxt = band(hi + 1, percent)
    weight = mix(elements ^ MIX2)
    out = []
    for number, n1 in ((i, groups(below, hi, percent)), (nxt[0], groups(lo, nxt[2], percent))):
        salt = np.array([number + 1], dtype=np.uint64) * MIX2
        if n1 == 0:
            out.append(mix(salt + weight.sum()))
            continue
        group = ((elements >> np.uint64(32)) * np.uint64(n1)) >> np.uint64(32)
        cell = group * np.uint64(CELLS) + (((elements & np.uint64(0xFFFFFFFF)) * np.uint64(CELLS)) >> np.uint64(32))
        order = np.argsort(cell, kind="stable")
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight[order], dtype=np.uint64)])
        ends = np.searchsorted(cell[order], np.arange(n1 * CELLS + 1, dtype=np.uint64))
        sums = np.diff(running[ends]).reshape(n1, CELLS)
        for left_out in range(CELLS):
            h = np.arange(n1, dtype=np.uint64) * np.uint64(CELLS) + np.uint64(left_out) + salt
            for c in range(CELLS):
                if c != left_out:
                    h = h * MIX1 + sums[:, c]
            out.append(mix(h))
    return np.concatenate(out).astype(np.int64)


def class_hash(elements: np.ndarray) -> int:
    """Hash of a whole set, as a signed 64-bit integer."""
    total = np.array([mix(elements).sum()], dtype=np.uint64) * MIX1 + np.uint64(len(elements))
    return int(mix(total).astype(np.int64)[0])


def _described(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (class), sigs of every row."""
    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHash()
        for b in batches:
            sizes, nodes, sigs = [], [], []
            for t in b["text"]:
                e = element_hashes(t, words, n)
                sizes.append(len(e))
                nodes.append(class_hash(e) if len(e) else None)
                sigs.append(signatures(e, percent) if len(e) else None)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_key": b["text_key"], "n_shingles": sizes,
                                "node": pd.array(nodes, dtype="Int64"), "sigs": sigs})
    return rows.mapInPandas(describe, "doc_id long, text_key long, n_shingles long, node long, sigs array<long>")


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """(node, elements) of rows with a text."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHash()
        for b in batches:
            yield pd.DataFrame({"node": b["node"],
                                "elements": [element_hashes(t, words, n).astype(np.int64) for t in b["text"]]})
    return rows.mapInPandas(cut, "node long, elements array<long>")


def connected(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of ``links`` (a, b): ``comp`` is the smallest
    node of the component. Alternates large and small stars, which turn any
    graph into stars around the smallest nodes, until nothing changes."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        edges = cut_lineage(small, "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
        mark = now


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    right = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    common = F.size(F.array_intersect("ea", "eb"))
    return (pairs.join(left, "b").join(right, "a")
            .withColumn("common", common)
            .filter(100 * F.col("common") >= percent * (F.size("ea") + F.size("eb") - F.col("common")))
            .select("a", "b"))


def _buckets(classes: DataFrame) -> DataFrame:
    """(sig, node, size, rank) of the signatures that several classes share;
    ``rank`` goes by the number of candidates of a class, most first."""
    shared = Window.partitionBy("sig")
    rows = (classes.select("node", F.col("n_shingles").alias("size"), F.explode("sigs").alias("sig"))
            .withColumn("n", F.count(F.lit(1)).over(shared)).filter("n > 1"))
    rows = cut_lineage(rows, "buckets")
    degree = rows.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = Window.partitionBy("sig").orderBy(F.col("degree").desc(), "node")
    return cut_lineage(rows.join(degree, "node").withColumn("rank", F.row_number().over(ranked))
                       .select("sig", "node", "size", "rank"), "ranked")


def _forest(sides: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of (node, comp, elements) rows: a
    spanning forest of all links between rows of different components."""
    elements = np.concatenate([e for _, _, e in sides])
    owner = np.repeat(np.arange(len(sides)), [len(e) for _, _, e in sides])
    code, uniques = pd.factorize(elements)
    shared = np.bincount(code) > 1
    code, owner = (np.cumsum(shared) - 1)[code][shared[code]], owner[shared[code]]
    n = len(sides)
    common = np.zeros((n, n), dtype=np.float32)
    width = 1 << 12                                          # columns of the incidence matrix at a time
    for lo in range(0, int(shared.sum()), width):
        part = (code >= lo) & (code < lo + width)
        has = np.zeros((n, width), dtype=np.float32)
        has[owner[part], code[part] - lo] = 1
        common += has @ has.T
    size = np.array([len(e) for _, _, e in sides])
    comp = pd.factorize(np.array([c for _, c, _ in sides]))[0]
    out = []
    for i in range(n - 1):
        both = common[i, i + 1:].astype(np.int64)
        similar = i + 1 + np.flatnonzero(100 * both >= percent * (size[i] + size[i + 1:] - both))
        for j in similar[comp[similar] != comp[i]]:
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
                out.append((sides[i][0], sides[j][0]))
    return out


def _blocks(nodes: DataFrame) -> DataFrame:
    """``nodes`` (cluster, node, size) with their block, a number within the
    cluster that grows with the size. Sizes are counted, so no task reads a
    cluster; in the place of its size a class is dealt by hash."""
    load = F.col("n") / BLOCK_CLASSES + F.col("n") * F.col("size") / BLOCK_ELEMENTS
    smaller = Window.partitionBy("cluster").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    loads = (nodes.groupBy("cluster", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("load", load)
             .withColumn("start", F.coalesce(F.sum("load").over(smaller), F.lit(0.0))).drop("n"))
    dealt = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / (1 << 20)
    return (nodes.join(loads, ["cluster", "size"])
            .withColumn("block", F.floor(F.col("start") + F.col("load") * dealt)).drop("load", "start"))


def _block_links(open_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components inside large buckets. Buckets that overlap form
    a cluster; its classes, by size, are dealt into blocks of about
    ``BLOCK_ELEMENTS`` elements or ``BLOCK_CLASSES`` classes at most, and every two blocks of compatible sizes are
    compared in one task, which returns a spanning forest only."""
    first = Window.partitionBy("sig")
    cluster = connected(open_rows.select("node", F.min("node").over(first).alias("lead"))
                        .select(F.col("node").alias("a"), F.col("lead").alias("b")))
    nodes = (open_rows.select("node", "size", "comp").distinct()
             .join(cluster.select("node", F.col("comp").alias("cluster")), "node"))
    nodes = cut_lineage(_blocks(cut_lineage(nodes, "clusters")), "blocks")
    blocks = nodes.groupBy("cluster", "block").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    other = blocks.select("cluster", F.col("block").alias("other"), F.col("least").alias("o_least"))
    meets = (blocks.join(other, "cluster")
             .filter((F.col("block") <= F.col("other")) & (100 * F.col("most") >= percent * F.col("o_least")))
             .select("cluster", F.col("block").alias("i"), F.col("other").alias("j")))
    sides = meets.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(n, c, np.asarray(e)) for n, c, e in zip(group["node"], group["comp"], group["elements"])]
        return pd.DataFrame(_forest(rows, percent), columns=["a", "b"])

    return (nodes.join(sides, ["cluster", "block"]).join(sets, "node")
            .select("cluster", "i", "j", "node", "comp", "elements")
            .groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long"))


def similar_classes(classes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, comp) of all classes with a link. ``classes``: node, n_shingles,
    sigs, doc_id, text_key (of one row); ``texts``: doc_id, text_key, text."""
    buckets = _buckets(classes)
    involved = (buckets.select("node").distinct().join(classes.select("node", "doc_id", "text_key"), "node")
                .withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"}))
    found = texts.join(involved, texts["doc_id"].eqNullSafe(F.col("_doc")) & (texts["text_key"] == F.col("_key")))
    sets = cut_lineage(_sets(found.select("node", "text"), n).dropDuplicates(["node"]), "sets")
    bucket = Window.partitionBy("sig")

    def still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of the buckets that span several components."""
        return (rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
                .withColumn("low", F.min("comp").over(bucket)).withColumn("high", F.max("comp").over(bucket))
                .filter("low <> high").drop("low", "high"))

    def pairs_of(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of different components that their sizes allow."""
        r = right.select("sig", F.col("node").alias("o"), F.col("comp").alias("o_comp"), F.col("size").alias("o_size"),
                         F.col("rank").alias("o_rank"))
        return (left.join(r, "sig")
                .filter((F.col("rank") < F.col("o_rank")) & (F.col("comp") != F.col("o_comp"))
                        & (100 * F.least("size", "o_size") >= percent * F.greatest("size", "o_size")))
                .select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).distinct())

    # First the class with most candidates of each bucket against the others.
    alone = buckets.withColumn("comp", F.col("node"))
    pairs = cut_lineage(pairs_of(alone.filter("rank = 1"), alone), "pairs")
    links = cut_lineage(_links(pairs, sets, percent), "links")
    labels = connected(links)
    # Then, where a bucket still spans several components, the other pairs of
    # small buckets, and the large buckets in blocks.
    rows = cut_lineage(still_open(buckets, labels).withColumn("m", F.count(F.lit(1)).over(bucket)), "open")
    small = rows.filter(F.col("m") <= SMALL_BUCKET)
    more = pairs_of(small, small).join(pairs, ["a", "b"], "left_anti")
    links = links.union(cut_lineage(_links(more, sets, percent), "links"))
    large = rows.filter(F.col("m") > SMALL_BUCKET)
    if not large.isEmpty():
        links = links.union(cut_lineage(_block_links(large, sets, percent), "links"))
    return connected(links)


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, component_key of every row;
    ``text_key`` is xxhash64 of the text, ``component_key`` tells components
    apart even if ids repeat (null for an empty set)."""
    prepare(docs.sparkSession)
    texts = id_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    rows = cut_lineage(_described(texts, shingle, percent), "shingle-sets")
    classes = cut_lineage(rows.filter(F.col("node").isNotNull()).groupBy("node")
                          .agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("n_shingles").alias("n_shingles"),
                               F.first("sigs").alias("sigs"), F.min("doc_id").alias("least_id"))
                          .select("node", "row.doc_id", "row.text_key", "n_shingles", "sigs", "least_id"), "classes")
    labels = similar_classes(classes, texts, shingle, percent)
    comp = (classes.select("node", "least_id").join(labels, "node", "left")
            .withColumn("comp", F.coalesce("comp", "node")))
    least = comp.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    of = comp.join(least, "comp").select("node", "component_id", F.col("comp").alias("component_key"))
    return (rows.select("doc_id", "text_key", "n_shingles", "node").join(of, "node", "left")
            .select("doc_id", "text_key", "n_shingles",
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    "component_key"))
