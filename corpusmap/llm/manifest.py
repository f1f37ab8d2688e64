"""Merkle manifest of a dataset, with a proof for every row.

Each row is a leaf: the sha256 of its fields. Per language the leaves ascend
by id; every two consecutive nodes become their hash (a last single one too),
level by level, until one node is left, the subroot. The subroots, ordered by
language, become the root the same way.

Nodes are labelled by nested intervals: a node of level ``h`` covers the leaf
ranks ``[lo, hi)``, and a node is the ancestor of another exactly if its
interval contains the other's. All joins follow from the labels:

* levels are bucketed by ``LEVELS``: one job hashes blocks of ``2 ** LEVELS``
  nodes up by so many levels, so a tree over 10^10 leaves takes four jobs and
  no task holds more than one block;
* ancestors are attached by a containment join, bucket by bucket from the top:
  the nodes of a bucket meet the one node of the next bucket whose interval
  contains theirs (an equality of ``lo`` without its lowest bits);
* siblings are what the parent's interval has beyond the node's own: the part
  before it, the part after it, or nothing.

A row's proof is the list of its siblings from the leaf to the root, each with
its side. Whoever has a row and its proof can fold them to the root.

Ranks come from a range partition of the narrow leaf rows, so a language that
holds most rows is spread over tasks; nothing but one row of counts goes to
the driver.

Defined results: a null field is ``-`` in the leaf; null languages are a tree
of their own, which is first; null ids come first in their tree; rows of equal
id are ordered by their leaf hash, and repeated rows are leaves of their own;
empty and very long texts are hashed whole like others; the only leaf of a
language is its subroot, and the only subroot is the root; an empty table gives
an empty result. Only the five columns of ``FIELDS`` are read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.llm.common import prepare
from corpusmap.session import cut_lineage, dense_index

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one job climbs; a block has 2 ** LEVELS nodes.
LEVELS = 10

NODE = "tree long, n long, lo long, hi long, digest string"
PATH = "path array<string>, subroot string, root string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    """Byte count, colon and value; ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(columns[c]) for c in FIELDS]), 256)


def covering(lo: int, level: int, n: int) -> tuple[int, int]:
    """The interval of the node of ``level`` over leaf ``lo`` in a tree of ``n`` leaves."""
    first = lo >> level << level
    return first, min(first + (1 << level), n)


def climb_block(nodes: dict[tuple[int, int], str], level: int, n: int, levels: int) -> list[dict[tuple[int, int], str]]:
    """Digest by interval, for each level of a block from the lowest up, in a
    tree of ``n`` leaves: ``levels`` levels, or fewer if the root comes first."""
    out = [nodes]
    for up in range(level + 1, min(level + levels, (n - 1).bit_length()) + 1):
        parts: dict[tuple[int, int], list[str]] = {}
        for (lo, _), digest in out[-1].items():
            parts.setdefault(covering(lo, up, n), []).append(digest)
        out.append({span: sha("".join(p)) for span, p in parts.items()})
    return out


def sibling(node: tuple[int, int], parent: tuple[int, int], digests: dict[tuple[int, int], str]) -> str:
    """What the parent covers beyond the node: ``L`` or ``R`` and its digest, or ``-``."""
    if parent[0] < node[0]:
        return "L" + digests[parent[0], node[0]]
    if node[1] < parent[1]:
        return "R" + digests[node[1], parent[1]]
    return "-"


def paths_of_block(nodes: dict[tuple[int, int], str], level: int, n: int, levels: int,
                   above: list[str]) -> dict[tuple[int, int], list[str]]:
    """Siblings of every node of a block up to the root; ``above`` is the path of the block's own node."""
    climbed = climb_block(nodes, level, n, levels)
    found = dict.fromkeys(climbed[-1], above)
    for down in range(len(climbed) - 2, -1, -1):
        rows = {}
        for node in climbed[down]:
            parent = covering(node[0], level + down + 1, n)
            rows[node] = [sibling(node, parent, climbed[down]), *found[parent]]
        found = rows
    return found


def fold(digest: str, path: list[str]) -> str:
    """The root that a digest and its path lead to."""
    for p in path:
        digest = sha(p[1:] + digest if p[0] == "L" else digest + p[1:] if p[0] == "R" else digest)
    return digest


def proof_hash(path: list[str]) -> str:
    return sha("".join(p[1:] for p in path))


def _nodes(pdf: pd.DataFrame) -> dict[tuple[int, int], str]:
    pdf = pdf.sort_values("lo")
    return dict(zip(zip(pdf["lo"].tolist(), pdf["hi"].tolist()), pdf["digest"]))


def block_of(level: int, levels: int) -> Column:
    """Nodes with the same block are contained in one node of the next bucket."""
    return F.shiftright("lo", level + levels).alias("block")


def climb(nodes: DataFrame, level: int, levels: int) -> DataFrame:
    """The nodes of the next bucket of levels."""
    def run(pdf):
        tree, n = int(pdf["tree"].iloc[0]), int(pdf["n"].iloc[0])
        top = climb_block(_nodes(pdf), level, n, levels)[-1]
        return pd.DataFrame([(tree, n, lo, hi, d) for (lo, hi), d in top.items()],
                            columns=["tree", "n", "lo", "hi", "digest"])

    narrow = nodes.select("tree", "n", "lo", "hi", "digest")
    return cut_lineage(narrow.groupBy("tree", block_of(level, levels)).applyInPandas(run, NODE), f"merkle-{level + levels}")


def attach(nodes: DataFrame, parents: DataFrame, level: int, levels: int) -> DataFrame:
    """Containment join: each node gets its path, by the node of the next bucket over it."""
    def run(pdf, over):
        if not len(pdf):
            return pd.DataFrame(columns=["tree", "n", "lo", "hi", "digest", "path", "subroot", "root"])
        p = over.iloc[0]
        found = paths_of_block(_nodes(pdf), level, int(pdf["n"].iloc[0]), levels, list(p["path"]))
        spans = zip(pdf["lo"].tolist(), pdf["hi"].tolist())
        return pdf[["tree", "n", "lo", "hi", "digest"]].assign(path=[found[s] for s in spans],
                                                               subroot=p["subroot"], root=p["root"])

    left = nodes.select("tree", "n", "lo", "hi", "digest").groupBy("tree", block_of(level, levels))
    right = parents.select("tree", "lo", "path", "subroot", "root").groupBy("tree", block_of(level, levels))
    return cut_lineage(left.cogroup(right).applyInPandas(run, f"{NODE}, {PATH}"), f"merkle-paths-{level}")


def proofs_of_leaves(leaves: DataFrame, parents: DataFrame, levels: int, with_path: bool) -> DataFrame:
    """The containment join of the lowest bucket, with the proofs and the folded roots."""
    schema = "tree long, lo long, doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    schema += ", path array<string>" if with_path else ""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf, over):
        if not len(pdf):
            return pd.DataFrame(columns=names)
        p = over.iloc[0]
        found = paths_of_block(_nodes(pdf), 0, int(pdf["n"].iloc[0]), levels, list(p["path"]))
        out = pdf[["tree", "lo", "doc_id"]].assign(leaf=pdf["digest"], subroot=p["subroot"], root=p["root"])
        path = [found[s] for s in zip(pdf["lo"].tolist(), pdf["hi"].tolist())]
        now = pdf["changed"].where(pdf["changed"].notna(), pdf["digest"])
        out = out.assign(proof_sha256=[proof_hash(x) for x in path], folded_root=[fold(d, x) for d, x in zip(now, path)])
        return (out.assign(path=path) if with_path else out)[names]

    left = leaves.select("tree", "n", "lo", "hi", "digest", F.col("doc_id").cast("string"), "changed").groupBy("tree", block_of(0, levels))
    right = parents.select("tree", "lo", "path", "subroot", "root").groupBy("tree", block_of(0, levels))
    # ids pass as text: pandas has no null integers, and doubles do not hold all of them
    return left.cogroup(right).applyInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def up_to_roots(nodes: DataFrame, most: int, levels: int) -> list[DataFrame]:
    """The buckets of a forest whose largest tree has ``most`` leaves; the last has the roots."""
    out = [nodes]
    while (most - 1).bit_length() > levels * (len(out) - 1):
        out.append(climb(out[-1], levels * (len(out) - 1), levels))
    return out


def forest(docs: DataFrame, tampered: Column | None = None) -> tuple[DataFrame, int, int]:
    """Labelled leaves (``tree`` numbers the languages, ``lang`` names them),
    the size of the largest tree and the number of trees. ``changed`` is the leaf
    of a row whose ``n_chars`` was raised by one where ``tampered`` holds."""
    prepare(docs.sparkSession)
    columns = {c: docs[c] for c in FIELDS}
    raised = leaf_hash(columns | {"n_chars": docs["n_chars"].cast("decimal(20,0)") + 1})
    hit = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    rows = docs.select(docs["lang"].cast("string").alias("lang"), docs["doc_id"].cast("long").alias("doc_id"),
                       leaf_hash(columns).alias("digest"),
                       F.when(hit & docs["n_chars"].isNotNull(), raised).alias("changed"))
    rows = dense_index(rows, ["doc_id", "digest"], ["lang"], name="lo")
    trees = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    trees = dense_index(trees, ["lang"], name="tree").withColumnRenamed("lang", "tree_lang")
    most = trees.agg(F.max("n"), F.count(F.lit(1))).first()
    leaves = (rows.join(trees, F.col("lang").eqNullSafe(F.col("tree_lang")))
              .select("lang", "tree", "n", "lo", (F.col("lo") + 1).alias("hi"), "digest", "doc_id", "changed"))
    return cut_lineage(leaves, "merkle-leaves"), most[0] or 0, most[1]


def nodes_over(leaves: DataFrame, most: int, levels: int = LEVELS) -> DataFrame:
    """The whole manifest: ``tree``, ``level`` (0: leaves), ``lo``, ``hi`` and
    ``digest`` of every node of every language's tree."""
    def run_at(level):
        def run(pdf):
            tree, n = int(pdf["tree"].iloc[0]), int(pdf["n"].iloc[0])
            rows = [(tree, level + k, lo, hi, d) for k, nodes in enumerate(climb_block(_nodes(pdf), level, n, levels)[1:], 1)
                    for (lo, hi), d in nodes.items()]
            return pd.DataFrame(rows, columns=["tree", "level", "lo", "hi", "digest"])
        return run

    out = leaves.select("tree", F.lit(0).cast("long").alias("level"), "lo", "hi", "digest")
    for k, bucket in enumerate(up_to_roots(leaves, most, levels)[:-1]):
        narrow = bucket.select("tree", "n", "lo", "hi", "digest").groupBy("tree", block_of(k * levels, levels))
        out = out.unionByName(narrow.applyInPandas(run_at(k * levels), "tree long, level long, lo long, hi long, digest string"))
    return out


def manifest(docs: DataFrame, tampered: Column | None = None, with_path: bool = False,
             levels: int = LEVELS) -> DataFrame:
    """``tree``, ``lo`` (the rank in it), ``doc_id``, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256``, ``folded_root`` and ``verified`` of every row; with
    ``with_path`` also the proof itself."""
    leaves, most, trees = forest(docs, tampered)
    up = up_to_roots(leaves, most, levels)
    tops = up[-1].select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("lo"),
                         (F.col("tree") + 1).alias("hi"), "digest")
    over = up_to_roots(tops, trees, levels)
    parents = over[-1].withColumns({"path": F.array().cast("array<string>"), "subroot": F.lit(None).cast("string"),
                                    "root": F.col("digest")})
    for k in range(len(over) - 2, -1, -1):
        parents = attach(over[k], parents, k * levels, levels)
    parents = parents.select(F.col("lo").alias("tree"), F.lit(0).cast("long").alias("lo"), "path",
                             F.col("digest").alias("subroot"), "root")
    for k in range(len(up) - 2, 0, -1):
        parents = attach(up[k], parents, k * levels, levels)
    return proofs_of_leaves(leaves, parents, levels, with_path).withColumn("verified", F.col("folded_root") == F.col("root"))
