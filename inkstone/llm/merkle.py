"""Merkle manifest of a dataset: a leaf for each row, a tree for each language, and a tree over their roots.

Checkpoint and recompute: of each tree only every STEP-th level is written. What lies between two written levels falls
into aligned subtrees of at most 2 ** STEP nodes, each a group of its own, so no task ever holds a tree. A proof is made
from the top down: each aligned subtree gets the path above its top node, makes its missing nodes again from those
written below, gives each of its lower nodes the siblings on its way up, and forgets the nodes it made.

Places of leaves come from one range partitioning: a leaf's place in its partition, and the sizes of the partitions before.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, keep

#: Levels from one written level to the next.
STEP = 10
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<before: string, after: string>>"
_PATH_TYPE = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def coded(value: Column) -> Column:
    """A field as a leaf has it: '-' for null, or else its length in bytes, ':' and its value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**other: Column) -> Column:
    """The digest of a row; other replaces fields."""
    return F.sha2(F.concat(*(coded(other.get(c, F.col(c))) for c in FIELDS)), 256)


def _node(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def height(n: int, step: int) -> int:
    """Levels above n nodes until one remains, step at most."""
    return min(step, (n - 1).bit_length())


def levels_above(digests: list[str], height: int) -> list[list[str]]:
    """The given nodes and those of each of the height levels above them."""
    out = [digests]
    for _ in range(height):
        below = out[-1]
        out.append([_node(below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def path_of(levels: list[list[str]], i: int) -> list[dict[str, str]]:
    """For each level below the top the sibling of the i-th node's ancestor, on its side; a node alone in its run has none."""
    out = []
    for nodes in levels[:-1]:
        out.append({"before": nodes[i - 1] if i & 1 else "", "after": nodes[i + 1] if not i & 1 and i + 1 < len(nodes) else ""})
        i >>= 1
    return out


def _tops(step: int) -> Callable[[pa.Table], pa.Table]:
    """The top node of an aligned subtree."""

    def run(group: pa.Table) -> pa.Table:
        order = group.sort_by("pos")
        n, block = order.column("n")[0].as_py(), order.column("pos")[0].as_py() >> step
        top = levels_above(order.column("digest").to_pylist(), height(n, step))[-1]
        return pa.table({"tree": order.column("tree").slice(0, 1), "pos": pa.array([block], pa.int64()), "n": pa.array([-(-n >> step) if n > 1 else 1], pa.int64()), "digest": pa.array(top, pa.string())})

    return run


def _paths(names: list[str], step: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Each node of an aligned subtree, with its columns of these names, and its path to the root."""

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        order = nodes.sort_by("pos")
        levels = levels_above(order.column("digest").to_pylist(), height(order.column("n")[0].as_py(), step))
        rest, subroot = above.column("path")[0].as_py(), above.column("subroot")[0].as_py()
        paths = [path_of(levels, i) + rest for i in range(len(order))]
        columns = {c: order.column(c) for c in names} | {"subroot": pa.array([subroot] * len(order), pa.string()), "path": pa.array(paths, _PATH_TYPE)}
        return pa.table(columns)

    return run


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """rows with pos, their place from 0 in their tree (column tree) by these columns, and n, how many the tree has."""
    tied = rows.withColumn("tie", F.monotonically_increasing_id())  # equal rows needn't meet in one partition
    ranged = tied.repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie")
    placed = keep(ranged.select(*rows.columns, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")), label)
    sizes = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("tree", "part", (before - F.col("first")).alias("start"), F.sum("rows").over(tree).alias("n"))
    out = keep(placed.join(starts, ["tree", "part"]).select(*rows.columns, (F.col("place") + F.col("start")).alias("pos"), "n"), label)
    drop(placed)
    return out


def _raised(lowest: DataFrame) -> list[DataFrame]:
    """The written levels of the trees: that given (tree, pos, n, digest) and every STEP-th above it, until each tree has one node."""
    out = [lowest]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        block = F.shiftright("pos", STEP).alias("block")
        out.append(keep(out[-1].select("tree", "pos", "n", "digest").groupBy("tree", block).applyInArrow(_tops(STEP), "tree string, pos long, n long, digest string"), "merkle-level"))
    return out


def _lowered(levels: list[DataFrame], tops: DataFrame, names: str) -> DataFrame:
    """Columns of the lowest level (names: 'name type, ...'), subroot and path of its nodes; tops: tree, subroot, path of each tree's only node."""
    above = tops.select("tree", F.lit(0).cast("long").alias("block"), "subroot", "path")
    for low in reversed(levels[:-1]):
        own = "tree string, pos long" if low is not levels[0] else names
        blocks = low.groupBy("tree", F.shiftright("pos", STEP).alias("block"))
        above = blocks.cogroup(above.groupBy("tree", "block")).applyInArrow(_paths([x.split()[0] for x in own.split(", ")], STEP), f"{own}, subroot string, path {_PATH}")
        if low is not levels[0]:
            above = keep(above.withColumnRenamed("pos", "block"), "merkle-paths")
    if len(levels) == 1:
        return levels[0].join(tops, "tree").select(*(x.split()[0] for x in names.split(", ")), "subroot", "path")
    return above


@dataclasses.dataclass
class Manifest:
    """levels: the written levels of the trees by language, the first being the leaves; subroots: those of the tree over their roots; root: null without rows."""

    levels: list[DataFrame]
    subroots: list[DataFrame]
    root: str | None

    def proofs(self, carried: str = "doc_id long") -> DataFrame:
        """Of each leaf the carried columns ('name type, ...'), leaf, subroot, root and path: the siblings before and after it, from its level to the root's."""
        none = F.array().cast(_PATH)
        top = self.subroots[-1].select("tree", F.lit(None).cast("string").alias("subroot"), none.alias("path"))
        of = _lowered(self.subroots, top, "lang_tree string, digest string").select(F.col("lang_tree").alias("tree"), F.col("digest").alias("subroot"), "path")
        out = _lowered(self.levels, keep(of, "merkle-subroots"), f"{carried}, digest string")
        return out.withColumn("root", F.lit(self.root).cast("string")).withColumnRenamed("digest", "leaf")

    def drop(self) -> None:
        """Remove what is written; no proof may be read afterwards."""
        for level in [*self.levels, *self.subroots]:
            drop(level)


def manifest(docs: DataFrame, **carried: Column) -> Manifest:
    """The manifest of docs (doc_id, source, lang, n_chars, text), with further columns beside the leaves.

    Nulls are part of a leaf; a null doc_id comes first, and a null language has a tree of its own, the first. Rows with one
    doc_id come by their leaves, so repeated rows are equal neighbours; texts of any length are hashed on the JVM and go no
    further. No rows have no root. Other columns of docs are ignored.
    """
    leaves = docs.select("lang", "doc_id", coded(F.col("lang")).alias("tree"), leaf().alias("digest"), *(c.alias(name) for name, c in carried.items()))
    levels = _raised(numbered(leaves, ["doc_id", "digest"], "merkle-leaves"))
    language = levels[0].filter("pos = 0").select("tree", "lang")
    tops = levels[-1].select("tree", "digest").join(language, "tree").select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "lang", "digest")
    subroots = _raised(numbered(tops, ["lang"], "merkle-tops"))
    top = subroots[-1].select("digest").first()
    return Manifest(levels, subroots, top and top[0])


def folded(path: Column, digest: Column) -> Column:
    """The root that a leaf's digest and the siblings on its path give."""
    return F.aggregate(path, digest, lambda below, x: F.sha2(F.concat(x["before"], below, x["after"]), 256))


def tampered_with() -> Column:
    """Rows that the audit tampers with: 7 divides the crc32 of the decimal doc_id; none without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs.

    Proofs are those of docs as they are; for each row tampered_with() the root is folded from a leaf whose n_chars is
    greater by one (a null stays null, so such a row is verified). Nulls, repeated rows and ties, long texts, no rows and
    other columns: as manifest() says.
    """
    changed = F.when(tampered_with(), leaf(n_chars=F.col("n_chars").cast("long") + 1))
    proofs = manifest(docs, tampered=changed).proofs("doc_id long, tampered string")
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "")
    out = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("path"), F.coalesce("tampered", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

