"""Merkle manifests: partial parents take up indexed child digests and emit themselves when full; open ones meet in wider spans.

The keyed combine of one tree: a child (level, index, digest) goes to the partial parent
(level + 1, index // arity). The size of the tree says how many children a parent has, so its
completion is an event: it then is a child itself. Aligned runs of leaves combine first, each as
a group of its own; the frontier that stays open is shuffled to wider spans and combined there,
and so on. Proofs go the other way: every span tells its nodes what lies beside their path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Leaves of a run, as a power of two, and by how many bits each further span is wider.
RUN_BITS, SPAN_BITS = 12, 8
STEP = "struct<digest:string,left:boolean>"


def field(value: Column) -> Column:
    """A value for hashing: `-` if null, else its length in bytes, `:` and itself; integers as decimals."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(values: Iterable[Column]) -> Column:
    """Lower-case hex sha256 of the values' encodings in a row."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def combine(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class PartialParents:
    """Parents of one tree of `size` leaves that lack children, by (level, index)."""

    def __init__(self, size: int, arity: int):
        self.arity, self.widths = arity, [size]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // arity))
        self.open: dict[tuple[int, int], dict[int, str]] = {}
        self.full: dict[tuple[int, int], dict[int, str]] = {}

    def add(self, level: int, index: int, digest: str) -> None:
        """One child digest; every parent that it completes is an event and goes up at once."""
        while level < len(self.widths) - 1:
            parent = (level + 1, index // self.arity)
            held = self.open.setdefault(parent, {})
            held[index] = digest
            if len(held) < min(self.arity, self.widths[level] - parent[1] * self.arity):
                return
            self.full[parent] = self.open.pop(parent)
            level, index = parent
            digest = combine(held[i] for i in sorted(held))
        self.open[level + 1, 0] = {0: digest}  # the root, for which no parent waits

    def frontier(self) -> list[tuple[int, int, str]]:
        """The children of parents that are still open: no event among these nodes can move them."""
        return sorted((level - 1, index, digest) for (level, _), held in self.open.items() for index, digest in held.items())

    def way(self, level: int, index: int, known: dict[tuple[int, int], list]) -> list[list[dict]]:
        """For each level from a node upwards its siblings (digest, left); `known` has the ways of the frontier, where reverse links end."""
        if (level, index) not in known:
            parent = (level + 1, index // self.arity)
            beside = [{"digest": d, "left": i < index} for i, d in sorted(self.full[parent].items()) if i != index]
            known[level, index] = [beside, *self.way(*parent, known)]
        return known[level, index]


NODE = "tree string, size long, level int, idx long, digest string"
WAY = f"array<array<{STEP}>>"
WAY_TYPE = pa.list_(pa.list_(pa.struct([("digest", pa.string()), ("left", pa.bool_())])))
#: What descends from a tree's root to its leaves.
DOWN = f"way {WAY}, subroot string, root string"


def _grown(rows: pa.Table, arity: int) -> tuple[PartialParents, list[tuple[int, int, str]]]:
    parents, nodes = PartialParents(rows["size"][0].as_py(), arity), list(zip(*(rows[c].to_pylist() for c in ("level", "idx", "digest")), strict=True))
    for node in sorted(nodes):
        parents.add(*node)
    return parents, nodes


def _climb(arity: int):
    """The nodes of one span -> its frontier."""

    def up(rows: pa.Table) -> pa.Table:
        found = _grown(rows, arity)[0].frontier()
        level, idx, digest = zip(*found, strict=True)
        return pa.table({"tree": [rows["tree"][0].as_py()] * len(found), "size": [rows["size"][0].as_py()] * len(found), "level": pa.array(level, pa.int32()), "idx": idx, "digest": digest})

    return up


def _descend(arity: int, keep: list[str]):
    """The nodes of one span and the ways of its frontier -> the ways of the nodes."""

    def down(rows: pa.Table, above: pa.Table) -> pa.Table:
        parents, nodes = _grown(rows, arity)
        known = {(level, index): way for level, index, way in zip(*(above[c].to_pylist() for c in ("level", "idx", "way")), strict=True)}
        ways = pa.array([parents.way(level, index, known) for level, index, _ in nodes], WAY_TYPE)
        tops = {c: pa.array([above[c][0].as_py()] * len(nodes), pa.string()) for c in ("subroot", "root")}
        return pa.table({**{c: rows[c] for c in keep}, "way": ways, **tops})

    return down


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves, which has a column `tree`, with `idx` (from 0 within the tree, by `order`) and `size` (leaves of the tree).

    Range partitions are sorted and numbered each in its own task, then moved by the leaves before
    them, so a tree that holds most rows is not sorted in one task. Rows equal in `order` are
    told apart by their place in the written table, so that ties spread as well. Nulls come first.
    """
    leaves = materialize(leaves.withColumn("tie", F.monotonically_increasing_id()))
    keys = ["tree", *order, "tie"]
    kinds = dict(leaves.dtypes)

    def count(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, upto = TaskContext.get().partitionId(), None, 0
        for batch in part:
            trees = batch.column("tree").to_pylist()
            local = []
            for tree in trees:
                upto = upto + 1 if tree == last else 0
                last = tree
                local.append(upto)
            columns = [*batch.columns, pa.array([number] * len(trees), pa.int32()), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "local"])

    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", part int, local long"
    ranged = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(ranged.mapInArrow(count, schema))
    # one row for each partition and tree in it: their number follows the partitions, not the leaves
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("n"))
    before = counts.select("tree", "part", F.expr("sum(n) OVER (PARTITION BY tree ORDER BY part) - n").alias("before"), F.expr("sum(n) OVER (PARTITION BY tree)").alias("size"))
    return placed.join(before, ["tree", "part"]).withColumn("idx", F.col("before") + F.col("local")).drop("part", "local", "before", "tie")


def _spans(nodes: DataFrame, height: int, arity: int):
    """nodes grouped by the span of arity ** height leaves in which they lie; nodes of such a height at most lie in one."""
    first = F.col("idx") * F.pow(F.lit(arity), "level").cast("long")
    return nodes.withColumn("span", F.floor(first / F.lit(arity**height))).groupBy("tree", "span")


def forest(leaves: DataFrame, order: list[str], arity: int = 2, above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """leaves (tree, digest and more) with idx, size, way, subroot and root: the nodes beside each leaf's path to the root.

    `above` may place the trees' roots, one row each, in a tree of their own; it returns their ways
    and the root of all. A span's work is bounded by its leaves or open nodes whatever the tree's
    size, and leaves one open node; the rounds are as many as the logarithm of the size.
    """
    leaves = materialize(numbered(leaves, order))
    most = leaves.agg(F.max("size")).first()[0] or 1
    bits = (arity - 1).bit_length()
    height, wider = max(1, RUN_BITS // bits), max(1, SPAN_BITS // bits)
    nodes = leaves.select("tree", "size", F.lit(0).alias("level"), "idx", "digest")
    rounds: list[tuple[int, DataFrame]] = []
    while not rounds or arity ** rounds[-1][0] < most:
        rounds.append((height, nodes))
        nodes = materialize(_spans(nodes, height, arity).applyInArrow(_climb(arity), NODE))
        height += wider
    own = nodes.select("tree", "level", "idx", F.array().cast(WAY).alias("way"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    if above is not None:
        placed = above(nodes.select("tree", "digest"))
        own = own.drop("way", "root").join(placed, "tree").select("tree", "level", "idx", "way", "subroot", "root")
    keep = ["tree", "level", "idx"]
    for height, rows in reversed(rounds[1:]):
        own = _spans(rows, height, arity).cogroup(_spans(own, height, arity)).applyInArrow(_descend(arity, keep), f"tree string, level int, idx long, {DOWN}")
    schema = ", ".join(f"`{c}` {t}" for c, t in leaves.dtypes)
    first = _spans(leaves.withColumn("level", F.lit(0)), rounds[0][0], arity)
    return first.cogroup(_spans(own, rounds[0][0], arity)).applyInArrow(_descend(arity, leaves.columns), f"{schema}, {DOWN}")


def merkle_manifest(leaves: DataFrame, group_col: str | None, order: list[str], digest_col: str, arity: int = 2) -> DataFrame:
    """leaves with idx, size, subroot, root and way: a tree for each value of group_col, and one over their roots.

    Leaves stand in `order`, nulls first; equal ones in any order, so name the digest last and
    they are the same leaf. Trees stand by the group's UTF-8 bytes, null first. A lone leaf is the
    root of its tree, a lone tree's root the root of all; no leaves give no row. way has an array
    of steps (digest, left) for each level from the leaf to the root of all, empty where a run
    holds one node. leaves must not have columns named tree, digest, idx, size, way, level, span,
    part, local, before, tie, subroot or root.
    """
    name = F.lit("=") if group_col is None else F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))

    def over_roots(roots: DataFrame) -> DataFrame:
        tops = roots.select(F.col("tree").alias("name"), F.lit("roots").alias("tree"), "digest")
        return forest(tops, ["name"], arity).select(F.col("name").alias("tree"), "way", "root")

    return forest(leaves.select("*", name.alias("tree"), F.col(digest_col).alias("digest")), order, arity, over_roots).drop("tree", "digest")


def proof_digest(way: Column) -> Column:
    """sha256 of all sibling digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(F.flatten(way), lambda s: s["digest"]), ""), 256)


def folded(leaf: Column, way: Column) -> Column:
    """The root that follows from a leaf and its way: each level hashes what is left of the node, the node, and what is right."""
    joined = lambda steps, left: F.array_join(F.transform(F.filter(steps, lambda s: s["left"] == F.lit(left)), lambda s: s["digest"]), "")
    return F.aggregate(way, leaf, lambda digest, steps: F.sha2(F.concat(joined(steps, True), digest, joined(steps, False)), 256))
