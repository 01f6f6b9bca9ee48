"""Merkle manifest of a dataset with an incremental witness for every row.

Rows are the leaves of one tree a source; the sources' roots are the leaves of a last tree. A
tree joins runs of three neighbours level by level until one node is left.

The work is done in aligned blocks of ``3 ** height`` neighbours. Inside a block the nodes are
appended in order, as a stream: a node waits in the open subtree of its height, and whenever a
run of three is complete, each of its three subtrees adds the other two digests to the partial
witnesses of the rows below it. The blocks' roots are then appended to blocks of their own, and
so on up to the source's root, and the sources' roots likewise. On the way down every block
gets the witness of its own root and adds it to those of its members. A block has at most 6,561
members whatever the size of a source, so the longest task is bounded and a source with a third
of all rows is as many blocks as it needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm.base import sha256_text
from stationflow.session import materialise

RUN, HEIGHT = 3, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
Step = tuple[str, str]  # siblings to the left and to the right, digests one after another
WITNESS = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Appender:
    """A tree that takes one node after another and keeps the witnesses of what it holds."""

    def __init__(self, witnesses: bool = True):
        self.open: list[list[tuple[str, range]]] = [[]]  # by height: subtrees of an unfinished run
        self.steps: list[list[Step]] | None = [] if witnesses else None
        self.size = 0

    def append(self, node: str) -> None:
        """Adds a node; runs that it completes close, from the lowest up."""
        if self.steps is not None:
            self.steps.append([])
        self.open[0].append((node, range(self.size, self.size + 1)))
        self.size += 1
        height = 0
        while len(self.open[height]) == RUN:
            self._close(height)
            height += 1

    def _close(self, height: int) -> None:
        run, self.open[height] = self.open[height], []
        digests = [d for d, _ in run]
        if self.steps is not None:
            for i, (_, rows) in enumerate(run):
                step = "".join(digests[:i]), "".join(digests[i + 1:])
                for row in rows:
                    self.steps[row].append(step)
        if height + 1 == len(self.open):
            self.open.append([])
        self.open[height + 1].append((digest("".join(digests)), range(run[0][1].start, run[-1][1].stop)))

    def finish(self, height: int | None) -> str:
        """The root: of a tree of the given height, or of the lowest that holds all nodes."""
        at = 0
        while at != height and (height is not None or len(self.open[at]) != 1 or any(self.open[at + 1:])):
            if self.open[at]:
                self._close(at)
            at += 1
        return self.open[at][0][0]


def grown(nodes: Iterable[str], height: int | None, witnesses: bool = True) -> tuple[str, list[list[Step]] | None]:
    """Root and witnesses of a block."""
    tree = Appender(witnesses)
    for node in nodes:
        tree.append(node)
    return tree.finish(height), tree.steps


def _close_at(n: int, height: int) -> int | None:
    """Blocks of a larger tree are all of one height; a tree in one block ends when one node is left."""
    return height if n > RUN ** height else None


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """Adds ``__rank`` (from 0, within ``__tree``, in the given order) and ``__n``, the tree's size.

    Nodes are dealt out by ranges of tree and order, with the position in the input behind them,
    so that equal nodes split too. Numbers within a range and the sizes of the ranges give the
    rank; no tree is sorted as a whole.
    """
    keys = ["__tree", *order, "__tie"]
    dealt = nodes.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
    dealt = materialise(dealt.withColumn("__part", F.spark_partition_id()), "merkle-nodes")
    sizes = dealt.groupBy("__tree", "__part").agg(F.count("*").alias("__c"))
    tree = Window.partitionBy("__tree")
    sizes = sizes.select("__tree", "__part", (F.sum("__c").over(tree.orderBy("__part")) - F.col("__c")).alias("__start"),
                         F.sum("__c").over(tree).alias("__n"))
    within = Window.partitionBy("__tree", "__part").orderBy(*order, "__tie")
    placed = dealt.withColumn("__at", F.row_number().over(within) - 1).join(sizes, ["__tree", "__part"])
    return placed.withColumn("__rank", F.col("__start") + F.col("__at")).drop("__tie", "__part", "__at", "__start")


def _blocked(level: DataFrame, height: int) -> DataFrame:
    return level.withColumn("__block", F.floor(F.col("__rank") / RUN ** height).cast("bigint"))


def _roots(level: DataFrame, height: int) -> DataFrame:
    """One node for each block of a level, with its rank and the size of the next level."""

    def of(block: pa.Table) -> pa.Table:
        n = block["__n"][0].as_py()
        root, _ = grown(block.sort_by("__rank")["__digest"].to_pylist(), _close_at(n, height), False)
        return pa.table({
            "__tree": block["__tree"].slice(0, 1), "__rank": block["__block"].slice(0, 1),
            "__n": pa.array([-(-n // RUN ** height)], pa.int64()), "__digest": pa.array([root])})

    used = _blocked(level.select("__tree", "__rank", "__n", "__digest"), height)
    return used.groupBy("__tree", "__block").applyInArrow(of, "__tree string, __rank bigint, __n bigint, __digest string")


def climb(level: DataFrame, height: int) -> list[DataFrame]:
    """The levels of all trees: the given one, the roots of its blocks, and so on; in the last
    every tree is one node, its root."""
    levels = [level]
    while (levels[-1].agg(F.max("__n")).first()[0] or 0) > 1:  # one number
        levels.append(materialise(_roots(levels[-1], height), "merkle-roots"))
    return levels


def _members(level: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """The rows of a level with ``__witness`` (within the block, then that of the block's root) and
    what else ``above`` says of their block."""
    told = [f for f in above.schema if f.name not in ("__tree", "__rank", "__witness")]

    def of(mine: pa.Table, top: pa.Table) -> pa.Table:
        mine = mine.sort_by("__rank")
        _, steps = grown(mine["__digest"].to_pylist(), _close_at(mine["__n"][0].as_py(), height))
        rest = [(s["left"], s["right"]) for s in top["__witness"][0].as_py()]
        rows = [s + rest for s in steps]
        flat = pa.StructArray.from_arrays([pa.array([s[i] for r in rows for s in r], pa.string()) for i in (0, 1)], ["left", "right"])
        out = mine.drop_columns(["__block"])
        for f in told:
            out = out.append_column(f.name, pa.repeat(top[f.name][0], len(rows)))
        offsets = pa.array(accumulate(map(len, rows), initial=0), pa.int32())
        return out.append_column("__witness", pa.ListArray.from_arrays(offsets, flat))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*level.schema, *told])
    above = above.withColumnRenamed("__rank", "__block")
    return _blocked(level, height).groupBy("__tree", "__block").cogroup(
        above.groupBy("__tree", "__block")).applyInArrow(of, f"{kind}, __witness {WITNESS}")


def descend(levels: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """The first level with every node's witness; ``above`` has that of each tree's root."""
    if len(levels) == 1:
        return levels[0].join(above.drop("__rank"), "__tree")
    for level in reversed(levels[:-1]):
        above = _members(level, above, height)
        if level is not levels[0]:
            above = materialise(above.drop("__n", "__digest"), "merkle-witnesses")
    return above


def field(value: Column) -> Column:
    """``-`` for null, else length in bytes, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """Digest of a row's fields, with another text in place of its own if one is given."""
    parts = [field(F.col(f)) for f in FIELDS[:-1]] + [field(F.col("text") if text is None else text)]
    return sha256_text(F.concat(*parts))


def manifest(docs: DataFrame, carried: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """doc_id, source, leaf, witness, subroot, root for each row of ``docs``.

    The witness lists the siblings to the left and right of the path from the leaf by the
    source's root to the dataset's, lowest first; ``folded`` goes up it. ``carried`` names
    further columns, worked out from ``docs``. A source's leaves are in the order of doc_id
    (null first; rows of one id by leaf), the sources in that of their bytes (null first, a
    source of its own). Every field may be null or empty. Repeated rows are leaves of their
    own. A single row is its source's root, a single source's root that of the dataset; an
    empty table has no rows and no root. Blocks have ``3 ** height`` members.
    """
    carried = carried or {}
    names = [f"__c{i}" for i in range(len(carried))]
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("__tree"), F.col("doc_id").alias("__id"),
        leaf().alias("__digest"), *[c.alias(n) for n, c in zip(names, carried.values(), strict=True)])
    sources = climb(ranked(rows, "__id", "__digest"), height)
    roots = sources[-1].select(F.lit("").alias("__tree"), F.col("__tree").alias("__key"), "__digest")
    last = climb(ranked(roots, "__key"), height)
    of_all = last[-1].select("__tree", "__rank", F.col("__digest").alias("__root"), F.array().cast(WITNESS).alias("__witness"))
    tops = descend(last, of_all, height).select(
        F.col("__key").alias("__tree"), F.lit(0).cast("bigint").alias("__rank"), F.col("__digest").alias("__subroot"),
        "__root", "__witness")
    out = descend(sources, materialise(tops, "merkle-tops"), height)
    return out.select(
        F.col("__id").alias("doc_id"), F.when(F.col("__tree") != "", F.substr("__tree", F.lit(2))).alias("source"),
        F.col("__digest").alias("leaf"), F.col("__witness").alias("witness"), F.col("__subroot").alias("subroot"),
        F.col("__root").alias("root"), *[F.col(n).alias(name) for n, name in zip(names, carried, strict=True)])


def folded(leaf_digest: Column, witness: Column) -> Column:
    """The root that a leaf and a witness lead to."""
    return F.aggregate(witness, leaf_digest, lambda at, s: sha256_text(F.concat(s["left"], at, s["right"])))


def proof_digest(witness: Column) -> Column:
    """Digest of the witness's siblings, level by level, left to right."""
    return sha256_text(F.array_join(F.transform(witness, lambda s: F.concat(s["left"], s["right"])), ""))
