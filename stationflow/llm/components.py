"""Connected components by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.session import materialise, materialise_counted

HELD = 1 << 20  # links a task looks at together
TASK_ROWS = 50_000  # small rows (ids, links) that are worth a task of their own


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that has a smaller one in its component of the links, and the smallest one there."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while not np.array_equal(further := root[root], root):
            root = further
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def few_tasks(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, ``most`` of them at most, in no more tasks than they are worth: many empty tasks
    take longer than the work. What there is, is only dealt to other tasks."""
    return rows.coalesce(max(8, most // TASK_ROWS))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars, ``HELD`` links at a time."""
    def batch(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held, size = [], 0
    for one in batches:
        held.append((one.column("a").to_numpy(), one.column("b").to_numpy()))
        size += len(one)
        if size >= HELD:
            a, b = stars(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [(a, b)], len(a)
            if size > HELD // 2:
                yield batch(a, b)
                held, size = [], 0
    if held:
        yield batch(*stars(*map(np.concatenate, zip(*held, strict=True))))


def _write(links: DataFrame) -> tuple[DataFrame, int]:
    """The links, contracted in each task and written, and how many they are."""
    table, seen = materialise_counted(links.mapInArrow(_contracted, "a long, b long"), "cc", {"n": F.count("*")})
    return table, seen["n"]


def _tangled(links: DataFrame) -> bool:
    """Whether a node has two smaller neighbours, or a smaller and a larger one."""
    sides = links.select(F.col("a").alias("node"), F.col("b").alias("up")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(None).cast("bigint").alias("up")))
    node = sides.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.count("*").alias("n"), F.count("up").alias("n_up"))
    return not node.where("low <> high OR (n_up > 0 AND n_up < n)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of edges (a, b) of longs.

    Each round moves the larger neighbours of a node to the smallest one and then the smaller
    ones; before it is written, each task contracts the links it holds, so most chains go at
    once. Links never grow in number. The rounds end when the links are stars: a table in the
    shared folder each, so a lost executor costs no more than a part of one round.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, n = _write(materialise(pairs, "cc-links"))
    while _tangled(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))).where("a <> b")
        now, n = _write(few_tasks(small, n))
    ends = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return ends.unionByName(ends.select(F.col("root").alias("node"), "root").distinct())
