"""Mixing sources to target weights by proportionate-fair scheduling.

Time is counted in slots of one block of documents. Block k (from 0) of a source with weight
w is released at floor(k / w) and due at ceil((k + 1) / w); in each slot the released block
with the earliest deadline runs. Then every source has, at any time t, between floor(w t) and
ceil(w t) blocks: less than one block from its share. Weights are fractions of whole numbers,
exactly as given, whatever the number of sources. The blocks of the whole run (not its
documents) are put in order on the driver, and every document finds its slot by equality joins.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm.base import columns, named

Weights = dict[str | None, float]
BROADCAST_BLOCKS = 500_000


def whole_weights(weights: Weights) -> dict[str | None, int]:
    """Whole numbers in exactly the proportions of the positive weights."""
    exact = {n: Fraction(w) for n, w in weights.items() if w > 0}
    scale = math.lcm(*(f.denominator for f in exact.values()))
    whole = {n: int(exact[n] * scale) for n in sorted(exact, key=lambda n: (n is not None, n or ""))}
    common = math.gcd(*whole.values())
    return {n: w // common for n, w in whole.items()}


def schedule(shares: list[int], period: int, blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) of so many blocks of each source: earliest deadline first among
    released blocks. A source has ``shares / period`` of the slots."""
    waiting = [(0, i, 0) for i, n in enumerate(blocks) if n]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // shares[i]), i, k))
        due, i, k = heapq.heappop(ready)
        assert slot < due
        yield i, k, slot
        if k + 1 < blocks[i]:
            heapq.heappush(waiting, ((k + 1) * period // shares[i], i, k + 1))
        slot += 1


def source_key() -> Column:
    """The source as a text that is never null: null is a source like others."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))


def square_root_weights(docs: DataFrame, max_sources: int = 100_000) -> Weights:
    """Weights that grow with the square root of a source's documents: large sources keep less
    than their share, small ones more."""
    rows = docs.groupBy("source").agg(F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources: give weights for groups of them")
    return {r["source"]: r["n"] ** 0.5 for r in rows}


def numbered(docs: DataFrame, buckets: int = 4096) -> DataFrame:
    """Adds ``__s``, the source's key, and ``__n``, a number from 0 within the source in the order
    of a hash of the id.

    A source is ranked in ``buckets`` hash ranges side by side; the ranges' sizes, a small
    table, give where each one starts. No source is sorted as a whole. Ties (equal ids) are
    numbered in the order of all columns.
    """
    rows = docs.withColumns({"__hash": F.xxhash64("doc_id"), "__s": source_key()}).withColumn(
        "__bucket", F.floor(F.shiftrightunsigned("__hash", 1) / F.lit(2.0 ** 63 / buckets)).cast("int"))
    sizes = rows.groupBy("__s", "__bucket").agg(F.count("*").alias("c"))
    before = Window.partitionBy("__s").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__s", "__bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__s", "__bucket").orderBy("__hash", *columns(docs))
    rows = rows.withColumn("__rank", F.row_number().over(within) - 1)
    # The ranked rows lie as the join needs them: only the sizes move.
    joined = rows.join(starts, ["__s", "__bucket"])
    return joined.select(*columns(docs), "__s", (F.col("__start") + F.col("__rank")).alias("__n"))


def mix(docs: DataFrame, weights: Weights, block: int = 64, buckets: int = 4096,
        broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """Every row of ``docs`` with ``slot`` (long) and ``place`` (its order inside the block).

    The weights hold exactly. The table of blocks is broadcast up to ``broadcast_blocks`` rows
    and shuffled beyond.

    Ordered by slot and place, the sources are mixed to the weights until the first source
    has no block left; the others keep to their shares, slots that would have been its own may
    stay free, nothing is dropped or repeated. Rows of sources without a positive weight have
    slot null. A null source is a source like others. Repeated rows are rows of their own. An
    empty table stays empty. Columns of the input that are called slot or place are replaced.
    """
    spark = docs.sparkSession
    shares = whole_weights(weights)
    total = sum(shares.values())

    def key(name: str | None) -> str:
        return "" if name is None else f"s{name}"

    of = spark.createDataFrame([(key(s), i) for i, s in enumerate(shares)], "__s string, __i int")
    sizes = docs.groupBy(source_key().alias("__s")).agg(F.count("*").alias("n")).join(F.broadcast(of), "__s")
    blocks = [0] * len(shares)
    for r in sizes.select("__i", "n").collect():  # a row for each source
        blocks[r["__i"]] = -(-r["n"] // block)
    plan = array("q")
    for run in schedule(list(shares.values()), total, blocks):
        if run[2] >= 1 << 63:
            raise ValueError("a weight is too small: its blocks lie beyond the last slot")
        plan.extend(run)
    runs = np.frombuffer(plan, np.int64).reshape(-1, 3)
    slots = spark.createDataFrame(pa.table({
        "__i": runs[:, 0].astype(np.int32), "__at": runs[:, 1].astype(np.int32), "__slot": np.ascontiguousarray(runs[:, 2])}))
    small = F.broadcast if len(runs) <= broadcast_blocks else (lambda df: df)
    rows = numbered(docs, buckets).join(F.broadcast(of), "__s", "left")
    rows = rows.withColumn("__at", F.floor(F.col("__n") / block).cast("int"))
    out = rows.join(small(slots), ["__i", "__at"], "left")
    taken = [named(c) for c in docs.columns if c.lower() not in ("slot", "place")]
    return out.select(*taken, F.col("__slot").alias("slot"), (F.col("__n") % block).cast("int").alias("place"))
