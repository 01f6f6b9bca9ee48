"""SimHash near-duplicates through covering locality-sensitive hashing.

A text's shingles vote on 64 bits. Each bit position gets a non-zero vector of ``radius + 1``
bits; every non-zero vector v makes one table, which keeps the positions whose vector has an
odd product with v. The vectors of ``radius`` differing positions never span the whole space,
so some v is orthogonal to all of them: two fingerprints within the radius agree on every kept
position of that table. No pair is missed, whatever the data.

Equal fingerprints are folded into one before anything is compared. Buckets with too many
different fingerprints are covered again on the positions not yet kept; each level keeps about
half of what is left, so the recursion ends with at most ``2 ** radius`` members. Within a
bucket only a spanning forest of links goes on, never all pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm.base import columns, each_text
from stationflow.llm.components import connected_components, few_tasks
from stationflow.session import materialise, materialise_counted

BITS = 64


def text_fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint; 0 for a text without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8")
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        block = hashes[i:i + 4096].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(words: int = 3):
    """Function of a text column: the fingerprint's bits as a signed long."""

    @F.arrow_udf("bigint")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = np.fromiter((text_fingerprint(t, words) for t in each_text(texts)), np.uint64, len(texts))
            yield pa.array(found.view(np.int64))

    return fp


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp for each row."""
    return docs.select("doc_id", fingerprint_column(words)("text").alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def covering_masks(kept: int, radius: int) -> list[int]:
    """Masks that keep the positions of ``kept`` and cover the remaining ones for ``radius``."""
    free = [i for i in range(BITS) if not kept >> i & 1]
    # The base of the space comes first: every v keeps one of the first radius + 1 positions.
    vectors = sorted(range(1, 1 << (radius + 1)), key=lambda x: (x.bit_count(), x))
    masks = set()
    for v in vectors:
        masks.add(kept | sum(1 << p for i, p in enumerate(free) if (v & vectors[i % len(vectors)]).bit_count() & 1))
    return sorted(masks)


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints."""
    bits = fps.view(np.uint64)  # the bit count of a signed number is that of its absolute value
    left = np.arange(len(fps))
    out = []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]) <= radius
            for j in left[near]:
                out.append((int(fps[at]), int(fps[j])))
                frontier.append(j)
            left = left[~near]
    return out


def links(distinct: DataFrame, radius: int = 3, max_bucket: int = 1024) -> DataFrame:
    """a, b: links that connect what is within ``radius``, some of them repeated; ``distinct`` holds
    each fp once."""
    max_bucket = max(max_bucket, 1 << radius)
    spark = distinct.sparkSession

    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def forest(buckets: pa.Array) -> pa.Array:
        found = [spanning_links(b.values.to_numpy(), radius) for b in buckets]
        return pa.array([[{"a": a, "b": b} for a, b in one] for one in found], kind)

    level = [(0, m) for m in covering_masks(0, radius)]
    rows, n = distinct.select("fp", F.lit(0).cast("bigint").alias("mask")), distinct.count()
    found = None
    while True:
        n *= max(Counter(p for p, _ in level).values())  # rows at most
        children = F.create_map(*[x for parent in dict.fromkeys(p for p, _ in level) for x in (
            F.lit(_signed(parent)).cast("bigint"),
            F.array(*[F.lit(_signed(c)).cast("bigint") for p, c in level if p == parent]))])
        rows = rows.select("fp", F.explode(children[F.col("mask")]).alias("mask"))
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        counts = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared, seen = materialise_counted(few_tasks(rows.join(counts, ["mask", "key"]), n), "simhash-buckets", {
            "small": F.count_if(F.col("n") <= max_bucket), "large": F.count_if(F.col("n") > max_bucket)})
        small = shared.where(F.col("n") <= max_bucket).groupBy("mask", "key").agg(F.collect_list("fp").alias("m"))
        part = few_tasks(small, seen["small"]).select(F.explode(forest("m")).alias("l")).select("l.a", "l.b")
        found = part if found is None else found.unionByName(part)
        rows, n = shared.where(F.col("n") > max_bucket), seen["large"]
        parents = [r["mask"] % (1 << BITS) for r in rows.select("mask").distinct().collect()]  # masks, not data
        if not parents:
            return found
        level = [(p, c) for p in parents for c in covering_masks(p, radius)]
        rows = rows.select("fp", "mask")


def classes(fps: DataFrame, radius: int = 3, max_bucket: int = 1024) -> DataFrame:
    """fp, root, component_id for each different fingerprint of fps (doc_id, fp)."""
    distinct = few_tasks(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), fps.count())
    distinct = materialise(distinct, "simhash-distinct")
    roots = connected_components(links(distinct.select("fp"), radius, max_bucket))
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    of = of.withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return of.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, max_bucket: int = 1024) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs``.

    component_id is the smallest doc_id that links of at most ``radius`` bits reach. Texts
    without words (null, empty, blank) share fingerprint zero and are linked like any other.
    Repeated rows each give a row. Null ids are never the smallest: a component of null ids
    only has component_id null.
    """
    fps = materialise(fingerprints(docs, words), "simhash-fps")
    return fps.join(classes(fps, radius, max_bucket), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id.

    A null id is chosen only where no other is; among rows that share the smallest id, the
    smallest fingerprint decides, and of repeated rows any one (they are equal) stays.
    """
    marked = docs.select("doc_id", F.xxhash64("text").alias("h"), fingerprint_column(words)("text").alias("fp"))
    fps = materialise(marked, "simhash-fps")
    chosen = fps.join(classes(fps.select("doc_id", "fp"), radius), "fp").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "h")).alias("c"))
    chosen = chosen.select(F.col("c.doc_id").alias("__id"), F.col("c.h").alias("__of"))
    # The texts themselves are found again by their hash under the id, without Python.
    rows = docs.withColumn("__h", F.xxhash64("text"))
    rows = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["__id"]) & (rows["__h"] == chosen["__of"]))
    first = Window.partitionBy("__id", "__of").orderBy("text")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*columns(docs))
