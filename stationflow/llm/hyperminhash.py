"""Near-duplicates by Jaccard similarity through HyperMinHash sketches.

Every distinct set of shingles gets a sketch of 128 registers. A shingle's hash chooses a
register by its first bits; the register keeps the least of the other bits in compressed form:
the number of leading zeros and the ten bits behind the first one. A register without a
shingle takes the value of the other one it ranks first; the ranks are the same for every set,
so two sets' registers agree about as often as their similarity says.

1. Bands of four registers bring sets together. Each set is compared with one centre of its
   band's bucket. Members that are not like it, the others, are compared with all members
   where they are few; a bucket with many others is split by bands of four further registers,
   again and again. A bucket of copies is so settled by its centre, however large it is.
2. Comparison is by sketch: the share of equal registers, less the share that two unrelated sets
   of those sizes would have by collision, must come within a margin of the wanted similarity.
3. What passes is verified on full sets. Candidates that no verified link connects are compared
   once more on full sets with everything in their cluster, in blocks of bounded size.

Lost are only pairs that share no band or whose sketches are off by more than the margin: about
2 in 100,000 at a similarity of exactly 0.8, fewer above. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.base import each_text
from stationflow.llm.components import connected_components
from stationflow.session import materialise

REGISTERS, MANTISSA, ROWS, BANDS, SPLIT = 128, 10, 4, 24, 4
INDEX_BITS = REGISTERS.bit_length() - 1
MARGIN = 0.15
MAX_BUCKET, MAX_BLOCK = 2048, 1_000_000
_MARK = pa.struct([("n", pa.int64()), ("sid", pa.int64()), ("regs", pa.binary())])


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted different 64-bit hashes of a text's shingles; A-Z count as a-z."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    whole = [b" ".join(parts)] if len(parts) < words else map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, whole), np.uint64))


def _ranks() -> np.ndarray:
    """For each register the others in a fixed, mixed order of preference: the highest is the first."""
    x = np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).reshape(REGISTERS, REGISTERS)


RANKS = _ranks()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits: leading zeros times 1,024 plus mantissa. Zero means no shingle at all."""
    least = np.full(REGISTERS, -1, np.int64)
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    at = (hashes >> np.uint64(64 - INDEX_BITS)).astype(np.int64)
    # The 52 bits behind the index, exact as a float; one is added so that none is zero.
    rest = ((hashes << np.uint64(INDEX_BITS)) >> np.uint64(12)).astype(np.int64) + 1
    order = np.lexsort((-rest, at))
    least[at[order]] = rest[order]  # of several assignments the last, the least value, stays
    full = least >= 0
    fraction, exponent = np.frexp(np.where(full, least, 1).astype(np.float64))
    zeros = 53 - exponent
    values = (((zeros + 1) << MANTISSA) + ((2 * fraction - 1) * (1 << MANTISSA)).astype(np.int64)).astype(np.uint16)
    if not full.all():
        known = np.flatnonzero(full)
        values[~full] = values[known[RANKS[~full][:, known].argmax(axis=1)]]
    return values


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of registers that two unrelated sets of a and b shingles have in common by chance.

    Least values are exponential with the mean number of shingles a register; the cells of one
    number of leading zeros are equally wide.
    """
    x, y = np.maximum(a / REGISTERS, 1.0), np.maximum(b / REGISTERS, 1.0)
    total = np.zeros(np.broadcast(x, y).shape)
    for zeros in range(52):
        high = 0.5 ** zeros
        total += high / 2 / (1 << MANTISSA) * (np.exp(-(x + y) * high / 2) - np.exp(-(x + y) * high))
    return total * x * y / (x + y)


def estimate(same: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for collisions."""
    by_chance = collisions(a, b)
    return (same / REGISTERS - by_chance) / (1 - by_chance)


def _like(same: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Pairs that may be similar: sizes allow it and the estimate is within the margin."""
    small, large = np.minimum(a, b), np.maximum(a, b)
    return (100 * small >= round(100 * least) * large) & (estimate(same, a, b) >= least - MARGIN - 0.5 / small)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def marks(text: Column, words: int) -> Column:
    """Struct (n, sid, regs): size, hash and sketch of a text's set."""

    @F.arrow_udf("n bigint, sid bigint, regs binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n, sid, regs = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
            for i, t in enumerate(each_text(texts)):
                hashes = shingle_hashes(t, words)
                n[i] = len(hashes)
                sid[i] = np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64)
                regs.append(sketch(hashes).tobytes())
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(sid), pa.array(regs, pa.binary())], fields=list(_MARK))

    return of(text)


def _register(i: Column | int) -> Column:
    at = (i if isinstance(i, Column) else F.lit(i)) * 2 + 1
    return F.substr("regs", at.cast("int"), F.lit(2))


def _bands(sets: DataFrame) -> DataFrame:
    """sid, path, key for each band of consecutive registers."""
    each = [F.struct(F.lit(j).cast("bigint").alias("path"), F.xxhash64(
        F.lit(j), F.substr("regs", F.lit(2 * ROWS * j + 1), F.lit(2 * ROWS))).alias("key")) for j in range(BANDS)]
    return sets.select("sid", F.explode(F.array(*each)).alias("b")).select("sid", "b.path", "b.key")


def _split(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of crowded buckets under bands of four further registers each."""
    rows = members.join(sets.select("sid", "regs"), "sid").withColumn("child", F.explode(F.array(*map(F.lit, range(SPLIT)))))
    rows = rows.withColumn("path", F.xxhash64("path", "child"))
    first, step = F.pmod(F.col("path"), F.lit(REGISTERS)), F.pmod(F.shiftright("path", 20), F.lit(REGISTERS // 2)) * 2 + 1
    chosen = [_register(F.pmod(first + k * step, F.lit(REGISTERS))) for k in range(ROWS)]
    return rows.select("sid", "path", F.xxhash64("key", "path", *chosen).alias("key"))


def similar_by_sketch(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b, ok for each of edges (a, b)."""

    @F.arrow_udf("boolean")
    def like(ra: pa.Array, rb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        same = (_registers(ra) == _registers(rb)).sum(axis=1)
        return pa.array(_like(same, na.to_numpy(), nb.to_numpy(), least))

    a = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    b = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    return edges.join(a, "a").join(b, "b").select("a", "b", like("ra", "rb", "na", "nb").alias("ok"))


def _sketch_links(n: np.ndarray, regs: np.ndarray, other: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of positions that look alike, enough to connect what is: the others among themselves
    and with one of the main ones, which their centre connects already."""
    out, main = [], np.flatnonzero(~other)
    left = np.flatnonzero(other)

    def near(at: int, among: np.ndarray) -> np.ndarray:
        return _like((regs[among] == regs[at]).sum(axis=1), n[among], n[at], least)

    while len(left):
        frontier, left, joined = [left[0]], left[1:], False
        while frontier:
            at = frontier.pop()
            if not joined and len(hits := main[near(at, main)]):
                out.append((at, hits[0]))
                joined = True
            like = near(at, left)
            out += [(at, j) for j in left[like]]
            frontier.extend(left[like])
            left = left[~like]
    return out


def _in_buckets(members: DataFrame, sets: DataFrame, least: float, max_bucket: int) -> DataFrame:
    """a, b: what looks alike in buckets with a bounded number of others.

    The main members are dealt into blocks; every block is compared with all the others.
    """

    def of(block: pa.Table) -> pa.Table:
        ids, regs = block["sid"].to_numpy(), _registers(block["regs"].combine_chunks())
        found = _sketch_links(block["n"].to_numpy(), regs, block["other"].to_numpy(), least)
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": ids[at[:, 0]], "b": ids[at[:, 1]]})

    blocks = F.greatest(F.ceil((F.col("size") - F.col("others")) / max_bucket), F.lit(1)).cast("int")
    rows = members.withColumn("at", F.explode(F.when(F.col("other"), F.sequence(F.lit(0), blocks - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("sid"), blocks).cast("int")))))
    rows = rows.select("path", "key", "at", "sid", "other").join(sets.select("sid", "n", "regs"), "sid")
    return rows.groupBy("path", "key", "at").applyInArrow(of, "a bigint, b bigint")


def candidates(sets: DataFrame, least: float, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """a, b: pairs of ``sets`` (sid, n, regs) that may be similar, enough to connect all of them.

    A level: buckets with several members, and the pairs with their centres, by sketch. The main
    members of a bucket are like its centre; the others are compared with all members where
    they are few, and buckets with many of them go to the next level.
    """
    rows, found = _bands(sets), None
    while True:
        sizes = rows.groupBy("path", "key").agg(F.count("*").alias("size"), F.min("sid").alias("centre")).where("size > 1")
        shared = materialise(rows.join(materialise(sizes, "hyper-sizes"), ["path", "key"]), "hyper-buckets")
        stars = shared.where("sid <> centre").select(F.col("centre").alias("a"), F.col("sid").alias("b")).distinct()
        judged = materialise(similar_by_sketch(stars, sets, least), "hyper-stars")
        found = judged.where("ok").select("a", "b") if found is None else found.unionByName(judged.where("ok").select("a", "b"))
        unlike = judged.where("NOT ok").select(F.col("a").alias("centre"), F.col("b").alias("sid"), F.lit(True).alias("other"))
        # With two members the pair with the centre is all there is.
        tagged = shared.where("size > 2").join(unlike, ["centre", "sid"], "left").withColumn("other", F.coalesce("other", F.lit(False)))
        tagged = materialise(tagged, "hyper-tagged")
        unsettled = tagged.where("other").groupBy("path", "key").agg(F.count("*").alias("others"))
        tagged = tagged.join(materialise(unsettled, "hyper-unsettled"), ["path", "key"])
        found = found.unionByName(_in_buckets(tagged.where(F.col("others") <= max_bucket), sets, least, max_bucket))
        crowded = tagged.where(F.col("others") > max_bucket).select("sid", "path", "key")
        if crowded.isEmpty():
            break
        rows = _split(crowded, sets)
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return materialise(pairs, "hyper-candidates")


def _similar(common: int, a: int, b: int, least: float) -> bool:
    return 100 * common >= round(100 * least) * (a + b - common)


def verified(edges: DataFrame, full: DataFrame, least: float) -> DataFrame:
    """The edges whose full sets are similar."""

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            out.append(_similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), least))
        return pa.array(out, pa.bool_())

    a = full.select(F.col("sid").alias("a"), F.col("hashes").alias("ha"))
    b = full.select(F.col("sid").alias("b"), F.col("hashes").alias("hb"))
    return edges.join(a, "a").join(b, "b").where(similar("ha", "hb")).select("a", "b")


def block_links(sid: np.ndarray, part: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between sets of different parts, enough to connect the parts that are linked."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(value, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(value))])
    own, by_value = np.concatenate([[0], np.cumsum(sizes)]), owner[order]
    now, out = part.copy(), []
    names, count = np.unique(part, return_counts=True)
    for i in np.flatnonzero(part != names[count.argmax()]):
        lists = [by_value[start[v]:start[v + 1]] for v in value[own[i]:own[i + 1]]]
        common = np.bincount(np.concatenate(lists), minlength=len(sets))
        linked = (100 * common >= round(100 * least) * (sizes + sizes[i] - common)) & (now != now[i])
        for p in np.unique(now[linked]):
            j = np.flatnonzero(linked & (now == p))[0]
            out.append((int(sid[i]), int(sid[j])))
            now[now == p] = now[i]
    return out


def inside_clusters(pairs: DataFrame, links: DataFrame, full: DataFrame, least: float, max_block: int = MAX_BLOCK) -> DataFrame:
    """a, b: links that candidates' clusters hold besides the verified ones.

    A cluster is what candidates connect, a part is what verified links connect. Members of a
    cluster's largest part are never compared with one another. Both they and the others are
    dealt into blocks of about ``max_block`` shingles, and each pair of blocks, of which one at
    least is of the others, is compared in a task of its own.
    """
    cluster = connected_components(pairs).withColumnRenamed("root", "cluster")
    parts = connected_components(links).withColumnRenamed("root", "part")
    members = cluster.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    members = materialise(members.join(full.select(F.col("sid").alias("node"), "n"), "node"), "hyper-members")
    counted = members.groupBy("cluster", "part").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    largest = counted.groupBy("cluster").agg(
        F.max(F.struct("size", "part", "weight")).alias("top"), F.sum("size").alias("sizes"), F.sum("weight").alias("weights"))
    open_clusters = materialise(largest.where("sizes > top.size").select(
        "cluster", F.col("top.part").alias("main"), F.ceil(F.col("top.weight") / max_block).cast("int").alias("mains"),
        F.ceil((F.col("weights") - F.col("top.weight")) / max_block).cast("int").alias("others"),
        (F.col("weights") <= max_block).alias("one")), "hyper-open")
    rows = members.join(open_clusters, "cluster")
    # Blocks 0 to mains - 1 hold the main part, the following ones the others.
    at = F.when(F.col("one"), 0).when(F.col("part") == F.col("main"), F.pmod(F.xxhash64("node"), "mains")).otherwise(
        F.col("mains") + F.pmod(F.xxhash64("node"), "others"))
    rows = rows.withColumn("at", at.cast("int")).withColumn("of_main", ~F.col("one") & (F.col("at") < F.col("mains")))
    partners = F.when(F.col("one"), F.array(F.lit(0))).otherwise(
        F.sequence(F.when(F.col("of_main"), F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1))
    sent = rows.select("cluster", "node", "part", "at", F.explode(partners).alias("with"))
    sent = sent.select("cluster", "node", "part", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"))

    def of(block: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in block["hashes"]]
        found = np.array(block_links(block["node"].to_numpy(), block["part"].to_numpy(), sets, least), np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    whole = sent.join(full.select(F.col("sid").alias("node"), "hashes"), "node")
    return whole.groupBy("cluster", "i", "j").applyInArrow(of, "a bigint, b bigint")


def full_sets(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """sid, n, hashes: the sets of chosen (sid, n, first, h), from the text with that hash under that id."""

    @F.arrow_udf("binary")
    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shingle_hashes(t, words).tobytes() for t in each_text(texts)], pa.binary())

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = texts.join(chosen.select("sid", "n", "first", F.col("h").alias("of")),
                      F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("of")))
    # Repeated rows give a set again.
    return rows.select("sid", "n", hashes("text").alias("hashes")).dropDuplicates(["sid"])


def near_duplicates(docs: DataFrame, words: int = 4, least: float = 0.8, max_bucket: int = MAX_BUCKET,
                    max_block: int = MAX_BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Documents are linked when their sets of shingles have a Jaccard similarity of ``least`` or
    more; component_id is the smallest doc_id that links reach, kept says that it is the row's own. A text with
    fewer words than a shingle is one shingle. Texts without words (null, empty, blank) are linked with nothing:
    each is kept with its own id. Repeated rows each give a row; with one id they are all
    kept. Null ids are never the smallest: a component of null ids only has component_id null and
    is kept. Equal 64-bit hashes of shingles and sets are treated as identity.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), marks(F.col("text"), words).alias("m"))
    rows = materialise(rows.select("doc_id", "h", "m.*"), "hyper-marks")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    sets = rows.where("n > 0").groupBy("sid").agg(F.min(one).alias("c"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    sets = materialise(sets.select("sid", "n", "regs", F.col("c.doc_id").alias("first"), F.col("c.h").alias("h")), "hyper-sets")
    pairs = candidates(sets.select("sid", "n", "regs"), least, max_bucket)
    used = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    full = materialise(full_sets(docs, sets.join(used, "sid", "left_semi"), words), "hyper-full")
    links = materialise(verified(pairs, full, least), "hyper-links")
    links = links.unionByName(inside_clusters(pairs, links, full, least, max_block))
    roots = connected_components(links).withColumnRenamed("node", "sid")
    linked = materialise(sets.select("sid", "first").join(roots, "sid"), "hyper-linked")
    least_id = materialise(linked.groupBy("root").agg(F.min("first").alias("least_id")), "hyper-least")
    linked = linked.join(least_id, "root").select("sid", "least_id")
    named = sets.select("sid", "first").join(linked, "sid", "left").select(
        F.col("sid").alias("of"), F.coalesce("least_id", "first").alias("least_id"))
    # Both sides are plain shuffles of written tables, so copies of one text, however many, are split.
    named = materialise(named, "hyper-named")
    key = F.when(F.col("n") > 0, F.col("sid"))
    out = rows.join(named, key == F.col("of"), "left")
    component = F.when(F.col("n") > 0, F.col("least_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))
