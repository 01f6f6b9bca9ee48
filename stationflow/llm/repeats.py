"""Repeated byte strings across documents, by column-wise suffix sorting.

A string of ``width`` bytes that starts at several places is found like this:

1. Every window of ``width`` bytes belongs to its minimizer, the ``kmer`` with the least hash (its
   first 40 bits, the leftmost of equal ones) in it. Neighbouring windows with the same minimizer
   occurrence form a stretch. Equal windows have equal minimizers, so only stretches whose
   minimizer occurs twice in the corpus matter.
2. Stretches of equal content are folded into their first occurrence before anything meets;
   every later one is a repeat as a whole. Within one stretch no window repeats, since the
   minimizer would have to sit at two places.
3. Different contents under one minimizer meet in a task, in blocks. For a block the suffix array
   of all its strings is built column by column, from the right end: each round inserts one
   symbol of every string into the collection's Burrows-Wheeler transform and updates the
   common-prefix lengths. Both are files of the task that a round reads from start to end and
   writes anew. Neighbouring suffixes with a common prefix of ``width`` are equal windows.

Minimizers with very many different contents are split into their single windows, which are
folded like contents; no group has to fit one task.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.session import materialise

WIDTH, KMER = 100, 24
CHUNK = 1 << 20  # bytes that are hashed together
ROW_BITS = 24  # of a 32-bit number, beside a symbol
PLACE_BITS = 24  # of a hash's 64; pieces hashed together have 2 * CHUNK + WIDTH bytes at most
_RANDOM = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64)
NO_ID = -(1 << 63)  # stands for a null doc_id inside


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


# --- stretches ---------------------------------------------------------------------------

def _kmer_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the KMER = 16 + 8 bytes from each position on."""
    factor = np.uint64(0x9E3779B97F4A7C15)
    h, have = _RANDOM[data], 1
    eight = None
    while have < 16:
        h = h[:-have] * (factor + np.uint64(2 * have)) + h[have:]
        have *= 2
        if have == 8:
            eight = h
    n = len(data) - KMER + 1
    h = h[:n] * (factor ^ np.uint64(0xABCDE0)) + eight[16:16 + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _first_least(h: np.ndarray, window: int) -> np.ndarray:
    """Leftmost position of the least value, but for its last PLACE_BITS bits, in each window."""
    if len(h) > 1 << PLACE_BITS:
        raise ValueError("too many values for their places")
    place = np.uint64((1 << PLACE_BITS) - 1)
    # Value in front, place behind, in one number: of equal values the leftmost is the least.
    low, have = h & ~place | np.arange(len(h), dtype=np.uint64), 1
    while have * 2 <= window:
        low = np.minimum(low[have:], low[:-have])
        have *= 2
    if window > have:
        low = np.minimum(low[window - have:], low[:have - window])
    return (low & place).astype(np.int32)


def stretches(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """piece, start in it, number of windows and minimizer of each stretch."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    windows = np.maximum(sizes - WIDTH + 1, 0)
    if not windows.sum():
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.int64),)
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = _kmer_hashes(np.frombuffer(b"".join(pieces), np.uint8))
    at = _first_least(h, WIDTH - KMER + 1)
    piece = np.repeat(np.arange(len(pieces)), windows)
    begin = np.arange(len(piece)) + np.repeat(offsets - (np.cumsum(windows) - windows), windows)
    place = at[begin]
    new = np.ones(len(piece), bool)
    new[1:] = (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(piece)))
    return piece[heads], begin[heads] - offsets[piece[heads]], count, h[place[heads]].view(np.int64)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Row, offset and bytes of pieces of CHUNK bytes at most; pieces of one text overlap by a
    window less one byte, so each window lies in exactly one."""
    rows, offsets, pieces, size = [], [], [], 0
    for i, text in enumerate(batch.column("text")):
        data = _bytes(text.as_py())
        for offset in range(0, max(1, len(data) - WIDTH + 1), CHUNK):
            piece = data[offset:offset + CHUNK + WIDTH - 1]
            if len(piece) < WIDTH:
                continue
            rows.append(i), offsets.append(offset), pieces.append(piece)
            size += len(piece)
            if size >= CHUNK:
                yield rows, offsets, pieces
                rows, offsets, pieces, size = [], [], [], 0
    if pieces:
        yield rows, offsets, pieces


def _minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, pieces in _chunks(batch):
            yield pa.RecordBatch.from_arrays([pa.array(stretches(pieces)[3])], ["mkey"])


def _stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, of = batch.column("id").to_numpy(), batch.column("h").to_numpy()
        for rows, offsets, pieces in _chunks(batch):
            piece, start, count, mkey = stretches(pieces)
            digest = xxhash.xxh64_intdigest
            content = np.fromiter(
                (digest(pieces[p][s:s + n + WIDTH - 1]) for p, s, n in zip(
                    piece.tolist(), start.tolist(), count.tolist(), strict=True)), np.uint64, len(piece))
            at = np.array(rows)[piece]
            yield pa.RecordBatch.from_arrays(
                [pa.array(mkey), pa.array(content.view(np.int64)), pa.array(ids[at]), pa.array(of[at]),
                 pa.array(start + np.array(offsets)[piece]), pa.array(count.astype(np.int32))],
                ["mkey", "content", "id", "h", "start", "n"])


# --- column-wise construction ------------------------------------------------------------

class _Column:
    """Bytes in an unnamed scratch file of the task, read from start to end, written anew."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile(buffering=0)  # gone with the task, never shared
        self.size = 0

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.fromfile(self.file, np.uint8, self.size)

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.write(values.data)
        self.size = len(values)

    def close(self) -> None:
        self.file.close()


def _range_least(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """min(values[l + 1 : r + 1]) for each pair l < r."""
    down = np.argsort(-left)  # from the last range to the first, so what lies between two is one value
    edges = np.empty(2 * len(left), np.int64)
    edges[::2], edges[1::2] = left[down] + 1, right[down] + 1
    out = np.empty(len(left), values.dtype)
    out[down] = np.minimum.reduceat(np.append(values, values.dtype.type(0)), edges)[::2]
    return out


def _by_symbol(bwt: np.ndarray) -> tuple[np.ndarray, np.unsignedinteger]:
    """Symbol and row as one number each (symbol in front), in order, and the bits of the row."""
    kind = np.uint32 if len(bwt) <= 1 << ROW_BITS else np.uint64
    bits = ROW_BITS if kind is np.uint32 else 2 * ROW_BITS
    return np.sort(bwt.astype(kind) << kind(bits) | np.arange(len(bwt), dtype=kind)), kind(bits)


def column_wise(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform (symbol codes from 1 on, 0 ends a string) and common-prefix
    lengths of the collection. Strings are shorter than 255 bytes and have 255 symbols at most."""
    m = len(strings)
    length = np.array([len(s) for s in strings])
    flat = np.frombuffer(b"".join(strings), np.uint8)
    used = np.unique(flat)
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    flat = code[flat]
    ends = np.cumsum(length)
    bwt_file, lcp_file = _Column(), _Column()
    bwt_file.write(flat[ends - 1])
    lcp_file.write(np.zeros(m, np.uint8))
    active, at = np.arange(m), np.arange(m)  # strings not yet complete, row of their last suffix
    for j in range(1, int(length.max()) + 1):
        bwt, lcp = bwt_file.read(), lcp_file.read()
        order, bits = _by_symbol(bwt)
        complete = int(np.count_nonzero(bwt == 0))
        last = bwt[at]
        r = np.searchsorted(order, last.astype(order.dtype) << bits | at.astype(order.dtype))
        row = m + r - complete  # of the suffix of length j among all rows after this round
        # Symbols before the new suffixes; 0 where the string is complete.
        left = np.where(length[active] > j, flat[np.maximum(ends[active] - j - 1, 0)], 0).astype(np.uint8)
        old = np.ones(len(bwt) + len(active), bool)
        old[row] = False
        merged, common = np.empty(len(old), np.uint8), np.empty(len(old), np.uint8)
        merged[old], common[old] = bwt, lcp
        merged[row], common[row] = left, 0
        mask = (order.dtype.type(1) << bits) - order.dtype.type(1)
        before, after = ((order[np.clip(k, 0, len(bwt) - 1)] & mask).astype(np.int64) for k in (r - 1, r + 1))
        has = (r > 0) & (bwt[before] == last)
        if has.any():
            common[row[has]] = 1 + _range_least(lcp, before[has], at[has])
        has = (r + 1 < len(bwt)) & (bwt[after] == last)
        if has.any():
            common[row[has] + 1] = 1 + _range_least(lcp, at[has], after[has])
        bwt_file.write(merged)
        lcp_file.write(common)
        keep = length[active] > j
        active, at = active[keep], row[keep]
    out = bwt_file.read(), lcp_file.read()
    bwt_file.close(), lcp_file.close()
    return out


def equal_windows(strings: list[bytes], width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(string, start) arrays of each set of two or more equal windows."""
    m = len(strings)
    bwt, lcp = column_wise(strings)
    order = np.argsort(bwt, kind="stable")
    rank = np.empty(len(bwt), np.int64)
    rank[order] = np.arange(len(bwt))
    complete = m  # rows whose string is complete
    length = np.array([len(s) for s in strings])
    owner, start = np.full(len(bwt), -1), np.zeros(len(bwt), np.int64)
    which, at = np.arange(m), np.arange(m)
    for j in range(1, int(length.max()) + 1):  # from each suffix to the one that is a symbol longer
        keep = length[which] >= j
        which, at = which[keep], at[keep]
        at = m + rank[at] - complete
        if j >= width:
            owner[at], start[at] = which, length[which] - j
    same = lcp >= width
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        yield owner[a - 1:b], start[a - 1:b]


def _repeats(ids: list[int], hashes: list[int], starts: list[int], strings: list[bytes]) -> tuple[np.ndarray, ...]:
    """Windows (id, h, start) that start earlier in another string of the block, too."""
    ids, hashes, starts = np.array(ids), np.array(hashes), np.array(starts)
    out = [(np.empty(0, np.int64),) * 3]
    for owner, start in equal_windows(strings):
        doc, of, begin = ids[owner], hashes[owner], starts[owner] + start
        first = np.lexsort((begin, of, doc))[0]
        later = (doc != doc[first]) | (of != of[first]) | (begin != begin[first])
        out.append((doc[later], of[later], begin[later]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def with_company(mkeys: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Which contents can share a window with another one under the same minimizer.

    A window has ``WIDTH - KMER`` bytes beside the minimizer, at least half of them on one side.
    So two contents with a common window agree in that half next to the minimizer, on the left
    or on the right; who agrees with nobody on either side goes no further.
    """
    half = (WIDTH - KMER + 1) // 2  # two hashes of KMER bytes cover it; a collision only keeps more
    size = np.array([len(s) for s in strings])
    offset = np.cumsum(size) - size
    h = _kmer_hashes(np.frombuffer(b"".join(strings), np.uint8))
    # The minimizer is the first one that the last window holds.
    at = np.flatnonzero(h.view(np.int64) == np.repeat(mkeys, size)[:len(h)])
    owner = np.searchsorted(offset, at, side="right") - 1
    within = at - offset[owner]
    last = (within >= size[owner] - WIDTH) & (within <= size[owner] - KMER)
    place = np.full(len(strings), -1)
    place[owner[last][::-1]] = within[last][::-1]
    first, known = offset + place, place >= 0
    keep = ~known
    for has, begin, end in ((place >= half, first - half, first - KMER),
                            (size >= place + KMER + half, first + KMER, first + half)):
        of = np.flatnonzero(known & has)
        side = np.stack([h[begin[of]], h[end[of]], mkeys[of].view(np.uint64)])
        order = np.lexsort(side)
        same = (side[:, order[1:]] == side[:, order[:-1]]).all(axis=0)
        keep[of[order[1:][same]]] = keep[of[order[:-1][same]]] = True
    return keep


def _block_rows(block: int):
    """Compares contents sorted by minimizer: whole groups are sifted, and what has company is
    put together in blocks of at least ``block`` strings, the last one aside."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mkeys: list[int] = []
        rows = ids, hashes, starts, strings = [], [], [], []
        kept = [], [], [], []
        last = None

        def sift():
            at = np.flatnonzero(with_company(np.array(mkeys), strings)).tolist()
            for column, values in zip(kept, rows, strict=True):
                column.extend([values[i] for i in at])
                values.clear()
            mkeys.clear()

        def repeats():
            doc, of, start = _repeats(*kept)
            for column in kept:
                column.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(of), pa.array(start), pa.array(np.ones(len(doc), np.int32))], ["id", "h", "start", "n"])

        for batch in batches:  # sorted by minimizer
            columns = (batch.column(c).to_pylist() for c in ("mkey", "id", "h", "start", "bytes"))
            for mkey, doc, of, start, content in zip(*columns, strict=True):
                if mkey != last and len(strings) >= block:
                    sift()
                    if len(kept[0]) >= block:
                        yield repeats()
                last = mkey
                mkeys.append(mkey), ids.append(doc), hashes.append(of), starts.append(start), strings.append(content)
        if strings:
            sift()
        if kept[0]:
            yield repeats()

    return run


# --- the operator ------------------------------------------------------------------------

def _folded(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key with its first occurrence (id, h, start) and how many there are."""
    out = rows.groupBy(*keys).agg(F.min(F.struct("id", "h", "start")).alias("f"), F.max("n").alias("n"), F.count("*").alias("times"))
    return out.select(*keys, F.col("f.id").alias("id"), F.col("f.h").alias("h"), F.col("f.start").alias("start"), "n", "times")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted stretches; those of crowded minimizers window by window."""
    for batch in batches:
        out = {"mkey": [], "window": [], "id": [], "h": [], "start": [], "bytes": []}
        size = 0
        for doc, of, text, wanted in zip(*(batch.column(c) for c in ("id", "h", "text", "wanted")), strict=True):
            data, doc, of = _bytes(text.as_py()), doc.as_py(), of.as_py()
            for w in wanted.as_py():
                begin, n = w["start"], w["n"]
                parts = [(begin, n)] if not w["crowded"] else [(begin + i, 1) for i in range(n)]
                for b, k in parts:
                    content = data[b:b + k + WIDTH - 1]
                    out["mkey"].append(w["mkey"]), out["id"].append(doc), out["h"].append(of), out["start"].append(b)
                    out["window"].append(hashlib.blake2b(content, digest_size=16).digest() if w["crowded"] else None)
                    out["bytes"].append(None if w["crowded"] else content)
                    size += 1
            if size >= 20_000:
                yield _cut_batch(out)
                out, size = {k: [] for k in out}, 0
        yield _cut_batch(out)


def _cut_batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


def _remainders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        found = batch.column("found")
        offsets = found.offsets.to_numpy()
        starts, sizes = (found.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
        for text, low, high in zip(batch.column("text"), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            data = _bytes(text.as_py())
            if low == high:
                rows.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            begin = starts[low:high]
            end = begin + sizes[low:high] + (WIDTH - 1)
            edge = np.bincount(begin, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_bytes(docs: DataFrame, block: int = 600, crowd: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``.

    Every byte goes that a 100-byte string covers which also starts earlier: under a smaller
    doc_id or earlier in the same text. Null and empty texts have no bytes, texts under 100
    bytes lose none. Different texts under one doc_id are places of their own, in the order of
    their hashes (xxhash64, signed). Equal texts under one doc_id are the same place, so each gives
    the same row and none is a copy of the other. A null doc_id is an id like others and comes
    before them.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
                       F.xxhash64("text").alias("h"), "text")
    common = rows.select("text").mapInArrow(_minimizers, "mkey long").groupBy("mkey").agg(
        F.count("*").alias("times")).where("times > 1").select("mkey")
    common = materialise(common, "common")  # a join of two plain shuffles, so a hot key can be split
    found = rows.select("id", "h", "text").mapInArrow(
        _stretch_rows, "mkey long, content long, id long, h long, start long, n int")
    found = materialise(found.join(common, "mkey"), "stretches")
    contents = materialise(_folded(found, "mkey", "content"), "contents")

    # Later occurrences of equal contents are repeats as a whole.
    def firsts(folded: DataFrame, key: str) -> DataFrame:
        return folded.where("times > 1").select(
            "mkey", key, F.col("id").alias("fid"), F.col("h").alias("fh"), F.col("start").alias("fstart"))

    other = "id <> fid OR h <> fh OR start <> fstart"
    later = found.join(firsts(contents, "content"), ["mkey", "content"]).where(other).select("id", "h", "start", "n")

    # Different contents under one minimizer are compared.
    rivals = materialise(contents.groupBy("mkey").agg(F.count("*").alias("rivals")).where("rivals > 1"), "rivals")
    wanted = contents.join(rivals, "mkey").groupBy("id", "h").agg(F.collect_list(
        F.struct("mkey", "start", "n", (F.col("rivals") > crowd).alias("crowded"))).alias("wanted"))
    cut = rows.select("id", "h", "text").join(wanted, ["id", "h"]).mapInArrow(
        _cut, "mkey long, window binary, id long, h long, start long, bytes binary")
    cut = materialise(cut, "cut")
    blocks = cut.where("bytes IS NOT NULL").select("mkey", "id", "h", "start", "bytes")
    compared = blocks.repartition("mkey").sortWithinPartitions("mkey").mapInArrow(
        _block_rows(block), "id long, h long, start long, n int")
    single = cut.where("window IS NOT NULL").select("mkey", "window", "id", "h", "start", F.lit(1).alias("n"))
    alone = firsts(_folded(single, "mkey", "window"), "window")
    crowded = single.join(alone, ["mkey", "window"]).where(other).select("id", "h", "start", "n")

    spans = later.unionByName(compared).unionByName(crowded).groupBy("id", "h").agg(
        F.collect_list(F.struct("start", "n")).alias("found"))
    return rows.join(spans, ["id", "h"], "left").select("doc_id", "text", "found").mapInArrow(
        _remainders, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
