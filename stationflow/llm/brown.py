"""Language-model scores from Brown class bigrams.

Classes start from the most frequent words (``core``), which exchange clustering on the driver
puts where class bigrams are most likely, and from the endings of all others. Rounds over the
whole training vocabulary follow: every word, however rare, moves to the class in which its own
occurrences, with the classes of their neighbours, are most likely. A text is scored by class
transitions and by each word's share of its class; every count comes from all training texts,
whatever the word. Words that no training text has are in the class of their ending.

Classes of the most frequent words (``local``, a bound on what each task holds) travel to the
texts; the others meet their classes in a join, a row for each text and word, none of which is
frequent, so no key is hot. Both ways give the same numbers, as gains are sums of whole numbers;
the bound only moves work.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.base import each_text, fold
from stationflow.session import materialise

END = b"\n"  # no word has it
TAILS = 16
FLUSH = 400_000  # different words a task counts before it hands them on
AT_ONCE = 256  # texts laid flat at a time


@dataclass(frozen=True)
class Size:
    core: int = 1024
    classes: int = 48
    local: int = 1 << 18
    sweeps: int = 6
    rounds: int = 1


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def tail(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(c.values(), pa.int64())], ["word", "c"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text"):
            counts.update(tokens(text.as_py()))
            if len(counts) > FLUSH:
                yield out(counts)
                counts = Counter()
    yield out(counts)


def word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes), c over all texts, the end token among them."""
    return texts.select("text").mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lookup:
    """Numbers of the frequent words."""

    def __init__(self, words: list[bytes]) -> None:
        self.key, self.words, self.size = uuid.uuid4().hex, b"\n".join(words), len(words)

    def number(self) -> dict[bytes, int]:
        """Made once in each Python worker."""
        if self.key not in _NUMBERS:
            _NUMBERS.clear()
            words = self.words.split(b"\n") if self.size else []
            _NUMBERS[self.key] = dict(zip(words, range(len(words)), strict=True))
        return _NUMBERS[self.key]


_NUMBERS: dict[str, dict[bytes, int]] = {}


def packed(ids: np.ndarray) -> bytes:
    """Four-byte numbers, byte by byte, compressed: texts travel by these."""
    return pa.compress(ids.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(data, 4 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view(np.int32)[:, 0]


def binaries(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary value from each start to the next, the last to the end of ``data``."""
    ends = np.append(starts, len(data)).astype(np.int32) * data.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def numbered(rows: DataFrame, words: list[bytes]) -> DataFrame:
    """row, doc_id, h, train, n (words), ids (packed: a frequent word's number, or -1 - j for the
    text's j-th rare word), rare (those words), cls (their endings' numbers)."""
    shared = rows.sparkSession.sparkContext.broadcast(Lookup(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.number().get
        for batch in batches:
            n, ids, rares = [], [], []
            for text in each_text(batch.column("text")):
                mine = tokens(text)[:-1]
                at = np.fromiter((get(w, -1) for w in mine), np.int32, len(mine))
                rare: dict[bytes, int] = {}
                for i in np.flatnonzero(at < 0).tolist():
                    at[i] = -1 - rare.setdefault(mine[i], len(rare))
                n.append(len(at))
                ids.append(packed(at))
                rares.append(list(rare))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(x) for x in ("row", "doc_id", "h", "train")], pa.array(n, pa.int32()), pa.array(ids, pa.binary()),
                 pa.array(rares, pa.list_(pa.binary())), pa.array([[tail(w) for w in r] for r in rares], pa.list_(pa.int32()))],
                ["row", "doc_id", "h", "train", "n", "ids", "rare", "cls"])

    return rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        run, "row long, doc_id long, h long, train boolean, n int, ids binary, rare array<binary>, cls array<int>")


class Flat:
    """All texts of a batch in one array of classes, an end after each."""

    def __init__(self, batch: pa.RecordBatch, of: np.ndarray, shift: int, end: int) -> None:
        lengths = batch.column("n").to_numpy().astype(np.int64)
        self.ids = np.concatenate([unpacked(*x) for x in zip(batch.column("ids").to_pylist(), lengths.tolist(), strict=True)])
        held = pc.list_value_length(batch.column("cls")).to_numpy().astype(np.int64)
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        self.rare = np.flatnonzero(self.ids < 0)
        self.kept = np.flatnonzero(self.ids >= 0)
        self.which = (np.cumsum(held) - held)[self.text[self.rare]] - 1 - self.ids[self.rare]  # of the batch's rare words
        classes = np.empty(len(self.ids), np.int64)
        classes[self.kept] = of[self.ids[self.kept]]
        classes[self.rare] = batch.column("cls").flatten().to_numpy(zero_copy_only=False)[self.which] + shift
        self.at = np.arange(len(self.ids)) + self.text  # place of each word
        self.classes = np.full(len(self.ids) + len(lengths), end, np.int64)
        self.classes[self.at] = classes
        self.before = np.concatenate([self.classes[-1:], self.classes[:-1]])  # the start is an end
        self.last = np.cumsum(lengths + 1)  # first place after each text


@dataclass(frozen=True)
class State:
    """Texts with their rare words' classes (plus ``shift``), and the frequent words' classes."""

    texts: DataFrame
    shift: int
    of: np.ndarray
    n: int  # classes, the last of which is the end's

    def runner(self, body):
        """``body`` on the batches of texts laid flat."""
        shared, shift, end = self.texts.sparkSession.sparkContext.broadcast(self.of), self.shift, self.n - 1

        def flat(batches):
            for whole in batches:
                for i in range(0, len(whole), AT_ONCE):
                    batch = whole.slice(i, AT_ONCE)
                    yield batch, Flat(batch, shared.value, shift, end)

        return lambda batches: body(flat(batches))


def class_pairs(state: State) -> np.ndarray:
    """Counts of neighbouring classes, the left one's row and the right one's column."""
    n = state.n

    def body(batches):
        total = np.zeros(n * n, np.int64)
        for _, flat in batches:
            total += np.bincount(flat.before * n + flat.classes, minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "c"])

    counted = state.texts.where("train").select("n", "ids", "cls").mapInArrow(state.runner(body), "pair int, c long")
    got = counted.groupBy("pair").agg(F.sum("c").alias("c")).toArrow()  # n * n numbers at most
    matrix = np.zeros(n * n)
    matrix[got["pair"].to_numpy()] = got["c"].to_numpy()
    return matrix.reshape(n, n)


def exchange(pairs: np.ndarray, core: int, classes: int, sweeps: int) -> np.ndarray:
    """Class of each symbol of a matrix of bigram counts: core words are moved to the class that
    raises the class bigrams' log likelihood most, until none moves; tails and the end keep
    classes of their own (after the core's)."""
    n = len(pairs)
    k = min(classes, core)
    of = np.concatenate([np.arange(core) % max(k, 1), k + np.arange(n - core)]).astype(np.int64)
    t = k + n - core
    onehot = np.zeros((n, t))
    onehot[np.arange(n), of] = 1
    right = pairs @ onehot  # of a word, by the class that follows
    left = pairs.T @ onehot
    table = onehot.T @ right

    def entropy(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0)

    for _ in range(sweeps):
        moved = 0
        for w in np.argsort(-pairs[:core].sum(axis=1), kind="stable"):
            old, own = of[w], pairs[w, w]
            r, s = right[w].copy(), left[w].copy()  # the word's neighbours without itself
            r[old] -= own
            s[old] -= own
            base = table.copy()  # the classes without the word
            base[old, :] -= r
            base[:, old] -= s
            base[old, old] -= own
            c = np.arange(k)
            rows = entropy(base[:k] + r) - entropy(base[:k])
            cols = entropy(base[:, :k] + s[:, None]) - entropy(base[:, :k])
            gain = rows.sum(axis=1) - rows[c, c] + cols.sum(axis=0) - cols[c, c]
            gain += entropy(base[c, c] + r[:k] + s[:k] + own) - entropy(base[c, c])
            before, after = base.sum(axis=1)[:k] + s[:k], base.sum(axis=0)[:k] + r[:k]
            gain -= entropy(before + r.sum() + own) - entropy(before)
            gain -= entropy(after + s.sum() + own) - entropy(after)
            best = int(gain.argmax())
            if best == old or gain[best] <= gain[old] + 1e-9:
                continue
            moved += 1
            of[w] = best
            base[best, :] += r
            base[:, best] += s
            base[best, best] += own
            table = base
            for side, counts in ((right, pairs[:, w]), (left, pairs[w])):
                side[:, old] -= counts
                side[:, best] += counts
        if not moved:
            break
    return of


def likelihood(pairs: np.ndarray, of: np.ndarray) -> float:
    """Log likelihood of the class bigrams up to a term that no assignment changes."""
    t = int(of.max()) + 1
    table = np.zeros((t, t))
    np.add.at(table, (of[:, None], of[None, :]), pairs)

    def entropy(x):
        return (x[x > 0] * np.log(x[x > 0])).sum()

    return entropy(table) - entropy(table.sum(axis=0)) - entropy(table.sum(axis=1))


def transitions(table: np.ndarray, weight: float = 10.0) -> np.ndarray:
    """log10 of smoothed class transitions: each row leans on the classes' own shares."""
    share = (table.sum(axis=0) + 1) / (table.sum() + len(table))
    return np.log10((table + weight * share) / (table.sum(axis=1, keepdims=True) + weight))


class Model:
    """Transitions, and the room of each class: its tokens, half a token for each word and one unknown."""

    def __init__(self, table: np.ndarray, words_of: np.ndarray) -> None:
        tokens_of = table.sum(axis=0)
        self.trans = transitions(table)
        self.room = tokens_of + 0.5 * (words_of + 1)
        # Of the training texts, up to the words' own counts, which no assignment changes.
        self.likelihood = float((table * self.trans).sum() - (tokens_of * np.log10(self.room)).sum())

    def gains(self) -> np.ndarray:
        """What a neighbour (by class to the left, then by class to the right) adds to a word in
        each class but the end's. Whole numbers: their sums are exact in any order."""
        left = self.trans[:, :-1] - np.log10(self.room[:-1])
        return np.rint(np.concatenate([left, self.trans[:-1].T]) * (1 << 20))


def _best(counts: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """Best class of each row of neighbour counts."""
    out = [(counts[i:i + 4096].astype(float) @ gains).argmax(axis=1) for i in range(0, len(counts), 4096)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def frequent_moves(state: State, model: Model) -> np.ndarray:
    """Best class of each frequent word."""
    n, size, gains = state.n, len(state.of), model.gains()

    def count(batches):
        held, waiting = [], 0

        def out():
            code, c = np.unique(np.concatenate(held), return_counts=True)
            ids, starts = np.unique(code // (2 * n), return_index=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids.astype(np.int32)), binaries((code % (2 * n)).astype(np.int16), starts), binaries(c.astype(np.int32), starts)],
                ["id", "sides", "c"])

        for _, flat in batches:
            at, first = flat.at[flat.kept], flat.ids[flat.kept].astype(np.int64) * (2 * n)
            held += [first + flat.before[at], first + n + flat.classes[at + 1]]
            waiting += 2 * len(at)
            if waiting > FLUSH * 5:
                yield out()
                held.clear()
                waiting = 0
        if held:
            yield out()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(size, -1)
        mine, counts = [], np.zeros((0, 2 * n), np.int64)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            c = np.frombuffer(b"".join(batch.column("c").to_pylist()), np.int32)
            sides = np.frombuffer(b"".join(batch.column("sides").to_pylist()), np.int16)
            new = np.unique(ids[place[ids] < 0])
            place[new] = len(mine) + np.arange(len(new))
            mine += new.tolist()
            if len(mine) > len(counts):
                counts = np.concatenate([counts, np.zeros((len(mine), 2 * n), np.int64)])
            np.add.at(counts, (np.repeat(place[ids], pc.binary_length(batch.column("c")).to_numpy() // 4), sides), c)
        yield pa.RecordBatch.from_arrays(
            [pa.array(mine, pa.int32()), pa.array(_best(counts[:len(mine)], gains).astype(np.int32))], ["id", "cls"])

    counted = state.texts.where("train").select("n", "ids", "cls").mapInArrow(state.runner(count), "id int, sides binary, c binary")
    parts = counted.repartition(1 + size // 4096, "id")  # so many that a task's counts stay small
    got = parts.mapInArrow(choose, "id int, cls int").toArrow()  # ``local`` numbers at most
    of = state.of.copy()
    of[got["id"].to_numpy()] = got["cls"].to_numpy()
    return of


def rare_moves(state: State, model: Model) -> DataFrame:
    """word, c, cls (its best class) of each word of the training texts that is not frequent."""
    n, gains = state.n, model.gains()

    def around(batches):
        for batch, flat in batches:
            at = flat.at[flat.rare]
            sides = np.stack([flat.before[at], n + flat.classes[at + 1]], axis=1).astype(np.int16)
            words = batch.column("rare").flatten()
            times = 2 * np.bincount(flat.which, minlength=len(words))
            data = sides[np.argsort(flat.which, kind="stable")].ravel()
            yield pa.RecordBatch.from_arrays([words, binaries(data, np.cumsum(times) - times)], ["word", "sides"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 4096):
                batch = whole.slice(i, 4096)
                parts = batch.column("sides").flatten()
                sides = np.frombuffer(b"".join(parts.to_pylist()), np.int16)
                word = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column("sides")).to_numpy())
                word = np.repeat(word, pc.binary_length(parts).to_numpy() // 2)
                counts = np.bincount(word * 2 * n + sides, minlength=len(batch) * 2 * n).reshape(len(batch), 2 * n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("word"), pa.array(counts.sum(axis=1) // 2), pa.array(_best(counts, gains).astype(np.int32))],
                    ["word", "c", "cls"])

    met = state.texts.where("train").select("n", "ids", "rare", "cls").mapInArrow(state.runner(around), "word binary, sides binary")
    return met.groupBy("word").agg(F.collect_list("sides").alias("sides")).mapInArrow(choose, "word binary, c long, cls int")


def brought_back(texts: DataFrame, classes: DataFrame, ending: Column) -> DataFrame:
    """The texts with class (the ending's, where no training text has the word) and count of their rare words."""
    rare = texts.select("row", F.posexplode("rare").alias("j", "word")).join(classes, "word", "left").select(
        "row", F.struct("j", F.coalesce("cls", ending).alias("cls"), F.coalesce("c", F.lit(0)).alias("c")).alias("r"))
    lists = rare.groupBy("row").agg(F.sort_array(F.collect_list("r")).alias("r"))
    none = F.array().cast("array<bigint>")
    return texts.drop("cls").join(lists, "row", "left").select(
        "row", "doc_id", "h", "train", "n", "ids", "rare", F.coalesce("r.cls", none.cast("array<int>")).alias("cls"),
        F.coalesce("r.c", none).alias("c"))


def perplexity_scores(docs: DataFrame, size: Size = Size()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from the folds that are not held out (crc32 of the id modulo 5 is not 1). A null or
    empty text is its end token alone. Equal rows give one row, different texts under one
    doc_id a row each; a null id is not held out. Without training texts every count is 0 and
    the scores are those of the smoothing alone.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), (fold(F.col("doc_id"), 5) != 1).alias("train"))
    counts = materialise(word_counts(rows.where("train")), "word-counts")
    total, different = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    # The frequent words: whole classes of counts, so that ties never split.
    step = F.floor(F.log2("c") * 16)
    known, cut = 0, 1 << 20
    for r in counts.groupBy(step.alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect():
        if known + r["n"] > size.local:
            break
        known, cut = known + r["n"], r["b"]
    top = counts.where(step >= cut).toArrow()
    pairs = sorted(((-c, w) for w, c in zip(top["word"].to_pylist(), top["c"].to_pylist(), strict=True) if w != END))
    words, c = [w for _, w in pairs], np.array([-n for n, _ in pairs], float)
    others = counts.where((step < cut) & (F.col("word") != F.lit(END)))
    core = min(size.core, len(words))
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    texts = materialise(numbered(rows, words), "numbered")

    # The start: classes of the core, endings for all others.
    symbol = np.array([i if i < core else core + tail(w) for i, w in enumerate(words)], np.int64)
    first = exchange(class_pairs(State(texts, core, symbol, core + TAILS + 1)), core, size.classes, size.sweeps)
    n = int(first.max()) + 1
    shift = n - 1 - TAILS
    ending = (F.crc32(F.substring("word", -2, 2)) % TAILS + shift).cast("int")

    def learned(state: State, rare: DataFrame) -> Model:
        words_of = np.bincount(state.of, minlength=n).astype(float)
        for r in rare.groupBy("cls").count().collect():
            words_of[r["cls"]] += r["count"]
        words_of[-1] = 1
        return Model(class_pairs(state), words_of)

    rare = others.select("word", "c", ending.alias("cls"))
    state = State(texts, shift, first[symbol], n)
    model = learned(state, rare)
    for _ in range(size.rounds if total else 0):
        moved = materialise(rare_moves(state, model), "classes")
        then = State(materialise(brought_back(texts, moved, ending), "texts"), 0, frequent_moves(state, model), n)
        better = learned(then, moved)
        if better.likelihood <= model.likelihood:
            break
        state, model = then, better
    if state.texts is texts:
        state = State(brought_back(texts, rare, ending), 0, state.of, n)

    all_room = total + 0.5 * (different + 1)
    base = np.log10((c + 0.5) / all_room)
    own = np.log10(c + 0.5)
    parts = spark.sparkContext.broadcast((base, own, np.log10(model.room), model.trans))
    end_base, end_own = math.log10((ends + 0.5) / all_room), math.log10(ends + 0.5)

    def body(batches):
        base, own, room, trans = parts.value
        for batch, flat in batches:
            times = batch.column("c").flatten().to_numpy(zero_copy_only=False)[flat.which].astype(float)
            value = np.zeros((3, len(flat.classes)))  # known, base, score of each token
            ends_at = flat.last - 1
            value[:, ends_at] = [[ends > 0], [end_base], [end_own]]
            value[:, flat.at[flat.kept]] = [np.ones(len(flat.kept)), base[flat.ids[flat.kept]], own[flat.ids[flat.kept]]]
            value[:, flat.at[flat.rare]] = [times > 0, np.log10((times + 0.5) / all_room), np.log10(times + 0.5)]
            value[2] += trans[flat.before, flat.classes] - room[flat.classes]
            starts = np.concatenate([[0], flat.last[:-1]])
            known, b, s = np.add.reduceat(value, starts, axis=1) if len(starts) else value
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(flat.last - starts), pa.array(known.astype(np.int64)),
                 pa.array(b), pa.array(s)], ["doc_id", "h", "n_tokens", "n_known", "base_score", "score"])

    scored = state.texts.select("doc_id", "h", "n", "ids", "cls", "c").mapInArrow(
        state.runner(body), "doc_id long, h long, n_tokens long, n_known long, base_score double, score double")
    # Equal rows have equal scores.
    return scored.groupBy("doc_id", "h").agg(*[F.first(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")]).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known",
        F.lit(int(total)).cast("bigint").alias("train_tokens"), "base_score", "score")
