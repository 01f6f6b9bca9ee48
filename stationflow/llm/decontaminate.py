"""Benchmark decontamination with a positional inverted index.

The documents' postings (text, position, term) are stored for the terms that test items use;
a row per text says how long it is. Each posting names the term at the next position, so two
neighbouring terms' lists, shifted by one, meet by equality. A window of an item can only occur
where its rarest pair of neighbours does: those postings, shifted by the pair's place in the
item, are the (text, item, shift) candidates. Each candidate is then compared word by word with
the stored postings, and unbroken runs of a window's length or more are exact phrase matches.

Proximity matches come from the same postings: a window is near where most of its neighbouring
pairs stand side by side within a band of shifts. A changed or dropped word parts two pairs, an
inserted one parts one, and each moves the words behind it by one place at most. So a window
with ``edits`` such faults keeps all but 2 * edits of its pairs in a band of edits + 1 shifts.

Only DataFrame operations; lists of common terms are never joined with anything but the
candidates of their own texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm.base import LOWER, UPPER, columns, same, sha256_text
from stationflow.session import materialise

WINDOW = 10
EDITS = 2
BROADCAST_TERMS = 1_000_000
# ASCII but digits and letters separates words.
_BREAKS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
END = -1  # term of the row that tells a text's length


def words(text: Column) -> Column:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, none for null."""
    clean = F.translate(F.coalesce(text, F.lit("")), _BREAKS + UPPER, " " * len(_BREAKS) + LOWER)
    return F.array_remove(F.split(clean, " "), "")


def item_words(items: DataFrame) -> DataFrame:
    """item_id, item (distinguishes texts under one id), n, ipos, term."""
    w = items.select("item_id", F.xxhash64("item_id", "text").alias("item"), words(F.col("text")).alias("w"))
    w = w.where(F.size("w") > 0).dropDuplicates(["item_id", "item"])
    return w.select("item_id", "item", F.size("w").alias("n"), F.posexplode("w").alias("ipos", "term"))


def build_index(docs: DataFrame, vocabulary: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Postings doc_id, h, pos, term_id, next_id of the vocabulary's terms, stored in the shared folder.

    next_id is the term at the following position, null if the vocabulary lacks it. ``vocabulary``
    (term, term_id) is broadcast up to ``broadcast_terms`` rows and shuffled beyond. h tells
    different texts under one doc_id apart; equal rows have equal postings.
    """
    small = F.broadcast if vocabulary.count() <= broadcast_terms else (lambda df: df)
    w = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), words(F.col("text")).alias("w"))
    w = w.withColumn("w", F.concat("w", F.array(F.lit(""))))
    follows = F.concat(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), F.array(F.lit("")))
    tokens = w.select("doc_id", "h", F.posexplode(F.arrays_zip(F.col("w").alias("term"), follows.alias("follow"))).alias("pos", "t"))
    tokens = tokens.select("doc_id", "h", "pos", "t.term", "t.follow")
    behind = vocabulary.select(F.col("term").alias("follow"), F.col("term_id").alias("next_id")).where(F.col("next_id") != END)
    rows = tokens.join(small(vocabulary), "term").join(small(behind), "follow", "left")
    return materialise(rows.select("doc_id", "h", "pos", "term_id", "next_id"), "postings")


@dataclass(frozen=True)
class Index:
    """Stored postings of the texts and the items' windows, with their pairs from rare to common.

    ``parts`` has a row for each item word, ``ranked`` one for each pair of neighbours in each
    window (its first word is ``s``) with the pair's frequency ``df`` in the texts and its ``rank``.
    """

    postings: DataFrame
    lengths: DataFrame
    parts: DataFrame
    ranked: DataFrame
    window: int
    few_terms: bool

    def small(self, table: DataFrame) -> DataFrame:
        """Tables of the items' size are broadcast while the items have few words."""
        return F.broadcast(table) if self.few_terms else table


def index_of(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_terms: int = BROADCAST_TERMS) -> Index:
    spark = docs.sparkSession
    parts = materialise(item_words(items), "items")
    ids = parts.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id())
    vocabulary = materialise(ids.unionByName(
        spark.range(1).select(F.lit("").alias("term"), F.lit(END).cast("bigint").alias("term_id"))), "terms")
    postings = build_index(docs, vocabulary, broadcast_terms)
    lengths = postings.where(F.col("term_id") == END).select("doc_id", "h", F.col("pos").alias("n_words")).distinct()
    postings = postings.where(F.col("term_id") != END)

    few_terms = parts.count() <= broadcast_terms
    small = F.broadcast if few_terms else (lambda df: df)
    size = F.least(F.col("n"), F.lit(window))
    in_item = Window.partitionBy("item_id", "item").orderBy("ipos")
    parts = materialise(parts.join(vocabulary, "term").select(
        "item_id", "item", "n", "ipos", "term_id", F.lead("term_id").over(in_item).alias("next_id"), size.alias("size")), "items")
    # How often each pair of an item's neighbouring words occurs: the lists' intersection sizes.
    pairs = parts.where("next_id IS NOT NULL")
    frequency = postings.join(small(pairs.select("term_id", "next_id").distinct()), ["term_id", "next_id"]).groupBy(
        "term_id", "next_id").agg(F.count("*").alias("df"))
    # A window starts at each word that has enough words behind it; an item that is shorter is one.
    spread = pairs.withColumn("s", F.explode(F.sequence(
        F.greatest(F.lit(0), F.col("ipos") - F.col("size") + 2), F.least(F.col("ipos"), F.col("n") - F.col("size")))))
    ranked = spread.join(frequency, ["term_id", "next_id"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = Window.partitionBy("item_id", "item", "s").orderBy("df", "ipos")
    ranked = materialise(ranked.withColumn("rank", F.row_number().over(rarest)), "windows")
    return Index(postings, lengths, parts, ranked, window, few_terms)


def _postings_of(index: Index, found: DataFrame, broadcast_texts: int) -> DataFrame:
    """The postings of the texts that ``found`` names."""
    texts = found.select("doc_id", "h").distinct()
    if texts.count() <= broadcast_texts:
        texts = F.broadcast(texts)
    return index.postings.join(texts, same(index.postings, texts, "doc_id", "h"), "left_semi")


def phrase_matches(index: Index, broadcast_texts: int = 500_000) -> DataFrame:
    """Maximal exact matches doc_id, h, item_id, start, ipos, n_match (words) in the different texts."""
    postings, parts, small = index.postings, index.parts, index.small
    anchors = materialise(index.ranked.where("rank = 1 AND df > 0").select(
        "item_id", "item", "ipos", "term_id", "next_id", "size").distinct(), "anchors")
    single = parts.where("n = 1").select("item_id", "item", "ipos", "term_id", "size")
    hits = postings.join(small(anchors), ["term_id", "next_id"]).drop("next_id").unionByName(
        postings.drop("next_id").join(small(single), "term_id"))
    found = materialise(hits.select(
        "doc_id", "h", "item_id", "item", (F.col("pos") - F.col("ipos")).alias("shift"), "size").distinct(), "candidates")

    lists = _postings_of(index, found, broadcast_texts)
    wanted = found.join(small(parts), same(found, parts, "item_id", "item")).select(
        "doc_id", "h", found["item_id"], found["item"], "shift", "ipos", "term_id", found["size"],
        (F.col("shift") + F.col("ipos")).alias("pos"))
    equal = wanted.join(lists, same(wanted, lists, "doc_id", "h", "pos", "term_id"), "left_semi")
    diagonal = ["doc_id", "h", "item_id", "item", "shift"]
    island = F.col("ipos") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("ipos"))
    runs = equal.withColumn("island", island).groupBy(*diagonal, "island").agg(
        F.min("pos").alias("start"), F.min("ipos").alias("ipos"), F.count("*").alias("n_match"),
        F.first("size").alias("size")).where(F.col("n_match") >= F.col("size"))
    return runs.select("doc_id", "h", "item_id", "start", "ipos", "n_match")


def proximity_matches(index: Index, edits: int = EDITS, broadcast_texts: int = 500_000) -> DataFrame:
    """Near windows doc_id, h, item_id, s (its first item word), shift, n_pairs in the different texts.

    A window is near at ``shift`` if at least window - 1 - 2 * edits of its pairs of neighbours
    (at least one) stand side by side at their item position plus a shift from ``shift`` to
    ``shift + edits``. ``shift`` is the smallest one with the most pairs. Exact occurrences are
    near, too. Items of fewer words than a window have no near ones.
    """
    pairs = index.window - 1
    need = max(1, pairs - 2 * edits)
    postings, small = index.postings, index.small
    # Of the need pairs at most pairs - len(rarest) are not among the rarest: two are, if two are needed.
    least = min(2, need)
    anchors = materialise(index.ranked.where(
        (F.col("n") >= index.window) & (F.col("rank") <= pairs - need + least) & (F.col("df") > 0)).select(
        "item_id", "item", "n", "ipos", "term_id", "next_id").distinct(), "near-anchors")
    hits = postings.join(small(anchors), ["term_id", "next_id"]).select("doc_id", "h", "item_id", "item", "n", "ipos", "pos").distinct()
    if least == 2:  # a hit without another one of its item as near as a window allows is alone
        reach = pairs - 1 + edits
        in_text = Window.partitionBy("doc_id", "h", "item_id", "item").orderBy("pos", "ipos")
        hits = hits.withColumns({"before": F.lag("pos").over(in_text), "behind": F.lead("pos").over(in_text)}).where(
            (F.col("pos") - F.col("before") <= reach) | (F.col("behind") - F.col("pos") <= reach))
    found = materialise(hits.select(
        "doc_id", "h", "item_id", "item", "n", "ipos", (F.col("pos") - F.col("ipos")).alias("shift")), "near-candidates")

    # Every pair of the item and every shift that a window with the hit can use, each once.
    around = F.sequence(F.greatest(F.lit(0), F.col("ipos") - pairs + 1), F.least(F.col("n") - 2, F.col("ipos") + pairs - 1))
    shifts = F.sequence(F.col("shift") - edits, F.col("shift") + edits)
    cells = found.select("doc_id", "h", "item_id", "item", F.explode(around).alias("ipos"), "shift").distinct()
    cells = cells.select("doc_id", "h", "item_id", "item", "ipos", F.explode(shifts).alias("shift")).distinct()
    parts = small(index.parts.where("next_id IS NOT NULL"))
    wanted = cells.join(parts, same(cells, parts, "item_id", "item", "ipos")).select(
        "doc_id", "h", cells["item_id"], cells["item"], "n", cells["ipos"], "shift", "term_id", "next_id",
        (cells["ipos"] + F.col("shift")).alias("pos"))
    lists = _postings_of(index, found, broadcast_texts)
    equal = wanted.join(lists, same(wanted, lists, "doc_id", "h", "pos", "term_id", "next_id"), "left_semi")
    windows = equal.withColumn("s", F.explode(F.sequence(
        F.greatest(F.lit(0), F.col("ipos") - pairs + 1), F.least(F.col("ipos"), F.col("n") - index.window))))
    bands = windows.select("doc_id", "h", "item_id", "item", "s", "ipos", F.explode(F.sequence(
        F.col("shift") - edits, F.col("shift"))).alias("shift")).distinct()
    near = bands.groupBy("doc_id", "h", "item_id", "item", "s", "shift").agg(F.count("*").alias("n_pairs")).where(F.col("n_pairs") >= need)
    best = F.max(F.struct("n_pairs", (-F.col("shift")).alias("back"))).alias("best")
    return near.groupBy("doc_id", "h", "item_id", "item", "s").agg(best).select(
        "doc_id", "h", "item_id", "s", (-F.col("best.back")).alias("shift"), "best.n_pairs")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, edits: int = EDITS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items,
    near_items_sha256, one row per different text.

    The first six are about exact phrases, the last two about items with near windows (see
    ``proximity_matches``), exact ones included.

    Equal rows give one row; different texts under one doc_id give a row each. Null texts
    have no words; a null doc_id is an id like others. Items without words never match; items
    without an id hit words but are not listed. Without items nothing is contaminated.
    """
    found = index_of(docs, items, window)
    lengths, runs = found.lengths, materialise(phrase_matches(found), "runs")
    near = proximity_matches(found, edits).groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("near_ids"))
    words_hit = runs.select("doc_id", "h", F.explode(F.sequence("start", F.col("start") + F.col("n_match") - 1)).alias("p"))
    words_hit = words_hit.distinct().groupBy("doc_id", "h").agg(F.count("*").alias("n_hit"))
    listed = runs.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    out = lengths.join(words_hit, same(lengths, words_hit, "doc_id", "h"), "left").select(
        lengths["doc_id"], lengths["h"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"))
    none = F.array().cast("array<string>")
    out = out.join(listed, same(out, listed, "doc_id", "h"), "left").select(
        out["doc_id"], out["h"], F.col("n_words").cast("bigint").alias("n_words"), "n_hit", F.coalesce("ids", none).alias("ids"))
    out = out.join(near, same(out, near, "doc_id", "h"), "left").select(
        out["doc_id"], "n_words", "n_hit", "ids", F.coalesce("near_ids", none).alias("near_ids"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("bigint").alias("n_items"),
        sha256_text(F.array_join("ids", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_ids").cast("bigint").alias("n_near_items"),
        sha256_text(F.array_join("near_ids", ",")).alias("near_items_sha256"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, edits: int | None = None) -> DataFrame:
    """The rows of ``docs`` in whose text no window of an item occurs, nor is near if ``edits`` is given.

    Null texts have no words and stay, repeated rows stay or go together, an empty table stays empty.
    """
    found = index_of(docs, items, window)
    places = phrase_matches(found).select("doc_id", "h")
    if edits is not None:
        places = places.unionByName(proximity_matches(found, edits).select("doc_id", "h"))
    hit = materialise(places.select(F.col("doc_id").alias("__id"), F.col("h").alias("__hit")).distinct(), "contaminated")
    rows = docs.withColumn("__h", F.xxhash64("doc_id", "text"))
    found = rows["doc_id"].eqNullSafe(hit["__id"]) & (rows["__h"] == hit["__hit"])
    return rows.join(hit, found, "left_anti").select(*columns(docs))
