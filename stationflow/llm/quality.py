"""Quality rules under weak supervision.

Rules look at counts of a text and vote good, bad or abstain. Expectation-maximisation finds,
without labels, how often each rule votes what for good and for bad texts; the posterior
probability of being good decides. EM runs over vote patterns with their counts, a table that
the number of rules bounds (3 ** rules), whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stationflow.llm.base import columns, each_text
from stationflow.session import materialise

SYMBOLS = frozenset("#*$%&|<>")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_caps", "n_letters", "n_marks")
_BLANK = " \t\n\x0b\x0c\r"


def text_counts(text: str | None) -> tuple[int, ...]:
    """The numbers of COUNTS: words, their code points, symbols, repeated lines, words in
    3-word windows that occur twice or more, capital letters, letters, exclamation marks."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0, 0, text.count("!"))
    chars = len(text) - sum(map(text.count, _BLANK))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    repeat = 0
    if n >= 3:
        number = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        v = len(number)
        pair = ids[:-1] * v + ids[1:]
        if v >= 2_000_000:  # v ** 3 must fit 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        _, at, times = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
        twice = times[at] > 1
        if twice.any():
            hit = np.zeros(n, bool)
            for k in range(3):
                hit[k:n - 2 + k] |= twice
            repeat = int(hit.sum())
    caps = len(text) - len(text.translate(_DROP_CAPS)) if len(raw) == len(text) else sum(map(str.isupper, text))
    letters = sum(map(str.isalpha, text)) if len(raw) != len(text) else len(text) - len(text.translate(_DROP_LETTERS))
    return n, chars, symbols, len(lines) - len(set(lines)), repeat, caps, letters, text.count("!")


_DROP_CAPS = {i: None for i in range(65, 91)}
_DROP_LETTERS = _DROP_CAPS | {i: None for i in range(97, 123)}


@F.arrow_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
def count_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = np.array([text_counts(t) for t in each_text(texts)], np.int64).reshape(-1, len(COUNTS))
        yield pa.StructArray.from_arrays([pa.array(c) for c in rows.T.copy()], list(COUNTS))


@dataclass(frozen=True)
class Rule:
    """Bad beyond ``bad``, good up to ``good``, abstains in between; a low text abstains."""

    name: str
    value: str  # SQL over COUNTS
    good: float
    bad: float
    least_words: int = 1


RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", 0.05, 0.2),
    Rule("symbol_share", "n_symbols / greatest(word_chars, 1)", 0.01, 0.03),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", 0.2, 0.4),
    Rule("lines", "n_dup_lines / greatest(n_words, 1) * 10", 0.1, 0.3),
    Rule("capitals", "n_caps / greatest(n_letters, 1)", 0.25, 0.5),
    Rule("marks", "n_marks / greatest(n_words, 1)", 0.1, 0.3),
    Rule("long_words", "word_chars / greatest(n_words, 1)", 10.0, 16.0),
    Rule("short", "-n_words", -80.0, -50.5, 0),
)


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    """One character per rule: + good, - bad, 0 abstains."""
    return F.concat(*[F.expr(
        f"CASE WHEN n_words < {r.least_words} THEN '0' WHEN {r.value} <= {r.good} THEN '+' "
        f"WHEN {r.value} > {r.bad} THEN '-' ELSE '0' END") for r in rules])


# What is believed of a rule before any text is seen: shares of bad, abstain, good votes.
PRIOR_GOOD, PRIOR_BAD = (0.002, 0.098, 0.9), (0.25, 0.1, 0.65)


PSEUDO, PSEUDO_GOOD = 200, 0.8  # texts that the belief counts as, and the share of good ones among them


def estimate(patterns: list[tuple[str, int]], rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good texts, rates[class (good, bad), rule, vote (bad, abstain, good)] and the
    posterior of each vote pattern.

    Rules hardly ever call a good text bad and each sees only some kinds of bad ones. That is
    the prior; it counts as PSEUDO texts (at most as half the corpus), so what the texts say
    outweighs it as soon as there are some hundreds. Without it a kind of bad text that one
    rule alone sees would pass for noise of that rule (maximum a posteriori).
    """
    marks = np.array([["-0+".index(c) for c in p] for p, _ in patterns])
    weight = np.array([n for _, n in patterns], float)
    rules, believed_texts = marks.shape[1], min(PSEUDO, weight.sum() / 2)
    rates = np.array([PRIOR_GOOD, PRIOR_BAD])[:, None, :].repeat(rules, axis=1)
    classes = np.array([PSEUDO_GOOD, 1 - PSEUDO_GOOD]) * believed_texts
    pseudo = rates * classes[:, None, None]
    share, good = PSEUDO_GOOD, np.ones(len(marks))
    for _ in range(rounds):
        log = [math.log(p) + np.log(rates[k, np.arange(rules), marks]).sum(axis=1)
               for k, p in enumerate((share, 1 - share))]
        fresh = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        done, good = np.abs(fresh - good).max() < 1e-6, fresh
        if done:
            break
        counted = np.stack([[((marks == v) * (weight * w)[:, None]).sum(axis=0) for v in range(3)]
                            for w in (good, 1 - good)]).transpose(0, 2, 1) + pseudo
        rates = counted / counted.sum(axis=2, keepdims=True)
        share = float(((weight * good).sum() + classes[0]) / (weight.sum() + believed_texts))
    return share, rates, good


def fit(patterns: list[tuple[str, int]]) -> dict[str, float]:
    """Probability of being good for each vote pattern. No patterns give no probabilities."""
    if not patterns:
        return {}
    return dict(zip((p for p, _ in patterns), estimate(patterns)[2].tolist(), strict=True))


def judged(docs: DataFrame, counted: DataFrame, at: float = 0.5) -> DataFrame:
    """``docs`` with ``__posterior`` and ``__kept``; needs the columns of COUNTS in both.

    ``counted`` is what EM learns from; texts that fail the base rules take no part in it.
    """
    spark = docs.sparkSession
    seen = counted.where(~base_failed()).groupBy(votes().alias("v")).agg(F.count("*").alias("n"))
    posterior = fit(sorted((r["v"], r["n"]) for r in seen.collect()))  # at most 3 ** rules rows
    known = spark.createDataFrame(list(posterior.items()), "__votes string, __posterior double")
    out = docs.withColumn("__votes", votes()).join(F.broadcast(known), "__votes", "left")
    return out.withColumn("__kept", ~base_failed() & (F.coalesce("__posterior", F.lit(0.0)) >= at)).drop("__votes")


def quality_verdicts(docs: DataFrame, at: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, posterior and kept for each row.

    Null and blank texts have no words and fail. Repeated rows each give a row and are each
    counted by EM. An empty table gives no rows.
    """
    counted = materialise(
        docs.select("doc_id", count_texts("text").alias("c")).select("doc_id", "c.*"), "quality-counts")
    out = judged(counted, counted, at)
    return out.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"),
                      F.col("__kept").alias("kept"), F.col("__posterior").alias("posterior"))


def kept(docs: DataFrame, at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and whose posterior is at least ``at``.

    Texts are counted once: rows are written with their counts, EM and the verdicts read those.
    Null and blank texts have no words and go. Repeated rows stay or go together. An empty
    table stays empty. Columns come back as they were, whatever they are called.
    """
    stored = materialise(docs.select(F.struct(*columns(docs)).alias("doc"), count_texts("text").alias("c")), "quality-counted")
    counted = stored.select("doc", "c.*")
    return judged(counted, counted.select(*COUNTS), at).where("__kept").select("doc.*")
