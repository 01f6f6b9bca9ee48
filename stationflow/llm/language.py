"""Language identification in two steps: family first, then the language within it.

Both steps are one-versus-one linear support vector machines over hashed byte bigrams and
trigrams of the whole lower-cased text: families against each other, then only the languages
of the chosen family. Each pair is trained in a task of its own by dual coordinate descent on
a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm.base import fold
from stationflow.session import materialise

# Families of language codes (fixed values); other languages are families of their own.
FAMILIES = {
    "germanic": "en de nl sv da nb nn no is af",
    "romance": "fr es it pt ro ca gl",
    "slavic": "ru uk be pl cs sk bg sr hr sl",
}
UNKNOWN = "und"
DIM = 1 << 13
SAMPLE = 400  # labelled texts a language trains on, at most
_CHUNK = 1 << 20


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def features(text: str) -> np.ndarray:
    """Unit vector of square roots of hashed bigram and trigram counts."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(DIM)
    for i in range(0, len(data), _CHUNK):
        part = data[max(0, i - 2):i + _CHUNK].astype(np.uint32)
        if len(part) < 2:
            continue
        two = (part[:-1] * np.uint32(2654435761)) ^ (part[1:] * np.uint32(40503))
        counts += np.bincount((two >> np.uint32(7)) % np.uint32(DIM), minlength=DIM)
        three = ((two[:-1] * np.uint32(31)) ^ (part[2:] * np.uint32(2246822519))) >> np.uint32(9)
        counts += np.bincount(three % np.uint32(DIM), minlength=DIM)
    counts = np.sqrt(counts)
    return (counts / (np.linalg.norm(counts) or 1.0)).astype(np.float32)


def fit_pair(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 20) -> np.ndarray:
    """Weights, bias last, of a linear machine for y in -1, 1 (squared hinge loss)."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    size = (x * x).sum(axis=1) + 0.5 / cost
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            step = (y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / cost) / size[i]
            fresh = max(alpha[i] - step, 0.0)
            if fresh != alpha[i]:
                w += (fresh - alpha[i]) * y[i] * x[i]
                alpha[i] = fresh
    return w


class Model:
    """Machines by level: (a, b) -> weights, for families and for each family's languages."""

    def __init__(self, langs: list[str], pairs: dict[tuple[str, str, str], np.ndarray]) -> None:
        self.levels: dict[str, tuple[list[str], list[tuple[int, int]], np.ndarray]] = {}
        groups = {"": sorted({family(x) for x in langs})}
        for x in sorted(langs):
            groups.setdefault(family(x), []).append(x)
        for level, names in groups.items():
            known = [(a, b) for a, b in combinations(names, 2)]
            weights = [pairs[level, a, b] for a, b in known]
            self.levels[level] = (names, [(names.index(a), names.index(b)) for a, b in known],
                                  np.array(weights, np.float32).reshape(-1, DIM + 1))

    def _choose(self, level: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Winner's index and share of the soft votes for each row."""
        names, pairs, weights = self.levels[level]
        votes = np.zeros((len(x), len(names)))
        margin = x @ weights[:, :-1].T + weights[:, -1]
        for k, (a, b) in enumerate(pairs):
            sure = 1 / (1 + np.exp(-3.0 * np.clip(margin[:, k], -50, 50)))
            votes[:, a] += sure
            votes[:, b] += 1 - sure
        best = votes.argmax(axis=1)
        duels = max(1, len(names) - 1)
        share = votes[np.arange(len(x)), best] / duels if len(names) > 1 else np.ones(len(x))
        return best, share, names

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.levels[""][0] else []
        for s in range(0, len(rows), 512):
            part = rows[s:s + 512]
            x = np.stack([features(texts[i]) for i in part])
            best, sure, families = self._choose("", x)
            for f in np.unique(best):
                at = np.flatnonzero(best == f)
                within, share, names = self._choose(families[f], x[at])
                for i, k, p in zip(at, within, share * sure[at], strict=True):
                    lang[part[i]], score[part[i]] = names[k], float(p)
        return lang, score


def training_sample(docs: DataFrame, per_lang: int = SAMPLE) -> DataFrame:
    """text, lang of at most ``per_lang`` labelled texts with a letter per language, chosen by a
    hash of the id.

    Labels are counted first. Only texts whose hash may be among the smallest (twice as many as
    wanted) are ranked, so a large language moves no more texts than a small one.
    """
    rows = docs.where("lang IS NOT NULL").select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("pick"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # the label set
    if sizes:
        limit = F.create_map(*[x for r in sizes for x in (
            F.lit(r["lang"]), F.lit(min(1 << 30, (2 * per_lang + 100) * (1 << 30) // r["n"])))])
        rows = rows.where(F.col("pick") <= limit[F.col("lang")])
    rows = rows.where(F.col("text").rlike("\\p{L}"))
    first = Window.partitionBy("lang").orderBy("pick", "text")
    return rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_lang).select("lang", "text")


def train(docs: DataFrame, per_lang: int = SAMPLE) -> Model:
    """``docs`` has lang and text. Rows without a language or a letter teach nothing."""
    spark = docs.sparkSession
    sample = materialise(training_sample(docs, per_lang), "language-sample")
    langs = [r["lang"] for r in sample.select("lang").distinct().collect()]  # the label set
    families = sorted({family(x) for x in langs})
    duels = [("", a, b, x, 1 if family(x) == a else -1) for a, b in combinations(families, 2)
             for x in langs if family(x) in (a, b)]
    for f in families:
        own = sorted(x for x in langs if family(x) == f)
        duels += [(f, a, b, x, 1 if x == a else -1) for a, b in combinations(own, 2) for x in (a, b)]
    if not duels:
        return Model(langs, {})
    table = spark.createDataFrame(duels, "level string, a string, b string, lang string, y int")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        w = fit_pair(np.stack([features(t) for t in pdf["text"]]), pdf["y"].to_numpy())
        return pd.DataFrame({"level": pdf["level"][:1], "a": pdf["a"][:1], "b": pdf["b"][:1],
                             "w": [w.astype(np.float32).tobytes()]})

    fitted = sample.join(F.broadcast(table), "lang").groupBy("level", "a", "b").applyInPandas(
        fit, "level string, a string, b string, w binary").collect()  # a few KB per pair of labels
    return Model(langs, {(r["level"], r["a"], r["b"]): np.frombuffer(r["w"], np.float32) for r in fitted})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row; ``und`` with score 0 for a null text, one without
    a letter, or a model that has learned no language."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = model.predict(list(texts))
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.select("doc_id", predict("text").alias("p")).select("doc_id", "p.lang_pred", "p.score")


def identified(docs: DataFrame, per_lang: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row: learned from the folds that are not
    held out (crc32 of the id modulo 3 is not 1), predicted from the text alone.

    Repeated rows each give a row; a null id is not held out. An empty table gives no rows.
    """
    held = fold(F.col("doc_id"), 3) == 1
    model = train(docs.where(~held).select("doc_id", "lang", "text"), per_lang)
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
