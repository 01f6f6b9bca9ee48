"""Language identification, licence scans and class bigrams."""

from __future__ import annotations

import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest

from stationflow.llm import brown, language, licenses, queries
from test_text_operators import BLANK_WORD, ascii_lower, table_rows

# --- 3 ---------------------------------------------------------------------------------


def held(doc_id, folds):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 1


def test_language_query_on_held_out_texts(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op3_language(spark, sf_dir).collect()}
    rows = table_rows(spark, sf_dir, "documents", "doc_id", "text", "lang")
    assert set(got) == {r[0] for r in rows}
    assert all(got[i]["held_out"] == held(i, 3) and 0 <= got[i]["score"] <= 1 for i, _, _ in rows)
    right = [got[i]["lang_pred"] == lang for i, text, lang in rows if held(i, 3) and lang and len(text or "") > 200]
    assert sum(right) / len(right) > 0.97


def test_language_on_fixture(spark, docs, rows, empty):
    got = language.identified(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {x[0]: x[1] for x in rows}[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        assert r["lang_pred"] in ("en", "fr", "und") and 0 <= r["score"] <= 1
    assert language.identified(empty).collect() == []
    unlabelled = docs.withColumn("lang", docs["lang"].substr(9, 9)).where("doc_id < 0 OR lang IS NULL")
    assert {r["lang_pred"] for r in language.identified(unlabelled).collect()} <= {"und"}
    one = docs.where("lang = 'en'")
    assert {r["lang_pred"] for r in language.identified(one).collect()} <= {"en", "und"}


def test_families_come_first(spark):
    rng = random.Random(2)
    alphabets = {"en": "abc", "de": "abd", "fr": "xyz", "es": "xyw", "zz": "mno"}
    data = [(i, " ".join("".join(rng.choices(alphabets[x], k=5)) for _ in range(40)), x)
            for i, x in enumerate(list(alphabets) * 40)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identified(frame, per_lang=20).collect()}
    assert sum(got[i] == x for i, _, x in data) / len(data) > 0.98
    assert language.family("de") == language.family("en") != language.family("fr") and language.family("zz") == "zz"
    sample = language.training_sample(frame, 7).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in sample} == dict.fromkeys(alphabets, 7)


# --- 5 ---------------------------------------------------------------------------------

def test_every_wording_is_found_and_changed_ones_are_not():
    for name, wordings in licenses.TEMPLATES.items():
        for w in wordings:
            assert licenses.confirmed(w)[::2] == (name, 0), w
            assert licenses.confirmed("See here. " + w.upper() + " Thanks")[0] == name
    for text in ("He had no license to do that.", "copyright by nobody", "licensed to nobody under any terms", "licence"):
        assert licenses.confirmed(text) is None


def test_licenses_on_fixture(spark, docs, rows, empty):
    mit = licenses.TEMPLATES["MIT"][0]
    data = [(1, f"A line\n{mit}\nend"), (2, None), (3, ""), (4, "é\U0001F600 " + mit), (5, ("word " * 5000) + mit + " word" * 50),
            (1, f"A line\n{mit}\nend"), (None, mit), (6, f"{mit}\n" * 3), (7, "license " * 9000)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_scan(frame).collect()}
    assert len(licenses.license_scan(frame).collect()) == len(data)
    assert got[1]["spans"] == f"MIT:7:{7 + len(mit)}:0:0" and got[4]["spans"].startswith("MIT:0:")
    assert (got[2]["n_blocks"], got[3]["n_licenses"], got[2]["licenses"]) == (0, 0, "")
    assert got[5]["licenses"] == "MIT" == got[None]["licenses"] and got[6]["n_licenses"] == 1 and got[7]["n_licenses"] == 0
    assert got[6]["spans"].count("MIT") == 1 or got[6]["spans"].count("MIT") == 3
    assert licenses.license_scan(docs).count() == len(rows) and licenses.license_scan(empty).collect() == []


def wrapped(wording, width, mark):
    return "\n".join(mark + line for line in textwrap.wrap(wording, width, break_on_hyphens=False))


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- ", ";; "])
def test_wrapped_and_commented_notices(mark):
    for name, wording in licenses.wordings():
        for width in (40, 72):
            notice = wrapped(wording, width, mark)
            text = "int main() {}\n" + notice + "\n" + "other words follow here. " * 30
            assert [f[0] for f in licenses.scan(text)[1]] == [name], text
            (_, a, b, saved, differing, _), = licenses.scan(text)[1]
            assert differing == 0 and saved > 0 and text[a:b] == notice


def test_adjacent_notices_and_false_friends():
    def names(text):
        return [f[0] for f in licenses.scan(text)[1]]

    assert names("Released under the MIT License. Licensed under CC BY 4.0.") == ["MIT", "CC-BY-4.0"]
    every = licenses.wordings()
    assert names(" ".join(w for _, w in every)) == [n for n, _ in every]
    assert names("".join(w + "\n" for _, w in every) * 2) == 2 * [n for n, _ in every]
    mit = licenses.TEMPLATES["MIT"][1].split()
    assert names(" ".join(mit[:9] + ["kindly"] + mit[9:20] + mit[21:])) == ["MIT"]  # a word more, a word less
    assert names(" ".join(mit[::2])) == [] == names(" ".join(reversed(mit)))
    for text in ("This work is licensed under the GNU General Public License, version 1.", "Licensed under CC BY 3.0.",
                 "Licensed under the Apache License, Version 1.1.", "SPDX-License-Identifier: LicenseRef-Own",
                 "Licensed under terms by which 4.0 cc of it may leave.", "license " * 9000, "copyright " + "\U0001F600" * 3000):
        assert names(text) == [], text


def spans_slow(wording, mine):
    """Cheapest alignment of the wording with any run of the words, by trying every run."""
    def cost(run):
        row = [i * licenses.ADDED for i in range(len(run) + 1)]
        for i, want in enumerate(wording, 1):
            now = [i * licenses.CHANGED]
            for j, w in enumerate(run, 1):
                now.append(min(row[j - 1] + (want != w) * licenses.CHANGED, row[j] + licenses.CHANGED, now[-1] + licenses.ADDED))
            row = now
        return row[-1]

    return min(cost(mine[a:b]) for a in range(len(mine) + 1) for b in range(a, len(mine) + 1))


def test_alignment_like_every_run():
    rng = random.Random(5)
    for _ in range(60):
        wording = tuple(rng.choices("abcd", k=rng.randint(1, 9)))
        mine = rng.choices("abcde", k=rng.randint(1, 14))
        if rng.random() < 0.5:
            mine[rng.randint(0, len(mine)):0] = wording
        got, limit = licenses.aligned(wording, mine), licenses.CHANGED * licenses.MISSING * len(wording)
        best = spans_slow(wording, mine)
        assert (min(g[0] for g in got) == best) if best <= limit else got == []


def test_license_query_against_a_search_for_the_lines(spark, sf_dir):
    got = {r["doc_id"]: r["licenses"] for r in queries.op5_licenses(spark, sf_dir).collect()}
    exact = {w: n for n, ws in licenses.TEMPLATES.items() for w in ws}
    for doc_id, text in table_rows(spark, sf_dir, "documents", "doc_id", "text"):
        lines = {exact[x] for x in (text or "").split("\n") if x in exact}
        assert set(got[doc_id].split(",")) - {""} == lines or lines < set(got[doc_id].split(","))


# --- 10 --------------------------------------------------------------------------------

def tokens_slow(text):
    return [*BLANK_WORD.findall(ascii_lower(text)), "\n"]


def base_slow(rows):
    counts = Counter(t for i, x in rows if not held(i, 5) for t in tokens_slow(x))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, x in rows:
        words = tokens_slow(x)
        out[i] = (held(i, 5), len(words), sum(w in counts for w in words), n,
                  sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
    return out, counts


def check(got, rows):
    want, _ = base_slow(rows)
    assert {r["doc_id"] for r in got} == set(want)
    for r in got:
        w = want[r["doc_id"]]
        assert tuple(r)[1:5] == w[:4]
        assert math.isclose(r["base_score"], w[4], rel_tol=1e-9) and r["score"] < 0


def test_brown_query(spark, sf_dir):
    rows = table_rows(spark, sf_dir, "documents", "doc_id", "text")
    got = queries.op10_brown_scores(spark, sf_dir).collect()
    check(got, rows)
    out = [r for r in got if r["held_out"]]
    # The classes must tell more about unseen texts than single words do.
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_brown_on_fixture_whatever_the_sizes(spark, docs, rows, empty):
    pairs = sorted({(r[0], r[1]) for r in rows}, key=repr)
    results = []
    for size in (brown.Size(), brown.Size(core=5, classes=3, local=20), brown.Size(core=5, classes=3, local=10**6),
                 brown.Size(core=0, local=0)):
        got = brown.perplexity_scores(docs.dropDuplicates(["doc_id", "text"]), size).collect()
        check(got, pairs)
        results.append({r["doc_id"]: r["score"] for r in got})
        again = {r["doc_id"]: r["score"] for r in brown.perplexity_scores(docs, size).collect()}
        assert set(again) == set(results[-1])
    assert all(math.isclose(results[1][i], results[2][i], rel_tol=1e-9) for i in results[1])
    assert brown.perplexity_scores(empty).collect() == []


def test_scores_are_those_of_the_classes():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 9, (30, 30)).astype(float)
    pairs[:10, 10:20] += 40
    pairs[10:20, :10] += 40
    of = brown.exchange(pairs, 20, 2, 10)
    start = np.concatenate([np.arange(20) % 2, 2 + np.arange(10)])
    assert brown.likelihood(pairs, of) > brown.likelihood(pairs, start)
    assert len(set(of[:10])) == 1 == len(set(of[10:20])) and of[0] != of[10]
    for w in range(20):  # no single move is better
        for c in range(2):
            moved = of.copy()
            moved[w] = c
            assert brown.likelihood(pairs, moved) <= brown.likelihood(pairs, of) + 1e-6
    t = brown.transitions(np.array([[3.0, 1], [0, 0]]))
    assert np.allclose((10 ** t).sum(axis=1), 1)


def test_probabilities_of_all_words_sum_to_one(spark):
    """Over the words that a class knows plus one unknown, emissions sum to one."""
    rng = random.Random(4)
    data = [(i, " ".join(rng.choices(["aa", "bb", "cc", "dd", "ee", "ff"], k=12))) for i in range(40)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = brown.perplexity_scores(frame, brown.Size(core=2, classes=1, local=3)).collect()
    check(got, data)
    assert re.fullmatch(r"[0-9]+", str(got[0]["train_tokens"]))


def scores_slow(rows, size):
    """Every word of the training texts moves alone, by its own occurrences; no Spark."""
    texts = {i: [w.encode() for w in tokens_slow(x)] for i, x in rows}
    train = [t for i, t in texts.items() if not held(i, 5)]
    counts = Counter(w for t in train for w in t)
    words = sorted((w for w in counts if w != brown.END), key=lambda w: (-counts[w], w))
    core = {w: i for i, w in enumerate(words[:size.core])}

    def table_of(of, n):
        out = np.zeros((n, n))
        for t in train:
            for a, b in zip([brown.END, *t], t, strict=False):
                out[of(a), of(b)] += 1
        return out

    end = len(core) + brown.TAILS

    def symbol(w):
        return end if w == brown.END else core.get(w, len(core) + brown.tail(w))

    first = brown.exchange(table_of(symbol, end + 1), len(core), size.classes, size.sweeps)
    n = int(first.max()) + 1
    of = {w: first[symbol(w)] for w in counts}

    def learned(of):
        held_by = np.bincount(list(of.values()), minlength=n).astype(float)
        held_by[-1] = 1
        return brown.Model(table_of(of.get, n), held_by)

    model = learned(of)
    for _ in range(size.rounds):
        left, right = np.split(model.gains(), [n])
        gain = {w: np.zeros(n - 1) for w in counts}
        for t in train:
            for a, w, b in zip([brown.END, *t], t, t[1:], strict=False):
                gain[w] += left[of[a]] + right[of[b]]
        then = {w: n - 1 if w == brown.END else int(g.argmax()) for w, g in gain.items()}
        better = learned(then)
        if better.likelihood <= model.likelihood:
            break
        of, model = then, better
    out = {}
    for i, t in texts.items():
        cls = [of.get(w, first[symbol(w)]) for w in [brown.END, *t]]
        out[i] = sum(model.trans[a, b] + math.log10((counts[w] + 0.5) / model.room[b])
                     for a, b, w in zip(cls, cls[1:], t, strict=False))
    return out, of


def test_every_training_word_moves_by_its_own_occurrences(spark):
    rng = random.Random(6)
    kinds = [[f"{k}{i}" for i in range(60)] for k in "abc"]
    data = [(i, " ".join(rng.choice(kinds[j % 3][:rng.choice([3, 60])]) for j in range(rng.randint(0, 40)))) for i in range(60)]
    data += [(100, None), (101, "never seen before " * 3)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for rounds, local in ((1, 30), (1, 10**6), (3, 30)):
        size = brown.Size(core=6, classes=3, local=local, rounds=rounds)
        want, of = scores_slow(data, size)
        beyond = [w for w in of if w != brown.END and not w.endswith((b"0", b"1", b"2"))]
        assert len(beyond) > 100 and len({of[w] for w in beyond if brown.tail(w) == brown.tail(beyond[0])}) > 1
        got = brown.perplexity_scores(frame, size).collect()
        check(got, data)
        for r in got:
            assert math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9)


def test_words_beyond_the_core_are_told_apart_by_their_neighbours(spark):
    """Two kinds of words with one ending and equal counts: only their neighbours differ."""
    train = [i for i in range(1000) if not held(i, 5)]
    first, second = [i for i in range(1000, 2000) if held(i, 5)][:2]
    texts = [f"the n{j}zz did v{j}zz" for j in range(2, 32) for _ in range(3)] + [f"the n{j}zz did v{j}zz" for j in (0, 1) for _ in range(20)]
    data = [*zip(train, texts, strict=False), (first, "the n5zz did v9zz"), (second, "the v9zz did n5zz")]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r for r in brown.perplexity_scores(frame, brown.Size(core=6, classes=4, local=10)).collect()}
    assert got[first]["base_score"] == pytest.approx(got[second]["base_score"])
    assert got[first]["score"] > got[second]["score"] + 3


def test_without_training_texts_nothing_is_known(spark):
    data = [(i, "a b a") for i in range(100) if held(i, 5)]
    got = brown.perplexity_scores(spark.createDataFrame(data, "doc_id long, text string")).collect()
    check(got, data)
    assert {r["n_known"] for r in got} == {0}
