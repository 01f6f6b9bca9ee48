"""Decontamination, SimHash, quality, personal data and mixing against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import differences, duck
from stationflow import session
from stationflow.llm import components, decontaminate, mixing, pii, queries, quality, simhash, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table_rows(spark, sf, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*cols).collect()]


# --- 1 ---------------------------------------------------------------------------------

def near_items_slow(w, items, window=10, edits=2):
    """Ids of the (id, words) items with a near window: every window and every band is counted."""
    places, ids = {}, set()
    for p, pair in enumerate(zip(w, w[1:], strict=False)):
        places.setdefault(pair, []).append(p)
    need = max(1, window - 1 - 2 * edits)
    for item_id, v in items:
        if len(v) < window:
            continue
        hits = {(i, p - i) for i, pair in enumerate(zip(v, v[1:], strict=False)) for p in places.get(pair, ())}
        if len({i for i, _ in hits}) >= need and any(
                len({i for i, e in hits if s <= i <= s + window - 2 and d <= e <= d + edits}) >= need
                for s in range(len(v) - window + 1) for d in {e - k for _, e in hits for k in range(edits + 1)}):
            ids.add(item_id)
    return sorted(str(i) for i in ids if i is not None)


def contamination_slow(docs, items, window=10):
    windows = {}
    worded = [(i, WORD.findall(ascii_lower(t))) for i, t in set(items)]
    for item_id, text in set(items):
        w = WORD.findall(ascii_lower(text))
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows.setdefault(k, {}).setdefault(tuple(w[s:s + k]), set()).add(item_id)
    out = []
    for doc_id, text in set(docs):
        w = WORD.findall(ascii_lower(text))
        hit, ids = set(), set()
        for k, known in windows.items():
            for s in range(len(w) - k + 1):
                if (owner := known.get(tuple(w[s:s + k]))) is not None:
                    hit.update(range(s, s + k))
                    ids |= owner
        listed = sorted(str(i) for i in ids if i is not None)
        near = near_items_slow(w, worded, window)
        out.append((doc_id, len(w), len(hit), len(listed), sha(",".join(listed)), bool(hit), len(near), sha(",".join(near))))
    return sorted(out, key=repr)


def test_contamination_on_fixture(spark, docs, rows, empty):
    texts = [r[1] for r in rows]
    items = [(1, " ".join(texts[0].split()[20:45])), (2, "TWO"), (3, None), (4, ""), (5, texts[11][500:900]),
             (None, texts[3][30:200]), (1, texts[14][:90]), (2, "TWO"), (10, "not there at all, no word of it"), (11, "nul É")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, frame)
    assert found(got) == contamination_slow([(r[0], r[1]) for r in rows], items)
    assert decontaminate.contamination(empty, frame).collect() == []
    none = decontaminate.contamination(docs, frame.limit(0))
    assert not any(r["contaminated"] for r in none.collect()) and none.count() == len({r[:2] for r in rows})
    left = decontaminate.clean(docs, frame)
    assert left.columns == docs.columns
    bad = {r[0] for r in contamination_slow([(r[0], r[1]) for r in rows], items) if r[5]}
    assert {r["doc_id"] for r in left.collect()} == {r[0] for r in rows} - bad


def test_near_passages_are_found(spark):
    draw = random.Random(7)
    passage = [f"w{draw.randrange(400)}" for _ in range(60)]
    filler = [f"f{draw.randrange(400)}" for _ in range(80)]

    def text(words):
        return " ".join(filler[:40] + words + filler[40:])

    inserted = [x for i, w in enumerate(passage) for x in ([w, "and"] if i % 7 == 3 else [w])]
    dropped = [w for i, w in enumerate(passage) if i % 8 != 3]
    changed = ["other" if i % 6 == 2 else w for i, w in enumerate(passage)]
    scattered = ["other" if i % 2 else w for i, w in enumerate(passage)]
    shuffled = random.Random(8).sample(passage, 60)
    docs = [(1, text(inserted)), (2, text(dropped)), (3, text(changed)), (4, text(scattered)), (5, text(shuffled)),
            (6, " ".join(filler)), (7, None), (8, text(passage)), (8, text(passage)), (9, ""), (None, text(changed))]
    items = [(1, " ".join(passage)), (2, " ".join(passage[:9])), (None, " ".join(passage[5:40])), (3, None), (4, "")]
    got = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == contamination_slow(docs, items)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert {i for i, r in rows.items() if r["n_near_items"]} == {1, 2, 3, 8, None}
    assert {i for i, r in rows.items() if r["contaminated"]} == {8}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    left = decontaminate.clean(frame, spark.createDataFrame(items, "item_id long, text string"), edits=2)
    assert sorted(r["doc_id"] for r in left.collect()) == [4, 5, 6, 7, 9]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=14), min_size=1, max_size=5),
       st.lists(st.lists(st.sampled_from("abcd"), max_size=9), min_size=1, max_size=4), st.sampled_from([(4, 0), (4, 1), (5, 1), (3, 2)]))
def test_near_windows_like_counting_all(spark, texts, passages, setting):
    window, edits = setting
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(passages)], "item_id long, text string")
    near = decontaminate.proximity_matches(decontaminate.index_of(docs, items, window), edits).collect()
    got = {}
    for r in near:
        got.setdefault(r["doc_id"], set()).add(str(r["item_id"]))
    worded = list(enumerate(passages))
    assert {i: sorted(v) for i, v in got.items()} == {
        i: ids for i, t in enumerate(texts) if (ids := near_items_slow(t, worded, window, edits))}


def test_contamination_query(spark, sf_dir):
    got = queries.op1_decontamination(spark, sf_dir)
    assert found(got) == contamination_slow(
        table_rows(spark, sf_dir, "documents", "doc_id", "text"), table_rows(spark, sf_dir, "benchmark", "item_id", "text"))


# --- 4 ---------------------------------------------------------------------------------

def fingerprint_slow(text, words=3):
    w = BLANK_WORD.findall(ascii_lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def near_slow(pairs, radius=3):
    fps = {i: fingerprint_slow(t) for i, t in pairs}
    ids, root = list(fps), {i: i for i in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array([fps[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1:] ^ values[k]) <= radius):
            a, b = top(i), top(ids[k + 1 + j])
            root[max(a, b)] = min(a, b)
    return {i: (f"{fps[i]:016x}", top(i)) for i in ids}


def test_near_duplicates_on_fixture(docs, rows, empty):
    want = near_slow({(r[0], r[1]) for r in rows if r[0] is not None})
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert simhash.near_duplicates(empty).collect() == []
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted({c for _, c in want.values()})
    assert simhash.one_of_each(empty).collect() == []


@pytest.mark.parametrize("max_bucket", [1024, 8])
def test_near_duplicates_in_crowded_buckets(spark, max_bucket):
    rng, base = random.Random(3), 0x123456789ABCDEF
    values = {base}
    while len(values) < 400:
        x = rng.choice([base, *list(values)[:5]])
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        values.add(x)
    fps = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    roots = components.connected_components(simhash.links(
        spark.createDataFrame([(f,) for f in fps], "fp long"), 3, max_bucket)).collect()
    got = {r["node"]: r["root"] for r in roots}
    mine = simhash.spanning_links(np.array(fps, np.int64), 64)
    assert len(mine) == len(fps) - 1
    want = {}
    for f in fps:  # flood fill
        if f in want:
            continue
        stack, want[f] = [f], f
        while stack:
            a = stack.pop()
            for b in fps:
                if b not in want and (np.uint64(a % 2**64) ^ np.uint64(b % 2**64)).item().bit_count() <= 3:
                    want[b] = want[f]
                    stack.append(b)
    groups = Counter(want.values())
    low = {}
    for f, w in want.items():
        low[w] = min(low.get(w, f), f)
    assert got == {f: low[w] for f, w in want.items() if groups[w] > 1}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_masks_cover_the_radius(kept, x, flips):
    y = x
    for b in set(flips):
        y ^= (1 << b) & ~kept
    assert any(x & m == y & m for m in simhash.covering_masks(kept, 3))
    assert all(m & kept == kept for m in simhash.covering_masks(kept, 3))


def test_near_duplicates_query(spark, sf_dir):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash(spark, sf_dir).collect()}
    assert got == near_slow(table_rows(spark, sf_dir, "documents", "doc_id", "text"))


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000), (-5, 700)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, -5: -5, 700: -5}


def test_components_take_few_tables(spark, monkeypatch):
    """Many partitions and a chain: each task contracts what it holds, so rounds are few."""
    made = []
    fresh = session.fresh_path
    monkeypatch.setattr(session, "fresh_path", lambda s, name: made.append(name) or fresh(s, name))
    chain = spark.range(0, 400, 1, 40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = components.connected_components(chain.repartition(40, "a"))
    assert {(r["node"], r["root"]) for r in roots.collect()} == {(i, 0) for i in range(401)}
    assert len(made) <= 5
    nothing = spark.createDataFrame([(1, 1)], "a long, b long")
    assert components.connected_components(nothing).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), max_size=25))
def test_stars_of_links(pairs):
    pairs = [(a, b) for a, b in pairs if a != b]
    a, b = components.stars(*np.array(pairs, np.int64).reshape(-1, 2).T)
    low = {x: x for p in pairs for x in p}
    for _ in low:
        for x, y in pairs:
            low[x] = low[y] = min(low[x], low[y])
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {x: r for x, r in low.items() if x != r}


# --- 6 ---------------------------------------------------------------------------------

def counts_slow(text):
    text = text or ""
    w = BLANK_WORD.findall(text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if BLANK_WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB é#|!\n\t\x0b\x1c\u2003x"), max_size=120))
def test_counts(text):
    assert quality.text_counts(text)[:5] == counts_slow(text)
    assert quality.text_counts(text)[5:] == (
        sum(map(str.isupper, text)), sum(map(str.isalpha, text)), text.count("!"))


def test_quality_on_fixture(docs, rows, empty):
    got = quality.quality_verdicts(docs).collect()
    base = sorted((r[0], *counts_slow(r[1])) for r in rows if r[0] is not None)
    assert sorted(tuple(r)[:6] for r in got if r["doc_id"] is not None) == base
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    left = quality.kept(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert quality.quality_verdicts(empty).collect() == [] and quality.kept(empty).collect() == []


def test_em_finds_the_bad_without_labels():
    rng, n = np.random.default_rng(5), 4000
    bad = rng.random(n) < 0.15
    kind = rng.integers(0, 2, n)
    seen = Counter()
    for b, k in zip(bad, kind, strict=True):  # two kinds of bad texts, each seen by two rules of six
        v = ["-" if b and i // 2 == k and rng.random() < 0.9 else "0" if rng.random() < 0.1 else "+" for i in range(6)]
        seen["".join(v), b] += 1
    p = quality.fit(sorted(Counter({v: sum(seen[v, x] for x in (False, True)) for v, _ in seen}).items()))
    right = sum(c for (v, b), c in seen.items() if (p[v] < 0.5) == b)
    assert right / n > 0.97
    assert quality.fit([]) == {}


@pytest.mark.parametrize("share", [0.01, 0.05, 0.3])
def test_em_recovers_planted_rates(share):
    """Rates of rules of different worth, whatever the share of bad texts."""
    rng, n = np.random.default_rng(11), 60_000
    bad = rng.random(n) < share
    rates = np.array([[(0.01, 0.04, 0.95), (0.02, 0.18, 0.8), (0.005, 0.295, 0.7), (0.03, 0.07, 0.9), (0.01, 0.39, 0.6)],
                      [(0.9, 0.05, 0.05), (0.6, 0.2, 0.2), (0.75, 0.2, 0.05), (0.5, 0.1, 0.4), (0.3, 0.6, 0.1)]])
    below = rates[bad.astype(int)].cumsum(axis=2)
    drawn = (rng.random((n, 5, 1)) > below[..., :2]).sum(axis=2)
    seen = Counter("".join("-0+"[v] for v in row) for row in drawn)
    good, found_rates, _ = quality.estimate(sorted(seen.items()))
    assert abs(1 - good - share) < 0.005 + 0.05 * share
    assert np.abs(found_rates[0] - rates[0]).max() < 0.01
    assert np.abs(found_rates[1] - rates[1]).max() < (0.15 if share == 0.01 else 0.05)


def test_quality_query_agrees_with_labels(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op6_quality_rules(spark, sf_dir).collect()}
    texts = dict(table_rows(spark, sf_dir, "documents", "doc_id", "text"))
    assert {i: tuple(r)[1:6] for i, r in got.items()} == {i: counts_slow(t) for i, t in texts.items()}
    labels = table_rows(spark, sf_dir, "labels", "doc_id", "quality")
    good = [got[i]["kept"] or got[i]["base_failed"] for i, q in labels if q == 1 and i in got]
    bad = [got[i]["kept"] for i, q in labels if q == 0 and i in got]
    assert sum(good) / len(good) > 0.97
    assert sum(bad) / max(1, len(bad)) < 0.3


# --- 7 ---------------------------------------------------------------------------------

def test_url_query_matches_sql(spark, sf_dir):
    name = "op7_url_filter"
    assert differences(spark, duck(sf_dir), name, entry.queries()[name], entry.oracle_sql()[name], sf_dir) is None


def test_urls_on_fixture(spark):
    urls = ["https://A.Example.NET/en/1", "http://example.net", "http://example.net/x#/en/", "http://xexample.net/en/",
            "x://a.example.com/de/", "http://example.com/de", "http://q.org/fr/?a=1", "org/fr/", None, "", "://", "http:///p",
            "HTTP://B.example.com/p?z=1&utm_source=q&a=2#f", "http://www.b.example.com:80/p?a=2&z=1", "http://b.example.com/other",
            "http://b.example.com/other", "http://net.com/en/", "mailto://x@y.net/p", "http://com/?u=http://net/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[0])], "page_id long, url string").withColumn(
        "rule", spark.range(1).selectExpr("'x' AS r").first()["r"] == url_filter.host("url"))
    listed = spark.createDataFrame([("http://b.example.com/p?a=2&z=1",), (None,), ("no url",)], "url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, listed).collect()}
    assert len(got) == len(urls) + 1
    rules = {i: got[i]["rule"] for i in range(len(urls))}
    assert rules == {**{i: None for i in range(len(urls))}, 0: "example.net/en/", 2: "net/", 3: "net/", 4: "example.com/de/",
                     6: "org/fr/", 17: "net/"}
    assert [i for i in range(len(urls)) if got[i]["verdict"] == "block"] == [2, 3, 4, 12, 13, 17]
    assert got[12]["host"] == "b.example.com" and got[12]["path"] == "/p" and got[8]["host"] == "" == got[8]["path"]
    assert [r["verdict"] for r in url_filter.judge_urls(pages, listed.limit(0)).where("page_id = 12").collect()] == ["allow"]
    assert url_filter.judge_urls(pages.limit(0), listed).collect() == []


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS __key")
    table, blocks = url_filter.bloom_table(keys, 12)
    assert table.count() <= blocks
    probe = spark.range(20000).selectExpr("concat('k', id) AS __key").selectExpr("*", f"pmod(xxhash64(__key), {blocks}) AS block")
    rows = probe.join(table, "block", "left")
    possible = None
    for j, b in enumerate(url_filter._bits(None)):
        one = rows[f"w{j}"].bitwiseAND(b) == b
        possible = one if possible is None else possible & one
    hits = [int(r["__key"][1:]) for r in rows.where(possible).select("__key").collect()]
    assert {h for h in hits if h < 5000} == set(range(5000))
    assert len(hits) < 5000 + 15000 * 0.05


# --- 8 ---------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12))
def test_every_source_stays_within_a_block_of_its_share(weights):
    whole = list(mixing.whole_weights({f"s{i:02}": w for i, w in enumerate(weights)}).values())
    assert [Fraction(n, sum(whole)) for n in whole] == [Fraction(w, sum(weights)) for w in weights]
    plan = list(mixing.schedule(whole, sum(whole), [2 * n for n in whole]))
    assert [p[2] for p in plan] == list(range(2 * sum(whole)))
    done = Counter()
    for t, (s, k, slot) in enumerate(plan):
        assert k == done[s] and slot == t
        done[s] += 1
        for i, n in enumerate(whole):
            assert abs(done[i] - Fraction(n * (t + 1), sum(whole))) < 1


def test_mixture_on_fixture(spark, docs, rows, empty):
    got = mixing.mix(docs, {"s0": 2, "s1": 1, None: 1, "s2": 0}, block=2, buckets=4).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert all((r["slot"] is None) == (r["source"] == "s2") for r in got)
    order = sorted((r for r in got if r["slot"] is not None), key=lambda r: (r["slot"], r["place"]))
    assert len({(r["slot"], r["place"]) for r in order}) == len(order)
    by_slot = {}
    for r in order:
        by_slot.setdefault(r["slot"], set()).add(r["source"])
    assert all(len(s) == 1 for s in by_slot.values())
    first = [next(iter(by_slot[s])) for s in sorted(by_slot)][:4]
    assert first.count("s0") == 2 and mixing.mix(empty, {"s0": 1}).collect() == []
    assert mixing.mix(empty, {}).collect() == []
    # Columns of these names give way to the result's.
    named = mixing.mix(docs.withColumn("Place", F.lit("x")), {"s0": 1})
    assert named.columns == [*(c for c in docs.columns if c != "slot"), "slot", "place"]
    assert dict(named.dtypes)["slot"] == "bigint" and dict(named.dtypes)["place"] == "int" and named.count() == len(rows)


def test_mixing_query(spark, sf_dir):
    got = queries.op8_mixing(spark, sf_dir).collect()
    rows = table_rows(spark, sf_dir, "documents", "doc_id", "source")
    assert sorted((r["doc_id"], r["source"]) for r in got) == sorted(rows)
    assert len({(r["slot"], r["place"]) for r in got}) == len(rows)
    size = Counter(s for _, s in rows)
    weights = {s: Fraction(n ** 0.5) for s, n in size.items()}
    total = sum(weights.values())
    slots = {r["slot"]: r["source"] for r in got}
    end = min(max(r["slot"] for r in got if r["source"] == s) for s in size)
    done = Counter()
    for t in range(end):
        done[slots[t]] += 1
        assert all(abs(done[s] - weights[s] / total * (t + 1)) < 1 for s in size)


@pytest.mark.parametrize("n", [1, 20, 300])
def test_every_prefix_keeps_to_the_given_weights(n):
    weights = {"hot": n / 2, None: 0.3} | {f"s{i}": 1.0 for i in range(n)}
    whole = mixing.whole_weights(weights)
    total = sum(map(Fraction, weights.values()))
    assert all(Fraction(whole[s], sum(whole.values())) == Fraction(w) / total for s, w in weights.items())
    blocks = [-(-3000 * w // sum(whole.values())) for w in whole.values()]
    done, order = Counter(), list(whole)
    for t, (i, k, slot) in enumerate(mixing.schedule(list(whole.values()), sum(whole.values()), blocks)):
        if t == 2000:
            break
        assert (k, slot) == (done[order[i]], t)
        done[order[i]] += 1
        assert all(abs(done[s] - Fraction(w) / total * (t + 1)) < 1 for s, w in weights.items())


@pytest.mark.parametrize("bound", [0, 10_000])
def test_mixture_of_a_hot_source_and_many_others(spark, bound):
    sizes = {"hot": 700, **{f"s{i}": 7 for i in range(100)}}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    weights = {s: float(n) for s, n in sizes.items()}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=1, broadcast_blocks=bound).collect()
    assert sorted((r["doc_id"], r["source"]) for r in got) == rows
    order = sorted(got, key=lambda r: (r["slot"], r["place"]))
    assert [r["slot"] for r in order] == list(range(1400))
    done = Counter()
    for t, r in enumerate(order, 1):
        done[r["source"]] += 1
        assert all(abs(done[s] * 1400 - n * t) < 1400 for s, n in sizes.items())


# --- 9 ---------------------------------------------------------------------------------

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(re.sub("[ -]", "", v)) <= 19 and luhn(re.sub("[ -]", "", v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_slow(text):
    spans = sorted((m.start(), list(BASE).index(k), f"{k}:{m.start()}:{m.end()}")
                   for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m.group(0)))
    names = [s[2].split(":")[0] for s in spans]
    return (*(names.count(k) for k in BASE), sha(",".join(s[2] for s in spans)))


PERSONAL = [
    "mail a.b+c@x-y.example.com, or a@b.c._d@e.f and x@y; @z.com a@@b.c", "ip 1.2.3.4 and 1.2.3.256 01.002.3.255 1.2.3.4.5",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111 5", "+1 (988) 555-2485 +12 +1234567890123456 +49 30 1234567",
    "4539 1488 0343 6467 é \U0001F600 4539148803436467 + +1 4539148803436467", "iban GB82WEST12345698765432 GB82WEST12345698765433",
    "SSN 078-05-1120 or 078-05-1120 and call 555-123-4567", "1" * 5000, "1 " * 3000 + "a@b.cc", "\ue000a@b.cd\ue000 \ue001 +1-988-555-2485",
    None, "", "x" * 5000 + "@" + "y." * 3000, "1.2.3.4 " * 300,
]


def test_personal_data_on_fixture(spark, docs, rows, empty):
    data = [(i, t) for i, t in enumerate(PERSONAL)] + [(None, PERSONAL[0]), (0, PERSONAL[0])]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = pii.personal_data(frame).collect()
    assert found(pii.personal_data(frame).drop("spans", "scores")) == sorted(((i, *base_slow(t)) for i, t in data), key=repr)
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert "iban:5:27" in spans[5] and spans[5].count("iban") == 1
    assert spans[6].startswith("ssn:4:15") and "local_phone:" in spans[6]
    assert found(pii.personal_data(docs).drop("spans", "scores")) == sorted(((r[0], *base_slow(r[1])) for r in rows), key=repr)
    assert pii.personal_data(empty).collect() == [] and pii.redacted(empty).collect() == []
    same = pii.redacted(docs)
    assert same.columns == docs.columns and same.exceptAll(docs).isEmpty()
    cut = {r["doc_id"]: r["text"] for r in pii.redacted(frame).collect()}
    assert cut[0].startswith("mail <EMAIL>, or <EMAIL>") and cut[10] is None and cut[11] == ""
    # Seventeen and sixteen digits are no phone number.
    assert cut[3].startswith("<PHONE> +12 +1234567890123456 ") and cut[4] == "<CARD> é \U0001F600 <CARD> + +1 4539148803436467"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab.@-+ 0123456789()é%"), max_size=60), min_size=1, max_size=20))
def test_personal_data_like_the_patterns(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(pii.personal_data(frame).drop("spans", "scores")) == sorted(((i, *base_slow(t)) for i, t in enumerate(texts)), key=repr)


def test_ibans_in_groups_and_context_on_both_sides(spark):
    texts = ["to DE89 3704 0044 0532 0130 00 today", "BE68 5390 0754 7034 BANK BIC", "GB82 WEST 1234 5698 7654 32, GB82WEST12345698765432",
             "DE89 3704 0044 0532 0130 01", "123-45-6789 (SSN)", "reach me: 555-123-4567, by phone", "123-45-6789 is a part number",
             "123-45-6789" + " " * 41 + "SSN", "SSN 123-45-6789"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [x for x in r["spans"].split(",") if x.split(":")[0] in ("iban", "ssn", "local_phone")]
           for r in pii.personal_data(frame).collect()}
    assert [got[i] for i in range(len(texts))] == [
        ["iban:3:30"], ["iban:0:19"], ["iban:0:27", "iban:29:51"], [], ["ssn:0:11"], ["local_phone:10:22"], [], [], ["ssn:4:15"]]
    text = {r["doc_id"]: r["text"] for r in pii.redacted(frame).collect()}
    assert text[1] == "<IBAN> BANK BIC" and text[4] == "<SSN> (SSN)"


def redacted_slow(text, spans):
    out, at = [], 0
    for kind, start, end in (x.split(":") for x in spans.split(",") if x):
        if int(start) >= at:
            out.append(text[at:int(start)] + f"<{kind.upper()}>")
        at = max(at, int(end))
    return "".join(out) + text[at:]


def test_very_many_spans_in_one_text(spark):
    """Spans inside others, longer than a cut, over many runs; time grows with the text only."""
    rng = random.Random(3)
    bits = ["a.b@c.de", "1.2.3.4.5.6.7.8@x.yz", "é" * 700, "+49 30 1234567", "SSN 078-05-1120", "4111 1111 1111 1111", "\n", "to",
            "+1 " + "(" * 600 + "988 555 24 85", "9" * 600 + "@x.yz", "\U0001F600"]
    texts = [" ".join(rng.choices(bits, k=n)) for n in (1, 31, 32, 64, 65, 700)]
    texts.append(" ".join(f"user{i}@host{i % 97}.example.com, é" for i in range(20_000)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = pii.personal_data(frame)
    assert found(got.drop("spans", "scores")) == sorted(((i, *base_slow(t)) for i, t in enumerate(texts)), key=repr)
    spans = {r["doc_id"]: r["spans"] for r in got.collect()}
    for r in pii.redacted(frame).collect():
        assert r["text"] == redacted_slow(texts[r["doc_id"]], spans[r["doc_id"]])


def test_columns_with_dots_and_marks(spark, docs, empty):
    """Columns come back under their names, whatever these are."""
    odd = docs.drop("slot").withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit("é"))
    items = spark.createDataFrame([("i", "no such passage")], "item_id string, text string")
    mixed = mixing.mix(odd, {"s0": 1, "s1": 1})
    assert mixed.columns == [*odd.columns, "slot", "place"] and mixed.count() == docs.count()
    kept = quality.kept(odd)
    assert kept.columns == odd.columns and {r["kept"] for r in kept.collect()} <= {"x", None}
    for out in (pii.redacted(odd), decontaminate.clean(odd, items), simhash.one_of_each(odd)):
        assert out.columns == odd.columns and {r["a.b"] for r in out.collect()} == {1}


def test_personal_data_query(spark, sf_dir):
    got = found(queries.op9_personal_data(spark, sf_dir).drop("spans", "scores"))
    assert got == sorted(((i, *base_slow(t)) for i, t in table_rows(spark, sf_dir, "documents", "doc_id", "text")), key=repr)
