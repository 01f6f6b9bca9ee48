"""HyperMinHash sketches and near-duplicates against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from compare import differences, duck
from corpus_prose import prose
from stationflow.llm import hyperminhash as hm
from stationflow.llm import queries


def shingles(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < words else [tuple(w[i:i + words]) for i in range(len(w) - words + 1)])


def slow(rows, least=80):
    """Rows of the query by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    distinct = list({s for s in sets if s})
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    owners = {}
    for s in distinct:
        for x in s:
            owners.setdefault(x, []).append(s)
    for s in distinct:
        near = {o for x in s for o in owners[x]}
        for o in near:
            if 100 * len(s & o) >= least * len(s | o):
                parent[root(s)] = root(o)
    ids = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            ids[root(s)] = min(i, ids.get(root(s), i))
    out = []
    for (i, _), s in zip(rows, sets, strict=True):
        c = ids.get(root(s)) if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=repr)


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.randrange(10 ** 9)}"
    return " ".join(words)


def crowd(rng, n):
    """Near copies at all similarities around the limit, texts around one long passage, short texts."""
    base = prose(rng, 120).split()
    rows = [edited(rng, base, rng.choice([1, 1, 2, 2, 3, 4, 5, 6])) for _ in range(n)]
    passage = prose(rng, 60)
    rows += [f"{prose(rng, rng.randint(5, 60))} {passage} {prose(rng, 10)}" for _ in range(n)]
    rows += [" ".join(rng.choices("abcd", k=rng.randint(0, 9))) for _ in range(n)]
    rows += rows[:n // 4]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_sketch_of_a_union_and_estimates():
    rng = np.random.default_rng(5)
    for n, share in ((40, 0.8), (300, 0.8), (5000, 0.9), (100_000, 0.5)):
        both = np.unique(rng.integers(0, 2 ** 64, 2 * n, np.uint64))
        cut = int(len(both) * (1 - share) / 2)
        a, b = np.sort(both[cut:]), np.sort(both[:len(both) - cut])
        same = (hm.sketch(a) == hm.sketch(b)).sum()
        assert abs(hm.estimate(same, np.array(len(a)), np.array(len(b))) - (1 - 2 * cut / len(both))) < 0.15
    assert not hm.sketch(np.empty(0, np.uint64)).any()


def test_collisions_of_unrelated_sets():
    """Sketches with few bits agree by chance as often as the correction says."""
    rng, same, runs = np.random.default_rng(2), 0, 3000
    for _ in range(runs):
        a, b = (np.unique(rng.integers(0, 2 ** 64, 2000, np.uint64)) for _ in range(2))
        same += (hm.sketch(a) == hm.sketch(b)).sum()
    expected = hm.collisions(np.array(2000.0), np.array(2000.0)) * hm.REGISTERS * runs
    assert abs(same - expected) < 5 * expected ** 0.5 + 1


def test_share_of_equal_registers_is_the_similarity():
    rng = np.random.default_rng(9)
    for n in (5, 20, 400):
        shares = []
        for _ in range(300):
            both = np.sort(np.unique(rng.integers(0, 2 ** 64, n, np.uint64)))
            shares.append((hm.sketch(both) == hm.sketch(np.delete(both, slice(0, None, 5)))).mean())
        assert abs(np.mean(shares) - 0.8) < 0.02


def test_fixture(spark, docs, rows, empty):
    assert found(hm.near_duplicates(docs)) == slow([(r[0], r[1]) for r in rows])
    assert hm.near_duplicates(empty).collect() == []


@pytest.mark.parametrize(("max_bucket", "max_block"), [(2048, 1_000_000), (20, 1_000_000), (50, 2_000)])
def test_crowds_in_small_blocks(spark, max_bucket, max_block):
    rows = crowd(random.Random(max_bucket), 250)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(hm.near_duplicates(frame, max_bucket=max_bucket, max_block=max_block)) == slow(rows)


def test_only_nulls_and_blanks(spark):
    rows = [(1, None), (2, ""), (None, " \n"), (3, None)]
    assert found(hm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == slow(rows)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = found(queries.op11_hyperminhash(spark, sf_dir))
    assert got == slow(rows)
    assert not all(r[3] for r in got)
    name = "op11_hyperminhash"
    assert differences(spark, duck(sf_dir), name, queries.QUERIES[name], queries.SQL[name], sf_dir) is None
