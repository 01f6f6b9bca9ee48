"""Merkle manifest against plain trees."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import differences, duck
from stationflow.llm import merkle, queries


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        now = out[-1]
        out.append([H("".join(now[i:i + 3])) for i in range(0, len(now), 3)])
    return out


def path(levels, i):
    out = []
    for level in levels[:-1]:
        at = i // 3 * 3
        out.append((level[at:i], level[i + 1:at + 3]))
        i //= 3
    return out


def slow(rows):
    """One tuple a row: what the query returns, in the order of its columns' names here."""
    by = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = H("".join(map(enc, (doc_id, source, lang, n_chars, text))))
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None
        other = H("".join(map(enc, (doc_id, source, lang, n_chars, text.replace("\n", ""))))) if bad else leaf
        by.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, other, doc_id))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([r[2] for r in sorted(by[s])]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, other, doc_id) in enumerate(sorted(by[s])):
            proof = path(trees[s], i) + path(top, k)
            now = other
            for left, right in proof:
                now = H("".join([*left, now, *right]))
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], H("".join(d for a, b in proof for d in a + b)),
                        now, now == top[-1][0]))
    return sorted(out, key=repr)


def found(df):
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 3))
def test_appended_blocks_give_the_plain_tree(n, height):
    nodes = [H(str(i)) for i in range(n)]
    root, steps = merkle.grown(nodes, None)
    levels = levels_of(nodes)
    assert root == levels[-1][0]
    assert steps == [[("".join(a), "".join(b)) for a, b in path(levels, i)] for i in range(n)]
    block = 3 ** height
    if n > block:
        parts = [merkle.grown(nodes[i:i + block], height) for i in range(0, n, block)]
        assert levels[height] == [r for r, _ in parts]
        assert [s for _, p in parts for s in p] == [s[:height] for s in steps]


def test_fixture(spark, docs, rows, empty):
    plain = [tuple(r[:5]) for r in rows]
    assert found(queries.manifest_digests(docs)) == slow(plain)
    assert queries.manifest_digests(empty).collect() == []
    one = docs.where("doc_id = 999")
    assert found(queries.manifest_digests(one)) == slow([r for r in plain if r[0] == 999])


@pytest.mark.parametrize("height", [1, 2])
def test_many_levels_of_blocks_and_sources(spark, height):
    rng = random.Random(3)
    rows = [(i, f"text {i}\n" * rng.randint(0, 3), None, rng.choice(["hot", "hot", "b", "é", None, f"s{i}"]), i) for i in range(400)]
    rows += [(7, "again", "en", "hot", 1)] * 40 + [(None, None, None, "hot", None)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert found(queries.manifest_digests(frame, height)) == slow(rows)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()]
    got = found(queries.op12_merkle_manifest(spark, sf_dir))
    assert got == slow(rows)
    assert {r[-1] for r in got} == {True, False}
    name = "op12_merkle_manifest"
    assert differences(spark, duck(sf_dir), name, queries.QUERIES[name], queries.SQL[name], sf_dir) is None
