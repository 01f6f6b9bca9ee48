"""Repeated bytes against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from stationflow.llm import queries, repeats


def slow(docs, width=100):
    """Rows of the operator for (doc_id, text); rows under one id are one place."""
    seen, out = {}, []
    for doc_id, text in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        data = (text or "").encode()
        for i in range(len(data) - width + 1):
            seen.setdefault(data[i:i + width], (doc_id, i))
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if seen[data[i:i + width]] != (doc_id, i):
                gone[i:i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = bytes(gone).replace(b"\0", b" ").split()
        out.append((doc_id, len(data), sum(gone), len(runs), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_on_fixture(docs, rows, empty):
    assert found(repeats.repeated_bytes(docs)) == slow([(r[0], r[1]) for r in rows])
    assert repeats.repeated_bytes(empty).collect() == []


def test_crowded_minimizers_and_small_blocks(spark):
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdef é", k=130))
    line = "".join(rng.choices("abcdefgh", k=60))
    data = [(i, "".join(rng.choices("abc ", k=rng.randint(0, 90))) + (passage if i % 2 else line)
             + "".join(rng.choices("xyz ", k=rng.randint(0, 90)))) for i in range(80)]
    data += [(100, "ab" * 200), (101, "ba" * 120), (102, "a" * 99), (103, "a" * 100), (104, "a" * 101)]
    rng.shuffle(data)
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    want = slow(data)
    assert found(repeats.repeated_bytes(frame)) == want
    assert found(repeats.repeated_bytes(frame, block=3, crowd=2)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=9, max_size=60), st.integers(1, 9))
def test_places_of_the_least_values(values, window):
    """Values that differ in their last bits only count as equal, wherever they lie."""
    h = np.array([v >> 1 << repeats.PLACE_BITS | v & 1 for v in values], np.uint64)
    want = [min(range(i, i + window), key=lambda j: (values[j] >> 1, j)) for i in range(len(values) - window + 1)]
    assert repeats._first_least(h, window).tolist() == want


def test_query(spark, sf_dir):
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op2_repeated_bytes(spark, sf_dir)) == slow(pairs)


def slow_places(docs, width=100):
    """Like ``slow``, but different texts under one id are places of their own."""
    def signed(text):
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (h >> 63 << 64)

    places = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, signed(d[1])))
    by_place = {}
    for row in slow([(i, text) for i, (_, text) in enumerate(places)], width):
        by_place[places[row[0]]] = row[1:]
    return sorted(((d[0], *by_place[d]) for d in docs), key=repr)


def test_different_texts_under_one_id_are_places_of_their_own(spark):
    rng = random.Random(3)

    def text(n):
        return "".join(rng.choices("abcdefgh é", k=n))

    a, b, c, d = (text(n) for n in (150, 140, 130, 400))
    data = [(None, a + text(300)), (None, text(450)), (None, text(20) + b), (None, b), (None, text(30)),
            (5, c + text(900)), (5, c + text(50)), (5, text(120)), (5, d), (5, d), (6, text(10) + a), (7, c + c), (7, text(500))]
    data += [(None, text(110)) for _ in range(30)]
    want = slow_places(data)
    assert sum(r[2] for r in want) > 400
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    assert found(repeats.repeated_bytes(frame)) == want
    assert found(repeats.repeated_bytes(frame, block=3, crowd=2)) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab$"), min_size=1, max_size=12), min_size=1, max_size=8))
def test_transform_and_prefixes(texts):
    strings = [t.encode() for t in texts]
    bwt, lcp = repeats.column_wise(strings)
    suffixes = sorted((s[i:] + b"\0" + bytes([k]), k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
    symbols = sorted(set(b"".join(strings)))
    want = [0 if i == 0 else symbols.index(strings[k][i - 1]) + 1 for _, k, i in suffixes]
    assert bwt.tolist() == want
    for (a, ka, ia), (b, kb, ib), n in zip(suffixes, suffixes[1:], lcp[1:].tolist(), strict=False):
        x, y = strings[ka][ia:], strings[kb][ib:]
        assert n == next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
    got = {frozenset(zip(o.tolist(), s.tolist(), strict=True)) for o, s in repeats.equal_windows(strings, 3)}
    windows = {}
    for k, s in enumerate(strings):
        for i in range(len(s) - 2):
            windows.setdefault(s[i:i + 3], set()).add((k, i))
    assert got == {frozenset(w) for w in windows.values() if len(w) > 1}


def test_stretches_hold_each_window_once():
    rng = random.Random(1)
    pieces = [bytes(rng.choices(b"abc", k=n)) for n in (0, 99, 100, 101, 1000)] + [b"z" * 500, b"xy" * 300]
    piece, start, count, mkey = repeats.stretches(pieces)
    windows = [(p, s + i) for p, s, n in zip(piece, start, count, strict=True) for i in range(n)]
    assert windows == [(p, i) for p, d in enumerate(pieces) for i in range(len(d) - 99)]
    assert max(count) <= repeats.WIDTH - repeats.KMER + 1
    by_content = {}
    for p, s, n, m in zip(piece, start, count, mkey, strict=True):
        for i in range(s, s + n):
            assert by_content.setdefault(pieces[p][i:i + 100], m) == m
        assert len({pieces[p][i:i + 100] for i in range(s, s + n)}) == n


def test_contents_that_share_a_window_keep_company():
    rng = random.Random(9)
    common = bytes(rng.choices(b"abcdefgh", k=140))
    pieces = [bytes(rng.choices(b"xyz", k=rng.randint(0, 80))) + common[rng.randint(0, 20):rng.randint(110, 140)]
              + bytes(rng.choices(b"uvw", k=rng.randint(0, 80))) for _ in range(60)]
    piece, start, count, mkey = repeats.stretches(pieces)
    contents = sorted({(int(m), pieces[p][s:s + n + 99]) for p, s, n, m in zip(piece, start, count, mkey, strict=True)})
    strings = [c for _, c in contents]
    keep = repeats.with_company(np.array([m for m, _ in contents]), strings)
    windows = [{s[i:i + 100] for i in range(len(s) - 99)} for s in strings]
    for i, w in enumerate(windows):
        if any(w & other for j, other in enumerate(windows) if i != j):
            assert keep[i]
    assert not all(keep)
