"""Fill-in-middle transformation against a plain version, and exact round trips."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import differences, duck
from stationflow.llm import infill, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert "".join(tokens) == text
    digest = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return doc_id, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


def found(df):
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def expected(rows):
    return sorted((slow(i, t) for i, t in rows), key=repr)


AWKWARD = ["a<P>b", "<S>", "<M", "x <S y> <", "\x00a\x00", "é", "日本 \U0001F600x\n\n", "\r\n", "a" * 100_000, "1 " * 50_000, "<", "<P", "ÿ\xff"]


def test_fixture(spark, docs, rows, empty):
    assert found(queries.infill_digests(docs)) == expected([(r[0], r[1]) for r in rows])
    more = [(100 * k + i, t) for k in range(8) for i, t in enumerate(AWKWARD)]
    assert found(queries.infill_digests(spark.createDataFrame(more, "doc_id long, text string"))) == expected(more)
    assert queries.infill_digests(empty).collect() == []


def test_all_forms_and_real_texts(spark):
    rows = [(i, f"Some text, number {i}. <") for i in range(300)]
    out = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert 0.8 < sum(r["form"] != "plain" for r in out) / 300 < 0.97
    for r in out:
        if r["form"] == "psm":
            p, s, m = re.fullmatch("<P>(.*)<S>(.*)<M>(.*)", r["output"]).groups()
            assert p + m + s == rows[r["doc_id"]][1] and (len(p), len(m)) == (r["prefix_chars"], r["middle_chars"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ09 <>PSM\n\x00\x1fé\U0001F600"), max_size=30), min_size=1, max_size=8))
def test_units_join_to_their_text(texts):
    lists = infill.units(pa.array(texts)).to_pylist()
    assert [[u.decode() for u in one] for one in lists] == [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]


def test_slices_hold_every_row_once():
    sizes = np.array([1, 9_000_000, 1, 1, 4_000_000, 500_000, 1])
    got = list(infill.slices(sizes))
    assert [i for a, k in got for i in range(a, a + k)] == list(range(len(sizes)))
    assert list(infill.slices(np.array([], np.int64))) == []


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_fill_in_middle(spark, sf_dir)
    assert found(got) == expected(rows)
    assert got.where(F.col("form") != "plain").count() > 0
    name = "op13_fill_in_middle"
    assert differences(spark, duck(sf_dir), name, queries.QUERIES[name], queries.SQL[name], sf_dir) is None
