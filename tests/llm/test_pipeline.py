"""The pipeline stage by stage against brute force, and on awkward input."""

from __future__ import annotations

import re

import corpus_pipeline
from stationflow.llm import pii, quality
from stationflow.session import materialise
from test_text_operators import base_slow, contamination_slow, near_slow, table_rows

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_id(df):
    out = {r["doc_id"]: r for r in df.collect()}
    return out


def redact_slow(text, spans):
    out, at = [], 0
    for s in [x for x in spans.split(",") if x]:
        kind, a, b = s.split(":")
        if int(a) >= at:
            out.append(text[at:int(a)] + f"<{kind.upper()}>")
        at = max(at, int(b))
    return "".join(out) + text[at:]


def test_stages_on_the_table(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "decontamination", "personal_data", "mix_sources"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    verdicts = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(docs).collect()}
    benchmark = table_rows(spark, sf_dir, "benchmark", "item_id", "text")
    now = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, sf_dir), name)
        got = by_id(after)
        assert after.count() == len(got)
        if name != "mix_sources":
            assert after.columns == DOC_COLUMNS
        if name == "quality_rules":
            want = {i for i in now if verdicts[i]}
        elif name == "near_duplicates":
            want = {c for _, c in near_slow([(i, r["text"]) for i, r in now.items()]).values()}
        elif name == "decontamination":
            hit = {r[0] for r in contamination_slow([(i, r["text"]) for i, r in now.items()], benchmark) if r[-1]}
            want = set(now) - hit
            assert hit
        else:
            want = set(now)
        assert set(got) == want
        if name == "personal_data":
            spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
            for i, r in got.items():
                assert r["text"] == redact_slow(now[i]["text"], spans[i]) and sum(base_slow(r["text"])[:4]) == 0
                assert r["n_chars"] == (len(r["text"]) if spans[i] else now[i]["n_chars"])
            assert any(re.search("<EMAIL>|<CARD>", r["text"]) for r in got.values())
        elif name != "mix_sources":
            assert all(tuple(r) == tuple(now[i]) for i, r in got.items())
        docs, now = after, got
    ran = by_id(corpus_pipeline.run(spark, sf_dir))
    assert {i: tuple(r) for i, r in ran.items()} == {i: tuple(r) for i, r in now.items()}


def test_stages_on_awkward_rows(spark, docs, empty, sf_dir, rows):
    for name, stage in corpus_pipeline.STAGES:
        taken, none = (d.drop("slot") for d in (docs, empty))
        out = stage(spark, taken, sf_dir)
        extra = ["slot", "place"] if name == "mix_sources" else []
        assert out.columns == [*taken.columns, *extra]
        assert 0 < out.count() <= len(rows)
        assert stage(spark, none, sf_dir).collect() == []
