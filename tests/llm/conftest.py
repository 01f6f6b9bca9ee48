from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from corpus_prose import prose

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Columns whose names operators use themselves.
    T.StructField("kept", T.StringType()), T.StructField("h", T.LongType()), T.StructField("slot", T.StringType()),
])


def fixture_rows() -> list[tuple]:
    rng = random.Random(7)
    long = prose(rng, 300)
    edited = long.split()
    edited[40], edited[200] = "changed", "words,"
    texts = [long, long, " ".join(edited), prose(rng, 200), None, "", " \t\n", "Ab", "one two", prose(rng, 60).upper(),
             "line of words\n" * 40, prose(rng, 9000), "aaaa" * 300, "\x00 nul é \U0001F600 end. " * 3,
             "Same passage here: " + long[:400], prose(rng, 90) + " " + long[200:500], "ÉÀ ÖÄ é" * 30]
    rows = [(i * 3, t, "en" if i % 2 else "fr", f"s{i % 3}", None if t is None else len(t), "x", i, None)
            for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, prose(rng, 80), None, None, 1, None, None, None))  # nulls everywhere else
    rows.append((999, prose(rng, 70), None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return fixture_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
