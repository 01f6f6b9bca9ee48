"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return value


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def differences(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None when both engines agree, else a short description."""
    df = fn(spark, sf_dir)
    left = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    right = normal([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        extra = sorted(set(left[1]) - set(right[1]), key=repr)[:2]
        lost = sorted(set(right[1]) - set(left[1]), key=repr)[:2]
        return f"rows {len(left[1])} vs {len(right[1])}; only spark {extra}; only sql {lost}"
    bad = [(a, b) for a, b in zip(left[1], right[1], strict=True) if a != b]
    if bad:
        columns = [n for i, n in enumerate(left[0]) if any(a[i] != b[i] for a, b in bad)]
        first = [(n, bad[0][0][left[0].index(n)], bad[0][1][left[0].index(n)]) for n in columns]
        return f"{len(bad)} of {len(left[1])} rows differ in {columns}: {first}"
    return None


if __name__ == "__main__":
    import time

    import __spark_entry__ as entry
    from stationflow.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, wanted = duck(sf), entry.oracle_sql(), sys.argv[1:]
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sqls:
                result = differences(spark, con, name, fn, sqls[name], sf)
                note = "ok" if result is None else f"DIFF {result}"
            else:
                note = f"rows {fn(spark, sf).count()}"
        except Exception as e:  # noqa: BLE001
            note = f"ERROR {type(e).__name__} {str(e)[:700]}"
        bad += note.startswith(("DIFF", "ERROR"))
        print(f"{name:26s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failed:", bad)
