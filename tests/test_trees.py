"""Forests with several outputs: splits, cuts and whole trees against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from stationflow.operators import trees


def split_slow(rows):
    """Best (feature, bin) over both targets by trying all, None where nothing helps."""
    w = np.array([r["w"] for r in rows], float)
    y = np.array([[r["y0"], r["y1"]] for r in rows], float)
    b = np.array([r["bins"] for r in rows])

    def error(keep):
        if not keep.any():
            return 0.0
        mean = np.average(y[keep], axis=0, weights=w[keep])
        return (w[keep, None] * (y[keep] - mean) ** 2).sum()

    whole, best = error(np.ones(len(rows), bool)), None
    for f in range(b.shape[1]):
        for at in np.unique(b[:, f])[:-1]:
            left = b[:, f] <= at
            gain = whole - error(left) - error(~left)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-6):
                best = (gain, f, at)
    return best and best[1:]


def test_best_splits_like_all_tries(spark):
    rng = random.Random(4)
    rows = [("m", t, n, rng.randint(1, 3), [rng.randint(0, 3) for _ in range(3)], float(rng.randint(0, 9)), float(rng.randint(0, 99)))
            for t in range(6) for n in (2, 3) for _ in range(rng.choice([1, 2, 8, 20]))]
    rows += [("k", 0, 1, 1, [i, 0, 0], 5.0, 7.0) for i in range(4)]  # nothing to gain
    frame = spark.createDataFrame(rows, "model string, tree int, node long, w int, bins array<smallint>, y0 double, y1 double")
    by = {}
    for r in frame.collect():
        by.setdefault((r["model"], r["tree"], r["node"]), []).append(r)
    got = {(r["model"], r["tree"], r["node"]): r for r in trees.best_splits(trees.with_totals(frame, 2), 2).collect()}
    assert set(got) == set(by)
    for key, members in by.items():
        r, w = got[key], [m["w"] for m in members]
        assert r["all_n"] == sum(w)
        for t in (0, 1):
            assert r[f"all_{t}"] == pytest.approx(np.dot([m[f"y{t}"] for m in members], w))
        assert (None if r["f"] is None else (r["f"], r["b"])) == split_slow(members)


def test_cuts(spark):
    rows = [("m", [float(i % 3), float(i), 1.0]) for i in range(100)] + [("n", [0.5, 7.0, 1.0])]
    frame = spark.createDataFrame(rows, "model string, x array<double>")
    got = {r["model"]: r["cuts"] for r in trees.cut_points(frame, 10).collect()}
    assert got == {"m": {0: [0.5, 1.5], 1: [10 * i - 0.5 for i in range(1, 10)]}}


def table(spark, n=600):
    rng = random.Random(8)
    rows = []
    for m in ("a", "b"):
        for i in range(n):
            x = [float(rng.randint(0, 23)), float(rng.randint(0, 6)), rng.random()]
            y = 50 * np.sin(x[0] / 4) + 10 * x[1] * (m == "a") + rng.gauss(0, 3)
            rows.append((m, i, x, float(y), float(200 - 2 * y + rng.gauss(0, 3))))
    return spark.createDataFrame(rows, "model string, i long, x array<double>, y0 double, y1 double").withColumn("key", F.xxhash64("i"))


def test_one_deep_tree_knows_its_rows(spark):
    """Unbounded trees end in single rows, so the drawn rows come back exactly."""
    rows = table(spark, 150).cache()
    forest = trees.grow(rows, 3, 2, {"a": (1, 30), "b": (1, 30)}, 10_000, 5)
    weight = trees.poisson_weight(F.xxhash64(F.lit(5), F.lit(0), "key"))
    drawn = rows.where(weight > 0).withColumn("id", F.xxhash64("model", "i"))
    got = drawn.join(trees.predict(forest, drawn.select("model", "id", "x")), "id")
    assert got.count() == drawn.count() > 100
    assert got.where("abs(p0 - y0) > 1e-6 OR abs(p1 - y1) > 1e-6").count() == 0


def test_weights_are_poisson(spark):
    got = spark.range(40_000).groupBy(trees.poisson_weight(F.xxhash64("id")).alias("w")).count().collect()
    share = {r["w"]: r["count"] / 40_000 for r in got}
    for k, p in enumerate((0.36788, 0.36788, 0.18394, 0.06131, 0.01533)):
        assert abs(share[k] - p) < 0.01


def test_models_have_their_own_trees_and_depth(spark):
    rows = table(spark, 80)
    forest = trees.grow(rows, 3, 2, {"a": (3, 2), "b": (2, 5), "none": (4, 4)}, 32, 1)
    assert forest.models == ("a", "b") and forest.depth == 5
    got = {(r["model"], r["tree"]): r["nodes"] for r in forest.trees.collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)}
    for (model, _), nodes in got.items():
        assert max(n["node"].bit_length() - 1 for n in nodes) == {"a": 2, "b": 5}[model]
        place = {n["node"]: i for i, n in enumerate(nodes)}
        for n in nodes:
            assert n["left"] is None if n["f"] is None else (place[2 * n["node"]], place[2 * n["node"] + 1]) == (n["left"], n["left"] + 1)


def test_scores_match_single_output_forests(spark):
    rows = table(spark).withColumn("id", F.xxhash64("model", "i")).cache()
    train, test = rows.where("i % 4 > 0"), rows.where("i % 4 = 0")
    forest = trees.grow(train, 3, 2, {"a": (20, 12), "b": (20, 12)}, 64, 1)
    joint = test.join(trees.predict(forest, test.select("model", "id", "x")), "id")
    wide = rows.select("model", "i", "id", "y0", "y1", *[F.col("x")[k].alias(f"x{k}") for k in range(3)])
    wide = VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="features").transform(wide)

    def error(frame, t):
        return frame.select(F.avg((F.col(f"p{t}") - F.col(f"y{t}")) ** 2)).first()[0]

    for t in (0, 1):
        alone = []
        for m in ("a", "b"):
            part = wide.where(F.col("model") == m)
            fit = RandomForestRegressor(labelCol=f"y{t}", predictionCol=f"p{t}", numTrees=20, maxDepth=12, maxBins=64,
                                        featureSubsetStrategy="all", seed=1).fit(part.where("i % 4 > 0"))
            alone.append(error(fit.transform(part.where("i % 4 = 0")), t))
        assert error(joint, t) < 1.1 * sum(alone) / 2
