"""Regression forests with several outputs, grown level by level for many models at once.

A model is what has trees of its own, e.g. a station. All trees of all models grow together:
one aggregation a level sums counts and targets per (model, tree, node, feature, bin), running
sums over the bins give every possible split, and the best split of a node is the one that
lowers the squared error of all targets together most. Rows then move to their child nodes.
Rows are shuffled by (model, tree), so a model with very many rows is spread over its trees, and
neither the number of models nor that of trees changes the number of jobs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.operators.shared import fixed_table
from stationflow.session import fresh_path, materialise

Settings = dict[str, tuple[int, int]]  # model -> trees, depth
CHUNKS = 64  # rows of a model are scored in so many groups a tree


@dataclass(frozen=True)
class Forest:
    """Trees as rows: model, tree and the nodes in level order."""

    trees: DataFrame
    models: tuple[str, ...]
    targets: int
    depth: int


def cut_points(rows: DataFrame, max_bins: int) -> DataFrame:
    """model, cuts: for each feature (its position) the ascending values between two bins.

    A feature with at most ``max_bins`` values has a bin a value, others bins of about equal
    size. A cut lies midway between the values beside it.
    """
    values = rows.select("model", F.posexplode("x").alias("f", "v")).groupBy("model", "f", "v").agg(F.count("*").alias("n"))
    of = Window.partitionBy("model", "f")
    up = of.orderBy("v")
    before = F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    quantile = F.floor(before * max_bins / F.sum("n").over(of))
    binned = values.withColumn("bin", F.when(F.count("*").over(of) <= max_bins, F.row_number().over(up)).otherwise(quantile))
    ends = binned.withColumns({"to": F.lead("v").over(up), "other": F.lead("bin").over(up)}).where("other <> bin")
    cuts = ends.groupBy("model", "f").agg(F.sort_array(F.collect_list((F.col("v") + F.col("to")) / 2)).alias("c"))
    return cuts.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("f", "c"))).alias("cuts"))


def _bins(features: int) -> Column:
    """For each feature the number of cuts below the value."""
    def below(f: int) -> Column:
        cuts = F.coalesce(F.col("cuts")[f], F.array().cast("array<double>"))
        return F.size(F.filter(cuts, lambda c: c < F.col("x")[f])).cast("smallint")

    return F.array(*map(below, range(features)))


def poisson_weight(drawn: Column) -> Column:
    """How often a row is in a bootstrap sample: Poisson with mean 1, from a 64-bit hash."""
    u = F.shiftrightunsigned(drawn, 11) / F.lit(2.0 ** 53)
    below, weight = 0.0, F.lit(0)
    for k in range(12):
        below += math.exp(-1) / math.factorial(k)
        weight = weight + (u > below).cast("int")
    return weight


NODE = ("model", "tree", "node")


def with_totals(rows: DataFrame, targets: int) -> DataFrame:
    """Adds what a node holds to each of its rows: the weights' sum ``all_n`` and the targets' sums."""
    of = Window.partitionBy(*NODE)
    return rows.withColumns({"all_n": F.sum("w").over(of)} | {
        f"all_{t}": F.sum(F.col("w") * F.col(f"y{t}")).over(of) for t in range(targets)})


def best_splits(rows: DataFrame, targets: int) -> DataFrame:
    """One row for each (model, tree, node) of ``rows``: its sums and the best split.

    ``rows`` has weight, bins, y0, y1, ... and the node's sums. The split (feature f, last bin b
    of the left side, the left side's sums) is null where no split lowers the error. Of equally good
    splits the first feature and bin win.
    """
    sums = ["n", *map(str, range(targets))]
    parts = [F.sum("w").alias("n"), *[F.sum(F.col("w") * F.col(f"y{t}")).alias(str(t)) for t in range(targets)]]
    kept = [f"all_{s}" for s in sums]
    cells = rows.select(*NODE, "w", *[f"y{t}" for t in range(targets)], *kept, F.posexplode("bins").alias("f", "b")).groupBy(
        *NODE, "f", "b").agg(*parts, *[F.max(c).alias(c) for c in kept])
    # Sorting goes by one number first, which tells nearly all nodes apart.
    cells = cells.withColumn("h", F.xxhash64(*NODE))
    up = Window.partitionBy("h", *NODE, "f").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumns({f"left_{s}": F.sum(s).over(up) for s in sums})
    right = F.nullif(F.col("all_n") - F.col("left_n"), F.lit(0))
    split_error, flat = F.lit(0.0), F.lit(0.0)
    for t in range(targets):
        left, whole = F.col(f"left_{t}"), F.col(f"all_{t}")
        flat = flat + whole * whole / F.col("all_n")
        split_error = split_error + left * left / F.col("left_n") + (whole - left) * (whole - left) / right
    gain = split_error - flat
    # Less is rounding, where all targets of a node are equal.
    split = F.when(gain > flat * 1e-12, F.struct(
        gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), *[f"left_{s}" for s in sums]))
    best = cells.withColumn("split", split).groupBy("h", *NODE).agg(*[F.max(c).alias(c) for c in kept], F.max("split").alias("split"))
    return best.select(*NODE, *kept, (-F.col("split.f")).alias("f"), (-F.col("split.b")).cast("smallint").alias("b"),
                       *[f"split.left_{s}" for s in sums])


def children(rows: DataFrame, best: DataFrame, targets: int) -> DataFrame:
    """The rows of nodes with a split under their new nodes."""
    sums = ["n", *map(str, range(targets))]
    splits = best.where("f IS NOT NULL").select(*NODE, "f", "b", *[f"left_{s}" for s in sums])
    moved = rows.join(splits, [*NODE]).withColumn("right", F.col("bins")[F.col("f").cast("int")] > F.col("b"))
    return moved.select(
        "model", "tree", (F.col("node") * 2 + F.col("right").cast("int")).alias("node"), "depth", "w", "bins",
        *[f"y{t}" for t in range(targets)],
        *[F.when(F.col("right"), F.col(f"all_{s}") - F.col(f"left_{s}")).otherwise(F.col(f"left_{s}")).alias(f"all_{s}") for s in sums])


def grow(rows: DataFrame, features: int, targets: int, settings: Settings, max_bins: int, seed: int) -> Forest:
    """A forest for each model of ``rows`` (model, key, x, y0, y1, ...) that ``settings`` names.

    x is an array of doubles without nulls; key is a 64-bit hash that draws a row's bootstrap
    weights. A model without rows gets no trees. Each level is written to the shared folder
    before the next one starts.
    """
    spark = rows.sparkSession
    plan = fixed_table(spark, [(m, t, d) for m, (t, d) in settings.items()], ["model", "trees", "depth"])
    ys = [f"y{t}" for t in range(targets)]
    rows = materialise(rows.join(F.broadcast(plan), "model"), "forest-rows")
    cuts = materialise(cut_points(rows, max_bins), "forest-cuts")
    start = rows.join(cuts, "model", "left").select(
        "model", "depth", "key", *ys, _bins(features).alias("bins"), F.explode(F.sequence(F.lit(0), F.col("trees").cast("int") - 1)).alias("tree"))
    start = start.withColumn("w", poisson_weight(F.xxhash64(F.lit(seed), "tree", "key"))).where("w > 0")
    start = start.select("model", "tree", F.lit(1).cast("bigint").alias("node"), "depth", "w", "bins", *ys)
    now = materialise(with_totals(start, targets), "forest-level")
    deepest = max(d for _, d in settings.values())
    folder, level, splits = fresh_path(spark, "forest-nodes"), 0, 1
    while splits:
        best, seen = best_splits(now.repartition("model", "tree"), targets), Observation()
        best.observe(seen, F.count("f").alias("splits")).write.parquet(f"{folder}/level={level}")
        best = spark.read.schema(best.schema).parquet(f"{folder}/level={level}")
        splits = seen.get["splits"] if level < deepest else 0
        if splits:
            now = materialise(children(now.where(F.col("depth") > level), best, targets), "forest-level")
            level += 1
    nodes = spark.read.schema(T.StructType([*best.schema, T.StructField("level", T.IntegerType())])).parquet(folder)
    return _forest(nodes, cuts, targets, plan, level)


def _forest(nodes: DataFrame, cuts: DataFrame, targets: int, plan: DataFrame, depth: int) -> Forest:
    """Nodes of all levels as one row a tree.

    In level order the children of the k-th split (from 0) stand at 1 + 2k and 2 + 2k.
    """
    nodes = nodes.join(F.broadcast(plan.select("model", "depth")), "model")
    nodes = nodes.withColumn("f", F.when(F.col("level") < F.col("depth"), F.col("f")))
    before = Window.partitionBy("model", "tree").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    left = F.when(F.col("f").isNotNull(), (1 + 2 * F.coalesce(F.count("f").over(before), F.lit(0))).cast("int"))
    placed = nodes.withColumn("left", left).join(cuts, "model", "left")
    node = F.struct("node", "left", F.col("f").cast("int").alias("f"), F.col("cuts")[F.col("f")][F.col("b").cast("int")].alias("cut"),
                    F.array(*[F.col(f"all_{t}") / F.col("all_n") for t in range(targets)]).alias("means"))
    trees = placed.groupBy("model", "tree").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    trees = materialise(trees, "forest")
    models = tuple(sorted(r["model"] for r in trees.select("model").distinct().collect()))  # at most one a setting
    return Forest(trees, models, targets, depth)


def predict(forest: Forest, rows: DataFrame) -> DataFrame:
    """id and p0, p1, ... (means over the trees) for ``rows`` (model, id, x).

    A tree meets a model's rows in groups, so that its nodes are copied once a group.
    """
    x, at = F.struct("id", "x"), F.pmod(F.xxhash64("id"), F.lit(CHUNKS))
    groups = rows.groupBy("model", at.alias("chunk")).agg(F.collect_list(x).alias("rows"))
    met = groups.join(forest.trees, "model")

    def walked(row: Column) -> Column:
        def step(i: Column, _: Column) -> Column:
            node = F.col("nodes")[i]
            return F.when(node["left"].isNull(), i).otherwise(
                node["left"] + (row["x"][node["f"]] > node["cut"]).cast("int"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(forest.depth)), F.lit(0), step)

    found = met.select(F.explode(F.transform("rows", lambda r: F.struct(
        r["id"].alias("id"), F.col("nodes")[walked(r)]["means"].alias("means")))).alias("r"))
    return found.groupBy("r.id").agg(*[F.avg(F.col("r.means")[t]).alias(f"p{t}") for t in range(forest.targets)])
