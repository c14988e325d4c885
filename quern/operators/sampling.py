"""Negative samples of graphs, drawn by weight of degree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.order import place, running
from quern.session import held

#: Weights are whole numbers of this many parts, so their running sums are exact.
PARTS = 1 << 20
#: Nodes that share a bin of the axis of weights, on average.
BIN = 64


def _axis(nodes: DataFrame, weight: Column) -> DataFrame:
    """node, low, high: each node's own stretch of the axis of weights, as long as its weight."""
    w = nodes.select("node", F.greatest(F.lit(1), F.round(weight * PARTS)).cast("long").alias("_w"))
    return held(running(w, ["node"], high=("sum", "_w")).select("node", (F.col("high") - F.col("_w")).alias("low"), "high"), "axis")


def _on_axis(draws: DataFrame, at: str, axis: DataFrame, width: int, name: str) -> DataFrame:
    """draws with the node whose stretch holds the whole number `at`, by bins of the axis: a heavy node is many bins."""
    spans = axis.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))).withColumnRenamed("node", name)
    return draws.withColumn("_bin", F.floor(F.col(at) / width)).join(spans, "_bin").where((F.col("low") <= F.col(at)) & (F.col(at) < F.col("high"))).drop("_bin", "low", "high", at)


def negative_edges_by_degree(edges: DataFrame, n: int, seed: int = 42, power: float = 0.75, sources: DataFrame | None = None, targets: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    """draw, src, dst: exactly n pairs that aren't edges (src to dst), each end drawn by max(degree, 1) ^ power of its side.

    Draws are seeded and independent; edges are rejected and drawn anew until n pairs are found,
    so a pair's chance is its ends' weights' product among the pairs that aren't edges. Pairs may
    repeat unless distinct. sources and targets (node) may add nodes without edges. Raises an
    error where there are no such pairs (or fewer than n distinct ones).

    Each end is found by its place on an axis of running weights that is cut into bins, so no
    pair table is built and a hub's draws are dealt to many tasks.
    """
    known = held(edges.select("src", "dst").na.drop().distinct(), "known-edges")

    def side(end: str, extra: DataFrame | None) -> tuple[DataFrame, int, int, int]:
        degree = known.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("_d"))
        if extra is not None:
            degree = degree.unionByName(extra.select("node", F.lit(0).cast("long").alias("_d")).na.drop()).groupBy("node").agg(F.max("_d").alias("_d"))
        axis = _axis(degree, F.pow(F.greatest(F.col("_d"), F.lit(1)).cast("double"), F.lit(float(power))))
        total, count = axis.agg(F.max("high"), F.count("*")).first()
        return axis, total or 0, count, max(1, -(-(total or 0) * BIN // max(count, 1)))

    (a, wa, na, ba), (b, wb, nb, bb) = side("src", sources), side("dst", targets)
    free = na * nb - known.count()
    if n and (free <= 0 or distinct and free < n):
        raise ValueError(f"only {max(free, 0)} pairs aren't edges")
    found: DataFrame | None = None
    missing, start, size = n, 0, 2 * n + 64
    while missing > 0:
        draws = edges.sparkSession.range(start, start + size).select(F.col("id").alias("draw"), *[F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(w)).alias(f"_{k}") for k, w in (("a", wa), ("b", wb))])
        pairs = _on_axis(_on_axis(draws, "_a", a, ba, "src"), "_b", b, bb, "dst").join(known, ["src", "dst"], "left_anti")
        if distinct:
            pairs = pairs.groupBy("src", "dst").agg(F.min("draw").alias("draw"))
            pairs = pairs if found is None else pairs.join(found.select("src", "dst"), ["src", "dst"], "left_anti")
        pairs = held(pairs.select("draw", "src", "dst"), "negative-pairs")
        got = pairs.count()
        if got > missing:
            pairs = place(pairs, ["draw"], name="_place").where(F.col("_place") <= missing).drop("_place")
        found = pairs if found is None else found.unionByName(pairs)
        missing, start = missing - got, start + size
        # the next turn is sized by the share that was new, at most eightfold
        size = min(8 * size, int(missing * size / max(got, 1) * 1.2) + 64) if missing > 0 else size
    return found if found is not None else known.select(F.lit(0).cast("long").alias("draw"), "src", "dst").limit(0)


def negative_pool(candidates: DataFrame, degrees: DataFrame, power: float = 1.0, seed: int = 42) -> DataFrame:
    """node, degree, place: the candidates (node) in the order of a draw without replacement by (1 / (1 + degree)) ^ power.

    Nodes of low degree come early; degrees (node, degree) count as 0 where missing. The first n
    places are a sample of n; the place of -ln(u) / weight among all is found by ranges.
    """
    nodes = candidates.select("node").na.drop().distinct().join(degrees.select("node", "degree"), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("node")), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    keyed = nodes.withColumn("_key", -F.ln(u) * F.pow(1.0 + F.col("degree"), F.lit(float(power))))
    return place(keyed, ["_key", "node"], name="place").select("node", "degree", "place")
