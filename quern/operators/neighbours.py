"""Highly variable features, and the graph of nearest neighbours by random projections and neighbours of neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.order import place
from quern.session import held, reach_package

#: Rows of a part that one task splits further, and of a leaf in which all pairs are compared.
PART, LEAF = 1 << 16, 128
#: Sampled rows for each part, from whose medians the planes between parts are set.
SAMPLE_PER_PART = 64
#: Levels of planes between parts, which bound that sample: at most 2^19 rows, about half as many as a rule.
MAX_DEPTH = 12
#: Rows that name a node as their neighbour and meet its neighbours in one task.
MEET = 64


def variable_features(df: DataFrame, feature: str, sample: str, value: str, samples: int, bins: int = 20, total: float = 1e4) -> DataFrame:
    """feature, mean, dispersion, normalised and rank: how far a feature's dispersion lies above those of like mean.

    df holds non-negative counts, absent pairs are zeros; samples is the number of samples. Counts
    of a sample are scaled to total. mean is log1p of the mean, dispersion the logarithm of
    variance (n - 1) by mean. Means are cut into bins of equal width, open at their lower end; a
    feature is normalised by the mean and standard deviation of its bin, alone in its bin it
    is 1. Ranks go by normalised descending, then by feature. Features without counts or
    variance have a null dispersion and rank last; null values are zeros; an empty table
    gives none. Rows of one pair are added up. No feature or sample is held by one task.
    """
    cells = df.where(f"`{feature}` IS NOT NULL AND `{sample}` IS NOT NULL").groupBy(F.col(feature).alias("feature"), F.col(sample).alias("_s")).agg(F.coalesce(F.sum(value), F.lit(0.0)).cast("double").alias("_x"))
    cells = held(cells, "cells")
    sums = cells.groupBy("_s").agg(F.sum("_x").alias("_t"))
    x = cells.join(sums, "_s").select("feature", F.coalesce(F.try_divide(F.col("_x") * total, F.col("_t")), F.lit(0.0)).alias("_x"))
    n = float(samples)
    moments = x.groupBy("feature").agg((F.sum("_x") / n).alias("_m"), F.var_pop("_x").alias("_v"), F.avg("_x").alias("_a"), F.count("*").alias("_n"))
    # the zeros that are left out shift both the mean and the squares about it
    squares = F.col("_n") * (F.col("_v") + F.pow(F.col("_a") - F.col("_m"), F.lit(2.0))) + (n - F.col("_n")) * F.pow("_m", F.lit(2.0))
    dispersion = F.try_divide(squares / (n - 1), F.col("_m")) if samples > 1 else F.lit(None).cast("double")
    moments = held(moments.select("feature", F.log1p("_m").alias("mean"), F.when(dispersion > 0, F.log(dispersion)).alias("dispersion")), "moments")
    span = moments.agg(F.min("mean").alias("_low"), F.max("mean").alias("_high"))
    at = F.ceil((F.col("mean") - F.col("_low")) * bins / (F.col("_high") - F.col("_low")))
    binned = moments.join(F.broadcast(span)).withColumn("_b", F.when(F.col("_high") > F.col("_low"), F.greatest(F.lit(1), F.least(F.lit(bins), at))).otherwise(1))
    of_bin = binned.groupBy("_b").agg(F.avg("dispersion").alias("_avg"), F.stddev_samp("dispersion").alias("_sd"), F.count("dispersion").alias("_k"))
    normalised = F.when(F.col("_k") == 1, F.when(F.col("dispersion").isNotNull(), 1.0)).otherwise(F.try_divide(F.col("dispersion") - F.col("_avg"), F.col("_sd")))
    out = binned.join(F.broadcast(of_bin), "_b").select("feature", "mean", "dispersion", normalised.alias("normalised"))
    # order by a rounded value, so that sums in another order don't swap equal features
    ranked = place(out.withColumn("_r", F.round("normalised", 9)), [F.col("_r").desc_nulls_last(), F.col("feature").asc()], name="rank")
    return ranked.select("feature", "mean", "dispersion", "normalised", "rank")


def split_leaves(x: np.ndarray, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Row numbers of leaves of at most size rows: halves on both sides of a plane between two random rows."""
    todo = [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            yield at
            continue
        a, b = rng.choice(at, 2, replace=False)
        order = np.argpartition(x[at] @ (x[a] - x[b]), len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]


def nearest_in(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, other row and distance of each row's k nearest others, by all pairs."""
    square = (x * x).sum(1)
    d = square[:, None] + square[None] - 2 * (x @ x.T)
    np.fill_diagonal(d, np.inf)
    k = min(k, len(x) - 1)
    if k <= 0:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    j = np.argpartition(d, k - 1, axis=1)[:, :k].ravel()
    i = np.repeat(np.arange(len(x)), k)
    return i, j, np.sqrt(((x[i] - x[j]) ** 2).sum(1))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64())])


def _edges(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64())], schema=_EDGES)


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k least of (d, b) for each a, repeated edges once."""
    once = edges.groupBy("a", "b").agg(F.min("d").alias("d"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy("d", "b"))).where(F.col("rank") <= k)


def _planes(points: DataFrame, depth: int, trees: int, seed: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each tree the direction of each level and the thresholds of its nodes, from a sample of SAMPLE_PER_PART rows a part."""
    wanted = SAMPLE_PER_PART << depth
    share = min(1.0, wanted / max(1, points.count()))
    rows = points.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vector").limit(2 * wanted).toPandas()
    x = np.array(rows["vector"].tolist(), float)
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        at, levels = np.zeros(len(x), int), []
        for level in range(depth):
            direction = rng.standard_normal(x.shape[1])
            p = x @ direction
            cuts = np.array([np.median(p[at == node]) if (at == node).any() else 0.0 for node in range(1 << level)])
            levels.append((direction, cuts))
            at = 2 * at + (p > cuts[at])
        out.append(levels)
    return out


def _by_trees(points: DataFrame, k: int, trees: int, seed: int) -> DataFrame:
    """Edges (a, b, d) from each row's nearest others in its leaf of each tree."""
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, points.count()) / PART)))))
    planes = _planes(points, depth, trees, seed) if depth else [[] for _ in range(trees)]

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            for tree, levels in enumerate(planes):
                at = np.zeros(len(x), int)
                for direction, cuts in levels:
                    at = 2 * at + (x @ direction > cuts[at])
                yield pa.record_batch([pa.array(np.full(len(x), tree), pa.int32()), pa.array(at, pa.int32()), batch.column(0), batch.column(1)], names=["tree", "part", "id", "vector"])

    def compare(group: pa.Table) -> pa.Table:
        ids = group.column("id").combine_chunks().to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], _matrix(group.column("vector").combine_chunks())[order]
        rng = np.random.default_rng([seed, group.column("tree")[0].as_py(), group.column("part")[0].as_py()])
        out = []
        for leaf in split_leaves(x, LEAF, rng):
            i, j, d = nearest_in(x[leaf], k)
            out.append(_edges(ids[leaf[i]], ids[leaf[j]], d))
        return pa.Table.from_batches(out, schema=_EDGES)

    kind = points.schema["vector"].dataType.simpleString()
    placed = points.mapInArrow(place_rows, f"tree int, part int, id long, vector {kind}")
    return placed.groupBy("tree", "part").applyInArrow(compare, "a long, b long, d double")


def _through_neighbours(points: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """Edges (a, b, d) between the rows that name a node as their neighbour and that node's neighbours.

    The rows that name a node meet its k neighbours at most MEET at a time, so a node that
    very many rows name is many small groups. Only edges that would be among the k nearest of
    their start so far are passed on.
    """
    far = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).alias("far"))
    known = held(points.join(far, F.col("id") == F.col("a"), "left").select("id", "vector", F.coalesce("far", F.lit(float("inf"))).alias("far")), "points")
    near = F.struct("id", "far", "vector")
    forward = graph.select(F.col("a").alias("via"), F.col("b").alias("id")).join(known, "id").groupBy("via").agg(F.collect_list(near).alias("ends"))
    named = graph.groupBy(F.col("b").alias("via")).agg(F.ceil(F.count("*") / F.lit(MEET)).cast("int").alias("groups"))
    back = graph.select(F.col("b").alias("via"), F.col("a").alias("id")).join(named, "via").join(known, "id")
    back = back.groupBy("via", F.pmod(F.hash("id"), F.col("groups")).alias("_g")).agg(F.collect_list(near).alias("starts"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for starts, ends in zip(batch.column(0), batch.column(1), strict=True):
                (a, far_a, x), (b, far_b, y) = ((v.field(0).to_numpy(), v.field(1).to_numpy(), _matrix(v.field(2))) for v in (starts.values, ends.values))
                d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
                other = a[:, None] != b[None]
                for good, one, two in ((other & (d <= far_a[:, None]), a[:, None], b[None]), (other & (d <= far_b[None]), b[None], a[:, None])):
                    yield _edges(np.broadcast_to(one, d.shape)[good], np.broadcast_to(two, d.shape)[good], d[good])

    return back.join(forward, "via").select("starts", "ends").mapInArrow(compare, "a long, b long, d double")


def neighbour_graph(df: DataFrame, key: str, vector: str, k: int = 15, trees: int = 6, rounds: int = 2, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(graph, members): nearest neighbours of every different vector by Euclidean distance, and the rows that each one stands for.

    graph has id, neighbour, rank (1 to k, by distance, then id) and distance; members has id and
    member, the row's key. Rows with equal vectors are one node, named by the least of their keys
    (whole numbers), so copies cost nothing and are no neighbours of each other. Null vectors and
    null keys are left out; fewer than k + 1 different vectors give fewer neighbours, an empty
    table none. All vectors have the same length. Other columns are left out.

    Candidates come from trees of random planes: parts of about PART rows (more only beyond
    PART << MAX_DEPTH rows) split by planes whose places are medians of a bounded sample, then leaves of LEAF rows by planes between two
    rows inside each task. rounds times the graph is completed by neighbours of neighbours. Every
    row is in a leaf of every tree; the neighbours are approximate and tests measure their recall.
    """
    reach_package(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("member"), F.col(vector).alias("vector")).where("member IS NOT NULL AND vector IS NOT NULL")
    named = rows.withColumn("_v", F.md5(F.to_json(F.struct("vector")).cast("binary")))
    points = held(named.groupBy("_v").agg(F.min("member").alias("id"), F.first("vector").alias("vector")), "vectors")
    members = named.select("member", "_v").join(points.select("_v", "id"), "_v").select("id", "member").distinct()
    points = points.select("id", "vector")
    graph = held(_nearest(_by_trees(points, k, trees, seed), k), "neighbours")
    for _ in range(rounds):
        more = _through_neighbours(points, graph.select("a", "b", "d"), k)
        graph = held(_nearest(graph.select("a", "b", "d").unionByName(more), k), "neighbours")
    return graph.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "rank", F.col("d").alias("distance")), members
