"""Skeletons of causal graphs: edges that no small set of neighbours explains away."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import held


def _eliminated(rows: DataFrame, size: int) -> Column:
    """The partial correlation of places 0 and 1 of a correlation matrix held in columns _r_a_b (a < b), given the other size - 2."""
    at = lambda a, b: F.lit(1.0) if a == b else F.col(f"_r_{min(a, b)}_{max(a, b)}")
    value = {(a, b): at(a, b) for a in range(size) for b in range(a + 1, size)}
    # one given place after the other is taken out: r_ab.k = (r_ab - r_ak r_bk) / sqrt((1 - r_ak^2)(1 - r_bk^2))
    for k in range(size - 1, 1, -1):
        value = {(a, b): F.try_divide(r - value[a, k] * value[b, k], F.sqrt(F.greatest(F.lit(0.0), (1 - value[a, k] * value[a, k]) * (1 - value[b, k] * value[b, k])))) for (a, b), r in value.items() if b < k}
    return value[0, 1]


def skeleton(correlations: DataFrame, n: int, alpha: float = 0.05, a: str = "a", b: str = "b", r: str = "r", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges: a, b, r with a < b; removed: a, b, given, z) of the order-independent search with Gaussian tests.

    correlations has each unordered pair of variables once, from n rows. Level after level l = 0,
    1, ... an edge goes if its ends are independent given some l neighbours of one end:
    sqrt(n - l - 3) |atanh(partial correlation)| not above the two-sided normal quantile of alpha.
    Neighbours are those at the start of the level, so the order of variables doesn't matter. given
    is the set with the least z, the first in order among equals. It ends when no node has l + 1
    neighbours, when too few rows are left, or after level `most`.

    A level is l joins of edges with neighbours and the correlations of the new triples, streamed
    into one row an edge: no node's neighbourhood is gathered. Null correlations count as 0. A
    denominator of 0 (variables that determine each other) leaves the edge in place.
    """
    base = correlations.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.coalesce(F.col(r), F.lit(0.0)).alias("r")).where("a <> b")
    base = held(base, "skeleton-correlations")
    both = base.unionByName(base.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    limit = NormalDist().inv_cdf(1 - alpha / 2)
    kind = dict(base.dtypes)["a"]
    edges, removed, level = base, None, 0
    while n - level - 3 > 0 and (most is None or level <= most):
        directed = edges.select("a", "b").union(edges.select("b", "a"))
        if level:
            degree = directed.groupBy("a").agg(F.count("*").alias("_d")).agg(F.max("_d")).first()[0]
            if degree is None or degree - 1 < level:
                break
            rows = directed.join(both.withColumnRenamed("r", "_r_0_1"), ["a", "b"])
            for k in range(2, level + 2):
                new = f"_v{k}"
                step = directed.select("a", F.col("b").alias(new))
                rows = rows.join(step, "a").where(F.col(new) != F.col("b"))
                if k > 2:
                    rows = rows.where(F.col(new) > F.col(f"_v{k - 1}"))
                ends = ["a", "b", *[f"_v{i}" for i in range(2, k)]]
                for place, end in enumerate(ends):
                    known = both.select(F.col("a").alias(end), F.col("b").alias(new), F.col("r").alias(f"_r_{place}_{k}"))
                    rows = rows.join(known, [end, new])
            given = F.array(*[F.col(f"_v{k}") for k in range(2, level + 2)])
        else:
            rows, given = edges.withColumnRenamed("r", "_r_0_1"), F.array().cast(f"array<{kind}>")
        partial = _eliminated(rows, level + 2)
        z = F.when(F.abs(partial) < 1, math.sqrt(n - level - 3) * F.abs(F.atanh(partial))).when(partial.isNotNull(), F.lit(float("inf")))
        tested = rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), given.alias("given"), z.alias("z")).where(F.col("z") <= limit)
        gone = held(tested.groupBy("a", "b").agg(F.min(F.struct("z", "given")).alias("_f")).select("a", "b", F.col("_f.given").alias("given"), F.col("_f.z").alias("z")), "skeleton-gone")
        edges = held(edges.join(gone.select("a", "b"), ["a", "b"], "left_anti"), "skeleton-edges")
        removed = gone if removed is None else removed.unionByName(gone)
        level += 1
    if removed is None:
        removed = edges.select("a", "b", F.array().cast(f"array<{kind}>").alias("given"), F.lit(0.0).alias("z")).limit(0)
    return edges, removed
