"""Ranks, percentiles and multiple-testing corrections over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.order import place, running, value_ranks
from quern.session import held


def _order(by: str, descending: bool) -> Column:
    return F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)


def rank(df: DataFrame, by: str, groups: Sequence[str] = (), method: str = "average", descending: bool = False, ties: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """df with the rank of by in its group: average, min, dense or ordinal (ties: columns that order equals). Nulls have none.

    Without groups the order is dealt to ranges, so no task holds all rows; df is written first,
    since values that are sums can differ in their last bits when they are computed again.
    """
    if not groups:
        return _rank_of_all(df, by, method, descending, ties, name)
    within = W.partitionBy(*groups, F.col(by).isNull())
    over = within.orderBy(_order(by, descending), *ties) if method == "ordinal" else within.orderBy(_order(by, descending))
    if method == "average":
        value = F.rank().over(over) + (F.count("*").over(W.partitionBy(*groups, by)) - 1) / F.lit(2.0)
    else:
        value = {"min": F.rank, "dense": F.dense_rank, "ordinal": F.row_number}[method]().over(over)
    return df.withColumn(name, F.when(F.col(by).isNotNull(), value))


def _rank_of_all(df: DataFrame, by: str, method: str, descending: bool, ties: Sequence[str], name: str) -> DataFrame:
    if method == "ordinal":
        placed = place(df.where(F.col(by).isNotNull()), [_order(by, descending), *ties], name=name)
        return placed.unionByName(df.where(F.col(by).isNull()).withColumn(name, F.lit(None).cast("long")))
    df = held(df, "rank-values")
    ranked = value_ranks(df.select(by), by, descending=descending)
    value = {"average": F.col("before") + (F.col("n") + 1) / F.lit(2.0), "min": F.col("before") + 1, "dense": F.col("distinct_before") + 1}[method]
    return df.join(ranked.select(F.col(by).alias("_by"), value.alias(name)), F.col(by) == F.col("_by"), "left").drop("_by")


def percentile_of_score(df: DataFrame, by: str, groups: Sequence[str] = (), name: str = "percentile") -> DataFrame:
    """100 times the mean share of values below and of values not above: the average rank by the number of values."""
    ranked = rank(df, by, groups, "average", name="_rank")
    if not groups:
        n = df.agg(F.count(by).alias("_n"))
        return ranked.crossJoin(F.broadcast(n)).withColumn(name, 100.0 * F.col("_rank") / F.col("_n")).drop("_rank", "_n")
    n = F.count(by).over(W.partitionBy(*groups))
    return ranked.withColumn(name, 100.0 * F.col("_rank") / n).drop("_rank")


def benjamini_hochberg(df: DataFrame, p: str, groups: Sequence[str] = (), name: str = "q") -> DataFrame:
    """df with p adjusted by the step-up of Benjamini and Hochberg: a running minimum from the largest p. Nulls stay out.

    Without groups distinct p are put in order by ranges, and equal ones share their q; df is
    written first, so the p that are ordered are, to the last bit, those that look up their q.
    """
    if not groups:
        df = held(df, "p-values")
        counts = value_ranks(df.select(p), p)
        total = df.agg(F.count(p).alias("_all"))
        raw = counts.crossJoin(F.broadcast(total)).select(F.col(p).alias("_p"), (F.col(p) * F.col("_all") / (F.col("before") + F.col("n"))).alias("_raw"))
        least = running(raw, [F.desc("_p")], **{name: ("min", "_raw")}).select("_p", F.least(F.lit(1.0), name).alias(name))
        return df.join(least, F.col(p) == F.col("_p"), "left").drop("_p")
    present = F.col(p).isNotNull()
    within = W.partitionBy(*groups, F.col(p).isNull())
    ordered = df.withColumn("_place", F.row_number().over(within.orderBy(p))).withColumn("_n", F.count(p).over(within))
    down = within.orderBy(F.desc("_place")).rowsBetween(W.unboundedPreceding, 0)
    return ordered.withColumn(name, F.when(present, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_place")).over(down)))).drop("_place", "_n")


def bonferroni(df: DataFrame, p: str, groups: Sequence[str] = (), name: str = "q") -> DataFrame:
    return df.withColumn(name, F.least(F.lit(1.0), F.col(p) * F.count(p).over(W.partitionBy(*groups))))
