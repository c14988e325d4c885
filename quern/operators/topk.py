"""First, best and random rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each group; order has to be total for the same rows each time. Spark limits groups before the shuffle."""
    w = W.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return top_per_group(df, keys, order, 1)


def strongest_per_key(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    """The row of the largest size of value for each key."""
    return top_per_group(df, keys, [F.desc_nulls_last(F.abs(value)), *ties], 1)


def top(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def priority_topup(df: DataFrame, first: Column, score: str, n: int, ties: Sequence[str]) -> DataFrame:
    """Rows of the first class by score, then others by score, n in all."""
    return df.orderBy(F.when(first, 0).otherwise(1), F.desc_nulls_last(score), *ties).limit(n)


def both_ends(df: DataFrame, value: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The n largest and the n smallest rows, marked up and down."""
    up = df.orderBy(F.desc_nulls_last(value), *ties).limit(n).withColumn("side", F.lit("up"))
    return up.unionByName(df.orderBy(F.asc_nulls_last(value), *ties).limit(n).withColumn("side", F.lit("down")))


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows by a seeded hash of key: the same on every run and for every partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def weighted_sample(df: DataFrame, n: int, weight: str, seed: int, key: str) -> DataFrame:
    """n rows without replacement, drawn by weight: the smallest -ln(u) / weight for a seeded u of key."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return df.where(F.col(weight) > 0).orderBy(-F.ln(u) / F.col(weight), key).limit(n)


def rank_column(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Numbers 1.. in the order; for tables of results (all rows pass one task)."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)))
