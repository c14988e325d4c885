"""Normalisations of values in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.ranks import rank


def _over(df: DataFrame, groups: Sequence[str], **aggregates: Column) -> DataFrame:
    """df with aggregates of its group; without groups they are one row that is broadcast, not one window over all rows."""
    if not groups:
        return df.crossJoin(F.broadcast(df.agg(*[a.alias(n) for n, a in aggregates.items()])))
    w = W.partitionBy(*groups)
    return df.withColumns({n: a.over(w) for n, a in aggregates.items()})


def zscore(df: DataFrame, value: str, groups: Sequence[str] = (), population: bool = False, name: str = "z", least_sd: float = 0.0) -> DataFrame:
    """(value - mean) / standard deviation of its group; 0 where the deviation isn't above least_sd."""
    d = _over(df, groups, _sd=(F.stddev_pop if population else F.stddev_samp)(value), _mean=F.avg(value))
    return d.withColumn(name, F.when(F.col(value).isNull(), None).when(F.col("_sd") > least_sd, (F.col(value) - F.col("_mean")) / F.col("_sd")).otherwise(0.0)).drop("_sd", "_mean")


def minmax(df: DataFrame, value: str, groups: Sequence[str] = (), name: str = "scaled") -> DataFrame:
    """(value - least) / range of its group, 0 for a constant group."""
    d = _over(df, groups, _low=F.min(value), _high=F.max(value))
    low, high = F.col("_low"), F.col("_high")
    return d.withColumn(name, F.when(F.col(value).isNull(), None).otherwise(F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0)))).drop("_low", "_high")


def max_share(df: DataFrame, value: str, groups: Sequence[str] = (), times: float = 100.0, name: str = "scaled") -> DataFrame:
    """times * value / largest of its group, 0 where the largest is 0."""
    return _over(df, groups, _high=F.max(value)).withColumn(name, F.coalesce(F.try_divide(F.col(value) * times, F.col("_high")), F.lit(0.0))).drop("_high")


def batch_centre(df: DataFrame, value: str, key: str, batch: str, name: str = "centred") -> DataFrame:
    """The value less its batch's mean for the key, plus the key's mean."""
    return df.withColumn(name, F.col(value) - F.avg(value).over(W.partitionBy(key, batch)) + F.avg(value).over(W.partitionBy(key)))


def counts_per_million(df: DataFrame, value: str, sample: str, name: str = "cpm") -> DataFrame:
    return df.withColumn(name, F.coalesce(F.try_divide(F.col(value) * 1e6, F.sum(value).over(W.partitionBy(sample))), F.lit(0.0)))


def looks_like_counts(df: DataFrame, value: str) -> DataFrame:
    """One row, raw: largest above 50, median above 5 and more than half of the values whole."""
    v = F.col(value)
    return df.agg(((F.max(v) > 50) & (F.median(v) > 5) & (F.avg((v == F.floor(v)).cast("double")) > 0.5)).alias("raw"))


def log2_cpm(df: DataFrame, value: str, sample: str, name: str = "log_cpm") -> DataFrame:
    return counts_per_million(df, value, sample, "_cpm").withColumn(name, F.log2(F.col("_cpm") + 1)).drop("_cpm")


def quantile_normalise(df: DataFrame, value: str, sample: str, ties: str, name: str = "normalised") -> DataFrame:
    """Every value becomes the mean, over the samples, of the values of its place in their order."""
    placed = rank(df, value, [sample], "ordinal", ties=[ties], name="_place")
    means = placed.groupBy("_place").agg(F.avg(value).alias(name))
    return placed.join(means, "_place").drop("_place")


def safe_log2(df: DataFrame, value: str, groups: Sequence[str] = (), name: str = "log2") -> DataFrame:
    """log2 with values not above 0 taken as the group's smallest positive one."""
    least = F.min(F.when(F.col(value) > 0, F.col(value))).over(W.partitionBy(*groups))
    return df.withColumn(name, F.log2(F.when(F.col(value) > 0, F.col(value)).otherwise(least)))
