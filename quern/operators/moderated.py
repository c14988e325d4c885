"""Differential tests that lend strength across members: moderated t statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import dist
from quern.operators.ranks import benjamini_hochberg
from quern.operators.stats import arms
from quern.session import held


def variance_prior(variances: DataFrame, variance: str, df: str) -> DataFrame:
    """One row, prior_df and prior_variance: the scaled inverse chi-square that the members' variances come from.

    Moments of ln variance are matched: its mean and variance beyond what the degrees of freedom
    df explain. prior_df is infinite where the variances differ no more than that. Variances below
    a hundred thousandth of their median count as that much (an approximate median, exact to one
    place in 10,000). Rows with a null or without degrees of freedom don't take part.
    """
    ok = variances.where((F.col(df) > 0) & F.col(variance).isNotNull()).select(F.col(variance).cast("double").alias("v"), (F.col(df) / 2.0).alias("h"))
    middle = ok.agg(F.percentile_approx("v", 0.5, 10_000).alias("m"))
    e = ok.crossJoin(F.broadcast(middle)).select(F.ln(F.greatest(F.col("v"), 1e-5 * F.col("m"))) - dist.digamma(F.col("h")) + F.ln("h"), dist.trigamma(F.col("h"))).toDF("e", "t")
    row = e.agg(F.avg("e").alias("mean"), (F.coalesce(F.var_samp("e"), F.lit(0.0)) - F.avg("t")).alias("spread"))
    row = row.withColumn("half", F.when(F.col("spread") > 0, dist.trigamma_inverse(F.col("spread"))))
    finite = F.exp(F.col("mean") + dist.digamma(F.col("half")) - F.ln("half"))
    return row.select(F.when(F.col("half").isNotNull(), 2 * F.col("half")).otherwise(F.lit(float("inf"))).alias("prior_df"), F.when(F.col("half").isNotNull(), finite).otherwise(F.exp("mean")).alias("prior_variance"))


def moderated_t(df: DataFrame, groups: Sequence[str], value: str, case: Column) -> DataFrame:
    """groups, n1, n0, difference, variance, t, df, p, q: two arms with variances drawn towards a common prior.

    The pooled variance s2 with d degrees of freedom becomes (d0 v0 + d s2) / (d0 + d), the prior
    (d0, v0) coming from all members; t has d + d0 degrees of freedom, at most the sum of all d.
    Members without a value in one arm or with fewer than three values are left out. One row a
    member is kept, and one row of sums is broadcast.
    """
    a = arms(df, groups, value, case).where("n1 > 0 and n0 > 0 and n1 + n0 > 2")
    own = (F.col("n1") + F.col("n0") - 2).cast("double")
    pooled = (F.coalesce("v1", F.lit(0.0)) * (F.col("n1") - 1) + F.coalesce("v0", F.lit(0.0)) * (F.col("n0") - 1)) / own
    a = held(a.select(*groups, "n1", "n0", (F.col("m1") - F.col("m0")).alias("difference"), pooled.alias("_s2"), own.alias("_d")), "moderated")
    row = variance_prior(a, "_s2", "_d").crossJoin(a.agg(F.sum("_d").alias("_all")))
    b = a.crossJoin(F.broadcast(row))
    shrunk = F.when(F.col("prior_df") == float("inf"), F.col("prior_variance")).otherwise((F.col("prior_df") * F.col("prior_variance") + F.col("_d") * F.col("_s2")) / (F.col("prior_df") + F.col("_d")))
    b = b.withColumn("variance", shrunk).withColumn("df", F.least(F.col("prior_df") + F.col("_d"), F.col("_all")))
    b = b.withColumn("t", F.try_divide("difference", F.sqrt(F.col("variance") * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n0"))))).withColumn("p", dist.t_two_sided("t", "df"))
    return benjamini_hochberg(b, "p").select(*groups, "n1", "n0", "difference", "variance", "t", "df", "p", "q")
