"""Negative-binomial regression of counts for many members at once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import dist
from quern.operators.ranks import benjamini_hochberg
from quern.session import held

#: Least dispersion; members within a hundredfold of it don't take part in the trend.
LEAST = 1e-8
#: Added to the diagonal of the normal equations, so that an arm without counts has a solution.
RIDGE = 1e-6


def size_factors(df: DataFrame, sample: str, member: str, value: str) -> DataFrame:
    """sample, size: the median over the members without a 0 of the count's ratio to the member's geometric mean.

    The median is the lower middle of the logarithms, exact to one place in 100,000. Without any
    such member every size is 1.
    """
    samples = df.select(sample).distinct()
    n = samples.agg(F.count("*").alias("_n"))
    means = df.where(F.col(value) > 0).groupBy(member).agg(F.count("*").alias("_k"), F.avg(F.ln(value)).alias("_mean")).crossJoin(F.broadcast(n)).where("_k = _n").select(member, "_mean")
    middle = df.join(means, member).groupBy(sample).agg(F.percentile_approx(F.ln(value) - F.col("_mean"), 0.5, 100_000).alias("_m"))
    return samples.join(middle, sample, "left").select(sample, F.exp(F.coalesce("_m", F.lit(0.0))).alias("size"))


def dispersions(counts: DataFrame, member: str, n_coefficients: int = 2) -> DataFrame:
    """member, base_mean, own, trend, dispersion of rows (member, y, x, size), x being 0 or 1.

    own matches the variance of y / size within the arms: (variance - mean * mean of 1 / size) /
    mean^2, at least LEAST. trend is a0 + a1 / mean, fitted by least squares weighted by the
    inverse square of the fit, ten turns. dispersion draws ln own towards ln trend as a normal
    prior would: own has the sampling variance trigamma((n - 2) / 2), the prior what the residuals
    vary beyond that, at least 0.25; an own value more than two standard deviations of the
    residuals above the trend stays. Each turn is one aggregate over a row a member.
    """
    v = F.col("y") / F.col("size")
    arms = counts.groupBy(member, "x").agg(F.count("*").alias("_n"), F.avg(v).alias("_m"), F.var_samp(v).alias("_v"), F.avg(1 / F.col("size")).alias("_i"))
    total = F.sum("_n")
    mean = F.sum(F.col("_n") * F.col("_m")) / total
    within = F.try_divide(F.sum(F.coalesce("_v", F.lit(0.0)) * (F.col("_n") - 1)), total - F.count("*"))
    m = arms.groupBy(member).agg(total.alias("_n"), mean.alias("base_mean"), within.alias("_v"), (F.sum(F.col("_n") * F.col("_i")) / total).alias("_i")).where("base_mean > 0")
    own = F.greatest(F.lit(LEAST), F.coalesce((F.col("_v") - F.col("base_mean") * F.col("_i")) / F.pow("base_mean", F.lit(2.0)), F.lit(LEAST)))
    m = held(m.withColumn("own", own).select(member, "_n", "base_mean", "own"), "dispersions")
    used = m.where(F.col("own") > 100 * LEAST)
    a0, a1 = used.agg(F.avg("own")).first()[0] or LEAST, 0.0
    for _ in range(10):
        fit = F.greatest(F.lit(LEAST), a0 + a1 / F.col("base_mean"))
        w, x, y = 1 / (fit * fit), 1 / F.col("base_mean"), F.col("own")
        s = used.agg(*[F.sum(c) for c in (w, w * x, w * x * x, w * y, w * x * y)]).first()
        if s[0] is None:
            break
        det = s[0] * s[2] - s[1] * s[1]
        b1 = (s[0] * s[4] - s[1] * s[3]) / det if det > 1e-12 * s[0] * s[2] else 0.0
        b1 = max(0.0, b1)
        a0, a1 = max(LEAST, (s[3] - b1 * s[1]) / s[0]), b1
    m = m.withColumn("trend", F.greatest(F.lit(LEAST), F.lit(a0) + F.lit(a1) / F.col("base_mean")))
    gap = F.ln("own") - F.ln("trend")
    half = F.greatest((F.col("_n") - n_coefficients) / 2.0, F.lit(0.5))
    spread = m.where(F.col("own") > 100 * LEAST).agg(F.coalesce(F.var_samp(gap), F.lit(0.0)).alias("_all"))
    m = m.crossJoin(F.broadcast(spread)).withColumn("_s", dist.trigamma(half)).withColumn("_p", F.greatest(F.lit(0.25), F.col("_all") - F.col("_s")))
    drawn = F.exp((F.ln("own") / F.col("_s") + F.ln("trend") / F.col("_p")) / (1 / F.col("_s") + 1 / F.col("_p")))
    return m.select(member, "base_mean", "own", "trend", F.when(gap > 2 * F.sqrt("_all"), F.col("own")).otherwise(drawn).alias("dispersion"))


def coefficients(counts: DataFrame, member: str, dispersion: DataFrame, rounds: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """member, b0, b1, se0, se1, rounds of ln(mean / size) = b0 + b1 x for rows (member, y, x, size), by reweighted least squares.

    All members take a step at once: weights mean / (1 + dispersion * mean), their normal
    equations (with RIDGE) are five sums a member, the 2 x 2 system is solved in columns. Members leave when no
    coefficient moves by more than the tolerance; each round is written. Steps are held to 5, and
    b0 and b1 to -30 and 30, as a group without counts has no finite estimate. A member whose x
    doesn't vary has no row.
    """
    data = held(counts.join(dispersion.select(member, F.col("dispersion").alias("_a")), member).select(member, "y", "x", "size", "_a"), "counts")
    start = data.groupBy(member).agg(F.ln(F.avg(F.col("y") / F.col("size")) + 0.1).alias("b0"), (F.min("x") < F.max("x")).alias("_varies")).where("_varies")
    live, done = held(start.select(member, "b0", F.lit(0.0).alias("b1")), "coefficients"), None
    for turn in range(1, rounds + 1):
        x = F.col("x")
        eta = F.col("b0") + F.col("b1") * x
        mu = F.col("size") * F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), eta)))
        rows = data.join(live, member).withColumn("_mu", mu).withColumn("_w", F.col("_mu") / (1 + F.col("_a") * F.col("_mu"))).withColumn("_z", eta + (F.col("y") - F.col("_mu")) / F.col("_mu"))
        w, z = F.col("_w"), F.col("_z")
        s = rows.groupBy(member, "b0", "b1").agg((F.sum(w) + RIDGE).alias("s0"), F.sum(w * x).alias("s1"), (F.sum(w * x * x) + RIDGE).alias("s2"), F.sum(w * z).alias("t0"), F.sum(w * x * z).alias("t1"))
        s = s.withColumn("_det", F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1"))
        held_to = lambda new, old: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(old) + F.greatest(F.lit(-5.0), F.least(F.lit(5.0), new - F.col(old)))))
        n0, n1 = (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / F.col("_det"), (F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0")) / F.col("_det")
        new = s.select(member, held_to(n0, "b0").alias("_n0"), held_to(n1, "b1").alias("_n1"), "b0", "b1", F.sqrt(F.col("s2") / F.col("_det")).alias("se0"), F.sqrt(F.col("s0") / F.col("_det")).alias("se1"))
        new = held(new.withColumn("_still", (F.abs(F.col("_n0") - F.col("b0")) <= tolerance) & (F.abs(F.col("_n1") - F.col("b1")) <= tolerance)), "coefficients")
        final = new.where("_still" if turn < rounds else "true").select(member, F.col("_n0").alias("b0"), F.col("_n1").alias("b1"), "se0", "se1", F.lit(turn).alias("rounds"))
        done = final if done is None else done.unionByName(final)
        live = new.where("not _still").select(member, F.col("_n0").alias("b0"), F.col("_n1").alias("b1"))
        if turn < rounds and not live.limit(1).count():
            break
    return done


def count_test(df: DataFrame, sample: str, member: str, value: str, case: str) -> DataFrame:
    """member, base_mean, dispersion, log2_fold, se, stat, p, q: do counts differ between cases and others (case boolean, by sample)?

    df has a row for each member and sample, zeros included; rows with a null are left out, and
    members without any count. The Wald test takes b1 / se as normal; se and log2_fold are to base 2.
    """
    rows = df.na.drop(subset=[sample, member, value, case]).select(sample, member, F.col(value).cast("double").alias("y"), F.col(case).cast("int").alias("x"))
    sizes = size_factors(rows, sample, member, "y")
    counts = held(rows.join(sizes, sample), "sized-counts")
    spread = held(dispersions(counts, member), "dispersion")
    fit = coefficients(counts, member, spread).join(spread, member)
    out = fit.withColumn("stat", F.col("b1") / F.col("se1")).withColumn("p", dist.normal_two_sided("stat"))
    return benjamini_hochberg(out, "p").select(member, "base_mean", "dispersion", (F.col("b1") / math.log(2)).alias("log2_fold"), (F.col("se1") / math.log(2)).alias("se"), "stat", "p", "q")
