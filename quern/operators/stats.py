"""Statistics over long tables: tests by group, meta-analysis, rank statistics, correlation.

Statistics come from built-in aggregates; p-values, where asked for, from quern.functions.dist.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import dist
from quern.operators.order import quantiles
from quern.operators.ranks import rank


def arms(df: DataFrame, groups: Sequence[str], value: str, case: Column) -> DataFrame:
    """groups with n, mean and variance of the case (1) and the control arm (0); one shuffle."""
    v1, v0 = F.when(case, F.col(value)), F.when(~case, F.col(value))
    return df.groupBy(*groups).agg(F.count(v1).alias("n1"), F.count(v0).alias("n0"), F.avg(v1).alias("m1"), F.avg(v0).alias("m0"), F.var_samp(v1).alias("v1"), F.var_samp(v0).alias("v0"))


def welch_t(df: DataFrame, groups: Sequence[str], value: str, case: Column, with_p: bool = False) -> DataFrame:
    """groups, difference, t, df: unequal variances; null where an arm has fewer than two values or nothing varies."""
    a = arms(df, groups, value, case)
    e1, e0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    out = a.where("n1 > 1 and n0 > 1").select(*groups, "n1", "n0", (F.col("m1") - F.col("m0")).alias("difference"), F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(e1 + e0)).alias("t"), F.try_divide((e1 + e0) * (e1 + e0), e1 * e1 / (F.col("n1") - 1) + e0 * e0 / (F.col("n0") - 1)).alias("df"))
    return out.withColumn("p", dist.t_two_sided("t", "df")) if with_p else out


def student_t(df: DataFrame, groups: Sequence[str], value: str, case: Column, with_p: bool = False) -> DataFrame:
    """groups, difference, t, df with the pooled variance."""
    a = arms(df, groups, value, case).where("n1 + n0 > 2 and n1 > 0 and n0 > 0")
    pooled = (F.coalesce("v1", F.lit(0.0)) * (F.col("n1") - 1) + F.coalesce("v0", F.lit(0.0)) * (F.col("n0") - 1)) / (F.col("n1") + F.col("n0") - 2)
    out = a.select(*groups, (F.col("m1") - F.col("m0")).alias("difference"), F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(pooled * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n0")))).alias("t"), (F.col("n1") + F.col("n0") - 2).cast("double").alias("df"))
    return out.withColumn("p", dist.t_two_sided("t", "df")) if with_p else out


def paired_t(df: DataFrame, groups: Sequence[str], before: str, after: str, least: int = 3, with_p: bool = False) -> DataFrame:
    """groups, n, difference, t of complete pairs, at least so many."""
    d = F.col(after) - F.col(before)
    a = df.groupBy(*groups).agg(F.count(d).alias("n"), F.avg(d).alias("difference"), F.stddev_samp(d).alias("_sd")).where(F.col("n") >= least)
    out = a.select(*groups, "n", "difference", F.try_divide(F.col("difference") * F.sqrt("n"), F.col("_sd")).alias("t"))
    return out.withColumn("p", dist.t_two_sided("t", F.col("n") - 1)) if with_p else out


def cohens_d(df: DataFrame, groups: Sequence[str], value: str, case: Column) -> DataFrame:
    """groups, d (0 if nothing varies) and its variance."""
    a = arms(df, groups, value, case).where("n1 > 1 and n0 > 1")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    d = F.coalesce(F.try_divide(F.col("m1") - F.col("m0"), pooled), F.lit(0.0))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    return a.select(*groups, "n1", "n0", d.alias("d")).withColumn("variance", (n1 + n0) / (n1 * n0) + F.col("d") * F.col("d") / (2 * (n1 + n0)))


def fisher_combined(df: DataFrame, groups: Sequence[str], p: str) -> DataFrame:
    """groups, k, chi2 and p of at least two p-values in (0, 1]; the even number of degrees of freedom needs no UDF."""
    ok = df.where((F.col(p) > 0) & (F.col(p) <= 1))
    a = ok.groupBy(*groups).agg(F.count("*").alias("k"), (-2 * F.sum(F.ln(p))).alias("chi2")).where("k >= 2")
    return a.withColumn("p", dist.chi2_upper_even(F.col("chi2"), F.col("k") * 2))


def stouffer(df: DataFrame, groups: Sequence[str], z: str, weight: str | None = None, with_p: bool = False) -> DataFrame:
    """groups, k, z: the weighted sum of z over the root of the squared weights."""
    w = F.col(weight) if weight else F.lit(1.0)
    out = df.where(F.col(z).isNotNull()).groupBy(*groups).agg(F.count("*").alias("k"), F.try_divide(F.sum(w * F.col(z)), F.sqrt(F.sum(w * w))).alias("z"))
    return out.withColumn("p", dist.normal_two_sided("z")) if with_p else out


def fixed_effect(df: DataFrame, groups: Sequence[str], effect: str, variance: str) -> DataFrame:
    """groups, k, effect, se, q, i2 by inverse variances."""
    w, e = F.lit(1.0) / F.col(variance), F.col(effect)
    a = df.where(F.col(variance) > 0).groupBy(*groups).agg(F.count("*").alias("k"), F.sum(w).alias("_w"), F.sum(w * e).alias("_we"), F.sum(w * e * e).alias("_wee"))
    q = F.greatest(F.lit(0.0), F.col("_wee") - F.col("_we") * F.col("_we") / F.col("_w"))
    return a.withColumn("q", q).select(*groups, "k", (F.col("_we") / F.col("_w")).alias("effect"), (F.lit(1.0) / F.sqrt("_w")).alias("se"), "q", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(100 * (F.col("q") - (F.col("k") - 1)), F.col("q")), F.lit(0.0))).alias("i2"))


def random_effects(df: DataFrame, groups: Sequence[str], effect: str, variance: str) -> DataFrame:
    """groups, k, q, tau2, i2, effect, se after DerSimonian and Laird: two passes of sums."""
    w, e = F.lit(1.0) / F.col(variance), F.col(effect)
    ok = df.where(F.col(variance) > 0)
    a = ok.groupBy(*groups).agg(F.count("*").alias("k"), F.sum(w).alias("_w"), F.sum(w * w).alias("_ww"), F.sum(w * e).alias("_we"), F.sum(w * e * e).alias("_wee")).where("k >= 2")
    a = a.withColumn("q", F.greatest(F.lit(0.0), F.col("_wee") - F.col("_we") * F.col("_we") / F.col("_w")))
    a = a.withColumn("tau2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("k") - 1), F.col("_w") - F.col("_ww") / F.col("_w")), F.lit(0.0))))
    a = a.withColumn("i2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(100 * (F.col("q") - (F.col("k") - 1)), F.col("q")), F.lit(0.0))))
    joined = ok.join(a.select(*groups, "k", "q", "tau2", "i2"), list(groups)) if groups else ok.crossJoin(F.broadcast(a.select("k", "q", "tau2", "i2")))
    r = F.lit(1.0) / (F.col(variance) + F.col("tau2"))
    out = joined.groupBy(*groups, "k", "q", "tau2", "i2").agg(F.sum(r).alias("_r"), F.sum(r * e).alias("_re"))
    return out.select(*groups, "k", "q", "tau2", "i2", (F.col("_re") / F.col("_r")).alias("effect"), (F.lit(1.0) / F.sqrt("_r")).alias("se"))


def leave_one_out(df: DataFrame, groups: Sequence[str], unit: str, effect: str, variance: str) -> DataFrame:
    """groups, unit, effect and se of the fixed-effect mean without that unit: totals less its own part, no self join."""
    w = F.lit(1.0) / F.col(variance)
    over = W.partitionBy(*groups)
    sums = df.where(F.col(variance) > 0).withColumn("_w", F.sum(w).over(over) - w).withColumn("_we", F.sum(w * F.col(effect)).over(over) - w * F.col(effect)).withColumn("_k", F.count("*").over(over))
    return sums.where("_k > 1").select(*groups, unit, (F.col("_we") / F.col("_w")).alias("effect"), (F.lit(1.0) / F.sqrt("_w")).alias("se"))


def auc(df: DataFrame, groups: Sequence[str], score: str, positive: Column) -> DataFrame:
    """groups, n_pos, n_neg, auc from average ranks."""
    ranked = rank(df.where(F.col(score).isNotNull()).withColumn("_pos", positive.cast("int")), score, groups, "average", name="_r")
    a = ranked.groupBy(*groups).agg(F.sum("_pos").alias("n_pos"), F.sum(1 - F.col("_pos")).alias("n_neg"), F.sum(F.col("_pos") * F.col("_r")).alias("_s"))
    return a.select(*groups, "n_pos", "n_neg", F.try_divide(F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg")).alias("auc"))


def roc_points(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """threshold, tpr, fpr, youden for each distinct score: counts first, then running sums over the counts."""
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    w = W.orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy()
    out = counts.withColumn("tpr", F.try_divide(F.sum("_p").over(w), F.sum("_p").over(every))).withColumn("fpr", F.try_divide(F.sum("_n").over(w), F.sum("_n").over(every)))
    return out.select("threshold", "tpr", "fpr", (F.col("tpr") - F.col("fpr")).alias("youden"))


def average_precision(df: DataFrame, groups: Sequence[str], score: str, positive: Column) -> DataFrame:
    """groups, average_precision: precision at each distinct score times the recall that it adds."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*groups, score).agg(F.count_if(positive).alias("_p"), F.count("*").alias("_a"))
    w = W.partitionBy(*groups).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    steps = counts.withColumn("_precision", F.sum("_p").over(w) / F.sum("_a").over(w)).withColumn("_all", F.sum("_p").over(W.partitionBy(*groups)))
    return steps.groupBy(*groups).agg(F.sum(F.try_divide(F.col("_p") * F.col("_precision"), F.col("_all"))).alias("average_precision"))


def mann_whitney(df: DataFrame, groups: Sequence[str], value: str, case: Column, with_p: bool = False) -> DataFrame:
    """groups, n1, n0, u, z (tie-corrected, continuity-corrected) and effect z / sqrt(n)."""
    ranked = rank(df.where(F.col(value).isNotNull()).withColumn("_c", case.cast("int")), value, groups, "average", name="_r")
    ranked = ranked.withColumn("_t", F.count("*").over(W.partitionBy(*groups, value)).cast("double"))
    a = ranked.groupBy(*groups).agg(F.sum("_c").cast("double").alias("n1"), F.sum(1 - F.col("_c")).cast("double").alias("n0"), F.sum(F.col("_c") * F.col("_r")).alias("_s"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"))
    n = F.col("n1") + F.col("n0")
    a = a.withColumn("u", F.col("_s") - F.col("n1") * (F.col("n1") + 1) / 2)
    sd = F.sqrt(F.col("n1") * F.col("n0") / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    off = F.col("u") - F.col("n1") * F.col("n0") / 2
    out = a.select(*groups, "n1", "n0", "u", F.try_divide(F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)), sd).alias("z"))
    out = out.withColumn("effect", F.col("z") / F.sqrt(F.col("n1") + F.col("n0")))
    return out.withColumn("p", dist.normal_two_sided("z")) if with_p else out


def correlations(df: DataFrame, unit: str, name: str, value: str, method: str = "pearson", groups: Sequence[str] = (), least: int = 3) -> DataFrame:
    """groups, a, b, n, r for pairs of names (a < b) with values of the same units: an equi join on the unit."""
    v = df.where(F.col(value).isNotNull())
    if method == "spearman":
        v = rank(v, value, [*groups, name], "average", name=value)
    x = v.select(*groups, unit, F.col(name).alias("a"), F.col(value).alias("_x"))
    y = v.select(*groups, unit, F.col(name).alias("b"), F.col(value).alias("_y"))
    both = x.join(y, [*groups, unit]).where("a < b")
    return both.groupBy(*groups, "a", "b").agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("r")).where(F.col("n") >= least)


def partner_correlations(df: DataFrame, unit: str, name: str, value: str, target: str) -> DataFrame:
    """name, n, r of every name with one target, whose values are joined by unit."""
    t = df.where(F.col(name) == target).select(unit, F.col(value).alias("_t"))
    return df.where(F.col(name) != target).join(t, unit).groupBy(name).agg(F.count("*").alias("n"), F.corr(value, "_t").alias("r"))


def ks_two_samples(df: DataFrame, groups: Sequence[str], value: str, case: Column) -> DataFrame:
    """groups, n1, n0, d: the largest distance of the two empirical distributions."""
    c = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count_if(case).alias("_a"), F.count_if(~case).alias("_b"))
    up, every = W.partitionBy(*groups).orderBy(value).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*groups)
    steps = c.withColumn("n1", F.sum("_a").over(every)).withColumn("n0", F.sum("_b").over(every)).withColumn("_d", F.abs(F.try_divide(F.sum("_a").over(up), F.col("n1")) - F.try_divide(F.sum("_b").over(up), F.col("n0"))))
    return steps.groupBy(*groups, "n1", "n0").agg(F.max("_d").alias("d"))


def ks_uniform(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """groups, n, d: the distance of values in [0, 1] from the uniform distribution."""
    w = W.partitionBy(*groups)
    i = F.row_number().over(w.orderBy(value))
    n = F.count("*").over(w)
    steps = df.where(F.col(value).isNotNull()).withColumn("_i", i).withColumn("n", n).withColumn("_d", F.greatest(F.col("_i") / F.col("n") - F.col(value), F.col(value) - (F.col("_i") - 1) / F.col("n")))
    return steps.groupBy(*groups, "n").agg(F.max("_d").alias("d"))


def jensen_shannon(df: DataFrame, value: str, case: Column, bins: int = 19) -> DataFrame:
    """One row, jsd (natural logarithm) of two arms over bins between the 1st and the 99th percentile; values beyond are in the end bins."""
    v = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"), case.alias("_c"))
    ends = quantiles(v, "_v", _lo=0.01, _hi=0.99)
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col("_v") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")), F.lit(0.0)))))
    cells = v.crossJoin(F.broadcast(ends)).groupBy(place.alias("_b")).agg(F.count_if("_c").alias("_a"), F.count_if(~F.col("_c")).alias("_z"))
    every = W.partitionBy()
    p, q = F.try_divide("_a", F.sum("_a").over(every)), F.try_divide("_z", F.sum("_z").over(every))
    cells = cells.select(p.alias("_p"), q.alias("_q")).withColumn("_m", (F.col("_p") + F.col("_q")) / 2)
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / F.col("_m"))).otherwise(0.0)
    return cells.agg(((F.sum(part("_p")) + F.sum(part("_q"))) / 2).alias("jsd"))


def quartile_strata(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rows of the top and of the bottom quarter of value (exact quartiles, linear), marked high and low."""
    q = df.groupBy(*groups).agg(F.percentile(value, 0.25).alias("_q1"), F.percentile(value, 0.75).alias("_q3"))
    joined = df.join(q, list(groups)) if groups else df.crossJoin(F.broadcast(q))
    return joined.withColumn("stratum", F.when(F.col(value) >= F.col("_q3"), "high").when(F.col(value) <= F.col("_q1"), "low")).where("stratum is not null").drop("_q1", "_q3")


def time_course(df: DataFrame, time: str, value: str, baseline: Column) -> DataFrame:
    """time, n, mean, sem, change against the mean of the baseline rows."""
    base = df.where(baseline).agg(F.avg(value).alias("_b"))
    a = df.where(~baseline).groupBy(time).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))
    return a.crossJoin(F.broadcast(base)).select(time, "n", "mean", "sem", (F.col("mean") - F.col("_b")).alias("change"))


def bootstrap_means(df: DataFrame, key: str, value: str, replicates: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row: mean, low, high, bias of the percentile interval by a Poisson bootstrap.

    Every row takes part in a replicate a Poisson(1) number of times, drawn from a hash of
    key, replicate and seed, so nothing is collected and reruns agree.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("_r")), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        steps.append(total)
        term /= k + 1
    times = sum(((F.col("_u") > s).cast("int") for s in steps), F.lit(0))
    drawn = df.where(F.col(value).isNotNull()).withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_u", u).withColumn("_k", times)
    means = drawn.groupBy("_r").agg(F.try_divide(F.sum(F.col(value) * F.col("_k")), F.sum("_k")).alias("_m"))
    edge = (1 - level) / 2
    whole = df.agg(F.avg(value).alias("mean"))
    return means.agg(F.percentile("_m", edge).alias("low"), F.percentile("_m", 1 - edge).alias("high"), F.avg("_m").alias("_a")).crossJoin(whole).select("mean", "low", "high", (F.col("_a") - F.col("mean")).alias("bias"))


def permutation_p(df: DataFrame, key: str, value: str, case: Column, replicates: int = 200, seed: int = 7) -> DataFrame:
    """One row: observed mean difference, p = (as extreme + 1) / (replicates + 1).

    In each replicate the labels are dealt anew: the n1 rows with the least seeded hashes of
    their keys are cases. Hashes are uniform, so the border lies within eight standard
    deviations of n1 / n: rows below are summed map-side, only those in between are put in
    order. Rows with a null value or case are left out. A replicate whose border lies elsewhere (many rows of one key) is put in order as a whole.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"), case.cast("int").alias("_c")).where("_c is not null")
    n = v.agg(F.count("_c").alias("_n"), F.sum("_c").alias("_n1"), F.sum("_v").alias("_s"), F.sum(F.when(F.col("_c") == 1, F.col("_v"))).alias("_s1"))
    share, difference = F.col("_n1") / F.col("_n"), lambda s1: F.try_divide(s1, F.col("_n1")) - F.try_divide(F.col("_s") - s1, F.col("_n") - F.col("_n1"))
    spread = 8 * F.sqrt((share * (1 - share) + 1 / F.col("_n")) / F.col("_n"))
    n = n.select("*", difference(F.col("_s1")).alias("observed"), (share - spread).alias("_low"), (share + spread).alias("_high"))
    dealt = v.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_h", F.xxhash64(F.lit(seed), "_k", "_r")).crossJoin(F.broadcast(n))
    place = F.col("_h") / float(1 << 64) + 0.5
    side = F.when(place < F.col("_low"), -1).when(place > F.col("_high"), 1).otherwise(0)
    between = lambda x: F.when(F.col("_side") == 0, F.col(x))
    sums = dealt.withColumn("_side", side).where("_side <= 0").groupBy("_r", "_side", between("_h").alias("_h"), between("_k").alias("_k"), between("_v").alias("_v")).agg(F.count("*").alias("_m"), F.sum("_v").alias("_t"))
    up = W.partitionBy("_r").orderBy("_side", "_h", "_k", "_v").rowsBetween(W.unboundedPreceding, 0)
    held = sums.withColumn("_upto", F.sum("_m").over(up)).crossJoin(F.broadcast(n.select("_n1")))
    taken = F.greatest(F.lit(0), F.least(F.col("_m"), F.col("_n1") - F.col("_upto") + F.col("_m")))
    share_taken = F.when(taken == F.col("_m"), F.col("_t")).when(F.col("_side") == 0, F.col("_v") * taken).otherwise(0.0)
    outside = ((F.col("_side") == -1) & (F.col("_m") > F.col("_n1"))).cast("int")
    each = held.groupBy("_r").agg(F.sum(share_taken).alias("_s1"), ((F.max(outside) == 1) | (F.max("_upto") < F.max("_n1"))).alias("_missed"))
    again = dealt.drop("_s1").join(F.broadcast(each.where("_missed").select("_r")), "_r").withColumn("_o", F.row_number().over(W.partitionBy("_r").orderBy("_h", "_k", "_v")))
    again = again.groupBy("_r").agg(F.sum(F.when(F.col("_o") <= F.col("_n1"), F.col("_v"))).alias("_s1"))
    every = each.where("not _missed").select("_r", "_s1").union(again).crossJoin(F.broadcast(n.drop("_s1")))
    return every.groupBy("observed").agg(((F.count_if(F.abs(difference(F.col("_s1"))) >= F.abs("observed")) + 1) / F.lit(replicates + 1.0)).alias("p"))


def with_correlation_p(correlations: DataFrame, r: str = "r", n: str = "n", method: str = "t") -> DataFrame:
    """correlations with p (of t = r sqrt((n - 2) / (1 - r^2)), or of |r| sqrt(n) as normal) and q over all rows."""
    from quern.operators.ranks import benjamini_hochberg

    t = F.try_divide(F.col(r) * F.sqrt(F.col(n) - 2), F.sqrt(1 - F.col(r) * F.col(r)))
    p = dist.t_two_sided(t, F.col(n) - 2) if method == "t" else dist.normal_two_sided(F.abs(r) * F.sqrt(n)) / 2
    return benjamini_hochberg(correlations.withColumn("p", p), "p")
