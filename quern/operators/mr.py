"""Instrument harmonisation and effect estimation for many exposures at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import dist
from quern.functions.scalar import complement, flags
from quern.operators.topk import top_per_group
from quern.session import held


def parse_variant(df: DataFrame, column: str) -> DataFrame:
    """df with chr, pos, ref and alt of ids such as chr1_665098_G_A_b38; null where a part is missing."""
    at = lambda i: F.when(F.split_part(F.col(column), F.lit("_"), F.lit(i)) != "", F.split_part(F.col(column), F.lit("_"), F.lit(i)))
    return df.withColumn("chr", F.regexp_replace(at(1), "^chr", "")).withColumn("pos", at(2).try_cast("bigint")).withColumn("ref", at(3)).withColumn("alt", at(4))


def to_exposure(df: DataFrame, gene: str, variant: str, beta: str, se: str, p: str, eaf: str, tissue: str, n: int = 50) -> DataFrame:
    """The n most significant variants of each gene in the common exposure layout."""
    best = top_per_group(parse_variant(df, variant), [gene], [F.asc_nulls_last(p), variant], n)
    return best.select(F.split_part(F.col(gene), F.lit("_"), F.lit(1)).alias("gene"), F.col(variant).alias("snp"), "chr", "pos", F.upper("alt").alias("effect_allele"), F.upper("ref").alias("other_allele"), F.col(beta).alias("beta"), F.col(se).alias("se"), F.col(p).alias("p"), F.col(eaf).alias("eaf"), F.lit(tissue).alias("tissue"))


def tissue_matches(df: DataFrame, gene: str, snp: str, tissue: str, p: str, n: int = 50) -> DataFrame:
    """Per gene the n best variants over all tissues, each with the tissues that have it (joined by +)."""
    merged = df.groupBy(gene, snp).agg(F.min(p).alias("p"), F.array_join(F.sort_array(F.collect_set(tissue)), "+").alias("tissues"))
    return top_per_group(merged, [gene], [F.asc_nulls_last("p"), snp], n)


def harmonise(exposure: DataFrame, outcome: DataFrame, keys: Sequence[str], p: str = "p", least_f: float = 10.0) -> DataFrame:
    """Exposure rows with the outcome effect for the same allele.

    Both sides have keys, effect_allele, other_allele, beta, se, eaf and p. Each position keeps
    its smallest p on either side. Outcome alleles that are swapped turn the sign of beta and
    eaf to 1 - eaf; other pairs go, as do rows with a null and those with F not above least_f.
    """
    exposure_keys = [*keys, *(["gene"] if "gene" in exposure.columns else [])]
    order = [F.asc_nulls_last(p), "effect_allele", "other_allele", "beta", "se", "eaf"]
    e = top_per_group(exposure, exposure_keys, order, 1)
    o = top_per_group(outcome, keys, order, 1)
    o = o.select(*keys, *[F.col(c).alias(f"{c}_out") for c in ("effect_allele", "other_allele", "beta", "se", "eaf")], F.col(p).alias("p_out"))
    u = F.upper
    same = (u("effect_allele") == u("effect_allele_out")) & (u("other_allele") == u("other_allele_out"))
    swapped = (u("effect_allele") == u("other_allele_out")) & (u("other_allele") == u("effect_allele_out"))
    both = e.join(o, list(keys)).withColumn("flipped", swapped).where(same | swapped)
    both = both.withColumn("beta_out", F.when(F.col("flipped"), -F.col("beta_out")).otherwise(F.col("beta_out"))).withColumn("eaf_out", F.when(F.col("flipped"), 1 - F.col("eaf_out")).otherwise(F.col("eaf_out")))
    return both.na.drop(subset=["beta", "se", "beta_out", "se_out"]).where((F.col("se") > 0) & (F.col("se_out") > 0)).withColumn("f", F.pow(F.col("beta") / F.col("se"), F.lit(2.0))).where(F.col("f") > least_f)


def palindromic(effect: str, other: str, eaf: str, near: float = 0.08) -> Column:
    """Whether the alleles are each other's complement and the frequency is too near one half to tell the strand."""
    return (F.upper(effect) == complement(F.col(other))) & (F.abs(F.col(eaf) - 0.5) <= near)


def f_summary(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, n, mean, smallest and largest F, and whether any is below 10."""
    return df.groupBy(*groups).agg(F.count("*").alias("n_snp"), F.avg("f").alias("f_mean"), F.min("f").alias("f_min"), F.max("f").alias("f_max"), F.bool_or(F.col("f") < 10).alias("any_weak"))


def f_from_r2(df: DataFrame, groups: Sequence[str], beta: str, se: str, eaf: str, n: str) -> DataFrame:
    """df with r2 of the variant, r2 of its group and F = r2 (n - k - 1) / (k (1 - r2))."""
    w = W.partitionBy(*groups)
    b2 = F.col(beta) * F.col(beta) * 2 * F.col(eaf) * (1 - F.col(eaf))
    r2 = F.try_divide(b2, b2 + F.col(se) * F.col(se) * 2 * F.col(n) * F.col(eaf) * (1 - F.col(eaf)))
    return df.withColumn("r2", r2).withColumn("r2_all", F.sum("r2").over(w)).withColumn("k", F.count("*").over(w)).withColumn("f_all", F.try_divide(F.col("r2_all") * (F.col(n) - F.col("k") - 1), F.col("k") * (1 - F.col("r2_all"))))


def wald(df: DataFrame) -> DataFrame:
    """df with ratio = beta_out / beta and its first-order standard error."""
    return df.withColumn("ratio", F.try_divide("beta_out", "beta")).withColumn("ratio_se", F.try_divide(F.col("se_out"), F.abs("beta")))


def ivw(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, n_snp, beta, se (multiplicative random effects, never below fixed), q and its degrees of freedom."""
    w = F.lit(1.0) / (F.col("se_out") * F.col("se_out"))
    x, y = F.col("beta"), F.col("beta_out")
    a = df.groupBy(*groups).agg(F.count("*").alias("n_snp"), F.sum(w * x * x).alias("_xx"), F.sum(w * x * y).alias("_xy"), F.sum(w * y * y).alias("_yy"))
    a = a.withColumn("beta", F.col("_xy") / F.col("_xx")).withColumn("q", F.greatest(F.lit(0.0), F.col("_yy") - F.col("_xy") * F.col("_xy") / F.col("_xx"))).withColumn("q_df", F.col("n_snp") - 1)
    inflate = F.greatest(F.lit(1.0), F.sqrt(F.coalesce(F.try_divide("q", "q_df"), F.lit(1.0))))
    return a.select(*groups, "n_snp", "beta", (inflate / F.sqrt("_xx")).alias("se"), "q", "q_df")


def egger(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, n_snp, slope, slope_se, intercept, intercept_se of the weighted line, exposures made positive; three variants at least."""
    sign = F.when(F.col("beta") < 0, -1.0).otherwise(1.0)
    w, x, y = F.lit(1.0) / (F.col("se_out") * F.col("se_out")), F.abs("beta"), F.col("beta_out") * sign
    a = df.groupBy(*groups).agg(F.count("*").alias("n_snp"), F.sum(w).alias("_w"), F.sum(w * x).alias("_x"), F.sum(w * y).alias("_y"), F.sum(w * x * x).alias("_xx"), F.sum(w * x * y).alias("_xy"), F.sum(w * y * y).alias("_yy")).where("n_snp >= 3")
    det = F.col("_w") * F.col("_xx") - F.col("_x") * F.col("_x")
    a = a.withColumn("_d", det).withColumn("slope", F.try_divide(F.col("_w") * F.col("_xy") - F.col("_x") * F.col("_y"), F.col("_d"))).withColumn("intercept", F.try_divide(F.col("_xx") * F.col("_y") - F.col("_x") * F.col("_xy"), F.col("_d")))
    rss = F.greatest(F.lit(0.0), F.col("_yy") - F.col("intercept") * F.col("_y") - F.col("slope") * F.col("_xy"))
    s = F.greatest(F.lit(1.0), F.sqrt(rss / (F.col("n_snp") - 2)))
    return a.select(*groups, "n_snp", "slope", (s * F.sqrt(F.try_divide("_w", "_d"))).alias("slope_se"), "intercept", (s * F.sqrt(F.try_divide("_xx", "_d"))).alias("intercept_se"))


def weighted_median(df: DataFrame, groups: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """groups, n_snp, beta: the ratio at half of the inverse-variance weight, linear between neighbours."""
    r = wald(df).where("ratio is not null").withColumn("_w", F.lit(1.0) / (F.col("ratio_se") * F.col("ratio_se")))
    over = W.partitionBy(*groups).orderBy("ratio", *ties)
    s = r.withColumn("_mid", (F.sum("_w").over(over.rowsBetween(W.unboundedPreceding, 0)) - F.col("_w") / 2) / F.sum("_w").over(W.partitionBy(*groups)))
    s = s.withColumn("_next", F.lead("_mid").over(over)).withColumn("_r2", F.lead("ratio").over(over)).withColumn("_n", F.count("*").over(W.partitionBy(*groups))).withColumn("_first", F.row_number().over(over) == 1)
    between = F.col("ratio") + (F.col("_r2") - F.col("ratio")) * (F.lit(0.5) - F.col("_mid")) / (F.col("_next") - F.col("_mid"))
    hit = F.when((F.col("_mid") <= 0.5) & (F.col("_next") > 0.5), between).when((F.col("_mid") <= 0.5) & F.col("_next").isNull(), F.col("ratio")).when(F.col("_first") & (F.col("_mid") > 0.5), F.col("ratio"))
    return s.groupBy(*groups).agg(F.max("_n").alias("n_snp"), F.max(hit).alias("beta"))


def leave_one_out(df: DataFrame, groups: Sequence[str], snp: str) -> DataFrame:
    """groups, snp, beta, se of the inverse-variance estimate without that variant: totals less its part."""
    w = F.lit(1.0) / (F.col("se_out") * F.col("se_out"))
    xx, xy, over = w * F.col("beta") * F.col("beta"), w * F.col("beta") * F.col("beta_out"), W.partitionBy(*groups)
    a = df.withColumn("_xx", F.sum(xx).over(over) - xx).withColumn("_xy", F.sum(xy).over(over) - xy).withColumn("_n", F.count("*").over(over)).where("_n > 1")
    return a.select(*groups, snp, F.try_divide("_xy", "_xx").alias("beta"), (F.lit(1.0) / F.sqrt("_xx")).alias("se"))


def steiger(df: DataFrame, groups: Sequence[str], n_exposure: float, n_outcome: float, with_p: bool = False) -> DataFrame:
    """groups, r2_exposure, r2_outcome, z, right_direction: whether the variants explain more of the exposure."""
    r2 = lambda b, s, n: (F.col(b) / F.col(s)) ** 2 / ((F.col(b) / F.col(s)) ** 2 + n - 2)
    a = df.groupBy(*groups).agg(F.sum(r2("beta", "se", n_exposure)).alias("r2_exposure"), F.sum(r2("beta_out", "se_out", n_outcome)).alias("r2_outcome"))
    fisher = lambda c: F.atanh(F.least(F.sqrt(c), F.lit(1 - 1e-12)))
    z = (fisher(F.col("r2_exposure")) - fisher(F.col("r2_outcome"))) / (1 / (n_exposure - 3) + 1 / (n_outcome - 3)) ** 0.5
    out = a.withColumn("z", z).withColumn("right_direction", F.col("r2_exposure") > F.col("r2_outcome"))
    return out.withColumn("p", dist.normal_two_sided("z")) if with_p else out


def coloc(df: DataFrame, groups: Sequence[str], prior_sd: float = 0.15, p1: float = 1e-4, p2: float = 1e-4, p12: float = 1e-5) -> DataFrame:
    """groups, n_snp and the posterior probabilities pp0 to pp4, from approximate Bayes factors of both traits."""

    def log_bf(b: str, s: str) -> Column:
        v = F.col(s) * F.col(s)
        r = prior_sd**2 / (prior_sd**2 + v)
        return 0.5 * (F.ln(1 - r) + r * F.col(b) * F.col(b) / v)

    d = df.withColumn("_a", log_bf("beta", "se")).withColumn("_b", log_bf("beta_out", "se_out")).withColumn("_c", F.col("_a") + F.col("_b"))
    over = W.partitionBy(*groups)
    for c in "abc":
        d = d.withColumn(f"_m{c}", F.max(f"_{c}").over(over))
    a = d.groupBy(*groups).agg(F.count("*").alias("n_snp"), *[(F.first(f"_m{c}") + F.ln(F.sum(F.exp(F.col(f"_{c}") - F.col(f"_m{c}"))))).alias(f"_l{c}") for c in "abc"])
    import math

    both = F.col("_la") + F.col("_lb")
    gap = F.greatest(1 - F.exp(F.col("_lc") - both), F.lit(1e-300))
    a = a.withColumn("_h0", F.lit(0.0)).withColumn("_h1", F.col("_la") + math.log(p1)).withColumn("_h2", F.col("_lb") + math.log(p2)).withColumn("_h3", both + F.ln(gap) + math.log(p1) + math.log(p2)).withColumn("_h4", F.col("_lc") + math.log(p12))
    top = F.greatest(*[F.col(f"_h{i}") for i in range(5)])
    total = sum((F.exp(F.col(f"_h{i}") - top) for i in range(5)), F.lit(0.0))
    return a.select(*groups, "n_snp", *[(F.exp(F.col(f"_h{i}") - top) / total).alias(f"pp{i}") for i in range(5)])


def replicate(discovery: DataFrame, replication: DataFrame, key: str) -> DataFrame:
    """key, beta, se, consistent: fixed-effect mean of two estimates (beta, se), and whether their signs agree."""
    r = replication.select(key, F.col("beta").alias("_b"), F.col("se").alias("_s"))
    w1, w2 = F.lit(1.0) / (F.col("se") * F.col("se")), F.lit(1.0) / (F.col("_s") * F.col("_s"))
    return discovery.join(r, key).select(key, ((F.col("beta") * w1 + F.col("_b") * w2) / (w1 + w2)).alias("beta"), (F.lit(1.0) / F.sqrt(w1 + w2)).alias("se"), (F.signum("beta") == F.signum("_b")).alias("consistent"))


def status(estimates: DataFrame) -> DataFrame:
    """estimates (n_snp, p and f_min if present) with status: what speaks against a result, joined by |."""
    rules = {"single_variant": F.col("n_snp") == 1}
    if "f_min" in estimates.columns:
        rules["weak_instrument"] = F.col("f_min") < 10
    if "q" in estimates.columns:
        rules["heterogeneous"] = F.coalesce(F.col("q") > 2 * F.col("q_df"), F.lit(False)) & (F.col("q_df") > 0)
    return estimates.withColumn("status", flags(**rules))


def consistency(left: DataFrame, right: DataFrame, key: str, beta: str = "beta") -> DataFrame:
    """Full outer comparison of two runs: key, left and right effect, and consistent, opposite, left_only or right_only."""
    from quern.operators.joins import compare

    c = compare(left, right, [key], beta)
    same = F.signum(f"left_{beta}") == F.signum(f"right_{beta}")
    return c.select(key, f"left_{beta}", f"right_{beta}", F.when(F.col("side") != "both", F.concat("side", F.lit("_only"))).when(same, "consistent").otherwise("opposite").alias("consistency"))


def bridge(edges: DataFrame, effects: DataFrame, a: str, b: str, key: str, beta: str, p: str, level: float = 0.05) -> DataFrame:
    """Edges with both ends' effects: concordant signs, evidence (0 to 3) and priority."""
    from quern.operators.joins import annotate_ends

    e = annotate_ends(edges, a, b, effects, key, [beta, p])
    good = lambda t: F.coalesce(F.col(f"{t}_{p}") < level, F.lit(False)).cast("int")
    concordant = F.coalesce(F.signum(f"a_{beta}") == F.signum(f"b_{beta}"), F.lit(False))
    out = e.withColumn("concordant", concordant).withColumn("evidence", good("a") + good("b") + (concordant & (good("a") + good("b") == 2)).cast("int"))
    return out.withColumn("priority", F.when(F.col("evidence") == 3, "high").when(F.col("evidence") == 2, "medium").when(F.col("evidence") == 1, "low").otherwise("none"))


def modes(df: DataFrame, groups: Sequence[str], phi: float = 1.0, points: int = 128) -> DataFrame:
    """groups, n_snp, simple_mode, weighted_mode: where the smoothed density of the ratios is highest, each ratio counting once or by its inverse variance.

    The width is phi * 0.9 * min(sd, 1.4826 * mad) / n^(1/5) of the group; the density is taken at
    equally spaced points from three widths below the least ratio to three above the largest.
    A group without spread has its median as mode. The lowest point wins ties.
    """
    r = wald(df).where("ratio is not null and ratio_se > 0").select(*groups, "ratio", (F.lit(1.0) / (F.col("ratio_se") * F.col("ratio_se"))).alias("_w"))
    a = r.groupBy(*groups).agg(F.count("*").alias("n_snp"), F.stddev_samp("ratio").alias("_sd"), F.median("ratio").alias("_med"), F.min("ratio").alias("_lo"), F.max("ratio").alias("_hi"))
    mad = r.join(a.select(*groups, "_med"), list(groups)).groupBy(*groups).agg((1.4826 * F.median(F.abs(F.col("ratio") - F.col("_med")))).alias("_mad"))
    a = a.join(mad, list(groups)).withColumn("_h", phi * 0.9 * F.least(F.coalesce("_sd", F.lit(0.0)), F.col("_mad")) / F.pow(F.col("n_snp").cast("double"), F.lit(0.2)))
    step = (F.col("_hi") - F.col("_lo") + 6 * F.col("_h")) / (points - 1)
    grid = a.where("_h > 0").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(*groups, "_i", (F.col("_lo") - 3 * F.col("_h") + F.col("_i") * step).alias("_x"), "_h")
    k = F.exp(-F.pow((F.col("_x") - F.col("ratio")) / F.col("_h"), F.lit(2.0)) / 2)
    density = grid.join(r, list(groups)).groupBy(*groups, "_i", "_x").agg(F.sum(k).alias("_s"), F.sum(k * F.col("_w")).alias("_v"))
    best = density.groupBy(*groups).agg(F.max_by("_x", F.struct("_s", -F.col("_i"))).alias("_simple"), F.max_by("_x", F.struct("_v", -F.col("_i"))).alias("_weighted"))
    return a.join(best, list(groups), "left").select(*groups, "n_snp", F.coalesce("_simple", "_med").alias("simple_mode"), F.coalesce("_weighted", "_med").alias("weighted_mode"))


def radial(df: DataFrame, groups: Sequence[str], snp: Sequence[str], level: float = 0.05) -> DataFrame:
    """groups, snp, weight, q, p, outlier: each variant's part of Cochran's Q about the radial estimate; Bonferroni within the group.

    Radial axes are sqrt(weight) and ratio * sqrt(weight) with weight beta^2 / se_out^2; the line
    through the origin has the inverse-variance estimate as slope. p is that of one degree of freedom.
    """
    r = wald(df).where("ratio is not null").withColumn("weight", F.pow(F.col("beta") / F.col("se_out"), F.lit(2.0)))
    over = W.partitionBy(*groups)
    slope = F.sum(F.col("weight") * F.col("ratio")).over(over) / F.sum("weight").over(over)
    q = r.withColumn("_n", F.count("*").over(over)).withColumn("q", F.col("weight") * F.pow(F.col("ratio") - slope, F.lit(2.0)))
    out = q.withColumn("p", dist.normal_two_sided(F.sqrt("q")))
    return out.select(*groups, *snp, "weight", "q", "p", (F.col("p") * F.col("_n") < level).alias("outlier"))


def all_methods(df: DataFrame, groups: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """groups, method, n_snp, beta: a single variant's ratio, else inverse variance, Egger (from three), weighted median and both modes."""
    one = df.withColumn("_n", F.count("*").over(W.partitionBy(*groups)))
    single, many = one.where("_n = 1").drop("_n"), one.where("_n > 1").drop("_n")
    row = lambda t, method, beta: t.select(*groups, F.lit(method).alias("method"), F.col("n_snp").cast("long").alias("n_snp"), F.col(beta).alias("beta"))
    m = modes(many, groups)
    parts = [row(wald(single).withColumn("n_snp", F.lit(1)), "wald_ratio", "ratio"), row(ivw(many, groups), "ivw", "beta"), row(egger(many, groups), "egger", "slope"), row(weighted_median(many, groups, ties), "weighted_median", "beta"), row(m, "simple_mode", "simple_mode"), row(m, "weighted_mode", "weighted_mode")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graded_clump(df: DataFrame, groups: Sequence[str], position: str, p: str, windows: Sequence[float], least: int) -> DataFrame:
    """df's rows after clumping with the widest window that leaves the group least rows, else with none; grade is its number from 0, -1 for none."""
    from quern.operators.intervals import clump

    keys, rest, out = list(groups), df.na.drop(subset=list(groups)), None
    for i, w in enumerate(windows):
        # only groups that no wider window settled are clumped again
        kept = held(clump(rest, keys, position, p, w).withColumn("grade", F.lit(i)), "clumped")
        enough = kept.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*keys)
        settled = kept.join(enough, keys, "left_semi")
        out = settled if out is None else out.unionByName(settled)
        rest = rest.join(enough, keys, "left_anti")
    rest = rest.withColumn("grade", F.lit(-1))
    rows = rest if out is None else out.unionByName(rest)
    return rows.select(*keys, "grade", *[c for c in df.columns if c not in keys])
