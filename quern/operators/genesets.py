"""Scores of named sets over ranked or measured members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import dist
from quern.functions.scalar import twice_the_lesser
from quern.operators.norm import zscore
from quern.operators.ranks import benjamini_hochberg, rank


def rank_sum_scores(df: DataFrame, sample: str, member: str, value: str, sets: dict[str, Column], least_common: int = 0, least_values: int = 1) -> DataFrame:
    """sample and one score a set: (rank sum - n_s (N + 1) / 2) / (n_s (N - n_s) / 2), from -1 to 1.

    0 where a set is empty or has everything; null where a sample has too few values or
    common members. All sets are scored from one ranking.
    """
    ranked = rank(df.where(F.col(value).isNotNull()), value, [sample], "average", name="_r")
    aggs = [F.count("*").alias("_n")]
    for k, inside in sets.items():
        aggs += [F.count_if(inside).alias(f"_n_{k}"), F.sum(F.when(inside, F.col("_r")).otherwise(0.0)).alias(f"_s_{k}")]
    a = ranked.groupBy(sample).agg(*aggs)
    out = []
    for k in sets:
        n, s = F.col(f"_n_{k}"), F.col(f"_s_{k}")
        score = F.coalesce(F.try_divide(s - n * (F.col("_n") + 1) / 2, n * (F.col("_n") - n) / 2.0), F.lit(0.0))
        out.append(F.when((F.col("_n") >= least_values) & (n >= least_common), score).alias(k))
    return a.select(sample, *out)


def coactivation(scores: DataFrame, first: str, second: str, name: str = "coactivation") -> DataFrame:
    """scores with z1, z2 over all samples and z1 + z2 - |z1 - z2|."""
    z = zscore(zscore(scores, first, name="z1"), second, name="z2")
    return z.withColumn(name, twice_the_lesser("z1", "z2"))


def running_enrichment(ranked: DataFrame, sets: DataFrame, member: str, score: str, name: str) -> DataFrame:
    """set, n_hits, score: the extreme of a walk down the list, +1/hits for members, -1/others for the rest.

    The walk is only evaluated at the hits, where it can turn: before and after each.
    """
    placed = rank(ranked.where(F.col(score).isNotNull()), score, [], "ordinal", True, [member], "_place")
    placed = placed.crossJoin(F.broadcast(placed.agg(F.max("_place").alias("_n"))))
    hits = placed.join(sets, member).withColumn("_i", F.row_number().over(W.partitionBy(name).orderBy("_place"))).withColumn("_h", F.count("*").over(W.partitionBy(name)))
    miss = F.coalesce(F.try_divide(F.lit(1.0), F.col("_n") - F.col("_h")), F.lit(0.0))
    after = F.col("_i") / F.col("_h") - (F.col("_place") - F.col("_i")) * miss
    both = hits.withColumn("_after", after).withColumn("_before", after - F.lit(1.0) / F.col("_h"))
    g = both.groupBy(name).agg(F.count("*").alias("n_hits"), F.max("_after").alias("_top"), F.min("_before").alias("_low"))
    return g.select(name, "n_hits", F.when(F.col("_top") >= -F.col("_low"), F.col("_top")).otherwise(F.col("_low")).alias("score"))


def over_representation(universe: DataFrame, chosen: DataFrame, sets: DataFrame, member: str, name: str, least: int = 1) -> DataFrame:
    """set, n_set, n_hit, expected, fold, p, q: hypergeometric upper tails, adjusted over the sets; built-in functions only."""
    u = universe.select(member).distinct()
    c = chosen.select(member).distinct().join(u, member, "left_semi")
    s = sets.select(name, member).distinct().join(u, member, "left_semi")
    sizes = u.agg(F.count("*").alias("_big")).crossJoin(c.agg(F.count("*").alias("_drawn")))
    hit = s.join(c.withColumn("_c", F.lit(1)), member, "left").groupBy(name).agg(F.count("*").alias("n_set"), F.count("_c").alias("n_hit")).where(F.col("n_hit") >= least)
    a = hit.crossJoin(F.broadcast(sizes)).withColumn("expected", F.col("n_set") * F.col("_drawn") / F.col("_big").cast("double"))
    a = a.withColumn("fold", F.try_divide("n_hit", "expected")).withColumn("p", dist.hypergeometric_upper(F.col("_big"), F.col("n_set"), F.col("_drawn"), F.col("n_hit")))
    return benjamini_hochberg(a, "p").select(name, "n_set", "n_hit", "expected", "fold", "p", "q")


def mean_scores(df: DataFrame, sets: DataFrame, sample: str, member: str, value: str, name: str) -> DataFrame:
    """sample, set, score: the mean value of the set's members."""
    return df.join(sets.select(name, member).distinct(), member).groupBy(sample, name).agg(F.avg(value).alias("score"))


def module_scores(df: DataFrame, sets: DataFrame, sample: str, member: str, value: str, name: str, bins: int = 24) -> DataFrame:
    """sample, set, score: the set's mean less the mean of all members from the same bins of average value."""
    means = df.groupBy(member).agg(F.avg(value).alias("_m"))
    binned = means.withColumn("_bin", F.floor(F.percent_rank().over(W.orderBy("_m")) * (bins - 1e-9)))
    inside = sets.select(name, member).distinct().join(binned, member)
    own = mean_scores(df, sets, sample, member, value, name)
    weights = inside.groupBy(name, "_bin").agg(F.count("*").alias("_w"))
    by_bin = df.join(binned, member).groupBy(sample, "_bin").agg(F.avg(value).alias("_v"))
    control = by_bin.join(weights, "_bin").groupBy(sample, name).agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("_c"))
    return own.join(control, [sample, name]).select(sample, name, (F.col("score") - F.col("_c")).alias("score"))


def marker_fractions(df: DataFrame, markers: DataFrame, sample: str, member: str, value: str, kind: str) -> DataFrame:
    """sample, kind, fraction: geometric means of x + 1 over the markers, less 1, as shares of the sample."""
    g = df.join(markers, member).groupBy(sample, kind).agg((F.exp(F.avg(F.ln(F.col(value) + 1))) - 1).alias("_g"))
    return g.select(sample, kind, F.coalesce(F.try_divide(F.col("_g"), F.sum("_g").over(W.partitionBy(sample))), F.lit(0.0)).alias("fraction"))


def annotate_clusters(tops: DataFrame, markers: DataFrame, cluster: str, member: str, kind: str, least_share: float = 0.1, unknown: str = "Unknown") -> DataFrame:
    """cluster, kind, share: the kind of which the largest share of markers is among the cluster's members; ties by name."""
    n = markers.groupBy(kind).agg(F.countDistinct(member).alias("_n"))
    hits = tops.select(cluster, member).distinct().join(markers.distinct(), member).groupBy(cluster, kind).agg(F.count("*").alias("_h")).join(n, kind)
    best = hits.withColumn("share", F.col("_h") / F.col("_n")).withColumn("_i", F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("share"), kind))).where("_i = 1")
    out = tops.select(cluster).distinct().join(best, cluster, "left")
    return out.select(cluster, F.when(F.col("share") >= least_share, F.col(kind)).otherwise(unknown).alias(kind), F.coalesce("share", F.lit(0.0)).alias("share"))


def condition_delta(df: DataFrame, kind: str, value: str, case: Column) -> DataFrame:
    """kind, n1, n0, delta: the mean of the case less that of the control."""
    return df.groupBy(kind).agg(F.count_if(case).alias("n1"), F.count_if(~case).alias("n0"), (F.avg(F.when(case, F.col(value))) - F.avg(F.when(~case, F.col(value)))).alias("delta"))


def effect_kinds(deltas: DataFrame, kind: str, least_delta: float = 0.02, least_n: int = 10, n: int = 5) -> DataFrame:
    ok = deltas.where((F.col("n1") >= least_n) & (F.col("n0") >= least_n) & (F.abs("delta") >= least_delta))
    return ok.orderBy(F.desc(F.abs("delta")), kind).limit(n)


def expressed_pairs(counts: DataFrame, cells: DataFrame, pairs: DataFrame, cell: str, kind: str, gene: str, ligand: str, receptor: str, least: float = 0.05) -> DataFrame:
    """sender, receiver, ligand, receptor of which more than the share least of cells have the gene; counts hold nonzero values only."""
    n = cells.groupBy(kind).agg(F.count("*").alias("_n"))
    share = counts.join(cells, cell).groupBy(kind, gene).agg(F.countDistinct(cell).alias("_h")).join(n, kind).where(F.col("_h") / F.col("_n") > least)
    l = share.select(F.col(kind).alias("sender"), F.col(gene).alias(ligand))
    r = share.select(F.col(kind).alias("receiver"), F.col(gene).alias(receptor))
    return pairs.select(ligand, receptor).distinct().join(l, ligand).join(r, receptor).where("sender <> receiver").select("sender", "receiver", ligand, receptor)


def perturbation_score(df: DataFrame, gene: str, significant: Column, correlated: Column, effect: str) -> DataFrame:
    """gene, n_sig, n_corr, score = 2 n_sig + 0.5 n_corr + 0.1 mean effect + 0.05 largest effect."""
    a = df.groupBy(gene).agg(F.count_if(significant).alias("n_sig"), F.count_if(correlated).alias("n_corr"), F.avg(effect).alias("_m"), F.max(effect).alias("_x"))
    return a.select(gene, "n_sig", "n_corr", (2 * F.col("n_sig") + 0.5 * F.col("n_corr") + 0.1 * F.coalesce("_m", F.lit(0.0)) + 0.05 * F.coalesce("_x", F.lit(0.0))).alias("score"))


def knockout_by_correlation(correlations: DataFrame, r: str, times: float = -2.0, name: str = "predicted") -> DataFrame:
    return correlations.withColumn(name, F.col(r) * times)


def map_orthologs(genes: DataFrame, gene: str, table: DataFrame, source: str, target: str, separator: str = r"\|") -> tuple[DataFrame, DataFrame]:
    """(gene with each ortholog, genes without one); the table's target may hold several, separated."""
    pairs = table.withColumn("_t", F.explode(F.split(target, separator))).select(F.upper(F.trim(source)).alias("_g"), F.upper(F.trim("_t")).alias("ortholog")).where("_g <> '' and ortholog <> ''").distinct()
    joined = genes.join(pairs, F.upper(F.trim(gene)) == F.col("_g"), "left").drop("_g")
    return joined.where("ortholog is not null"), joined.where("ortholog is null").drop("ortholog")


def compare_groups(df: DataFrame, sample: str, scores: Sequence[str], case: Column) -> DataFrame:
    """score, n1, n0, difference, t, df for each named score column."""
    from quern.operators.stats import welch_t

    long = df.withColumn("_case", case).unpivot([sample, "_case"], list(scores), "score", "_v")
    return welch_t(long, ["score"], "_v", F.col("_case"))


def rank_stability(scores: DataFrame, run: str, sample: str, score: str) -> DataFrame:
    """One row, n_pairs and stability: the mean rank correlation of all pairs of runs (of a parameter grid) over the same samples."""
    from quern.operators.stats import correlations

    r = correlations(scores, sample, run, score, "spearman")
    return r.agg(F.count("r").alias("n_pairs"), F.avg("r").alias("stability"))


def virtual_knockout(df: DataFrame, sample: str, member: str, value: str, target: str, top: int = 50) -> DataFrame:
    """member, n, r, effect, d, p, q: what taking the target away would do to its most correlated members.

    Each member is regressed on the target; setting the target to zero moves its mean by
    -slope * mean(target), d is that move in standard deviations of the member, p that of
    |d| sqrt(n) as normal. One pass of sums over the joined values.
    """
    t = df.where(F.col(member) == target).select(sample, F.col(value).alias("_t"))
    both = df.where(F.col(member) != target).join(t, sample).where(F.col(value).isNotNull() & F.col("_t").isNotNull())
    a = both.groupBy(member).agg(F.count("*").alias("n"), F.corr(value, "_t").alias("r"), F.regr_slope(F.col(value), F.col("_t")).alias("_slope"), F.avg("_t").alias("_m"), F.stddev_samp(value).alias("_sd"))
    best = a.orderBy(F.desc_nulls_last(F.abs("r")), member).limit(top).withColumn("effect", -F.col("_slope") * F.col("_m"))
    out = best.withColumn("d", F.try_divide("effect", "_sd")).withColumn("p", dist.normal_two_sided(F.abs("d") * F.sqrt("n")))
    return benjamini_hochberg(out, "p").select(member, "n", "r", "effect", "d", "p", "q")
