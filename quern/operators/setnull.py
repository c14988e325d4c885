"""Set enrichment against a null of random sets, and kernel-based set scores of samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import dist
from quern.operators.order import place
from quern.session import held, reach_package

#: Values of a member that meet in one group of the kernel; more are dealt to blocks that meet pair by pair.
KERNEL_BLOCK = 2048


def deviations(ranked: DataFrame, sets: DataFrame, member: str, score: str, name: str) -> DataFrame:
    """set, n_set, n_hits, n_ranked, es: the largest distance between the share of hits and the share of places passed.

    It is reached at a hit or just before one, so only hits are looked at. Members rank by score,
    descending, then by member; null scores and repeated members of a set don't count, members
    that aren't ranked count in n_set only. A set without hits has es 0.
    """
    s = sets.select(name, member).distinct()
    placed = place(ranked.where(F.col(score).isNotNull()).select(member, score), [F.desc(score), F.asc(member)], name="_place")
    hits = place(placed.join(s, member).select(name, "_place"), ["_place"], [name], "_i")
    sizes = s.groupBy(name).agg(F.count("*").alias("n_set"))
    totals = hits.groupBy(name).agg(F.max("_i").alias("n_hits"))
    all_places = placed.agg(F.max("_place").alias("n_ranked"))
    both = hits.join(totals, name).crossJoin(F.broadcast(all_places))
    share, n = lambda k: (F.col("_i") - k) / F.col("n_hits"), F.col("n_ranked")
    es = F.max(F.greatest(F.abs(share(0) - F.col("_place") / n), F.abs(share(1) - (F.col("_place") - 1) / n)))
    found = both.groupBy(name, "n_hits").agg(es.alias("es"))
    out = sizes.join(found, name, "left").crossJoin(F.broadcast(all_places))
    return out.select(name, "n_set", F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), F.coalesce("n_ranked", F.lit(0)).cast("long").alias("n_ranked"), F.coalesce("es", F.lit(0.0)).alias("es"))


def random_deviation(n: int, k: int, seed: int, replicate: int) -> float:
    """The deviation of k of n places drawn without replacement; the draw depends on the arguments alone."""
    at = np.sort(np.random.default_rng([seed, n, k, replicate]).choice(n, k, replace=False, shuffle=False)) + 1
    i = np.arange(1, k + 1)
    return float(max(np.abs(i / k - at / n).max(), np.abs((i - 1) / k - (at - 1) / n).max()))


def permuted_enrichment(ranked: DataFrame, sets: DataFrame, member: str, score: str, name: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """set, n_set, n_hits, n_ranked, es, nes, p: es against those of random sets of the same size.

    nes is es less the mean of the null, in its (population) standard deviations, es itself where
    the null doesn't vary; p the share of the null that reaches es. A set without hits has nes 0
    and p 1. One ranking serves all: a random set is a draw of places, and sets of one size share
    their null, so the work is replicates x distinct sizes, dealt to all tasks, whatever the
    number of sets. A draw takes memory for the places of one set.
    """
    reach_package(ranked.sparkSession)
    observed = held(deviations(ranked, sets, member, score, name), "set-deviations")
    sizes = observed.where("n_hits > 0").select("n_ranked", F.least("n_set", "n_ranked").alias("_k")).distinct()
    runs = sizes.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).repartition("_k", "_r")

    def draw(n: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ns, ks, rs in n:
            yield pd.Series([random_deviation(int(a), int(b), seed, int(c)) for a, b, c in zip(ns, ks, rs)], dtype=float)

    draw.__annotations__ = {"n": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    null = runs.withColumn("_es", F.pandas_udf(draw, "double")("n_ranked", "_k", "_r"))
    null = null.groupBy("_k").agg(F.avg("_es").alias("_mean"), F.stddev_pop("_es").alias("_sd"), F.collect_list("_es").alias("_null"))
    both = observed.withColumn("_k", F.least("n_set", "n_ranked")).join(null, "_k", "left")
    p = F.size(F.filter("_null", lambda x: x >= F.col("es"))) / F.lit(float(replicates))
    nes = F.when(F.col("_sd") > 0, (F.col("es") - F.col("_mean")) / F.col("_sd")).otherwise(F.col("es"))
    hit = F.col("n_hits") > 0
    return both.select(name, "n_set", "n_hits", "n_ranked", "es", F.when(hit, nes).otherwise(0.0).alias("nes"), F.when(hit, p).otherwise(1.0).alias("p"))


def kernel_density(df: DataFrame, sample: str, member: str, value: str, block: int = KERNEL_BLOCK) -> DataFrame:
    """member, sample, density: the Gaussian-kernel cumulative distribution of the member's values, at each of them.

    The width is a quarter of the member's standard deviation; members that don't vary and null
    values are left out. A member with more than block values is dealt to blocks, each pair of
    which is a group of its own.
    """
    reach_package(df.sparkSession)
    v = df.where(F.col(value).isNotNull()).select(F.col(member).alias("member"), F.col(sample).alias("sample"), F.col(value).cast("double").alias("x"))
    widths = v.groupBy("member").agg((F.stddev_samp("x") / 4).alias("_h"), F.count("*").alias("_n")).where("_h > 0").withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    # written, as a width computed a second time differs in its last bits
    at = held(v.join(widths, "member").withColumn("_mine", F.pmod(F.xxhash64("sample"), F.col("_blocks")).cast("int")), "kernel-values")
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    left = at.withColumn("_side", F.lit(True)).withColumn("_j", F.explode(others)).withColumnRenamed("_mine", "_i")
    right = at.withColumn("_side", F.lit(False)).withColumn("_i", F.explode(others)).withColumnRenamed("_mine", "_j")
    cells = left.unionByName(right).groupBy("member", "_i", "_j").agg(F.max("_h").alias("_h"), F.max("_n").alias("_n"), F.collect_list(F.when(F.col("_side"), F.struct("sample", "x"))).alias("_l"), F.collect_list(F.when(~F.col("_side"), F.col("x"))).alias("_r"))

    def sums(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ls, rs, hs in batches:
            out = []
            for a, b, h in zip(ls, rs, hs):
                a, b = np.asarray(a, float), np.asarray(b, float)
                total = np.zeros(len(a))
                for k in range(0, len(b), 256):
                    total += dist.normal_upper_array((b[k : k + 256][None, :] - a[:, None]) / h).sum(1)
                out.append(total)
            yield pd.Series(out)

    sums.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    part = cells.where(F.size("_l") > 0).withColumn("_s", F.pandas_udf(sums, "array<double>")(F.transform("_l", lambda e: e["x"]), "_r", "_h"))
    each = part.select("member", "_n", F.explode(F.arrays_zip(F.transform("_l", lambda e: e["sample"]).alias("sample"), F.col("_s").alias("s"))).alias("e"))
    return each.groupBy(F.col("member").alias(member), F.col("e.sample").alias(sample)).agg((F.sum("e.s") / F.first("_n")).alias("density"))


def kernel_scores(df: DataFrame, sets: DataFrame, sample: str, member: str, value: str, name: str, taus: Sequence[float] = (0.25, 0.5, 1.0, 2.0), digits: int = 9, least: int = 1) -> DataFrame:
    """sample, set, tau, mx_diff, score: the walk of each set down the sample's members, by kernel density, for a grid of settings.

    The density is rounded to so many digits; members stand in its descending order, then by
    member. Place l of p weighs |p - l + 1 - p / 2|; a hit moves the walk up by its weight ^ tau
    over the hits' sum (all alike where that is 0), another member down by 1 / others. With mx_diff the score is the largest
    positive plus the least negative value, else whichever is further from 0 (the positive one
    only if it is further, to so many digits). The walk is looked at before and after hits alone. Sets with fewer
    than least hits, or with every member, have no row.
    """
    density = kernel_density(df, sample, member, value).withColumn("_d", F.round("density", digits))
    placed = held(place(density, [F.desc("_d"), F.asc(member)], [sample], "_l").drop("_d", "density"), "kernel-places")
    all_members = placed.groupBy(sample).agg(F.count("*").alias("_p"))
    s = sets.select(name, member).distinct()
    hits = placed.join(s, member).join(all_members, sample)
    weight = F.abs(F.col("_p") - F.col("_l") + 1 - F.col("_p") / 2.0)
    over = W.partitionBy(sample, name).orderBy("_l")
    upto, every = over.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(sample, name)
    h = hits.withColumn("_m", F.row_number().over(over)).withColumn("_k", F.count("*").over(every)).where((F.col("_k") >= least) & (F.col("_k") < F.col("_p")))
    grid = None
    for tau in taus:
        w = F.pow(weight, F.lit(float(tau)))
        share = F.coalesce(F.try_divide(F.sum(w).over(upto), F.sum(w).over(every)), F.col("_m") / F.col("_k"))
        down = (F.col("_l") - F.col("_m")) / (F.col("_p") - F.col("_k"))
        g = h.withColumn("_w", F.coalesce(F.try_divide(w, F.sum(w).over(every)), F.lit(1.0) / F.col("_k"))).withColumn("_after", share - down)
        a = g.groupBy(sample, name).agg(F.greatest(F.lit(0.0), F.max("_after")).alias("_up"), F.least(F.lit(0.0), F.min(F.col("_after") - F.col("_w"))).alias("_low")).withColumn("tau", F.lit(float(tau)))
        grid = a if grid is None else grid.unionByName(a)
    both: Column = F.explode(F.array(F.struct(F.lit(True).alias("mx_diff"), (F.col("_up") + F.col("_low")).alias("score")), F.struct(F.lit(False).alias("mx_diff"), F.when(F.round(F.col("_up") + F.col("_low"), digits) > 0, F.col("_up")).otherwise(F.col("_low")).alias("score"))))
    return grid.select(sample, name, "tau", both.alias("_e")).select(sample, name, "tau", "_e.mx_diff", "_e.score")


def best_settings(scores: DataFrame, sample: str, name: str, top: int = 2) -> DataFrame:
    """set, tau, mx_diff, mean, sd (population), mean_abs and place of each setting, the largest mean absolute score first; top places a set."""
    a = scores.groupBy(name, "tau", "mx_diff").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.avg(F.abs("score")).alias("mean_abs"))
    order = W.partitionBy(name).orderBy(F.desc(F.round("mean_abs", 9)), "tau", F.desc("mx_diff"))
    return a.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
