"""Fusing rankings and evidence from several models. Scores are long: model, member, score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.norm import max_share
from quern.operators.ranks import benjamini_hochberg, percentile_of_score, rank
from quern.session import held, reach_package

#: Left rows of a group that meet in one cell of pair_scores; on the right four times as many.
PAIR_ROWS = 4096


def reciprocal_ranks(scores: DataFrame, model: str, member: str, score: str, k: float = 60.0, weights: DataFrame | None = None, average_ties: bool = False) -> DataFrame:
    """member, rrf: the sum over models of w / (k + rank), the best score being first.

    weights has model and w; they are divided by their sum. Ties go by member, or share their
    average rank.
    """
    r = rank(scores.where(F.col(score).isNotNull()), score, [model], "average" if average_ties else "ordinal", True, [member], "_r")
    if weights is None:
        return r.groupBy(member).agg(F.sum(1.0 / (k + F.col("_r"))).alias("rrf"))
    w = weights.select(model, (F.col("w") / F.sum("w").over(W.partitionBy())).alias("_w"))
    return r.join(w, model).groupBy(member).agg(F.sum(F.col("_w") / (k + F.col("_r"))).alias("rrf"))


def quality_weights(metrics: DataFrame, model: str, first: str, second: str, least: float = 0.5) -> DataFrame:
    """model, w: the mean of two metrics where both are above least; other models are left out."""
    return metrics.where((F.col(first) > least) & (F.col(second) > least)).select(model, ((F.col(first) + F.col(second)) / 2).alias("w"))


def borda(scores: DataFrame, model: str, member: str, score: str, least_sd: float = 1e-12) -> DataFrame:
    """member, points: the number of members below it, summed over models whose scores vary."""
    sd = F.stddev_pop(score).over(W.partitionBy(model))
    ok = scores.where(F.col(score).isNotNull()).withColumn("_sd", sd).where(F.col("_sd") >= least_sd)
    return rank(ok, score, [model], "ordinal", False, [member], "_r").groupBy(member).agg(F.sum(F.col("_r") - 1).alias("points"))


def geometric_rank(scores: DataFrame, model: str, member: str, score: str) -> DataFrame:
    """member, rank_mean: the geometric mean of its minimum ranks, best first."""
    r = rank(scores.where(F.col(score).isNotNull()), score, [model], "min", True, name="_r")
    return r.groupBy(member).agg(F.exp(F.avg(F.ln(F.col("_r").cast("double")))).alias("rank_mean"))


def rank_uniformity(scores: DataFrame, model: str, member: str, score: str) -> DataFrame:
    """member, n, d: the Kolmogorov-Smirnov distance of its normalised ranks from the uniform distribution."""
    from quern.operators.stats import ks_uniform

    r = rank(scores.where(F.col(score).isNotNull()), score, [model], "average", True, name="_r").withColumn("_u", F.col("_r") / F.count("*").over(W.partitionBy(model)))
    return ks_uniform(r, [member], "_u")


def rho_scores(scores: DataFrame, model: str, member: str, score: str) -> DataFrame:
    """member, rho: the smallest probability of an order statistic of its normalised ranks, times their number (1 at most).

    The i-th smallest of n uniform values is at most u with the probability of i or more
    successes of n, a sum of n - i + 1 terms.
    """
    r = rank(scores.where(F.col(score).isNotNull()), score, [model], "average", True, name="_r").withColumn("_u", F.col("_r") / F.count("*").over(W.partitionBy(model)))
    u = r.groupBy(member).agg(F.sort_array(F.collect_list("_u")).alias("_u"))
    n = F.size("_u")
    choose = lambda a, b: F.exp(sum_log(a) - sum_log(b) - sum_log(a - b))
    sum_log = lambda x: F.when(x <= 1, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(x, F.lit(2))), F.lit(0.0), lambda acc, i: acc + F.ln(i.cast("double"))))
    tail = F.transform("_u", lambda x, i: F.aggregate(F.sequence(i + 1, n), F.lit(0.0), lambda acc, j: acc + choose(n, j) * F.pow(x, j) * F.pow(1 - x, n - j)))
    return u.select(member, F.least(F.lit(1.0), F.array_min(tail) * n).alias("rho"))


def product_scores(left: DataFrame, right: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """keys, score: the product of two probabilities of the same keys."""
    return left.select(*keys, F.col(p).alias("_a")).join(right.select(*keys, F.col(p).alias("_b")), list(keys)).select(*keys, (F.col("_a") * F.col("_b")).alias("score"))


def family_consensus(scores: DataFrame, model: str, member: str, score: str, families: Mapping[str, str], weights: Mapping[str, float], k: int = 30, least: int | None = None) -> DataFrame:
    """member, families: members among the k best of each family's weighted mean score, in at least so many families (all by default)."""
    table = scores.sparkSession.createDataFrame([(m, f, float(weights.get(m, 1.0))) for m, f in families.items()], f"{model} string, family string, _w double")
    mean = scores.join(table, model).groupBy("family", member).agg((F.sum(F.col(score) * F.col("_w")) / F.sum("_w")).alias("_m"))
    best = rank(mean, "_m", ["family"], "ordinal", True, [member], "_r").where(F.col("_r") <= k)
    return best.groupBy(member).agg(F.count("*").alias("families")).where(F.col("families") >= (least or len(set(families.values()))))


def percentile_consensus(left: DataFrame, right: DataFrame, key: str, score: str) -> DataFrame:
    """key, left, right, consensus: percentiles of both scores over the common keys, and their mean."""
    both = left.select(key, F.col(score).alias("_a")).join(right.select(key, F.col(score).alias("_b")), key)
    p = percentile_of_score(percentile_of_score(both, "_a", name="left_percentile"), "_b", name="right_percentile")
    return p.select(key, "left_percentile", "right_percentile", ((F.col("left_percentile") + F.col("right_percentile")) / 2).alias("consensus"))


def evidence_fusion(tables: Mapping[str, DataFrame], key: str, weights: Mapping[str, float], sample_sizes: Mapping[str, str] | None = None) -> DataFrame:
    """key, fused (0 to 100) of tables (key, score[, n]): each scaled to its largest, weighted, absent ones 0.

    Where sample_sizes names a table's n column, its weight is taken n / (n + 10) times and what
    that frees goes to the other tables in proportion.
    """
    sample_sizes = sample_sizes or {}
    out = None
    for name, t in tables.items():
        n = F.col(sample_sizes[name]).cast("double") if name in sample_sizes else F.lit(None).cast("double")
        part = max_share(t, "score", name=f"s_{name}").select(key, f"s_{name}", F.coalesce(n / (n + 10), F.lit(1.0)).alias(f"t_{name}"))
        out = part if out is None else out.join(part, key, "full")
    real = {k: weights[k] * F.coalesce(F.col(f"t_{k}"), F.lit(1.0)) for k in tables}
    total = sum(real.values(), F.lit(0.0))
    fused = sum((F.coalesce(F.col(f"s_{k}"), F.lit(0.0)) * F.try_divide(real[k], total) for k in tables), F.lit(0.0))
    return out.select(key, *[F.coalesce(F.col(f"s_{k}"), F.lit(0.0)).alias(k) for k in tables], fused.alias("fused"))


def tiers(df: DataFrame, score: str, demote: Column | None = None, floors: tuple[float, float] = (40.0, 25.0)) -> DataFrame:
    """df with tier: 1 above the larger of the first floor and the 75th percentile, 2 of the second and the median, else 3; demoted rows one lower."""
    q = df.agg(F.percentile(score, 0.75).alias("_q3"), F.percentile(score, 0.5).alias("_q2"))
    tier = F.when(F.col(score) >= F.greatest(F.lit(floors[0]), F.col("_q3")), 1).when(F.col(score) >= F.greatest(F.lit(floors[1]), F.col("_q2")), 2).otherwise(3)
    lower = F.coalesce(demote, F.lit(False)).cast("int") if demote is not None else F.lit(0)
    return df.crossJoin(F.broadcast(q)).withColumn("tier", F.least(F.lit(3), tier + lower)).drop("_q2", "_q3")


def rule_score(df: DataFrame, rules: Mapping[str, tuple[Column, float]], veto: Column, steps: Sequence[tuple[float, str]] = ((6, "A"), (3, "B"), (1, "C")), rejected: str = "rejected") -> DataFrame:
    """df with rule_score (the points of the rules that hold) and rule_tier; a veto rejects."""
    total = sum((F.coalesce(r.cast("int"), F.lit(0)) * p for r, p in rules.values()), F.lit(0.0))
    out = df.withColumn("rule_score", total)
    tier = F.when(F.coalesce(veto, F.lit(False)), rejected)
    for least, name in steps:
        tier = tier.when(F.col("rule_score") >= least, name)
    return out.withColumn("rule_tier", tier.otherwise(rejected))


def stouffer_evidence(df: DataFrame, key: str, z: str, direction: str, weight: str, with_p: bool = False) -> DataFrame:
    """key, k, z, agreement: Stouffer over the modules that a key has, and the share of the commoner sign; p and q if asked for."""
    from quern.functions import dist

    w = F.col(weight)
    a = df.where(F.col(z).isNotNull()).groupBy(key).agg(F.count("*").alias("k"), F.try_divide(F.sum(w * F.col(z)), F.sqrt(F.sum(w * w))).alias("z"), (F.greatest(F.count_if(F.col(direction) > 0), F.count_if(F.col(direction) < 0)) / F.count("*")).alias("agreement"))
    return benjamini_hochberg(a.withColumn("p", dist.normal_two_sided("z")), "p") if with_p else a


def run_average(scores: DataFrame, key: Sequence[str], score: str) -> DataFrame:
    """key, mean, sd, n over the runs."""
    return scores.groupBy(*key).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.count(score).alias("n"))


def bootstrap_ranks(scores: DataFrame, model: str, member: str, score: str, k: float = 60.0, replicates: int = 100, seed: int = 42, level: float = 0.95) -> DataFrame:
    """member, rrf, low, high: reciprocal-rank sums over models drawn with replacement, percentile interval.

    Each replicate draws as many models as there are, by seeded hashes; ranks are taken once.
    """
    ranked = rank(scores.where(F.col(score).isNotNull()), score, [model], "ordinal", True, [member], "_r").select(model, member, (1.0 / (k + F.col("_r"))).alias("_v"))
    models = ranked.select(model).distinct().withColumn("_i", F.row_number().over(W.orderBy(model)) - 1)
    n = models.count()
    draws = scores.sparkSession.range(replicates * max(1, n)).select((F.col("id") % replicates).alias("_rep"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, n))).cast("int").alias("_i"))
    times = draws.join(models, "_i").groupBy("_rep", model).agg(F.count("*").alias("_times"))
    sums = ranked.join(times, model).groupBy(member, "_rep").agg(F.sum(F.col("_v") * F.col("_times")).alias("_s"))
    edge = (1 - level) / 2
    whole = ranked.groupBy(member).agg(F.sum("_v").alias("rrf"))
    return whole.join(sums.groupBy(member).agg(F.percentile("_s", edge).alias("low"), F.percentile("_s", 1 - edge).alias("high")), member)


def best_pairs(left: np.ndarray, right: np.ndarray, top: int, rows: int = 512, columns: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of left, rows of right and scores of all pairs up to the left row's top-th distinct score.

    A matrix product finds candidates, those within its rounding error of the best so far; their
    scores are then summed in order, as functions.scalar.dot does.
    """
    left, right = left.astype(float), right.astype(float)
    error = 4 * left.shape[1] * np.finfo(float).eps * np.sqrt((left**2).sum(1)) * np.sqrt((right**2).sum(1).max()) + np.finfo(float).tiny
    out = []
    for a in range(0, len(left), rows):
        x = left[a : a + rows]
        least, none = np.full(len(x), -np.inf), np.zeros(0, int)
        kept = (none, none, np.zeros(0))

        def best(i, j, kept):
            """kept and the pairs (i, j) up to the top-th distinct score; least follows."""
            product, score = x[i] * right[j], np.zeros(len(i))
            for t in range(product.shape[1]):
                score += product[:, t]
            i, j, score = (np.concatenate(c) for c in zip(kept, (i, j, score)))
            order = np.lexsort((-score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.r_[True, i[1:] != i[:-1]][: len(i)]
            place = np.cumsum(first | np.r_[True, score[1:] != score[:-1]][: len(i)])
            place -= np.maximum.accumulate(np.where(first, place - 1, 0))
            least[i[place == top]] = score[place == top]
            return tuple(c[place <= top] for c in (i, j, score))

        for b in range(0, len(right), columns):
            product = x @ right[b : b + columns].T
            n = min(2 * top + 2, product.shape[1])
            if not b:
                some = np.argpartition(product, product.shape[1] - n, axis=1)[:, -n:]
                best(np.repeat(np.arange(len(x)), n), some.ravel(), kept)
            i, j = np.divmod(np.flatnonzero(product >= (least - error[a : a + rows])[:, None]), product.shape[1])
            kept = best(i, j + b, kept)
        out.append((kept[0] + a, *kept[1:]))
    return tuple(np.concatenate(c) for c in zip(*out))


def pair_scores(left: DataFrame, right: DataFrame, groups: list[str], vector: str, left_id: str, right_id: str, top: int) -> DataFrame:
    """left_id, right_id, score, rank: the top partners of each left row by dot product, within equal groups.

    All pairs are scored, which is quadratic in the rows of a group; equal vectors on the right
    are one. A group's rows are dealt to blocks, any two of which meet in a cell; only pairs up to
    the top-th distinct score of a left row leave it. Vectors that are null, empty, of another
    length or with null or huge elements are joined row by row.
    """
    from quern.functions.scalar import dot

    reach_package(left.sparkSession)

    def sided(df: DataFrame, name: str, new: str) -> DataFrame:
        usual = (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < 1e100, F.lit(False)))
        return df.dropna(subset=groups).select(*groups, name, F.col(vector).alias(new), F.when(usual, F.size(vector)).otherwise(-1).alias("_d"))

    l, r = sided(left, left_id, "_v"), sided(right, right_id, "_w").withColumn("_c", F.sha2(F.col("_w").cast("string"), 256))
    key = [*groups, "_d"]
    contents = held(r.where("_d > 0").groupBy(*key, "_c").agg(F.first("_w").alias("_v")), "pair-contents")

    def most(df: DataFrame) -> int:
        return df.groupBy(*key).count().agg(F.max("count")).first()[0] or 0

    n_left, n_right = 1 + most(l.where("_d > 0")) // PAIR_ROWS, 1 + most(contents) // (4 * PAIR_ROWS)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ls = l.where("_d > 0").withColumn("_i", block(left_id, n_left)).withColumn("_j", every(n_right)).withColumn("_left", F.lit(True))
    rs = contents.withColumn("_j", block("_c", n_right)).withColumn("_i", every(n_left)).withColumn("_left", F.lit(False))
    both = ls.unionByName(rs, allowMissingColumns=True)
    kinds = T.StructType([T.StructField(f.name, f.dataType) for f in l.select(*groups, left_id).schema] + [T.StructField("_c", T.StringType()), T.StructField("score", T.DoubleType())])

    def cell(table: pa.Table) -> pa.Table:
        from quern.operators.fusion import best_pairs

        sides = [table.filter(side) for side in (table["_left"], pc.invert(table["_left"]))]
        if not all(map(len, sides)):
            return table.slice(0, 0).select([*groups, left_id, "_c"]).append_column("score", pa.array([], pa.float64()))
        a, b = (pc.list_flatten(s["_v"]).to_numpy().reshape(len(s), -1) for s in sides)
        i, j, score = best_pairs(a, b, top)
        return sides[0].select([*groups, left_id]).take(i).append_column("_c", sides[1]["_c"].take(j)).append_column("score", pa.array(score))

    found = both.groupBy(*key, "_i", "_j").applyInArrow(cell, kinds).withColumn(right_id, F.lit(None).cast(r.schema[right_id].dataType))
    usual = [x.agg(F.min("_d"), F.max("_d")).first() for x in (l, r)]
    ends = {d for x in usual for d in x if d is not None}
    if len(ends) > 1 or -1 in ends:
        others = r.select(*groups, F.col("_d").alias("_e")).distinct()
        odd = l.join(others, groups).where("_d <> _e OR _d = -1").join(r.withColumnRenamed("_d", "_e").drop("_c"), [*groups, "_e"])
        found = found.unionByName(odd.select(*groups, left_id, right_id, dot("_v", "_w").alias("score")), allowMissingColumns=True)
    ranked = found.withColumn("rank", F.dense_rank().over(W.partitionBy(left_id).orderBy(F.desc("score")))).where(F.col("rank") <= top)
    ranked = held(ranked, "pair-ranks")
    members = ranked.where("_c IS NOT NULL").drop(right_id).join(r.select(*groups, "_c", right_id), [*groups, "_c"])
    return members.unionByName(ranked.where("_c IS NULL").drop("_c"), allowMissingColumns=True).select(left_id, right_id, "score", "rank")
