"""Collapsing, profiling, pivoting and pseudobulk of long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def collapse(df: DataFrame, keys: Sequence[str], value: str, how: str = "max") -> DataFrame:
    """One value a key by max, median, mean or sum; nulls are left out."""
    f = {"max": F.max, "median": F.median, "mean": F.avg, "sum": F.sum}[how]
    return df.groupBy(*keys).agg(f(value).alias(value))


def collapse_to_best(df: DataFrame, probe: str, gene: str, sample: str, value: str) -> DataFrame:
    """gene, sample, value of the gene's probe with the highest mean; equal means by probe name."""
    means = df.groupBy(gene, probe).agg(F.avg(value).alias("_m"))
    w = W.partitionBy(gene).orderBy(F.desc_nulls_last("_m"), probe)
    best = means.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(gene, probe)
    return df.join(best, [gene, probe]).select(gene, probe, sample, value)


def drop_all_zero(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.withColumn("_m", F.max(F.abs(value)).over(W.partitionBy(key))).where("_m > 0").drop("_m")


def distribution_profile(df: DataFrame, groups: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Statistics of each group's values in [0, 1]-like ranges: moments, order statistics, tails, spread and entropy."""
    v = F.col(value)
    base = df.where(v.isNotNull()).groupBy(*groups).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"), F.log1p(F.count(v).cast("double")).alias("log_n"),
        F.median(v).alias("median"), (F.max(v) - F.min(v)).alias("spread"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"),
        F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.75).alias("q3"), F.count(v).alias("n"),
    )
    base = base.withColumn("iqr", F.col("q3") - F.col("q1")).withColumn("cv", F.try_divide("sd", F.abs("mean")))
    both = df.where(v.isNotNull()).select(*groups, v.alias("_v")).join(base, list(groups))
    place = F.when(F.col("spread") > 0, F.least(F.floor((F.col("_v") - F.col("least")) / F.col("spread") * bins), F.lit(bins - 1))).otherwise(0)
    tails = both.groupBy(*groups).agg(
        F.avg(F.abs(F.col("_v") - F.col("mean"))).alias("mad"),
        F.avg((F.col("_v") < F.col("mean") - F.col("sd")).cast("double")).alias("low_tail"),
        F.avg((F.col("_v") > F.col("mean") + F.col("sd")).cast("double")).alias("high_tail"),
    )
    cells = both.groupBy(*groups, place.alias("_b")).agg((F.count("*") / F.first("n")).alias("_p")).groupBy(*groups).agg((-F.sum(F.col("_p") * F.ln("_p"))).alias("entropy"))
    return base.join(tails, list(groups)).join(cells, list(groups))


def summary(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*groups).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd"), F.max(v).alias("most"), F.count(v).alias("n"))


def joined_names(df: DataFrame, groups: Sequence[str], name: str, separator: str = ", ") -> DataFrame:
    """The distinct names of each group in order, in one text, and how many there are."""
    s = F.sort_array(F.collect_set(name))
    return df.groupBy(*groups).agg(F.array_join(s, separator).alias("names"), F.size(s).alias("n_names"))


def supported(df: DataFrame, key: str, source: str, score: str, least: int = 2, least_score: float | None = None) -> DataFrame:
    """Keys that so many sources name: sources, n_sources, the best score and its source."""
    rows = df if least_score is None else df.where(F.col(score) >= least_score)
    out = rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(source)), "|").alias("sources"), F.countDistinct(source).alias("n_sources"), F.max(score).alias("best"), F.max_by(source, F.struct(score, source)).alias("best_source"))
    return out.where(F.col("n_sources") >= least)


def weighted_best(frames: Sequence[DataFrame], key: str, score: str, weights: Sequence[float]) -> DataFrame:
    """key, combined, coverage: each frame's best score of the key (0 if absent) times its weight; coverage counts the frames that have it."""
    tagged = [f.select(key, score, F.lit(i).alias("_i")) for i, f in enumerate(frames)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    best = rows.groupBy(key).agg(*[F.max(F.when(F.col("_i") == i, F.col(score))).alias(f"s{i}") for i in range(len(frames))])
    total = sum((F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * w for i, w in enumerate(weights)), F.lit(0.0))
    cover = sum((F.col(f"s{i}").isNotNull().cast("int") for i in range(len(frames))), F.lit(0))
    return best.select(key, total.alias("combined"), cover.alias("coverage"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[object]) -> DataFrame:
    """Counts of row by the named values of column, 0 where there are none."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == F.lit(v)).alias(str(v)) for v in values])


def pivot(df: DataFrame, row: str, column: str, values: Sequence[object], value: str, how: str = "sum") -> DataFrame:
    f = {"sum": F.sum, "mean": F.avg, "max": F.max, "first": F.first}[how]
    return df.groupBy(row).agg(*[f(F.when(F.col(column) == F.lit(v), F.col(value))).alias(str(v)) for v in values])


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def pseudobulk(df: DataFrame, sample: str, kind: str, cell: str, gene: str, value: str, least_cells: int = 3) -> DataFrame:
    """sample, kind, gene, total, log_cpm (log1p of counts per million) of groups with enough cells."""
    cells = df.groupBy(sample, kind).agg(F.countDistinct(cell).alias("_cells")).where(F.col("_cells") >= least_cells)
    total = df.join(cells, [sample, kind], "left_semi").groupBy(sample, kind, gene).agg(F.sum(value).alias("total"))
    all_ = F.sum("total").over(W.partitionBy(sample, kind))
    return total.withColumn("log_cpm", F.log1p(F.coalesce(F.try_divide(F.col("total") * 1e6, all_), F.lit(0.0))))


def cell_quality(df: DataFrame, cell: str, gene: str, value: str, mito_prefix: str, least: int, most: int, most_mito: float) -> DataFrame:
    """cell, n_genes, mito_share of the cells within the limits."""
    mito = F.sum(F.when(F.col(gene).startswith(mito_prefix), F.col(value)).otherwise(0))
    q = df.groupBy(cell).agg(F.count_if(F.col(value) > 0).alias("n_genes"), F.try_divide(mito, F.sum(value)).alias("mito_share"))
    return q.where(F.col("n_genes").between(least, most) & (F.coalesce("mito_share", F.lit(0.0)) <= most_mito))


def mean_vector(df: DataFrame, groups: Sequence[str], vector: str, normalise: bool = True) -> DataFrame:
    """groups, vector: the mean of array columns by place, scaled to length 1 if normalise (a zero vector stays)."""
    placed = df.select(*groups, F.posexplode(vector).alias("_i", "_x")).groupBy(*groups, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    out = placed.groupBy(*groups).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(vector))
    if not normalise:
        return out
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return out.withColumn("_norm", norm).withColumn(vector, F.when(F.col("_norm") > 0, F.transform(vector, lambda x: x / F.col("_norm"))).otherwise(F.col(vector))).drop("_norm")


def action_profile(df: DataFrame, key: str, action: str, groups: dict[str, Sequence[str]], paper: str) -> DataFrame:
    """key, log1p counts of each group of actions, of all and of distinct papers, and each group's share of all."""
    n = {g: F.count_if(F.col(action).isin(*names)) for g, names in groups.items()}
    logs = [F.log1p(c.cast("double")).alias(f"log_{g}") for g, c in [*n.items(), ("all", F.count("*")), ("papers", F.countDistinct(paper))]]
    return df.groupBy(key).agg(*logs, *[(c / F.count("*")).alias(f"share_{g}") for g, c in n.items()])


def one_hot(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """df with a 0/1 column for each value instead of the column; null is none of them."""
    return df.select(*[c for c in df.columns if c != column], *[F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(str(v)) for v in values])
