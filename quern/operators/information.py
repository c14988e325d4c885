"""Mutual information of numeric features and a class, by distances to nearest neighbours, and selection by it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import dist
from quern.operators.order import place, running
from quern.session import held

#: Rows of a class that one window looks through; each carries k rows of its neighbours along.
STRETCH = 4096


def mutual_information(df: DataFrame, features: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """feature, n, mi (in nats, not below 0): the estimate of Ross for a class and a continuous value.

    For each value d is the distance to its k-th nearest of the same class (of a class of k or
    fewer, to the farthest) and m counts all values nearer than that, itself included; a distance
    of 0 counts the values equal to it. mi = psi(n) + mean psi(k) - mean psi(n of the class) -
    mean psi(m). Distances count as equal within 1e-10 of d or twice the spacing of floating
    point there. Null values and labels, and classes of one row, are left out of a feature.

    Neighbours stand next to each other in the order of a class, which is cut into stretches with
    ghost rows at both ends; m is the difference of two running counts over the order of all
    values. So the work is a few sorts, whatever the sizes of features and classes.
    """
    long = df.select(F.col(label).alias("y"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["y"], list(features), "feature", "x").where("x is not null and y is not null")
    sizes = long.groupBy("feature", "y").agg(F.count("*").alias("n_y")).where("n_y > 1")
    rows = held(place(long.join(sizes, ["feature", "y"]), ["x"], ["feature", "y"], "i"), "information-places")
    at = F.col("i") - 1
    home = F.floor(at / STRETCH)
    copies = F.array_distinct(F.array(home, F.floor((at - k) / STRETCH), F.floor((at + k) / STRETCH)))
    dealt = rows.withColumn("_home", home).withColumn("_stretch", F.explode(copies))
    over = W.partitionBy("feature", "y", "_stretch").orderBy("i")
    gaps = [F.col("x") - F.lag("x", j).over(over) for j in range(1, k + 1)] + [F.lead("x", j).over(over) - F.col("x") for j in range(1, k + 1)]
    near = dealt.withColumn("_gaps", F.array(*gaps)).where("_stretch = _home")
    kth = F.least(F.lit(k), F.col("n_y") - 1).cast("int")
    d = F.element_at(F.array_sort(F.filter("_gaps", lambda g: g.isNotNull())), kth)
    near = near.withColumn("k", kth).withColumn("_d", d)
    near = near.withColumn("_d", F.greatest(F.lit(0.0), F.col("_d") - F.greatest(F.col("_d") * 1e-10, (F.abs("x") + F.col("_d")) * 4.5e-16)))
    near = held(near.select("feature", "y", "i", "x", "n_y", "k", "_d"), "information-near")
    # kinds in order at one place: counts of values below it, values, counts of values up to it
    event = lambda at, kind, one: near.select("feature", "y", "i", at.alias("_at"), F.lit(kind).alias("_kind"), F.lit(one).cast("long").alias("_one"))
    events = event(F.col("x") - F.col("_d"), 0, 0).unionByName(event(F.col("x"), 1, 1)).unionByName(event(F.col("x") + F.col("_d"), 2, 0))
    counted = running(events, ["_at", "_kind"], ["feature"], _upto=("sum", "_one"))
    m = counted.where("_kind <> 1").groupBy("feature", "y", "i").agg(F.sum(F.when(F.col("_kind") == 2, F.col("_upto")).otherwise(-F.col("_upto"))).alias("m"))
    psi = lambda c: F.avg(dist.digamma(F.col(c).cast("double")))
    both = near.join(m, ["feature", "y", "i"]).groupBy("feature").agg(F.count("*").alias("n"), psi("k").alias("_k"), psi("n_y").alias("_y"), psi("m").alias("_m"))
    return both.select("feature", "n", F.greatest(F.lit(0.0), dist.digamma(F.col("n").cast("double")) + F.col("_k") - F.col("_y") - F.col("_m")).alias("mi"))


def select_features(df: DataFrame, features: Sequence[str], label: str, most: int = 100, inflation: float = 10.0, k: int = 3) -> DataFrame:
    """feature, mi, vif, kept: the `most` features of the largest mutual information, then without those that others explain.

    In falling order of mi (ties by name) a feature goes if its variance inflation among the
    features still there is above the bound. Rows with a null feature don't count for that. Only
    the correlation matrix of the `most` features comes to the driver.
    """
    scores = mutual_information(df, features, label, k).orderBy(F.desc("mi"), "feature").limit(most).collect()
    names = [r.feature for r in scores]
    data = VectorAssembler(inputCols=names, outputCol="_v").transform(df.select(*[F.col(f).cast("double").alias(f) for f in names]).na.drop())
    matrix = np.nan_to_num(Correlation.corr(data, "_v").first()[0].toArray())
    np.fill_diagonal(matrix, 1.0)
    kept = list(range(len(names)))
    vif = {}
    for i in range(len(names)):
        rest = [j for j in kept if j != i]
        r2 = float(matrix[i, rest] @ np.linalg.pinv(matrix[np.ix_(rest, rest)]) @ matrix[rest, i]) if rest else 0.0
        vif[i] = 1 / (1 - r2) if r2 < 1 - 1e-12 else float("inf")
        if vif[i] > inflation:
            kept.remove(i)
    rows = [(r.feature, float(r.mi), float(vif[i]), i in kept) for i, r in enumerate(scores)]
    return df.sparkSession.createDataFrame(rows, "feature string, mi double, vif double, kept boolean")
