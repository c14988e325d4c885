"""Places and running aggregates over orders of any length: ranges first, then sums of the ranges, then the rows within.

No task holds more than one range. Rows are dealt to ranges by Spark's range partitioning (on a
sample of the order) and written to the shared folder, so the ranges stay the same when an
executor is lost; a group of any size is many ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import held

_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right, strict=True):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def running(df: DataFrame, order: Sequence[Column | str], groups: Sequence[str] = (), inclusive: bool = True, **what: tuple[str, str]) -> DataFrame:
    """df with running aggregates within its group: name=(kind, column), kind sum, min or max.

    inclusive says whether a row's own value counts; where nothing counts the result is null.
    order should be total within a group: rows that it doesn't tell apart come in any order.
    """
    keys = [*groups, "_range"]
    dealt = held(df.repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys).agg(*[_FOLD[kind](c).alias(f"_all_{n}") for n, (kind, c) in what.items()])
    before = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    earlier = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[_FOLD[kind](f"_all_{n}").over(before).alias(f"_before_{n}") for n, (kind, _) in what.items()])
    both = dealt.join(earlier, _same(keys, [f"_k_{k}" for k in keys]))
    within = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    for n, (kind, c) in what.items():
        own, old = _FOLD[kind](c).over(within), F.col(f"_before_{n}")
        value = {"sum": F.coalesce(own + old, own, old), "min": F.least(own, old), "max": F.greatest(own, old)}[kind]
        both = both.withColumn(n, value)
    return both.select(*df.columns, *what)


def place(df: DataFrame, order: Sequence[Column | str], groups: Sequence[str] = (), name: str = "place") -> DataFrame:
    """df with each row's place in its group, from 1."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), order, groups, **{name: ("sum", "_one")}).drop("_one")


def value_ranks(df: DataFrame, by: str, groups: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """One row for each distinct value that isn't null: groups, by, and how many rows have it (n), a value before it (before), distinct values before it (distinct_before).

    Equal values are counted map-side first, so a value that a third of the rows have is one row.
    """
    counts = df.where(F.col(by).isNotNull()).groupBy(*groups, by).agg(F.count("*").alias("n")).withColumn("_one", F.lit(1).cast("long"))
    order = [F.col(by).desc() if descending else F.col(by).asc()]
    out = running(counts, order, groups, inclusive=False, before=("sum", "n"), distinct_before=("sum", "_one")).drop("_one")
    return out.fillna(0, ["before", "distinct_before"])


def quantiles(df: DataFrame, by: str, **which: float) -> DataFrame:
    """One row: name=share gives the exact quantile of by, linear between neighbours; nulls don't count."""
    counts = held(value_ranks(df.select(by), by), "quantile-places")
    at = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all"))))
    out = []
    for name, share in which.items():
        place = (F.col("_all") - 1) * F.lit(share)
        low, high = F.floor(place), F.ceil(place)
        value = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(by).cast("double")))
        gap = F.max(place - low)
        out.append(F.when(gap == 0, value(low)).otherwise((1 - gap) * value(low) + gap * value(high)).alias(name))
    return at.agg(*out)
