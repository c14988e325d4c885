"""Runs of neighbouring positions, and clumping by distance."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Islands of a group that start within so many rows are clumped in one call.
TOGETHER = 5000


def islands(df: DataFrame, position: str, gap: float, groups: Sequence[str] = ()) -> DataFrame:
    """groups, start, stop, n_rows: positions that follow each other at less than gap."""
    w = W.partitionBy(*groups).orderBy(position)
    new = F.when(F.col(position) - F.lag(position).over(w) < gap, 0).otherwise(1)
    numbered = df.select(*groups, position, new.alias("_new")).withColumn("_island", F.sum("_new").over(w.rangeBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*groups, "_island").agg(F.min(position).alias("start"), F.max(position).alias("stop"), F.count("*").alias("n_rows")).drop("_island")


def clump(df: DataFrame, groups: Sequence[str], position: str, p: str, window: float) -> DataFrame:
    """Greedy distance clumping: in each group the smallest p stays and silences what lies within window of it.

    Ties go to the smaller position. Groups are cut where neighbours are further apart than
    window, as they can't silence each other there; Python is given some thousands of rows of
    such islands at a time (a longer island as a whole), not a whole key. Rows with a null position or p go. Rows of df keep their columns.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([p, position], kind="stable")
        kept: list[float] = []
        chosen = []
        for i, x in zip(pdf.index, pdf[position], strict=True):
            at = bisect.bisect_left(kept, x)
            if all(abs(x - y) > window for y in kept[max(0, at - 1) : at + 1]):
                kept.insert(at, x)
                chosen.append(i)
        return pdf.loc[chosen].drop(columns="_part")

    w = W.partitionBy(*groups).orderBy(position)
    start = F.when(F.col(position) - F.lag(position).over(w) <= window, None).otherwise(F.row_number().over(w))
    cut = df.na.drop(subset=[position, p]).withColumn("_start", start)
    cut = cut.withColumn("_part", F.floor(F.max("_start").over(w.rangeBetween(W.unboundedPreceding, 0)) / TOGETHER)).drop("_start")
    return cut.groupBy(*groups, "_part").applyInPandas(keep, df.schema)
