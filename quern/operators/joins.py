"""Joins beyond the plain ones: lookups without fan-out, membership of edge ends, comparisons, ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """Left join with at most one row of table a key: the first in order, or the last. order is ascending and total."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    w = W.partitionBy(*on).orderBy(*[c.desc() if last else c.asc() for c in cols])
    one = table.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return df.join(one, list(on), "left")


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str], negate: bool = False) -> DataFrame:
    """Rows whose key is (not) among keys; null keys match nothing. Spark broadcasts keys if they are small."""
    return df.join(keys.select(*on), list(on), "left_anti" if negate else "left_semi")


def ends_among(edges: DataFrame, a: str, b: str, keys: DataFrame, key: str, need: str = "both") -> DataFrame:
    """Edges with both or either end among keys."""
    k = keys.select(key).distinct()
    if need == "both":
        return edges.join(k.withColumnRenamed(key, a), a, "left_semi").join(k.withColumnRenamed(key, b), b, "left_semi").select(*edges.columns)
    marked = edges.join(k.select(F.col(key).alias(a), F.lit(True).alias("_a")), a, "left").join(k.select(F.col(key).alias(b), F.lit(True).alias("_b")), b, "left")
    return marked.where(F.col("_a") | F.col("_b")).select(*edges.columns)


def annotate_ends(edges: DataFrame, a: str, b: str, nodes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Edges with the nodes' columns for either end, as a_<column> and b_<column>."""
    side = lambda end, tag: nodes.select(F.col(key).alias(end), *[F.col(c).alias(f"{tag}_{c}") for c in columns])
    return edges.join(side(a, "a"), a, "left").join(side(b, "b"), b, "left")


def compare(left: DataFrame, right: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Full outer join of two results: key, left_<value>, right_<value> and where: both, left or right."""
    l = left.select(*on, F.col(value).alias(f"left_{value}"), F.lit(1).alias("_l"))
    r = right.select(*on, F.col(value).alias(f"right_{value}"), F.lit(1).alias("_r"))
    where = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return l.join(r, list(on), "full").select(*on, f"left_{value}", f"right_{value}", where.alias("side"))


def expand(df: DataFrame, column: str, separator: str, name: str) -> DataFrame:
    """One row for each part of a separated list; blank parts go."""
    parts = F.explode(F.split(F.col(column), separator))
    return df.withColumn(name, parts).withColumn(name, F.trim(name)).where(F.col(name) != "")


def in_range(points: DataFrame, at: str, spans: DataFrame, low: str, high: str, bin_size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Points with the spans that hold them (low <= at <= high): an equi join on bins of the axis.

    A span is copied to each bin that it touches, so bin_size should be about a span's length.
    """
    p = points.withColumn("_bin", F.floor(F.col(at) / bin_size))
    s = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / bin_size), F.floor(F.col(high) / bin_size))))
    return p.join(s, [*keys, "_bin"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_bin")


def match_case(df: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """Rows whose column is among names as it is, in small letters, in capitals or as a title, in this order: names' columns, the name as matched."""
    c = F.col(column)
    tries = df.withColumn("_try", F.explode(F.array_distinct(F.array(c, F.lower(c), F.upper(c), F.initcap(c))))).withColumn("_rank", F.array_position(F.array(c, F.lower(c), F.upper(c), F.initcap(c)), F.col("_try")))
    found = tries.join(names.withColumnRenamed(name, "matched"), F.col("_try") == F.col("matched")).drop("_try")
    w = W.partitionBy(*df.columns).orderBy("_rank")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def split_known(df: DataFrame, known: dict[str, DataFrame], name: str = "eval_mode") -> DataFrame:
    """df with transductive where every named column's value is among its known ones, else inductive."""
    out = df
    for i, (column, keys) in enumerate(known.items()):
        out = out.join(keys.select(F.col(column)).distinct().withColumn(f"_k{i}", F.lit(True)), column, "left")
    every = F.coalesce(F.greatest(*[F.col(f"_k{i}").isNull().cast("int") for i in range(len(known))], F.lit(0)), F.lit(1)) == 0
    return out.withColumn(name, F.when(every, "transductive").otherwise("inductive")).drop(*[f"_k{i}" for i in range(len(known))])
