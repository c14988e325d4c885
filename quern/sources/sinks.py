"""Writers. Failures raise; Spark's commit protocol leaves no half-written result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_csv(df: DataFrame, path: str, mode: str = "error", sep: str = ",") -> None:
    df.write.mode(mode).csv(path, header=True, sep=sep)


def to_parquet(df: DataFrame, path: str, mode: str = "error", by: tuple[str, ...] = ()) -> None:
    """Parquet, a folder a value of the by columns: readers prune them."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def per_key_csv(df: DataFrame, path: str, key: str, mode: str = "error") -> None:
    """A folder a key instead of a file a key; rows of a key are brought together first."""
    df.repartition(key).write.mode(mode).partitionBy(key).csv(path, header=True)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys aren't in the Parquet table at path yet."""
    spark = df.sparkSession
    old = spark.read.parquet(path).select(*keys).distinct()
    df.join(old, keys, "left_anti").write.mode("append").parquet(path)


def to_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def to_sif(edges: DataFrame, path: str, relation: str = "pp", mode: str = "error") -> None:
    """Source, relation, target, tab-separated without a header."""
    edges.select("src", F.lit(relation).alias("relation"), "dst").write.mode(mode).csv(path, sep="\t")
