"""Column names by alias, missing values, and expectations about a table."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean a missing value.
MISSING = ("", "null", "NULL", "NA", "nan", "NaN", "---")


def find_column(df: DataFrame, candidates: Sequence[str], pattern: bool = False) -> str | None:
    """The first candidate that df has, exactly before without case; as regular expressions if pattern."""
    if pattern:
        return next((c for p in candidates for c in df.columns if re.search(p, c, re.IGNORECASE)), None)
    lower = {c.lower(): c for c in reversed(df.columns)}
    return next((c for c in candidates if c in df.columns), None) or next((lower[c.lower()] for c in candidates if c.lower() in lower), None)


def resolve_columns(df: DataFrame, wanted: Mapping[str, Sequence[str]], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Only the wanted columns, each from its first alias present, else from defaults; a missing one without default is an error."""
    defaults, out = defaults or {}, []
    for name, aliases in wanted.items():
        found = find_column(df, [name, *aliases])
        if found is not None:
            out.append(F.col(f"`{found}`").alias(name))
        elif name in defaults:
            out.append(F.lit(defaults[name]).alias(name))
        else:
            raise ValueError(f"no column for {name}: tried {[name, *aliases]}")
    return df.select(*out)


def number(text: Column) -> Column:
    """A double, null where the text isn't one or is NaN or infinite."""
    return finite(text.try_cast("double"))


def finite(x: Column) -> Column:
    """Null for NaN and infinite values."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers and the texts of MISSING become null, in every column."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = finite(c).cast(f.dataType)
        elif isinstance(f.dataType, T.StringType):
            c = F.when(~F.trim(c).isin(*MISSING), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null or NaN in the columns."""
    return df.na.drop(subset=list(columns))


def quality_report(df: DataFrame) -> DataFrame:
    """A row a column: rows, missing, distinct (approximate, with a standard deviation of 2 %), and smallest and largest value as text; one pass."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))]
    aggs = [x for i, c in enumerate(numeric) for q in [F.col(f"`{c}`")] for x in (F.count_if(q.isNull()).alias(f"m{i}"), F.approx_count_distinct(q, 0.02).alias(f"d{i}"), F.min(q).cast("string").alias(f"l{i}"), F.max(q).cast("string").alias(f"h{i}"))]
    one = df.agg(F.count("*").alias("rows"), *aggs)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows").alias("rows"), F.col(f"m{i}").alias("missing"), F.col(f"d{i}").alias("distinct"), F.col(f"l{i}").alias("smallest"), F.col(f"h{i}").alias("largest")) for i, c in enumerate(numeric)])
    return one.select(F.inline(entries))


def expect(df: DataFrame, **rules: Column) -> DataFrame:
    """df, or an error that names the rules broken by any row; one pass over df."""
    broken = df.agg(F.count("*").alias("_rows"), *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(k) for k, rule in rules.items()]).first()
    if not broken["_rows"]:
        raise ValueError("the table is empty")
    if bad := {k: broken[k] for k in rules if broken[k]}:
        raise ValueError(f"rows that break a rule: {bad}")
    return df


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if absent := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns {absent} are absent")
    return df


def drop_constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df without those of the columns whose variance is zero or unknown."""
    row = df.agg(*[F.var_pop(f"`{c}`").alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if not row[c]])


def duplicate_columns(df: DataFrame, columns: Sequence[str], digits: int = 6) -> dict[str, str]:
    """column -> an earlier column of the same rounded values in every row."""
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    row = numbered.agg(*[F.sum(F.xxhash64("_row", F.round(f"`{c}`", digits)).cast("decimal(38,0)")).alias(c) for c in columns]).first()
    first: dict[object, str] = {}
    return {c: first[row[c]] for c in columns if first.setdefault(row[c], c) != c}


def drop_correlated_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Of two columns correlated above the threshold in size the one of the smaller variance goes; pairs in column order."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.var_pop(f"`{c}`").alias(f"v_{c}") for c in columns], *[F.corr(f"`{a}`", f"`{b}`").alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first()
    gone: set[str] = set()
    for i, (a, b) in enumerate(pairs):
        if a not in gone and b not in gone and row[f"r{i}"] is not None and abs(row[f"r{i}"]) > threshold:
            gone.add(a if row[f"v_{a}"] < row[f"v_{b}"] else b)
    return df.drop(*gone)


def looks_like(df: DataFrame, column: str, patterns: Mapping[str, str]) -> DataFrame:
    """label, share: of the column's values the share that matches each pattern, best first."""
    c = F.col(f"`{column}`")
    one = df.agg(*[F.avg(F.coalesce(c.rlike(p), F.lit(False)).cast("double")).alias(k) for k, p in patterns.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"`{k}`").alias("share")) for k in patterns]))).orderBy(F.desc("share"), "label")
