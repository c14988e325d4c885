"""Named queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import held

DIGITS = 6


@dataclass
class Tables:
    """The tables of a folder, read lazily."""

    spark: SparkSession
    folder: str
    made: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What make gives, written and read back: it is computed once, however often a query asks for it."""
        if name not in self.made:
            self.made[name] = held(make(), name)
        return self.made[name]

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        out = self.run(Tables(spark, folder))
        return out.withColumns({c: F.round(F.col(c), d) + F.lit(0.0) for c, d in self.rounded()}) if self.doubles else out

    def rounded(self) -> list[tuple[str, int]]:
        """Columns and digits; name:2 stands for two digits, as large sums need."""
        return [(c.split(":")[0], int(c.split(":")[1]) if ":" in c else DIGITS) for c in self.doubles]

    def oracle(self) -> str | None:
        if not self.sql or not self.doubles:
            return self.sql
        rounded = ", ".join(f"round({c}, {d}) + 0.0::DOUBLE AS {c}" for c, d in self.rounded())
        return f"SELECT * REPLACE ({rounded}) FROM ({self.sql}) AS _q"


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, doubles: str = "", name: str | None = None):
    """Register a function of Tables under its name; doubles are rounded on both sides (sums differ in their last bits)."""

    def put(run: Callable[[Tables], DataFrame]):
        QUERIES[name or run.__name__] = Query(run, sql, tuple(doubles.split()))
        return run

    return put
