"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text turned into NumPy arrays at once inside a task.
SLICE_BYTES = 1 << 20
#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def narrow_batches(spark: SparkSession, rows: int = 256, size: str = "8m") -> None:
    """Bound the Arrow batches sent to Python: long texts must not travel by the ten thousand.

    Workers are also told where this package lies, for runs from a plain checkout; on a
    cluster it comes by --py-files.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor can reach.

    Where it is unset (tests, single machine) a folder below the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_quern"
    return base.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_slices(texts: list[bytes | None], limit: int = SLICE_BYTES):
    """Yield (from, to) index ranges whose texts add up to about limit bytes, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def per_text(setup: Callable[[], Callable[[list], list]], schema: pa.DataType, column: Column | str, as_bytes: bool = True) -> Column:
    """An Arrow-batched column: setup() runs once in each task, its result maps texts to Python values.

    The texts arrive as bytes (UTF-8) or str, None for null, in batches bounded by narrow_batches.
    """
    from collections.abc import Iterator

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = setup()
        for batch in batches:
            yield pa.array(f(batch.to_pylist()), schema)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    from pyspark.sql.pandas.types import from_arrow_type

    udf = F.arrow_udf(run, returnType=from_arrow_type(schema))
    text = F.col(column) if isinstance(column, str) else column
    return udf(text.cast("binary") if as_bytes else text)


def fields(df: DataFrame, result: str, names: list[str]) -> DataFrame:
    """Put the fields of the struct column result beside df's columns; a clashing older column gives way."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != result and c not in names]
    return df.select(*kept, *[F.col(f"`{result}`.{n}").alias(n) for n in names])
