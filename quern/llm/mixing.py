"""Mixing sources to target weights by capped water-filling, DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import WORD, written

#: Ranges of the seeded hash: the border of a fractional repetition falls into one range of a source,
#: and only its documents are put in order.
RANGES = 4096
#: Most sources whose plan (five short columns) is broadcast; above it the plan is joined by a shuffle.
MAX_BROADCAST_SOURCES = 10_000


def words(text: str) -> Column:
    """Number of words, 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: float) -> DataFrame:
    """Targets of sources (source, source_size): one row a source in, one out.

    Sources by code point, null last, take the weights in turn. Filling: with w the weight
    and c = max_epochs * source_size the cap, sources are clamped in the order of c / w
    while the level (what is left / weights left) is above c / w. That is the state where
    sharing the excess again and again ends. One row a source: their number is that of the
    distinct sources, not of the documents.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    every = W.partitionBy(F.lit(1))
    by_level = W.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("all_words", F.sum("source_size").over(every) * F.lit(float(share)))
    s = s.withColumn("left_words", F.col("all_words") - F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)))
    s = s.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)))
    s = s.withColumn("clamped", F.col("left_words") / F.col("left_weight") * F.col("weight") >= F.col("cap"))
    level = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("left_words") / F.col("left_weight")))).over(every)
    s = s.withColumn("level", level["col4"])
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with size, source_size, target and reps: how often the mix takes each document.

    Each source gets its target in words: every document floor(target / source_size) times,
    and once more those that come first by a seeded hash until the rest is filled; the one on
    the border is taken if more than half of it fits. The order is that of md5(seed, id,
    text); rows equal in id and text are interchangeable, and where the border falls among
    them (only then they are numbered) as many are taken as fit. A null or empty text has size 0. A null source is
    a source. Columns of the results' names give way. Reruns give the same rows.

    A source may hold any share of the rows: sums by hash range come first, and only
    the range on the border is sorted.
    """
    names = ["size", "source_size", "target", "reps"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("-")), F.coalesce(F.md5(F.col(f"`{text}`").cast("binary")), F.lit("-"))))
    hash_range = F.conv(F.substring("_key", 1, 3), 16, 10).cast("int")
    light = docs.select(F.col(f"`{source}`").alias("source"), words(text).alias("size"), digest.alias("_key")).withColumn("_range", hash_range)
    ranges = light.groupBy("source", "_range").agg(F.sum("size").alias("words"))
    filled = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    epochs = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    filled = filled.withColumn("whole", F.floor(epochs)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    filled = filled.select(F.col("source").alias("_s"), "source_size", "target", "whole", "rest")
    of_source = F.col("source").eqNullSafe(F.col("_s"))

    # the range in which each source's rest ends: at most RANGES rows a source
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    border = ranges.withColumn("_before", before).join(filled, of_source).where("_before <= rest and rest < _before + words")
    border = border.select("_s", "_range", "_before", "rest", "source_size", "target", "whole")
    # the last key taken within that range: only its documents are put in order
    within = light.withColumnRenamed("_range", "_r").join(border, of_source & (F.col("_r") == F.col("_range")))
    run = F.coalesce(F.sum("size").over(W.partitionBy("_s").orderBy("_key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fits = within.withColumn("_fits", F.col("_before") + run + F.col("size") / 2 <= F.col("rest"))
    # rows equal in id and text share a key: the last key may be taken for some of its rows only
    fits = fits.groupBy(F.col("_s").alias("_t"), "_key").agg(F.count_if("_fits").alias("_n"), F.count("*").alias("_of"), F.first("_range").alias("_range"))
    last = fits.groupBy("_t").agg(F.max(F.when(F.col("_n") > 0, F.struct("_key", "_n", "_of"))).alias("_end"), F.first("_range").alias("_at"))
    last = last.select("_t", F.col("_end._key").alias("_last"), F.when(F.col("_end._n") < F.col("_end._of"), F.col("_end._n")).alias("_few"), "_at")
    # keys are 32 hexadecimal digits: "" is below all, "g" above all, three digits below those that start with them
    cutoff = F.when(F.col("_last").isNotNull(), F.col("_last")).when(F.col("_at").isNotNull(), F.lower(F.lpad(F.hex(F.col("_at")), 3, "0"))).when(F.col("rest") > 0, "g").otherwise("")
    plan = filled.join(last, F.col("_s").eqNullSafe(F.col("_t")), "left").select("_s", "source_size", "target", "whole", cutoff.alias("_cutoff"), "_few")
    plan = written(plan, "mixing-plan")
    small = plan.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    at = docs.select(*kept, words(text).alias("size"), digest.alias("_key")).join(F.broadcast(plan) if small else plan, F.col(f"`{source}`").eqNullSafe(F.col("_s")))
    result = lambda rows, extra: rows.select(*kept, "size", "source_size", "target", (F.col("whole") + extra.cast("int")).cast("int").alias("reps"))
    extra = F.col("_key") <= F.col("_cutoff")
    if not plan.where("_few is not null").limit(1).count():
        return result(at, extra)
    torn = F.col("_few").isNotNull() & (F.col("_key") == F.col("_cutoff"))
    number = F.row_number().over(W.partitionBy("_s").orderBy(F.lit(1)))
    return result(at.where(~torn), extra).unionByName(result(at.where(torn).withColumn("_number", number), F.col("_number") <= F.col("_few")))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each row reps times; rows taken zero times go."""
    return mixed.where("reps > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("reps")))).drop("_n")
