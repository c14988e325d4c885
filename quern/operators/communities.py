"""Communities of a weighted graph by modularity: parallel moves under a conflict rule, then contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.graph import closure
from quern.session import held


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, modularity of labels (node, community) over edges (src, dst, w): the share of weight inside less what degrees let expect."""
    e = closure(edges)
    a, b = (labels.select(F.col("node").alias(end), F.col("community").alias(f"_{end}")) for end in ("src", "dst"))
    inside = e.join(a, "src").join(b, "dst").groupBy(F.col("_src").alias("c")).agg(F.sum(F.when(F.col("_src") == F.col("_dst"), F.col("w")).otherwise(0.0)).alias("_in"), F.sum("w").alias("_all"))
    total = inside.agg(F.sum("_all").alias("_m"))
    return inside.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(F.col("_in") / F.col("_m") - F.pow(F.col("_all") / F.col("_m"), F.lit(2.0))), F.lit(0.0)).alias("modularity"))


def _accepted(offers: DataFrame, two_m: float) -> DataFrame:
    """Offers (node, k, own, to, gain) that may all be carried out at once without a loss of modularity.

    Carried out one after another by falling gain, an offer loses at most k times the strength
    that earlier ones took away from its community or brought to its target, over 2m: links to
    those nodes can only help. That strength is summed by class of gain (quarters of a power of
    two, then 32 parts by hash), so a community that half of all nodes want is a few hundred rows
    of a window, and whatever shares an offer's class counts as earlier. The best offer of both
    its communities has none before it.
    """
    part = F.pmod(F.xxhash64("node"), F.lit(32)).cast("int")
    o = offers.withColumn("_class", (F.floor(F.log2("gain") * 4) * -32 + part).cast("long")).withColumn("_best", F.struct("gain", F.xxhash64("node").alias("h"), "node"))
    for side in ("own", "to"):
        sums = o.groupBy(side, "_class").agg(F.sum("k").alias("_k"), F.max("_best").alias("_top"))
        upto = W.partitionBy(side).orderBy("_class").rowsBetween(W.unboundedPreceding, 0)
        every = W.partitionBy(side)
        sums = sums.select(side, "_class", F.sum("_k").over(upto).alias(f"_k_{side}"), F.max("_top").over(every).alias(f"_top_{side}"))
        o = o.join(sums, [side, "_class"])
    first = (F.col("_top_own.node") == F.col("node")) & (F.col("_top_to.node") == F.col("node"))
    rest = F.col("gain") - F.col("k") * (F.col("_k_own") + F.col("_k_to") - 2 * F.col("k")) / two_m
    return o.where(first | (rest > 0)).select("node", "to")


def _level(e: DataFrame, strengths: DataFrame, two_m: float, seed: int, rounds: int, quiet: int) -> DataFrame:
    """node, community after moves of single nodes, until some rounds in a row move none."""
    label = held(strengths.withColumn("community", F.col("node")), "louvain")
    links = e.where("src <> dst")
    still = 0
    for r in range(rounds):
        gives = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col(c)), F.lit(2)) == 1  # noqa: B023, E731
        totals = label.groupBy("community").agg(F.sum("k").alias("_total"))
        near = links.join(label.select(F.col("node").alias("dst"), F.col("community").alias("c")), "dst").groupBy("src", "c").agg(F.sum("w").alias("_w"))
        near = near.join(totals.select(F.col("community").alias("c"), "_total"), "c")
        own = label.join(totals, "community").select(F.col("node").alias("src"), F.col("community").alias("own"), "k", F.col("_total").alias("_own_total"))
        # a community gives or takes in a round, never both; a node whose best community doesn't take waits
        x = near.join(own.where(gives("own")), "src")
        worth = F.col("_w") - F.col("k") * F.col("_total") / two_m
        best = x.groupBy("src", "own", "k", "_own_total").agg(F.max(F.when(F.col("c") != F.col("own"), F.struct(worth.alias("worth"), F.xxhash64("c").alias("h"), F.col("c")))).alias("_b"), F.max(F.when(F.col("c") == F.col("own"), F.col("_w"))).alias("_w_own"))
        stay = F.coalesce("_w_own", F.lit(0.0)) - F.col("k") * (F.col("_own_total") - F.col("k")) / two_m
        offers = best.where(~gives("_b.c")).select(F.col("src").alias("node"), "k", "own", F.col("_b.c").alias("to"), (F.col("_b.worth") - stay).alias("gain")).where(F.col("gain") > 1e-12 * two_m)
        moves = _accepted(held(offers, "louvain-offers"), two_m)
        label = held(label.select("node", "k", "community").join(moves, "node", "left").select("node", "k", F.coalesce("to", "community").alias("community"), F.col("to").isNotNull().alias("moved")), "louvain")
        still = 0 if label.where("moved").limit(1).count() else still + 1
        if still == quiet:
            break
    return label.select("node", "community")


def louvain(edges: DataFrame, seed: int = 7, rounds: int = 12, quiet: int = 2, levels: int = 20) -> DataFrame:
    """node, community: nodes move to the neighbouring community that gains most modularity, communities become nodes, and so on.

    In a round half of the communities, by hash, give nodes and half take some; of the offers
    those go through that can't lose modularity together, so it never falls. A level ends when
    `quiet` rounds in a row move nothing, or after so many rounds; what could still move does so
    in the next level as part of its community. community is the number of one of its nodes. Parallel
    edges keep the largest weight, loops and weights not above 0 are left out; a node without an
    edge isn't in the result.
    """
    e = closure(edges).where("w > 0")
    e = held(e, "louvain-edges")
    labels: DataFrame | None = None
    two_m = e.agg(F.sum("w")).first()[0]
    if not two_m:
        return e.select(F.col("src").alias("node"), F.col("src").alias("community"))
    for level in range(levels):
        strengths = e.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
        found = held(_level(e, strengths, float(two_m), seed + 1000 * level, rounds, quiet), "louvain-level")
        merged = found.where("node <> community").limit(1).count()
        inner = found.select(F.col("node").alias("_n"), F.col("community").alias("_c"))
        labels = found if labels is None else held(labels.join(inner, F.col("community") == F.col("_n")).select("node", F.col("_c").alias("community")), "louvain-labels")
        if not merged:
            break
        a, b = (found.select(F.col("node").alias(end), F.col("community").alias(f"_{end}")) for end in ("src", "dst"))
        e = held(e.join(a, "src").join(b, "dst").groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.sum("w").alias("w")), "louvain-edges")
    return labels
