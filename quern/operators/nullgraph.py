"""Graphs with the same degrees as a given one, by double edge swaps in conflict-free batches, and tests against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.order import place
from quern.session import held


def _simple(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def rewired(edges: DataFrame, replicates: int = 20, rounds: int = 10, seed: int = 42) -> DataFrame:
    """rep, src, dst: each replicate has every node's degree and no loop or parallel edge.

    In a round the edges of a replicate are paired at random; a-b and c-d become a-d and c-b (or
    a-c and b-d, by a coin). A pair is left as it is if a new edge would be a loop, is there
    already, or is also made by a pair of lower number, so all swaps of a round hold together.
    All replicates go side by side. Rounds are written, places come from hashes: reruns agree.
    """
    e = held(_simple(edges).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).select("rep", "src", "dst"), "rewired")
    for r in range(rounds):
        mixed = e.withColumn("_h", F.xxhash64(F.lit(seed), F.lit(r), "rep", "src", "dst"))
        placed = place(mixed, ["_h", "src", "dst"], ["rep"], "_i").withColumn("_pair", F.floor((F.col("_i") - 1) / 2)).withColumn("_first", F.col("_i") % 2 == 1)
        end = lambda c, first: F.max(F.when(F.col("_first") == first, F.col(c)))
        pairs = placed.groupBy("rep", "_pair").agg(end("src", True).alias("a"), end("dst", True).alias("b"), end("src", False).alias("_c"), end("dst", False).alias("_d"))
        coin = F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.lit(-1), "rep", "_pair"), F.lit(2)) == 0
        pairs = held(pairs.select("rep", "_pair", "a", "b", F.when(coin, F.col("_c")).otherwise(F.col("_d")).alias("c"), F.when(coin, F.col("_d")).otherwise(F.col("_c")).alias("d")), "swap-pairs")
        edge = lambda x, y: F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"))
        offered = pairs.where("c is not null and a <> d and b <> c").select("rep", "_pair", F.explode(F.array(edge("a", "d"), edge("c", "b"))).alias("_e")).select("rep", "_e.src", "_e.dst", "_pair")
        # an edge that is there stands for pair -1, below all others
        owner = offered.unionByName(e.withColumn("_pair", F.lit(-1).cast("long"))).groupBy("rep", "src", "dst").agg(F.min("_pair").alias("_pair")).where("_pair >= 0")
        good = owner.groupBy("rep", "_pair").agg(F.count("*").alias("_n")).where("_n = 2").select("rep", "_pair", F.lit(True).alias("_swap"))
        old = F.when(F.col("c").isNull(), F.array(edge("a", "b"))).otherwise(F.array(edge("a", "b"), edge("c", "d")))
        e = held(pairs.join(good, ["rep", "_pair"], "left").select("rep", F.explode(F.when(F.col("_swap"), F.array(edge("a", "d"), edge("c", "b"))).otherwise(old)).alias("_e")).select("rep", "_e.src", "_e.dst"), "rewired")
    return e


def triangle_counts(edges: DataFrame) -> DataFrame:
    """rep, triangles of each replicate's graph (rep, src, dst); wedges start at the end of lower degree."""
    both = edges.union(edges.select("rep", "dst", "src"))
    degree = both.groupBy("rep", F.col("src").alias("node")).agg(F.count("*").alias("_d"))
    at = lambda end: degree.select("rep", F.col("node").alias(end), F.col("_d").alias(f"_d_{end}"))
    turned = edges.join(at("src"), ["rep", "src"]).join(at("dst"), ["rep", "dst"])
    lower = (F.col("_d_src") < F.col("_d_dst")) | (F.col("_d_src") == F.col("_d_dst")) & (F.col("src") < F.col("dst"))
    up = held(turned.select("rep", F.when(lower, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(lower, F.col("dst")).otherwise(F.col("src")).alias("y")), "oriented")
    wedge = up.join(up.withColumnRenamed("y", "z"), ["rep", "x"]).where("y < z")
    closed = wedge.join(edges.select("rep", F.col("src").alias("y"), F.col("dst").alias("z")), ["rep", "y", "z"])
    return closed.groupBy("rep").agg(F.count("*").alias("triangles"))


def against_rewired(edges: DataFrame, members: DataFrame, replicates: int = 20, rounds: int = 10, seed: int = 42) -> DataFrame:
    """measure, observed, mean, sd, p: transitivity of the graph and density among members (node), against graphs of the same degrees.

    p is the share of replicates that reach the observed value, (b + 1) / (replicates + 1). A graph
    without a connected triple has transitivity 0, fewer than two members have density 0.
    """
    own = held(_simple(edges), "null-edges")
    graphs = held(own.select(F.lit(0).alias("rep"), "src", "dst").unionByName(rewired(own, replicates, rounds, seed)), "null-graphs")
    degree = own.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    triples = degree.agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0.0)).alias("_triples"))
    m = members.select("node").na.drop().distinct()
    inside = graphs.join(m.withColumnRenamed("node", "src"), "src", "left_semi").join(m.withColumnRenamed("node", "dst"), "dst", "left_semi").groupBy("rep").agg(F.count("*").alias("_inside"))
    size = m.agg(F.count("*").alias("_m"))
    reps = edges.sparkSession.range(replicates + 1).select(F.col("id").cast("int").alias("rep"))
    each = reps.join(triangle_counts(graphs), "rep", "left").join(inside, "rep", "left").crossJoin(F.broadcast(triples)).crossJoin(F.broadcast(size))
    zero = F.lit(0.0)
    transitivity = F.coalesce(F.try_divide(3.0 * F.coalesce("triangles", F.lit(0)), F.col("_triples")), zero)
    density = F.coalesce(F.try_divide(2.0 * F.coalesce("_inside", F.lit(0)), (F.col("_m") * (F.col("_m") - 1)).cast("double")), zero)
    values = each.select("rep", F.explode(F.create_map(F.lit("transitivity"), transitivity, F.lit("density"), density)).alias("measure", "v"))
    seen = values.where("rep = 0").select("measure", F.col("v").alias("observed"))
    return values.where("rep > 0").join(F.broadcast(seen), "measure").groupBy("measure", "observed").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), ((F.count_if(F.col("v") >= F.col("observed") - 1e-12) + 1) / F.lit(replicates + 1.0)).alias("p"))
