"""Co-expression modules: soft thresholds, topological overlap in blocks, average linkage by mutual nearest clusters, an adaptive cut."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.order import place
from quern.session import held, reach_package

#: Members of a block of the overlap matrix; a task holds three blocks of this size squared.
BLOCK = 512


def soft_thresholds(pairs: DataFrame, powers: Sequence[int] = tuple(range(1, 21)), a: str = "a", b: str = "b", r: str = "r", bins: int = 10) -> DataFrame:
    """power, fit, slope, mean_k, median_k, max_k: how well connectivities follow a power law for each soft threshold.

    pairs has each unordered pair once. Connectivity k of a member is the sum of |r|^power; k is
    cut into bins of equal width, and log10 of each bin's share (plus 1e-9) is regressed on log10
    of its mean k (an empty bin's middle); fit is the squared correlation. The median is
    approximate. All powers share one pass of sums.
    """
    both = pairs.select(F.col(a).alias("m"), r).unionByName(pairs.select(F.col(b).alias("m"), r))
    sums = both.groupBy("m").agg(*[F.sum(F.pow(F.abs(r), F.lit(float(p)))).alias(f"_{p}") for p in powers])
    k = held(sums.select("m", F.explode(F.array(*[F.struct(F.lit(p).alias("power"), F.col(f"_{p}").alias("k")) for p in powers])).alias("e")).select("e.power", "e.k"), "connectivity")
    span = k.groupBy("power").agg(F.min("k").alias("_low"), F.max("k").alias("_high"), F.count("*").alias("_n"), F.avg("k").alias("mean_k"), F.percentile_approx("k", 0.5, 10_000).alias("median_k"))
    width = (F.col("_high") - F.col("_low")) / bins
    binned = k.join(F.broadcast(span), "power").withColumn("_b", F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("k") - F.col("_low"), width)), F.lit(0))))
    counts = binned.groupBy("power", "_b").agg(F.count("*").alias("_c"), F.avg("k").alias("_m"))
    grid = span.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))).join(counts, ["power", "_b"], "left")
    middle = F.coalesce("_m", F.col("_low") + (F.col("_b") + 0.5) * width)
    x, y = F.log10(F.greatest(middle, F.lit(1e-300))), F.log10(F.coalesce(F.col("_c") / F.col("_n"), F.lit(0.0)) + 1e-9)
    return grid.withColumn("_x", x).withColumn("_y", y).groupBy("power", "mean_k", "median_k", F.col("_high").alias("max_k")).agg(F.coalesce(F.pow(F.corr("_x", "_y"), F.lit(2.0)), F.lit(0.0)).alias("fit"), F.regr_slope("_y", "_x").alias("slope")).select("power", "fit", "slope", "mean_k", "median_k", "max_k")


def _products(blocks: DataFrame, size: int) -> DataFrame:
    """i, j, v: the square of a symmetric matrix held in blocks (bi, bj, cells), for i < j; partial products are added as they stream by."""
    left = blocks.select("bi", F.col("bj").alias("u"), F.col("cells").alias("left"))
    right = blocks.select(F.col("bi").alias("u"), "bj", F.col("cells").alias("right"))
    work = left.join(right, "u").where("bi <= bj").repartition("bi", "bj").sortWithinPartitions("bi", "bj", "u").select("bi", "bj", "left", "right")
    out = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("v", pa.float64())])

    def dense(cells: pa.StructScalar) -> np.ndarray:
        m = np.zeros(size * size)
        flat = cells.values
        m[flat.field("c").to_numpy(zero_copy_only=False)] = flat.field("w").to_numpy(zero_copy_only=False)
        return m.reshape(size, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def emit() -> Iterator[pa.RecordBatch]:
            i, j = np.nonzero(total)
            gi, gj = i + key[0] * size, j + key[1] * size
            keep = gi < gj
            i, j, gi, gj = i[keep], j[keep], gi[keep], gj[keep]
            for k in range(0, len(i), 100_000):
                s = slice(k, k + 100_000)
                yield pa.record_batch([pa.array(gi[s], pa.int64()), pa.array(gj[s], pa.int64()), pa.array(total[i[s], j[s]])], schema=out)

        for batch in batches:
            for r in range(batch.num_rows):
                now = (batch.column(0)[r].as_py(), batch.column(1)[r].as_py())
                if now != key:
                    if key is not None:
                        yield from emit()
                    key, total = now, np.zeros((size, size))
                total += dense(batch.column(2)[r]) @ dense(batch.column(3)[r])
        if key is not None:
            yield from emit()

    return work.mapInArrow(run, "i long, j long, v double")


def topological_overlap(pairs: DataFrame, power: float, a: str = "a", b: str = "b", r: str = "r", block: int = BLOCK) -> DataFrame:
    """a, b, overlap of each unordered pair: (paths of two steps + adjacency) / (lesser connectivity + 1 - adjacency).

    Adjacency is |r|^power. The paths are a matrix product, done block by block: blocks meet on
    their common side, and a task adds the products of one block of the result as they stream in.
    Pairs without a row, or with a null r, have adjacency 0.
    """
    reach_package(pairs.sparkSession)
    adj = held(pairs.where(F.col(r).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"), F.pow(F.abs(r), F.lit(float(power))).alias("w")), "adjacency")
    both = adj.unionByName(adj.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    k = both.groupBy("a").agg(F.sum("w").alias("k"))
    ids = held(place(k, ["a"], name="_p").select(F.col("a").alias("m"), "k", (F.col("_p") - 1).alias("i")), "module-members")
    at = lambda end, name: ids.select(F.col("m").alias(end), F.col("i").alias(name), F.col("k").alias(f"k{name}"))
    numbered = held(adj.join(at("a", "i"), "a").join(at("b", "j"), "b"), "numbered-adjacency")
    cells = numbered.select("i", "j", "w").unionByName(numbered.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    cells = cells.select(F.floor(F.col("i") / block).alias("bi"), F.floor(F.col("j") / block).alias("bj"), F.struct((F.col("i") % block * block + F.col("j") % block).cast("int").alias("c"), "w").alias("e"))
    blocks = held(cells.groupBy("bi", "bj").agg(F.collect_list("e").alias("cells")), "adjacency-blocks")
    spark = pairs.sparkSession
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        paths = held(_products(blocks, block), "paths")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    direct = numbered.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w")
    whole = paths.join(direct, ["i", "j"], "full").join(ids.select("i", F.col("m").alias("_a"), F.col("k").alias("_ka")), "i").join(ids.select(F.col("i").alias("j"), F.col("m").alias("_b"), F.col("k").alias("_kb")), "j")
    w = F.coalesce("w", F.lit(0.0))
    return whole.select(F.col("_a").alias("a"), F.col("_b").alias("b"), ((F.coalesce("v", F.lit(0.0)) + w) / (F.least("_ka", "_kb") + 1 - w)).alias("overlap"))


def average_linkage(distances: DataFrame, a: str = "a", b: str = "b", d: str = "d", digits: int = 12) -> DataFrame:
    """merge rows round, a, b, height, n_a, n_b: clusters, each named by its least member, whose average distance is least for both.

    All mutual nearest pairs of a round merge at once. Average linkage is reducible (a merged
    cluster is no nearer to a third than the nearer of its parts was), so this is the tree that
    one merge after another gives. Sums of distances of cluster pairs are kept; a merge adds
    them. Equal distances (to so many digits) go to the least names. distances has every
    unordered pair once; a pair without a row counts as infinitely far.
    """
    p = distances.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(d).cast("double").alias("s")).where("a <> b").withColumn("na", F.lit(1).cast("long")).withColumn("nb", F.lit(1).cast("long")).withColumn("pairs", F.lit(1).cast("long"))
    p = held(p, "linkage-pairs")
    merges, turn, left = None, 0, -1
    # pairs that are left as they were have no distance: nothing merges any more
    while (count := p.count()) and count != left:
        turn, left = turn + 1, count
        # a pair that isn't there in full is infinitely far
        near = p.where(F.col("pairs") == F.col("na") * F.col("nb")).withColumn("h", F.round(F.col("s") / F.col("pairs"), digits))
        best = near.select(F.col("a").alias("c"), F.struct("h", "a", "b").alias("e")).unionByName(near.select(F.col("b").alias("c"), F.struct("h", "a", "b").alias("e"))).groupBy("c").agg(F.min("e").alias("e"))
        mutual = best.groupBy("e").agg(F.count("*").alias("_n")).where("_n = 2").select("e.a", "e.b", F.col("e.h").alias("height"))
        now = held(mutual.join(p.select("a", "b", F.col("na").alias("n_a"), F.col("nb").alias("n_b")), ["a", "b"]).select(F.lit(turn).alias("round"), "a", "b", "height", "n_a", "n_b"), "linkage-merges")
        merges = now if merges is None else merges.unionByName(now)
        # both parts get the lesser name and the whole size
        renamed = now.select(F.explode(F.array(*[F.struct(F.col(x).alias("old"), F.col("a").alias("new"), (F.col("n_a") + F.col("n_b")).alias("size")) for x in ("a", "b")])).alias("e")).select("e.*")
        named = lambda end: renamed.select(F.col("old").alias(end), F.col("new").alias(f"_{end}"), F.col("size").alias(f"_n{end}"))
        q = p.join(named("a"), "a", "left").join(named("b"), "b", "left")
        x, y = F.coalesce("_a", "a"), F.coalesce("_b", "b")
        q = q.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "s", "pairs", F.when(x < y, F.coalesce("_na", "na")).otherwise(F.coalesce("_nb", "nb")).alias("na"), F.when(x < y, F.coalesce("_nb", "nb")).otherwise(F.coalesce("_na", "na")).alias("nb")).where("a <> b")
        p = held(q.groupBy("a", "b", "na", "nb").agg(F.sum("s").alias("s"), F.sum("pairs").alias("pairs")).select("a", "b", "s", "na", "nb", "pairs"), "linkage-pairs")
    if merges is None:
        merges = p.select(F.lit(0).alias("round"), "a", "b", F.col("s").alias("height"), F.col("na").alias("n_a"), F.col("nb").alias("n_b")).limit(0)
    return merges


def cut_modules(merges: DataFrame, members: DataFrame, least: int = 30, gap: float = 0.25, top: float = 0.99) -> DataFrame:
    """member, module (null for none) of an adaptive cut of the tree, from the leaves up.

    Merges above a height of q5 + top * (max - q5) of all heights don't count (q5 is the 5%
    quantile). Where two branches meet, a branch with `least` members whose mean merge height lies
    at least gap * (that height - q5) below the meeting stands for itself: if both do, both become
    modules and what grows on top of them is none; if one does not, the branches go on as one. A
    branch that nothing joins any more is a module if it is large enough. A module is named by its
    least member. One row a cluster is kept; rounds of the linkage are gone through in turn.
    """
    merges = held(merges, "tree")
    row = merges.agg(F.percentile_approx("height", 0.05, 10_000), F.max("height"), F.max("round")).first()
    low, high, rounds = row[0] or 0.0, row[1] or 0.0, row[2] or 0
    limit = low + top * (high - low)
    # of: each member's cluster, and whether it has left with a module or without; open: still one branch; total: sum of its merge heights
    of = members.select(F.col("member"), F.col("member").alias("c"), F.lit(None).cast(dict(members.dtypes)["member"]).alias("module"), F.lit(False).alias("left")).distinct()
    state = of.select("c", F.lit(1).cast("long").alias("n"), F.lit(True).alias("open"), F.lit(0.0).alias("total"))
    for turn in range(1, rounds + 1):
        now = merges.where((F.col("round") == turn) & (F.col("height") <= limit)).select("a", "b", "height")
        side = lambda x: state.select(F.col("c").alias(x), *[F.col(v).alias(f"{v}_{x}") for v in ("n", "open", "total")])  # noqa: B023, E731
        m = now.join(side("a"), "a").join(side("b"), "b")
        alone = lambda x: F.col(f"open_{x}") & (F.col(f"n_{x}") >= least) & (F.col("height") - F.col(f"total_{x}") / F.greatest(F.col(f"n_{x}") - 1, F.lit(1)) >= gap * (F.col("height") - low))
        m = held(m.withColumn("_sa", alone("a") & (alone("b") | ~F.col("open_b"))).withColumn("_sb", alone("b") & (alone("a") | ~F.col("open_a"))), "meetings")
        # members of a branch that stands for itself leave with its module, those of one that falls onto a closed one without
        ends = m.select(F.col("a").alias("new"), F.explode(F.array(*[F.struct(F.col(x).alias("c"), F.when(F.col(f"_s{x}"), F.col(x)).alias("own"), (F.col(f"_s{x}") | F.col(f"open_{x}") & ~F.col(f"open_{y}")).alias("leaves")) for x, y in (("a", "b"), ("b", "a"))])).alias("e")).select("new", "e.*")
        goes = ~F.col("left") & F.coalesce("leaves", F.lit(False))
        of = held(of.join(ends, "c", "left").select("member", F.coalesce("new", "c").alias("c"), F.when(goes, F.col("own")).otherwise(F.col("module")).alias("module"), (F.col("left") | goes).alias("left")), "module-of")
        one = F.col("open_a") & F.col("open_b") & ~F.col("_sa") & ~F.col("_sb")
        grown = m.select(F.col("a").alias("c"), (F.col("n_a") + F.col("n_b")).alias("n"), one.alias("open"), (F.col("total_a") + F.col("total_b") + F.col("height")).alias("total"))
        state = held(state.join(ends.select("c"), "c", "left_anti").unionByName(grown), "branches")
    stays = F.when(F.col("left"), F.col("module")).when(F.col("open") & (F.col("n") >= least), F.col("c"))
    return of.join(state, "c").select("member", stays.alias("module"))
