"""Edge-list graph analytics by joins. edges: src, dst (undirected, any order) and optionally w.

Iterations write each round to the folder in spark.checkpoint.dir (DataFrame.checkpoint), so
plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.order import place


def _cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        spark.sparkContext.setCheckpointDir(base or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint()


def closure(edges: DataFrame) -> DataFrame:
    """Both directions of every edge once, without loops; the largest weight of parallel edges, 1 if there is none."""
    w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    e = edges.where(F.col("src") != F.col("dst")).select("src", "dst", w.alias("w"))
    return e.union(e.select(F.col("dst"), F.col("src"), "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree, strength."""
    return closure(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def neighbour_degree(edges: DataFrame) -> DataFrame:
    """node, mean, smallest and largest degree of its neighbours."""
    e, d = closure(edges), degrees(edges)
    return e.join(d, e.dst == d.node).groupBy(F.col("src").alias("node")).agg(F.avg("degree").alias("mean_degree"), F.min("degree").alias("least_degree"), F.max("degree").alias("most_degree"))


def khop(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """node, hop: the nodes first reached from the seeds (column node) after so many steps, seeds left out."""
    e = closure(edges).select("src", "dst")
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for h in range(1, hops + 1):
        front = _cut(front.join(e, front.node == e.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.union(front)
    return seen.where("hop > 0")


def distances(edges: DataFrame, sources: DataFrame, limit: int = 6) -> DataFrame:
    """source, node, hops for every node within limit of each source (column node); breadth first from all sources at once."""
    e = closure(edges).select("src", "dst")
    seen = sources.select(F.col("node").alias("source"), F.col("node")).distinct().withColumn("hops", F.lit(0))
    front = seen
    for h in range(1, limit + 1):
        step = front.join(e, front.node == e.src).select("source", F.col("dst").alias("node")).distinct()
        front = _cut(step.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(h)))
        if front.limit(1).count() == 0:
            break
        seen = seen.union(front)
    return seen


def closeness(edges: DataFrame, sources: DataFrame, limit: int = 6) -> DataFrame:
    """node, reached, closeness (reached / sum of hops) and harmonic (sum of 1 / hops) of the sources."""
    d = distances(edges, sources, limit).where("hops > 0")
    # where nothing is reached, hops is the constant 0 and 1 / hops is folded before the filter empties the plan
    harmonic = F.sum(F.try_divide(F.lit(1.0), F.col("hops")))
    return d.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("reached"), (F.count("*") / F.sum("hops")).alias("closeness"), harmonic.alias("harmonic"))


def two_hop_mean(edges: DataFrame, values: DataFrame) -> DataFrame:
    """node, one_hop, two_hop: mean value (node, value) of the neighbours and, path by path, of theirs; without the latter the former."""
    e = closure(edges).select("src", "dst")
    one = e.join(values.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.sum("value").alias("_s"), F.count("value").alias("_n"))
    first = one.select(F.col("src").alias("node"), (F.col("_s") / F.col("_n")).alias("one_hop"))
    # paths a-b-c with c <> a: what b's neighbours hold in all, less a's own value
    own = values.withColumnRenamed("node", "src").withColumnRenamed("value", "_v")
    paths = e.join(one.select(F.col("src").alias("dst"), "_s", "_n"), "dst").join(own, "src", "left")
    second = paths.groupBy(F.col("src").alias("node")).agg(F.sum(F.col("_s") - F.coalesce("_v", F.lit(0.0))).alias("_s"), F.sum(F.col("_n") - F.col("_v").isNotNull().cast("int")).alias("_n"))
    return first.join(second, "node", "left").select("node", "one_hop", F.coalesce(F.try_divide("_s", "_n"), F.col("one_hop")).alias("two_hop"))


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles, clustering. Edges point from the lower to the higher degree, so no node lists all its neighbours' pairs."""
    e, d = closure(edges), degrees(edges).select("node", "degree")
    up = e.join(d.select(F.col("node").alias("src"), F.col("degree").alias("_s")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("_d")), "dst")
    up = _cut(up.where((F.col("_s") < F.col("_d")) | ((F.col("_s") == F.col("_d")) & (F.col("src") < F.col("dst")))).select("src", "dst"))
    wedge = up.alias("x").join(up.alias("y"), F.col("x.src") == F.col("y.src")).where("x.dst < y.dst").select(F.col("x.src").alias("a"), F.col("x.dst").alias("b"), F.col("y.dst").alias("c"))
    closed = wedge.join(up.select(F.least("src", "dst").alias("b"), F.greatest("src", "dst").alias("c")), ["b", "c"])
    counts = closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    t = F.coalesce("triangles", F.lit(0))
    return d.join(counts, "node", "left").select("node", t.alias("triangles"), F.coalesce(F.try_divide(2.0 * t, F.col("degree") * (F.col("degree") - 1)), F.lit(0.0)).alias("clustering"))


def pagerank(edges: DataFrame, rounds: int | None = 10, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """node, rank after so many rounds over the undirected graph, from 1 / n.

    Without rounds, until a round changes the ranks by less than n * tolerance in all.
    """
    e = closure(edges)
    d = degrees(edges).select(F.col("node"), F.col("degree"))
    n = d.count()
    links = _cut(e.join(d.withColumnRenamed("node", "src"), "src").select("src", "dst", "degree"))
    ranks = d.select("node", F.lit(1.0 / max(1, n)).alias("rank"))
    for turn in itertools.count():
        if turn == rounds:
            break
        given = links.join(ranks, links.src == ranks.node).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("_g"))
        new = _cut(given.select(F.col("dst").alias("node"), (F.lit((1 - damping) / max(1, n)) + damping * F.col("_g")).alias("rank")))
        if rounds is None:
            change = new.join(ranks.withColumnRenamed("rank", "_before"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("_before")))).first()[0] or 0.0
            if change < max(1, n) * tolerance:
                return new
        ranks = new
    return ranks


def eigenvector(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """node, score: power iteration of (adjacency + identity), length 1 after each round."""
    e = closure(edges)
    scores = degrees(edges).select("node", F.lit(1.0).alias("score"))
    for _ in range(rounds):
        given = e.join(scores, e.dst == scores.node).groupBy("src").agg(F.sum(F.col("w") * F.col("score")).alias("_g"))
        raw = scores.join(given, scores.node == given.src).select("node", (F.col("score") + F.col("_g")).alias("_r"))
        total = raw.agg(F.sqrt(F.sum(F.col("_r") * F.col("_r"))).alias("_t"))
        scores = _cut(raw.crossJoin(F.broadcast(total)).select("node", (F.col("_r") / F.col("_t")).alias("score")))
    return scores


def hits(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """node, hub, authority of directed edges; each sums to 1."""
    e = edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    hub = e.select(F.col("src").alias("node")).distinct().withColumn("hub", F.lit(1.0))
    for _ in range(rounds):
        a = e.join(hub, e.src == hub.node).groupBy(F.col("dst").alias("node")).agg(F.sum("hub").alias("authority"))
        h = e.join(a, e.dst == a.node).groupBy(F.col("src").alias("node")).agg(F.sum("authority").alias("_h"))
        hub = _cut(h.crossJoin(F.broadcast(h.agg(F.sum("_h").alias("_t")))).select("node", (F.col("_h") / F.col("_t")).alias("hub")))
    a = e.join(hub, e.src == hub.node).groupBy(F.col("dst").alias("node")).agg(F.sum("hub").alias("_a"))
    a = a.crossJoin(F.broadcast(a.agg(F.sum("_a").alias("_t")))).select("node", (F.col("_a") / F.col("_t")).alias("authority"))
    return hub.join(a, "node", "full").select("node", F.coalesce("hub", F.lit(0.0)).alias("hub"), F.coalesce("authority", F.lit(0.0)).alias("authority"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that each can reach, by minimum labels and pointer jumps."""
    e = _cut(closure(edges).select("src", "dst"))
    labels = _cut(e.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = e.join(labels, e.dst == labels.node).groupBy("src").agg(F.min("component").alias("_c"))
        low = labels.join(near, labels.node == near.src).select("node", "component", F.least("component", "_c").alias("_l"))
        jump = labels.select(F.col("node").alias("_n"), F.col("component").alias("_j"))
        new = _cut(low.join(jump, F.col("_l") == F.col("_n"), "left").select("node", F.least("_l", F.coalesce("_j", "_l")).alias("_new"), "component"))
        labels = new.select("node", F.col("_new").alias("component"))
        if new.where("_new <> component").limit(1).count() == 0:
            return labels


def kcore(edges: DataFrame, k: int) -> DataFrame:
    """The edges (src < dst) among nodes that keep k neighbours when weaker ones are taken off again and again."""
    e = _cut(edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    while True:
        weak = degrees(e).where(F.col("degree") < k).select("node")
        if weak.limit(1).count() == 0:
            return e
        e = _cut(e.join(weak.withColumnRenamed("node", "src"), "src", "left_anti").join(weak.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (column node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def isolated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without an edge to another of the nodes."""
    return nodes.select("node").distinct().join(degrees(induced(edges, nodes)), "node", "left_anti")


def overview(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean_degree, transitivity (3 triangles / connected triples)."""
    d, t = degrees(edges), triangles(edges)
    a = d.agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.avg("degree").alias("mean_degree"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("_triples"))
    b = t.agg(F.sum("triangles").alias("_t"))
    return a.crossJoin(b).select("nodes", "edges", F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"), "mean_degree", F.try_divide(F.col("_t").cast("double"), F.col("_triples")).alias("transitivity"))


def density_scores(edges: DataFrame) -> DataFrame:
    """node, density: the share of a node's closed neighbourhood's pairs that are edges."""
    d, t = degrees(edges), triangles(edges)
    size = F.col("degree") + 1
    return d.join(t, "node").select("node", F.try_divide(2.0 * (F.col("degree") + F.col("triangles")), size * (size - 1)).alias("density"))


def hubs(edges: DataFrame, quantile: float = 0.75) -> DataFrame:
    """node, degree, hub: degree above the exact quantile of all degrees."""
    d = degrees(edges)
    q = d.agg(F.percentile("degree", quantile).alias("_q"))
    return d.crossJoin(F.broadcast(q)).select("node", "degree", (F.col("degree") > F.col("_q")).alias("hub"))


def above_medians(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Rows above the median in every column."""
    m = metrics.agg(*[F.median(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    out = metrics.crossJoin(F.broadcast(m))
    for i, c in enumerate(columns):
        out = out.where(F.col(c) > F.col(f"_m{i}"))
    return out.select(*metrics.columns)


def maximal_cliques_score(edges: DataFrame, most_degree: int = 200) -> DataFrame:
    """node, cliques (maximal, of three nodes or more), score (sum of size - 1).

    Each task enumerates the cliques whose least node is its own, within that node's
    neighbourhood; a node of a higher degree than most_degree is an error, as its
    neighbourhood wouldn't be small.
    """
    import pandas as pd

    e = closure(edges).select("src", "dst")
    if e.groupBy("src").count().where(F.col("count") > most_degree).limit(1).count():
        raise ValueError("a neighbourhood is too large for clique enumeration")
    near = e.alias("x").join(e.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("centre"), F.col("x.dst").alias("a"), F.col("y.dst").alias("b"))
    inside = near.join(e.select(F.col("src").alias("centre"), F.col("dst").alias("b")), ["centre", "b"], "left_semi").select("centre", "a", "b")
    kind = dict(e.dtypes)["src"]

    def cliques(pdf: pd.DataFrame) -> pd.DataFrame:
        centre, links = pdf["centre"].iloc[0], {}
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            links.setdefault(a, set()).add(b)
        found = []

        def grow(clique: list, more: set, done: set) -> None:
            if not more and not done:
                if len(clique) >= 2 and all(centre < x for x in clique):
                    found.append([centre, *clique])
                return
            pivot = max(more | done, key=lambda x: len(links[x] & more))
            for x in list(more - links[pivot]):
                grow([*clique, x], more & links[x], done & links[x])
                more = more - {x}
                done = done | {x}

        grow([], set(links), set())
        rows = [(x, len(c)) for c in found for x in c]
        return pd.DataFrame(rows, columns=["node", "size"])

    out = inside.groupBy("centre").applyInPandas(cliques, f"node {kind}, size int")
    return out.groupBy("node").agg(F.count("*").alias("cliques"), F.sum(F.col("size") - 1).alias("score"))


def negative_edges(edges: DataFrame, nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """n node pairs (src < dst) that aren't edges: seeded draws of both ends, so no pair table is built."""
    ids = _cut(place(nodes.select("node").distinct(), ["node"], name="_i").withColumn("_i", F.col("_i") - 1))
    count = ids.count()
    if count < 2:
        return ids.select(F.col("node").alias("src"), F.col("node").alias("dst")).limit(0)
    draws = edges.sparkSession.range(4 * n + 64).select("id", *[F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(count)).cast("int").alias(f"_{k}") for k in "ab"]).where("_a <> _b")
    pairs = draws.join(ids.select(F.col("_i").alias("_a"), F.col("node").alias("a")), "_a").join(ids.select(F.col("_i").alias("_b"), F.col("node").alias("b")), "_b").select("id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    known = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return pairs.groupBy("src", "dst").agg(F.min("id").alias("id")).join(known, ["src", "dst"], "left_anti").orderBy("id").limit(n).select("src", "dst")


def typed_graph(**tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind, name; edges: src, etype, dst, w) from edge tables (kind_a, a, kind_b, b) by edge type."""
    rows = None
    for etype, t in tables.items():
        part = t.select("kind_a", "a", "kind_b", "b", (F.col("w") if "w" in t.columns else F.lit(1.0)).alias("w"), F.lit(etype).alias("etype"))
        rows = part if rows is None else rows.unionByName(part)
    ends = rows.select(F.col("kind_a").alias("kind"), F.col("a").alias("name")).union(rows.select("kind_b", "b")).distinct()
    nodes = ends.withColumn("id", F.dense_rank().over(W.partitionBy("kind").orderBy("name")) - 1)
    side = lambda x, e: nodes.select(F.col("kind").alias(f"kind_{x}"), F.col("name").alias(x), F.col("id").alias(e))
    return nodes, rows.join(side("a", "src"), ["kind_a", "a"]).join(side("b", "dst"), ["kind_b", "b"]).select("kind_a", "src", "etype", "kind_b", "dst", "w")


def betweenness(edges: DataFrame, sources: DataFrame, limit: int = 6) -> DataFrame:
    """node, betweenness: how much of the shortest paths from the sources (column node) within limit passes a node.

    Path counts go outwards hop by hop, dependencies come back the same way; both are joins.
    All nodes as sources give twice the usual value of an undirected graph.
    """
    e = closure(edges).select("src", "dst")
    levels = [_cut(sources.select(F.col("node").alias("source"), "node").distinct().withColumn("paths", F.lit(1.0)))]
    seen = levels[0].select("source", "node")
    for _ in range(limit):
        step = levels[-1].join(e, levels[-1].node == e.src).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        front = _cut(step.join(seen, ["source", "node"], "left_anti"))
        if front.limit(1).count() == 0:
            break
        levels.append(front)
        seen = seen.union(front.select("source", "node"))
    total = None
    below = levels[-1].withColumn("depends", F.lit(0.0))
    for level in reversed(levels[:-1]):
        back = below.select("source", F.col("node").alias("dst"), ((1 + F.col("depends")) / F.col("paths")).alias("_share")).join(e, "dst")
        given = back.groupBy("source", F.col("src").alias("node")).agg(F.sum("_share").alias("_s"))
        below = _cut(level.join(given, ["source", "node"], "left").select("source", "node", "paths", (F.col("paths") * F.coalesce("_s", F.lit(0.0))).alias("depends")))
        total = below if total is None else total.union(below)
    if total is None:
        return sources.select("node").distinct().withColumn("betweenness", F.lit(0.0))
    return total.where("node <> source").groupBy("node").agg(F.sum("depends").alias("betweenness"))


def cross_module(correlations: DataFrame, modules: DataFrame, a: str, b: str, r: str, member: str, module: str, least: float) -> DataFrame:
    """a, b, r, a_module, b_module of correlations above least in size between members of two modules."""
    side = lambda end, tag: modules.select(F.col(member).alias(end), F.col(module).alias(f"{tag}_module"))
    strong = correlations.where(F.abs(r) > least).select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(r).alias("r"))
    return strong.join(side("a", "a"), "a").join(side("b", "b"), "b").where("a_module <> b_module")


def edge_betweenness(edges: DataFrame, sources: DataFrame, limit: int = 6) -> DataFrame:
    """src, dst (src < dst), betweenness: how much of the shortest paths from the sources within limit goes over an edge."""
    e = closure(edges).select("src", "dst")
    levels = [_cut(sources.select(F.col("node").alias("source"), "node").distinct().withColumn("paths", F.lit(1.0)))]
    seen = levels[0].select("source", "node")
    for _ in range(limit):
        step = levels[-1].join(e, levels[-1].node == e.src).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        front = _cut(step.join(seen, ["source", "node"], "left_anti"))
        if front.limit(1).count() == 0:
            break
        levels.append(front)
        seen = seen.union(front.select("source", "node"))
    total = None
    below = levels[-1].withColumn("depends", F.lit(0.0))
    for level in reversed(levels[:-1]):
        share = below.select("source", F.col("node").alias("dst"), ((1 + F.col("depends")) / F.col("paths")).alias("_share")).join(e, "dst")
        flow = _cut(share.join(level.select("source", F.col("node").alias("src"), "paths"), ["source", "src"]).select("source", "src", "dst", (F.col("paths") * F.col("_share")).alias("_f")))
        total = flow if total is None else total.union(flow)
        given = flow.groupBy("source", F.col("src").alias("node")).agg(F.sum("_f").alias("depends"))
        below = _cut(level.join(given, ["source", "node"], "left").select("source", "node", "paths", F.coalesce("depends", F.lit(0.0)).alias("depends")))
    if total is None:
        return e.where("src < dst").limit(0).withColumn("betweenness", F.lit(0.0))
    return total.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("_f").alias("betweenness"))


def without_bridges(edges: DataFrame, scores: DataFrame, quantile: float = 0.95) -> DataFrame:
    """The scored edges (src, dst, betweenness) not above the exact quantile of all scores."""
    q = scores.agg(F.percentile("betweenness", quantile).alias("_q"))
    low = scores.crossJoin(F.broadcast(q)).where(F.col("betweenness") <= F.col("_q")).select("src", "dst", "betweenness")
    return low.join(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), ["src", "dst"], "left_semi")


def connectivity(edges: DataFrame, nodes: DataFrame, targets: DataFrame, limit: int = 3) -> DataFrame:
    """node, direct, indirect, mean_weight, mean_hops of nodes (column node): links to targets, targets within two steps only, and steps to the targets within limit."""
    e = closure(edges)
    aims = targets.select(F.col("node").alias("_t")).distinct()
    direct = e.join(aims, F.col("dst") == F.col("_t")).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("direct"), F.avg("w").alias("mean_weight"))
    d = distances(edges, nodes, limit).where("hops > 0").join(aims, F.col("node") == F.col("_t"))
    far = d.groupBy(F.col("source").alias("node")).agg(F.count_if(F.col("hops") == 2).alias("indirect"), F.avg("hops").alias("mean_hops"))
    out = nodes.select("node").distinct().join(direct, "node", "left").join(far, "node", "left")
    return out.select("node", F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("indirect", F.lit(0)).alias("indirect"), "mean_weight", "mean_hops")


def reach(edges: DataFrame, sources: DataFrame, limit: int = 6) -> DataFrame:
    """One row: pairs, mean_hops and longest over all pairs of a source and a node within limit."""
    d = distances(edges, sources, limit).where("hops > 0")
    return d.agg(F.count("*").alias("pairs"), F.avg("hops").alias("mean_hops"), F.max("hops").alias("longest"))


def hub_score(metrics: DataFrame, columns: list[str], name: str = "hub_score") -> DataFrame:
    """metrics with the mean of the columns, each divided by its largest (0 if that is 0)."""
    top = metrics.agg(*[F.max(c).alias(f"_x{i}") for i, c in enumerate(columns)])
    parts = [F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"_x{i}")), F.lit(0.0)) / len(columns) for i, c in enumerate(columns)]
    return metrics.crossJoin(F.broadcast(top)).select(*metrics.columns, sum(parts[1:], parts[0]).alias(name))
