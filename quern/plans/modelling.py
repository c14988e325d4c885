"""Queries of communities, causal skeletons, nearest neighbours, variable features, null graphs, negative samples, mutual information and count models."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from quern.operators import communities, countmodels, graph, information, modules, neighbours, nullgraph, sampling, skeleton
from quern.plans.analytics import CLOSURE, edges
from quern.plans.registry import Tables, query


@query()
def louvain_communities(t: Tables):
    return communities.louvain(edges(t))


@query(
    f"WITH RECURSIVE c AS ({CLOSURE}), r AS (SELECT src AS node, src AS low FROM c UNION SELECT dst, low FROM r JOIN c ON src = node AND low < dst), l AS (SELECT node, min(low) AS g FROM r GROUP BY 1), s AS (SELECT a.g, sum(CASE WHEN a.g = b.g THEN w ELSE 0 END) AS inside, sum(w) AS every FROM c JOIN l a ON a.node = src JOIN l b ON b.node = dst GROUP BY 1) SELECT coalesce(sum(inside / (SELECT sum(every) FROM s) - power(every / (SELECT sum(every) FROM s), 2)), 0) AS modularity FROM s",
    "modularity",
)
def component_modularity(t: Tables):
    return communities.modularity(edges(t), graph.components(edges(t)).select("node", F.col("component").alias("community")))


LONG = "SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS v, unnest(embedding)::DOUBLE AS x FROM embeddings"
LEAST_R = NormalDist().inv_cdf(0.975)
SKELETON = f"""
WITH x AS MATERIALIZED ({LONG}), n AS (SELECT count(*) AS n FROM embeddings),
c AS MATERIALIZED (SELECT a.v AS a, b.v AS b, corr(a.x, b.x) AS r FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.v <> b.v GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b, r FROM c, n WHERE sqrt(n - 3) * abs(atanh(r)) > {LEAST_R!r}),
p AS (SELECT e.a, e.b, (e.r - x.r * y.r) / sqrt((1 - x.r * x.r) * (1 - y.r * y.r)) AS r FROM e JOIN e x ON x.a = e.a AND x.b <> e.b JOIN c y ON y.a = e.b AND y.b = x.b),
g AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM p, n WHERE sqrt(n - 4) * abs(atanh(r)) <= {LEAST_R!r})
SELECT a, b, r FROM e WHERE a < b AND (a, b) NOT IN (SELECT (a, b) FROM g)"""


def dimension_correlations(t: Tables):
    x = t.embeddings.select("vec_id", F.posexplode("embedding").alias("v", "x")).select("vec_id", (F.col("v") + 1).alias("v"), F.col("x").cast("double").alias("x"))
    both = x.join(x.select("vec_id", F.col("v").alias("b"), F.col("x").alias("y")), "vec_id").where("v < b")
    return both.groupBy(F.col("v").alias("a"), "b").agg(F.corr("x", "y").alias("r"))


@query(SKELETON, "r")
def causal_skeleton_level1(t: Tables):
    return skeleton.skeleton(dimension_correlations(t), t.embeddings.count(), most=1)[0]


@query()
def rewired_null(t: Tables):
    return nullgraph.against_rewired(edges(t), t.part.where("p_size >= 25").select(F.col("p_partkey").alias("node")), rounds=5)


def orders_of(t: Tables):
    """Suppliers and the parts that they have delivered."""
    return t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@query()
def negative_edges_by_degree(t: Tables):
    e = orders_of(t)
    return sampling.negative_edges_by_degree(e, e.count() // 2, targets=t.part.select(F.col("p_partkey").alias("node")))


@query()
def negative_pool(t: Tables):
    return sampling.negative_pool(t.part.select(F.col("p_partkey").alias("node")), graph.degrees(edges(t)), power=0.75)


#: Fixed value: Euler's constant
PSI = "(-0.5772156649015329::DOUBLE + coalesce(list_sum([1.0::DOUBLE / i for i in range(1, {0})]), 0))"
SPENT = "SELECT c_custkey AS id, c_mktsegment AS y, c_acctbal AS acctbal, coalesce(sum(o_totalprice), 0)::DOUBLE AS spent, count(o_orderkey)::DOUBLE AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3"
INFORMATION = f"""
WITH w AS ({SPENT}), l AS (SELECT id, y, 'acctbal' AS feature, acctbal AS x FROM w UNION ALL SELECT id, y, 'spent', spent FROM w UNION ALL SELECT id, y, 'orders', orders FROM w),
s AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY feature, y) AS n_y FROM l QUALIFY count(*) OVER (PARTITION BY feature, y) > 1),
d AS (SELECT a.feature, a.id, a.x, a.n_y, least(3, a.n_y - 1) AS k, list_sort(list(abs(a.x - b.x)))[least(3, a.n_y - 1)] AS d FROM s a JOIN s b ON a.feature = b.feature AND a.y = b.y AND a.id <> b.id GROUP BY 1, 2, 3, 4),
r AS MATERIALIZED (SELECT *, greatest(0, d - greatest(d * 1e-10, (abs(x) + d) * 4.5e-16)) AS r FROM d),
m AS (SELECT a.feature, a.id, any_value(a.k) AS k, any_value(a.n_y) AS n_y, count(*) AS m FROM r a JOIN s b ON a.feature = b.feature AND b.x >= a.x - a.r AND b.x <= a.x + a.r GROUP BY 1, 2)
SELECT feature, count(*) AS n, greatest(0, {PSI.format("count(*)")} + avg({PSI.format("k")}) - avg({PSI.format("n_y")}) - avg({PSI.format("m")})) AS mi FROM m GROUP BY 1"""


def spent(t: Tables):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("orders"))
    return t.customer.join(o, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("y"), F.col("c_acctbal").alias("acctbal"), F.coalesce("spent", F.lit(0.0)).alias("spent"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query(INFORMATION, "mi")
def mutual_information(t: Tables):
    return information.mutual_information(spent(t), ["acctbal", "spent", "orders"], "y")


@query()
def selected_features(t: Tables):
    return information.select_features(spent(t), ["acctbal", "spent", "orders"], "y", inflation=5.0)


QUANTITIES = "SELECT l_suppkey AS m, l_returnflag || '-' || l_linenumber AS s, sum(l_quantity)::BIGINT AS y FROM lineitem GROUP BY 1, 2"


def quantities(t: Tables):
    """Units of each supplier in each combination of flag and line number."""
    return t.lineitem.groupBy(F.col("l_suppkey").alias("m"), F.concat("l_returnflag", F.lit("-"), "l_linenumber").alias("s"), (F.col("l_returnflag") == "R").alias("returned")).agg(F.sum("l_quantity").cast("long").alias("y"))


@query(f"WITH q AS ({QUANTITIES}), g AS (SELECT m, avg(ln(y)) AS g FROM q WHERE y > 0 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT s) FROM q)) SELECT s, exp(coalesce(quantile_disc(ln(y) - g, 0.5), 0)) AS size FROM q LEFT JOIN g USING (m) GROUP BY 1", "size")
def size_factors(t: Tables):
    return countmodels.size_factors(quantities(t), "s", "m", "y")


@query()
def count_test(t: Tables):
    return countmodels.count_test(quantities(t), "s", "m", "y", "returned")


PAIRS = f"WITH x AS MATERIALIZED ({LONG}), c AS MATERIALIZED (SELECT a.v AS a, b.v AS b, corr(a.x, b.x) AS r FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.v <> b.v GROUP BY 1, 2)"


@query(
    f"{PAIRS}, w AS MATERIALIZED (SELECT a, b, power(abs(r), 2) AS w FROM c), k AS (SELECT a, sum(w) AS k FROM w GROUP BY 1), p AS (SELECT x.a, y.b, sum(x.w * y.w) AS v FROM w x JOIN w y ON x.b = y.a AND x.a < y.b GROUP BY 1, 2) SELECT w.a, w.b, (coalesce(v, 0) + w) / (least(s.k, t.k) + 1 - w) AS overlap FROM w LEFT JOIN p ON p.a = w.a AND p.b = w.b JOIN k s ON s.a = w.a JOIN k t ON t.a = w.b WHERE w.a < w.b",
    "overlap",
)
def topological_overlap(t: Tables):
    return modules.topological_overlap(dimension_correlations(t), 2)


@query(
    f"{PAIRS}, k AS (SELECT power::INT AS power, a, sum(power(abs(r), power)) AS k FROM c, (SELECT unnest(range(1, 21))::DOUBLE AS power) GROUP BY 1, 2), s AS (SELECT power, min(k) AS low, (max(k) - min(k)) / 10 AS width, count(*) AS n, avg(k) AS mean_k, max(k) AS max_k FROM k GROUP BY 1), b AS (SELECT power, least(9, coalesce(floor((k - low) / nullif(width, 0)), 0))::INT AS b, count(*) AS c, avg(k) AS m FROM k JOIN s USING (power) GROUP BY 1, 2), g AS (SELECT s.*, log10(coalesce(m, low + (i.b + 0.5) * width)) AS x, log10(coalesce(c / n, 0) + 1e-9) AS y FROM s CROSS JOIN (SELECT unnest(range(0, 10))::INT AS b) i LEFT JOIN b USING (power, b)) SELECT power, coalesce(power(corr(x, y), 2), 0) AS fit, regr_slope(y, x) AS slope, mean_k, max_k FROM g GROUP BY power, mean_k, max_k",
    "fit slope mean_k max_k",
)
def soft_thresholds(t: Tables):
    return modules.soft_thresholds(dimension_correlations(t)).drop("median_k")


@query()
def coexpression_modules(t: Tables):
    d = modules.topological_overlap(dimension_correlations(t), 2).select("a", "b", (1 - F.col("overlap")).alias("d"))
    members = t.embeddings.select(F.posexplode("embedding").alias("member", "_x")).select((F.col("member") + 1).alias("member")).distinct()
    return modules.cut_modules(modules.average_linkage(d), members, least=3)


VARIABLE = """
WITH c AS (SELECT l_partkey AS feature, l_suppkey AS s, sum(l_quantity)::DOUBLE AS x FROM lineitem GROUP BY 1, 2),
t AS (SELECT s, sum(x) AS t FROM c GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM supplier),
y AS (SELECT feature, coalesce(x * 10000 / nullif(t, 0), 0) AS y FROM c JOIN t USING (s)),
m AS (SELECT feature, sum(y) / any_value(n) AS m, sum(y) AS sy, sum(y * y) AS sq, any_value(n) AS n FROM y, n GROUP BY 1),
d AS MATERIALIZED (SELECT feature, ln(1 + m) AS mean, CASE WHEN m > 0 AND sq - sy * m > 0 THEN ln((sq - sy * m) / (n - 1) / m) END AS dispersion FROM m),
b AS MATERIALIZED (SELECT d.*, CASE WHEN high > low THEN greatest(1, least(20, ceil((mean - low) * 20 / (high - low)))) ELSE 1 END AS b FROM d, (SELECT min(mean) AS low, max(mean) AS high FROM d)),
g AS (SELECT b, avg(dispersion) AS a, stddev_samp(dispersion) AS sd, count(dispersion) AS k FROM b GROUP BY 1),
z AS (SELECT feature, mean, dispersion, CASE WHEN k = 1 THEN CASE WHEN dispersion IS NOT NULL THEN 1.0 END ELSE (dispersion - a) / nullif(sd, 0) END AS normalised FROM b JOIN g USING (b))
SELECT feature, mean, dispersion, normalised, row_number() OVER (ORDER BY round(normalised, 9) DESC NULLS LAST, feature) AS rank FROM z"""


@query(VARIABLE, "mean dispersion normalised")
def variable_features(t: Tables):
    return neighbours.variable_features(t.lineitem, "l_partkey", "l_suppkey", "l_quantity", t.supplier.count())


@query()
def neighbour_graph(t: Tables):
    return neighbours.neighbour_graph(t.embeddings, "vec_id", "embedding")[0]
