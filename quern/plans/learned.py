"""Queries of learners, reductions, deconvolution, samples, protein profiles and the tails of distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import dist, scalar
from quern.operators import fusion, genesets, graph, learning, mr, topk
from quern.plans.analytics import edges
from quern.plans.inference import MATRIX, matrix
from quern.plans.registry import Tables, query


def _count(r: str) -> str:
    return f"(length(s) - length(replace(s, '{r}', '')))"


def _weighted(values: dict[str, float]) -> str:
    return "(" + " + ".join(f"{w!r}::DOUBLE * {_count(r)}" for r, w in values.items()) + ")"


CHARGE = " + ".join(f"{_count(r)} / (1 + power(10.0::DOUBLE, (low + high) / 2 - {pk!r}))" for r, pk in scalar.BASE_PK.items()) + "".join(f" - {_count(r)} / (1 + power(10.0::DOUBLE, {pk!r} - (low + high) / 2))" for r, pk in scalar.ACID_PK.items())
SHARES = ", ".join(f"{_count(r)} / n AS share_{r}" for r in sorted(scalar.RESIDUE_MASS))


@query(
    f"WITH RECURSIVE x AS (SELECT DISTINCT upper(p_name) AS s FROM part), b AS (SELECT s, 0 AS i, 0.0::DOUBLE AS low, 14.0::DOUBLE AS high FROM x UNION ALL SELECT s, i + 1, CASE WHEN {CHARGE} > 0 THEN (low + high) / 2 ELSE low END, CASE WHEN {CHARGE} > 0 THEN high ELSE (low + high) / 2 END FROM b WHERE i < 50), p AS (SELECT p_partkey, upper(p_name) AS s, length(p_name)::DOUBLE AS n FROM part) SELECT p_partkey, ln(1 + n) AS log_length, ({_weighted(scalar.RESIDUE_MASS)} - (n - 1) * 18.015) / 1000 AS kilodalton, (low + high) / 2 AS isoelectric, {_weighted(scalar.HYDROPATHY)} / n AS hydropathy, ({_count('F')} + {_count('Y')} + {_count('W')}) / n AS aromatic, {SHARES} FROM p JOIN b USING (s) WHERE i = 50",
    "log_length kilodalton isoelectric hydropathy aromatic " + " ".join(f"share_{r}" for r in sorted(scalar.RESIDUE_MASS)),
)
def protein_profile(t: Tables):
    # a row is half a millisecond's work, so a small file of many rows must not be one task
    parts = t.part.select("p_partkey", "p_name").repartition(int(1 + t.part.count() // 5_000), "p_partkey")
    return parts.select("p_partkey", *scalar.protein_profile("p_name"))


@query(f"SELECT p_partkey, length(s) AS n_residues, ({' + '.join(_count(r) for r in 'AVILMFWC')}) / length(s) AS hydrophobic, ({_count('D')} + {_count('E')}) / length(s) AS acidic, {_count('K')} + {_count('R')} - {_count('D')} - {_count('E')} AS net_charge FROM (SELECT p_partkey, upper(p_name) AS s FROM part)", "hydrophobic acidic")
def protein_features(t: Tables):
    return t.part.select("p_partkey", *scalar.protein_features("p_name")).select("p_partkey", "n_residues", "hydrophobic", "acidic", "net_charge")


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 3 = 0 AND abs(l_quantity / 50 - 0.5) <= 0.08 AS doubtful FROM lineitem")
def palindromic_variants(t: Tables):
    a = F.when(F.col("l_linenumber") % 3 == 0, "a").otherwise("G")
    l = t.lineitem.withColumn("ea", a).withColumn("oa", F.lit("T")).withColumn("eaf", F.col("l_quantity") / 50)
    return l.select("l_orderkey", "l_linenumber", mr.palindromic("ea", "oa", "eaf").alias("doubtful"))


R2 = "(power({0}, 2) + power({1}, 2) - 2 * {0} * {1} * {2}) / (1 - power({2}, 2))"


@query(f"WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem) SELECT 'l_quantity' AS feature, 1 / (1 - {R2.format('a', 'b', 'c')}) AS vif FROM c UNION ALL SELECT 'l_extendedprice', 1 / (1 - {R2.format('a', 'c', 'b')}) FROM c UNION ALL SELECT 'l_discount', 1 / (1 - {R2.format('b', 'c', 'a')}) FROM c", "vif")
def variance_inflation(t: Tables):
    return learning.variance_inflation(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


@query("WITH l AS (SELECT 'o_totalprice' AS score, o_totalprice AS v, o_orderpriority IN ('1-URGENT', '2-HIGH') AS c FROM orders UNION ALL SELECT 'o_custkey', o_custkey, o_orderpriority IN ('1-URGENT', '2-HIGH') FROM orders), m AS (SELECT score, count(*) FILTER (c) AS n1, count(*) FILTER (NOT c) AS n0, avg(v) FILTER (c) AS m1, avg(v) FILTER (NOT c) AS m0, var_samp(v) FILTER (c) AS v1, var_samp(v) FILTER (NOT c) AS v0 FROM l GROUP BY 1) SELECT score, n1, n0, m1 - m0 AS difference, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t FROM m", "difference:4 t")
def compared_groups(t: Tables):
    o = t.orders.withColumn("o_custkey", F.col("o_custkey").cast("double"))
    return genesets.compare_groups(o, "o_orderkey", ["o_totalprice", "o_custkey"], F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("score", "n1", "n0", "difference", "t")


#: With 2 and m degrees of freedom F has a closed tail, as has chi-square with 4; Kolmogorov's is its series; the quantile is undone.
@query("SELECT p_partkey, power(1 + 2 * x / p_size, -p_size / 2.0::DOUBLE) AS f, exp(-x / 2) * (1 + x / 2) AS chi2, least(1, greatest(0, 2 * list_sum([CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * power(y, 2)) for k in range(1, 101)]))) AS kolmogorov, u FROM (SELECT p_partkey, p_size, p_retailprice / 500 AS x, 0.3 + p_size / 40.0::DOUBLE AS y, (p_partkey % 97 + 0.5::DOUBLE) / 97 AS u FROM part)", "f chi2 kolmogorov u")
def distribution_tails(t: Tables):
    p = t.part.select("p_partkey", F.col("p_size").cast("double").alias("m"), (F.col("p_retailprice") / 500).alias("x"), (0.3 + F.col("p_size") / 40.0).alias("y"), ((F.col("p_partkey") % 97 + 0.5) / 97).alias("u"))
    # the tail takes a distance and a number of values: (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * distance at n = 1 is 1.23 times it
    return p.select("p_partkey", dist.f_upper("x", 2.0, "m").alias("f"), dist.chi2_upper("x", 4.0).alias("chi2"), dist.kolmogorov_upper(F.col("y") / 1.23, 1.0).alias("kolmogorov"), dist.normal_cdf(dist.normal_quantile("u")).alias("u"))


@query(f"WITH x AS ({MATRIX}), r AS (SELECT s, m, row_number() OVER (PARTITION BY s ORDER BY v DESC, m) AS i FROM x) SELECT m, sum(1.0::DOUBLE / (60 + i)) AS rrf, true AS in_order FROM r GROUP BY 1", "rrf")
def bootstrap_ranks(t: Tables):
    return fusion.bootstrap_ranks(matrix(t), "s", "m", "v").select("m", "rrf", (F.col("low") <= F.col("high")).alias("in_order"))


@query()
def principal_components(t: Tables):
    return learning.pca(t.embeddings, "embedding", 3).select("vec_id", "components")


def _spending(t: Tables):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"), F.count("*").cast("double").alias("orders"))
    c = t.customer.join(o, "c_custkey", "left").fillna(0.0, ["spent", "orders"])
    return c.select("c_custkey", F.col("c_acctbal").alias("balance"), (F.col("spent") / 1e5).alias("spent"), "orders", (F.col("c_mktsegment") == "BUILDING").cast("double").alias("label"))


@query()
def calibrated_scores(t: Tables):
    return learning.platt_scale(_spending(t), "spent", "label").select("c_custkey", "calibrated")


@query()
def cross_validated(t: Tables):
    penalty, area = learning.cross_validated(_spending(t), ["balance", "spent", "orders"], "label", penalties=(0.01, 0.1))
    return t.spark.createDataFrame([(penalty, area)], "penalty double, area double")


@query()
def stable_features(t: Tables):
    return learning.stability_selection(_spending(t), ["balance", "spent", "orders"], "label", penalty=0.001, key="c_custkey", draws=8)


@query()
def deconvolved(t: Tables):
    own = matrix(t)
    kinds = own.withColumn("kind", F.substring("s", 1, 1)).groupBy("m", "kind").agg(F.avg("v").alias("w"))
    return learning.deconvolve(own, kinds, "s", "m", "v", "kind", "w")


@query()
def uniform_negatives(t: Tables):
    e = edges(t)
    return graph.negative_edges(e, t.part.select(F.col("p_partkey").alias("node")), 500, 42)


@query()
def weighted_sample(t: Tables):
    return topk.weighted_sample(t.orders, 200, "o_totalprice", 42, "o_orderkey").select("o_orderkey", "o_totalprice")
