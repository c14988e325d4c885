"""Queries of statistics, set enrichment, instruments, graphs, fusion and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import dist
from quern.operators import fusion, genesets, graph, mr, stats
from quern.plans.registry import Tables, query
from quern.plans.relational import LIST, YEARLY, yearly
from quern.streaming import windows

ARMS = "SELECT l_suppkey AS g, l_extendedprice AS v, l_returnflag = 'R' AS c FROM lineitem"
MOMENTS = f"SELECT g, count(*) FILTER (c) AS n1, count(*) FILTER (NOT c) AS n0, avg(v) FILTER (c) AS m1, avg(v) FILTER (NOT c) AS m0, var_samp(v) FILTER (c) AS v1, var_samp(v) FILTER (NOT c) AS v0 FROM ({ARMS}) GROUP BY 1"


def arms(t: Tables):
    return t.lineitem.select(F.col("l_suppkey").alias("g"), F.col("l_extendedprice").alias("v"), (F.col("l_returnflag") == "R").alias("c"), "l_orderkey", "l_linenumber")


@query(f"SELECT g, n1, n0, m1 - m0 AS difference, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)) AS df FROM ({MOMENTS}) WHERE n1 > 1 AND n0 > 1", "difference t df")
def welch_t(t: Tables):
    return stats.welch_t(arms(t), ["g"], "v", F.col("c"))


@query(f"SELECT g, m1 - m0 AS difference, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)) AS t, (n1 + n0 - 2)::DOUBLE AS df FROM ({MOMENTS}) WHERE n1 > 1 AND n0 > 1", "difference t df")
def student_t(t: Tables):
    return stats.student_t(arms(t), ["g"], "v", F.col("c"))


@query("SELECT l_suppkey AS g, count(*) AS n, avg(l_tax - l_discount) AS difference, avg(l_tax - l_discount) * sqrt(count(*)) / stddev_samp(l_tax - l_discount) AS t FROM lineitem GROUP BY 1 HAVING count(*) >= 3", "difference t")
def paired_t(t: Tables):
    return stats.paired_t(t.lineitem.withColumnRenamed("l_suppkey", "g"), ["g"], "l_discount", "l_tax")


COHEN = f"SELECT g, n1, n0, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d FROM ({MOMENTS}) WHERE n1 > 1 AND n0 > 1"
COHEN_V = f"SELECT *, (n1 + n0) / (n1 * n0)::DOUBLE + d * d / (2 * (n1 + n0)) AS variance FROM ({COHEN})"


@query(COHEN_V, "d variance")
def cohens_d(t: Tables):
    return stats.cohens_d(arms(t), ["g"], "v", F.col("c"))


def effects(t: Tables):
    d = stats.cohens_d(arms(t), ["g"], "v", F.col("c"))
    return d.join(t.supplier.select(F.col("s_suppkey").alias("g"), F.col("s_nationkey").alias("r")), "g")


EFFECTS = f"SELECT d.*, s_nationkey AS r FROM ({COHEN_V}) d JOIN supplier ON g = s_suppkey"


@query(f"WITH s AS (SELECT r, count(*) AS k, sum(1 / variance) AS w, sum(power(variance, -2)) AS ww, sum(d / variance) AS we, sum(d * d / variance) AS wee FROM ({EFFECTS}) GROUP BY 1 HAVING count(*) >= 2), q AS (SELECT *, greatest(0, wee - we * we / w) AS q FROM s), t AS (SELECT *, greatest(0, (q - (k - 1)) / (w - ww / w)) AS tau2, greatest(0, 100 * (q - (k - 1)) / q) AS i2 FROM q) SELECT r, k, q, tau2, i2, sum(d / (variance + tau2)) / sum(1 / (variance + tau2)) AS effect, 1 / sqrt(sum(1 / (variance + tau2))) AS se FROM ({EFFECTS}) JOIN t USING (r) GROUP BY ALL", "q tau2 i2 effect se")
def random_effects_meta(t: Tables):
    return stats.random_effects(effects(t), ["r"], "d", "variance")


@query(f"WITH s AS (SELECT r, count(*) AS k, sum(1 / variance) AS w, sum(d / variance) AS we, sum(d * d / variance) AS wee FROM ({EFFECTS}) GROUP BY 1), q AS (SELECT *, greatest(0, wee - we * we / w) AS q FROM s) SELECT r, k, we / w AS effect, 1 / sqrt(w) AS se, CASE WHEN k = 1 THEN 0 ELSE q END AS q, CASE WHEN k = 1 OR q = 0 THEN 0 ELSE greatest(0, 100 * (q - (k - 1)) / q) END AS i2 FROM q", "effect se q i2")
def fixed_effect_meta(t: Tables):
    f = stats.fixed_effect(effects(t), ["r"], "d", "variance")
    return f.withColumn("q", F.when(F.col("k") == 1, 0.0).otherwise(F.col("q"))).withColumn("i2", F.when(F.col("k") == 1, 0.0).otherwise(F.col("i2")))


@query(f"SELECT r, g, (sum(d / variance) OVER w - d / variance) / (sum(1 / variance) OVER w - 1 / variance) AS effect, 1 / sqrt(sum(1 / variance) OVER w - 1 / variance) AS se FROM ({EFFECTS}) WINDOW w AS (PARTITION BY r) QUALIFY count(*) OVER w > 1", "effect se")
def leave_one_out_meta(t: Tables):
    return stats.leave_one_out(effects(t), ["r"], "g", "d", "variance")


@query("WITH p AS (SELECT p_brand, (p_partkey * 7919 % 10007 + 1) / 10008.0::DOUBLE AS p FROM part) SELECT p_brand, count(*) AS k, -2 * sum(ln(p)) AS chi2 FROM p GROUP BY 1 HAVING count(*) >= 2", "chi2")
def fisher_combined(t: Tables):
    p = t.part.select("p_brand", ((F.col("p_partkey") * 7919 % 10007 + 1) / 10008.0).alias("p"))
    return stats.fisher_combined(p, ["p_brand"], "p").drop("p")


@query("WITH p AS (SELECT p_brand, (p_partkey * 7919 % 10007 + 1) / 10008.0::DOUBLE AS p FROM part) SELECT p_brand, count(*) AS k, -2 * sum(ln(p)) AS chi2 FROM p GROUP BY 1 HAVING count(*) >= 2", "chi2")
def fisher_combined_all(t: Tables):
    p = t.part.select("p_brand", ((F.col("p_partkey") * 7919 % 10007 + 1) / 10008.0).alias("p"))
    return stats.fisher_combined(p, ["p_brand"], "p").drop("p")


@query("WITH p AS (SELECT *, (o_orderkey * 7919 % 2001 - 1000) / 400.0::DOUBLE AS z FROM orders) SELECT o_custkey, count(*) AS k, sum(o_totalprice * z) / sqrt(sum(o_totalprice * o_totalprice)) AS z FROM p GROUP BY 1", "z")
def stouffer(t: Tables):
    return stats.stouffer(t.orders.withColumn("z", (F.col("o_orderkey") * 7919 % 2001 - 1000) / 400.0), ["o_custkey"], "z", "o_totalprice")


LABELLED = "SELECT d.doc_id, lang AS g, n_chars AS s, quality = 1 AS c FROM documents d JOIN labels USING (doc_id)"


def labelled(t: Tables):
    return t.documents.join(t.labels, "doc_id").select("doc_id", F.col("lang").alias("g"), F.col("n_chars").alias("s"), (F.col("quality") == 1).alias("c"))


RANKED = f"SELECT *, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY g, s)::DOUBLE AS t FROM ({LABELLED})"


@query(f"SELECT g, count(*) FILTER (c) AS n_pos, count(*) FILTER (NOT c) AS n_neg, (sum(r) FILTER (c) - count(*) FILTER (c) * (count(*) FILTER (c) + 1) / 2) / nullif(count(*) FILTER (c) * count(*) FILTER (NOT c), 0) AS auc FROM ({RANKED}) GROUP BY 1", "auc")
def auc(t: Tables):
    return stats.auc(labelled(t), ["g"], "s", F.col("c"))


@query(f"WITH k AS (SELECT g, s, count(*) FILTER (c) AS p, count(*) AS a FROM ({LABELLED}) GROUP BY 1, 2), w AS (SELECT *, sum(p) OVER o / sum(a) OVER o AS precision, sum(p) OVER (PARTITION BY g) AS every FROM k WINDOW o AS (PARTITION BY g ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT g, sum(p * precision / nullif(every, 0)) AS average_precision FROM w GROUP BY 1", "average_precision")
def average_precision(t: Tables):
    return stats.average_precision(labelled(t), ["g"], "s", F.col("c"))


@query(f"WITH a AS (SELECT g, count(*) FILTER (c)::DOUBLE AS n1, count(*) FILTER (NOT c)::DOUBLE AS n0, coalesce(sum(r) FILTER (c), 0) AS s, sum(t * t - 1) AS ties FROM ({RANKED}) GROUP BY 1), u AS (SELECT *, s - n1 * (n1 + 1) / 2 AS u FROM a), z AS (SELECT *, sign(u - n1 * n0 / 2) * greatest(abs(u - n1 * n0 / 2) - 0.5, 0) / nullif(sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))), 0) AS z FROM u) SELECT g, n1, n0, u, z, z / sqrt(n1 + n0) AS effect FROM z", "n1 n0 u z effect")
def mann_whitney_u(t: Tables):
    return stats.mann_whitney(labelled(t), ["g"], "s", F.col("c"))


@query(f"WITH k AS (SELECT g, v, count(*) FILTER (c) AS a, count(*) FILTER (NOT c) AS b FROM ({ARMS}) GROUP BY 1, 2), s AS (SELECT g, sum(a) OVER p AS n1, sum(b) OVER p AS n0, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS d FROM k WINDOW p AS (PARTITION BY g), w AS (PARTITION BY g ORDER BY v ROWS UNBOUNDED PRECEDING)) SELECT g, n1::BIGINT AS n1, n0::BIGINT AS n0, max(d) AS d FROM s GROUP BY 1, 2, 3", "d")
def ks_two_samples(t: Tables):
    return stats.ks_two_samples(arms(t), ["g"], "v", F.col("c"))


@query(f"WITH e AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM ({ARMS})), b AS (SELECT greatest(0, least(18, floor((v - lo) * 19 / (hi - lo)))) AS b, count(*) FILTER (c) AS a, count(*) FILTER (NOT c) AS z FROM ({ARMS}), e GROUP BY 1), p AS (SELECT a / sum(a) OVER () AS p, z / sum(z) OVER () AS q FROM b) SELECT (sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)) / 2 AS jsd FROM p", "jsd")
def jensen_shannon(t: Tables):
    return stats.jensen_shannon(arms(t), "v", F.col("c"))


for method, source in {"pearson": YEARLY, "spearman": f"SELECT sample, gene, rank() OVER (PARTITION BY sample ORDER BY value) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2.0::DOUBLE AS value FROM ({YEARLY})"}.items():

    @query(f"WITH r AS ({source}) SELECT x.sample AS a, y.sample AS b, count(*) AS n, corr(x.value, y.value) AS r FROM r x JOIN r y ON x.gene = y.gene AND x.sample < y.sample GROUP BY 1, 2 HAVING count(*) >= 3", "r", f"{method}_pairs")
    def _pairs(t: Tables, method=method):
        return stats.correlations(yearly(t), "gene", "sample", "value", method)


@query("WITH q AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1) SELECT o_orderkey, CASE WHEN o_totalprice >= q3 THEN 'high' ELSE 'low' END AS stratum FROM orders JOIN q ON g = o_orderpriority WHERE o_totalprice >= q3 OR o_totalprice <= q1")
def quartile_strata(t: Tables):
    return stats.quartile_strata(t.orders, "o_totalprice", ["o_orderpriority"]).select("o_orderkey", "stratum")


@query("WITH e AS (SELECT hour(ts)::INT AS h, value FROM events), b AS (SELECT avg(value) AS b FROM e WHERE h = 0) SELECT h, count(value) AS n, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS sem, avg(value) - any_value(b) AS change FROM e, b WHERE h <> 0 GROUP BY 1", "mean sem change")
def time_course(t: Tables):
    return stats.time_course(t.events.select(F.hour("ts").alias("h"), "value"), "h", "value", F.col("h") == 0)


@query("WITH c AS (SELECT DISTINCT l_partkey AS m FROM lineitem WHERE l_quantity >= 49), z AS (SELECT (SELECT count(*) FROM part) AS big, (SELECT count(*) FROM c) AS drawn) SELECT p_type, count(*) AS n_set, count(m) AS n_hit, count(*) * any_value(drawn) / any_value(big)::DOUBLE AS expected, count(m) / (count(*) * any_value(drawn) / any_value(big)::DOUBLE) AS fold FROM part LEFT JOIN c ON m = p_partkey, z GROUP BY 1 HAVING count(m) >= 1", "expected fold")
def over_representation(t: Tables):
    universe = t.part.select(F.col("p_partkey").alias("m"), "p_type")
    chosen = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("m"))
    return genesets.over_representation(universe, chosen, universe, "m", "p_type").drop("p", "q")


INSTRUMENTS = """SELECT l_suppkey AS gene, l_partkey AS chr, l_orderkey AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'C' END AS effect_allele, CASE WHEN l_linenumber % 2 = 0 THEN 'G' ELSE 'T' END AS other_allele,
 l_discount - 0.05 + 0.001 AS beta, 0.005 + l_tax / 40 AS se, l_quantity / 100 AS eaf, (l_orderkey * 31 + l_linenumber * 7919) % 100003 / 100003.0::DOUBLE AS p FROM lineitem"""
OUTCOMES = """SELECT l_partkey AS chr, l_orderkey AS pos, CASE WHEN l_linenumber % 3 = 0 THEN 'G' WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'C' END AS effect_allele, CASE WHEN l_linenumber % 3 = 0 THEN 'A' WHEN l_linenumber % 2 = 0 THEN 'G' ELSE 'T' END AS other_allele,
 l_tax - 0.04 AS beta, 0.01 + l_discount / 20 AS se, l_quantity / 100 AS eaf, (l_orderkey * 17 + l_linenumber * 6007) % 100019 / 100019.0::DOUBLE AS p FROM lineitem"""
HARMONISED = f"""
WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chr, pos, gene ORDER BY p, effect_allele, other_allele, beta, se, eaf) AS i FROM ({INSTRUMENTS})) WHERE i = 1),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chr, pos ORDER BY p, effect_allele, other_allele, beta, se, eaf) AS i FROM ({OUTCOMES})) WHERE i = 1),
j AS (SELECT e.gene, e.chr, e.pos, e.beta, e.se, o.effect_allele = e.other_allele AND o.other_allele = e.effect_allele AS flipped, o.beta AS b, o.se AS se_out, o.eaf AS f0, e.effect_allele = o.effect_allele AND e.other_allele = o.other_allele AS same FROM e JOIN o USING (chr, pos))
SELECT gene, chr, pos, beta, se, flipped, CASE WHEN flipped THEN -b ELSE b END AS beta_out, se_out, CASE WHEN flipped THEN 1 - f0 ELSE f0 END AS eaf_out, power(beta / se, 2) AS f FROM j WHERE (same OR flipped) AND power(beta / se, 2) > 10"""


def harmonised(t: Tables):
    l = t.lineitem
    even, third = F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") % 3 == 0
    place = [F.col("l_partkey").alias("chr"), F.col("l_orderkey").alias("pos")]
    key = F.col("l_orderkey")
    e = l.select(F.col("l_suppkey").alias("gene"), *place, F.when(even, "A").otherwise("C").alias("effect_allele"), F.when(even, "G").otherwise("T").alias("other_allele"), (F.col("l_discount") - 0.05 + 0.001).alias("beta"), (0.005 + F.col("l_tax") / 40).alias("se"), (F.col("l_quantity") / 100).alias("eaf"), ((key * 31 + F.col("l_linenumber") * 7919) % 100003 / 100003.0).alias("p"))
    o = l.select(*place, F.when(third, "G").when(even, "A").otherwise("C").alias("effect_allele"), F.when(third, "A").when(even, "G").otherwise("T").alias("other_allele"), (F.col("l_tax") - 0.04).alias("beta"), (0.01 + F.col("l_discount") / 20).alias("se"), (F.col("l_quantity") / 100).alias("eaf"), ((key * 17 + F.col("l_linenumber") * 6007) % 100019 / 100019.0).alias("p"))
    return mr.harmonise(e, o, ["chr", "pos"])


@query(f"SELECT gene, chr, pos, flipped, beta_out, eaf_out, f FROM ({HARMONISED})", "beta_out eaf_out f")
def harmonise(t: Tables):
    return harmonised(t).select("gene", "chr", "pos", "flipped", "beta_out", "eaf_out", "f")


@query(f"SELECT gene, count(*) AS n_snp, avg(f) AS f_mean, min(f) AS f_min, max(f) AS f_max, bool_or(f < 10) AS any_weak FROM ({HARMONISED}) GROUP BY 1", "f_mean f_min f_max")
def f_summary(t: Tables):
    return mr.f_summary(harmonised(t), ["gene"])


@query(f"WITH s AS (SELECT gene, count(*) AS n_snp, sum(beta * beta / power(se_out, 2)) AS xx, sum(beta * beta_out / power(se_out, 2)) AS xy, sum(beta_out * beta_out / power(se_out, 2)) AS yy FROM ({HARMONISED}) GROUP BY 1), q AS (SELECT *, greatest(0, yy - xy * xy / xx) AS q FROM s WHERE n_snp > 1) SELECT gene, n_snp, xy / xx AS beta, greatest(1, sqrt(q / (n_snp - 1))) / sqrt(xx) AS se, q, n_snp - 1 AS q_df FROM q", "beta se q")
def ivw(t: Tables):
    return mr.ivw(harmonised(t), ["gene"]).where("n_snp > 1")


@query(f"WITH h AS (SELECT gene, 1 / power(se_out, 2) AS w, abs(beta) AS x, beta_out * CASE WHEN beta < 0 THEN -1 ELSE 1 END AS y FROM ({HARMONISED})), s AS (SELECT gene, count(*) AS n_snp, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM h GROUP BY 1 HAVING count(*) >= 3) SELECT gene, n_snp, (w * xy - x * y) / (w * xx - x * x) AS slope, (xx * y - x * xy) / (w * xx - x * x) AS intercept FROM s", "slope intercept")
def egger(t: Tables):
    return mr.egger(harmonised(t), ["gene"]).select("gene", "n_snp", "slope", "intercept")


@query(f"SELECT gene, chr, pos, (sum(beta * beta_out / power(se_out, 2)) OVER w - beta * beta_out / power(se_out, 2)) / (sum(beta * beta / power(se_out, 2)) OVER w - beta * beta / power(se_out, 2)) AS beta FROM ({HARMONISED}) WINDOW w AS (PARTITION BY gene) QUALIFY count(*) OVER w > 1", "beta")
def leave_one_out_mr(t: Tables):
    h = harmonised(t).withColumn("snp", F.struct("chr", "pos"))
    return mr.leave_one_out(h, ["gene"], "snp").select("gene", "snp.chr", "snp.pos", "beta")


@query(f"WITH r AS (SELECT gene, chr, pos, beta_out / beta AS ratio, power(beta / se_out, 2) AS w FROM ({HARMONISED})), c AS (SELECT *, (sum(w) OVER o - w / 2) / sum(w) OVER (PARTITION BY gene) AS mid, row_number() OVER o AS i FROM r WINDOW o AS (PARTITION BY gene ORDER BY ratio, chr, pos ROWS UNBOUNDED PRECEDING)), n AS (SELECT *, lead(mid) OVER o AS m2, lead(ratio) OVER o AS r2 FROM c WINDOW o AS (PARTITION BY gene ORDER BY i)) SELECT gene, count(*) AS n_snp, max(CASE WHEN mid <= 0.5 AND m2 > 0.5 THEN ratio + (r2 - ratio) * (0.5 - mid) / (m2 - mid) WHEN mid <= 0.5 AND m2 IS NULL THEN ratio WHEN i = 1 AND mid > 0.5 THEN ratio END) AS beta FROM n GROUP BY 1", "beta")
def weighted_median_mr(t: Tables):
    return mr.weighted_median(harmonised(t), ["gene"], ["chr", "pos"])


@query()
def colocalisation(t: Tables):
    return mr.coloc(harmonised(t), ["gene"])


@query()
def steiger_direction(t: Tables):
    return mr.steiger(harmonised(t), ["gene"], 31684, 50000, with_p=True)


EDGES = "SELECT x.l_partkey AS src, y.l_partkey AS dst, count(DISTINCT x.l_orderkey) AS w FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2 HAVING count(DISTINCT x.l_orderkey) >= 2"
CLOSURE = f"SELECT src, dst, w::DOUBLE AS w FROM ({EDGES}) UNION ALL SELECT dst, src, w FROM ({EDGES})"


#: Lines a task takes when pairs of parts are counted; larger tables get more tasks, not larger ones.
LINES_A_TASK = 250_000


def together(t: Tables):
    tasks = 1 + t.lineitem.count() // LINES_A_TASK
    l = t.lineitem.select("l_orderkey", "l_partkey").repartition(tasks, "l_orderkey").distinct()
    both = l.withColumnRenamed("l_partkey", "src").join(l.withColumnRenamed("l_partkey", "dst"), "l_orderkey").where("src < dst")
    # nearly every pair is there once, so counting before the shuffle would only fill memory
    return both.select("src", "dst").repartition(tasks, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("w")).where("w >= 2")


def edges(t: Tables):
    """Parts that stand together in two orders or more; counted once a query."""
    return t.once("edges", lambda: together(t))


def seeds(t: Tables):
    return edges(t).where("w >= 3").select(F.col("src").alias("node")).distinct()


@query(f"SELECT src AS node, count(*) AS degree, sum(w) AS strength FROM ({CLOSURE}) GROUP BY 1", "strength")
def degree(t: Tables):
    return graph.degrees(edges(t))


@query(f"WITH c AS ({CLOSURE}), d AS (SELECT src AS node, count(*) AS k FROM c GROUP BY 1) SELECT src AS node, avg(k) AS mean_degree, min(k) AS least_degree, max(k) AS most_degree FROM c JOIN d ON dst = node GROUP BY 1", "mean_degree")
def neighbour_degree(t: Tables):
    return graph.neighbour_degree(edges(t))


@query(f"WITH c AS ({CLOSURE}), s AS (SELECT DISTINCT src AS node FROM ({EDGES}) WHERE w >= 3), a AS (SELECT DISTINCT dst AS node FROM c JOIN s ON src = node WHERE dst NOT IN (SELECT node FROM s)), b AS (SELECT DISTINCT dst AS node FROM c JOIN a ON src = node WHERE dst NOT IN (SELECT node FROM s) AND dst NOT IN (SELECT node FROM a)) SELECT node, 1 AS hop FROM a UNION ALL SELECT node, 2 FROM b")
def khop2(t: Tables):
    return graph.khop(edges(t), seeds(t), 2)


@query(f"WITH RECURSIVE c AS ({CLOSURE}), s AS (SELECT DISTINCT src AS node FROM ({EDGES}) WHERE w >= 4), r AS (SELECT node AS source, node, 0 AS hops FROM s UNION SELECT source, dst, hops + 1 FROM r JOIN c ON src = node WHERE hops < 3) SELECT source, node, min(hops) AS hops FROM r GROUP BY 1, 2")
def bfs_distances(t: Tables):
    return graph.distances(edges(t), edges(t).where("w >= 4").select(F.col("src").alias("node")).distinct(), 3)


@query(f"WITH c AS ({CLOSURE}), v AS (SELECT p_partkey AS node, p_retailprice AS v FROM part), o AS (SELECT src AS node, avg(v) AS one FROM c JOIN v ON dst = node GROUP BY 1), p AS (SELECT x.src AS node, avg(v) AS two FROM c x JOIN c y ON x.dst = y.src AND y.dst <> x.src JOIN v ON v.node = y.dst GROUP BY 1) SELECT node, one AS one_hop, coalesce(two, one) AS two_hop FROM o LEFT JOIN p USING (node)", "one_hop two_hop")
def two_hop_mean(t: Tables):
    return graph.two_hop_mean(edges(t), t.part.select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("value")))


@query(f"WITH c AS ({CLOSURE}), d AS (SELECT src AS node, count(*) AS k FROM c GROUP BY 1), t AS (SELECT x.src AS node, count(*) AS t FROM c x JOIN c y ON x.src = y.src AND x.dst < y.dst JOIN c z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1) SELECT node, coalesce(t, 0) AS triangles, CASE WHEN k > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END AS clustering FROM d LEFT JOIN t USING (node)", "clustering")
def triangles(t: Tables):
    return graph.triangles(edges(t))


PAGERANK = f"WITH c AS MATERIALIZED ({CLOSURE}), d AS MATERIALIZED (SELECT src AS node, count(*) AS k FROM c GROUP BY 1), n AS MATERIALIZED (SELECT count(*) AS n FROM d), r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS r FROM d, n)" + "".join(f", r{i} AS MATERIALIZED (SELECT dst AS node, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * sum(r / k) AS r FROM c JOIN d ON c.src = d.node JOIN r{i - 1} p ON p.node = c.src, n GROUP BY 1)" for i in range(1, 6)) + " SELECT node, r AS rank FROM r5"


@query(PAGERANK, "rank")
def pagerank5(t: Tables):
    return graph.pagerank(edges(t), 5)


@query()
def pagerank_converged(t: Tables):
    return graph.pagerank(edges(t), None)


@query()
def connected_components(t: Tables):
    return graph.components(edges(t))


@query()
def core3(t: Tables):
    return graph.kcore(edges(t), 3)


@query(f"WITH c AS ({CLOSURE}), d AS (SELECT src AS node, count(*) AS k FROM c GROUP BY 1), t AS (SELECT count(*) / 6 AS t FROM c x JOIN c y ON x.dst = y.src JOIN c z ON z.src = y.dst AND z.dst = x.src) SELECT count(*) AS nodes, (sum(k) / 2)::BIGINT AS edges, sum(k)::DOUBLE / (count(*) * (count(*) - 1)) AS density, avg(k) AS mean_degree, 3 * any_value(t) / sum(k * (k - 1) / 2)::DOUBLE AS transitivity FROM d, t", "density mean_degree transitivity")
def graph_overview(t: Tables):
    return graph.overview(edges(t))


@query(f"WITH d AS (SELECT src AS node, count(*) AS degree FROM ({CLOSURE}) GROUP BY 1) SELECT node, degree, degree > (SELECT quantile_cont(degree, 0.75) FROM d) AS hub FROM d")
def hubs(t: Tables):
    return graph.hubs(edges(t))


MODELS = "SELECT 'count' AS model, l_suppkey AS m, count(*)::DOUBLE AS s FROM lineitem GROUP BY 2 UNION ALL SELECT 'price', l_suppkey, round_even(sum(l_extendedprice), 2) FROM lineitem GROUP BY 2 UNION ALL SELECT 'balance', s_suppkey, s_acctbal FROM supplier"


def models(t: Tables):
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("m"))
    a = g.agg(F.count("*").cast("double").alias("s")).select(F.lit("count").alias("model"), "m", "s")
    b = g.agg(F.bround(F.sum("l_extendedprice"), 2).alias("s")).select(F.lit("price").alias("model"), "m", "s")
    return a.unionByName(b).unionByName(t.supplier.select(F.lit("balance").alias("model"), F.col("s_suppkey").alias("m"), F.col("s_acctbal").alias("s")))


@query(f"WITH r AS (SELECT m, row_number() OVER (PARTITION BY model ORDER BY s DESC, m) AS r FROM ({MODELS})) SELECT m, sum(1.0::DOUBLE / (60 + r)) AS rrf FROM r GROUP BY 1", "rrf")
def rrf(t: Tables):
    return fusion.reciprocal_ranks(models(t), "model", "m", "s")


@query(f"WITH r AS (SELECT m, model, row_number() OVER (PARTITION BY model ORDER BY s DESC, m) AS r FROM ({MODELS})) SELECT m, sum(CASE model WHEN 'count' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END / 1.4::DOUBLE / (60 + r)) AS rrf FROM r WHERE model <> 'balance' GROUP BY 1", "rrf")
def weighted_rrf(t: Tables):
    metrics = t.spark.createDataFrame([("count", 0.9, 0.7), ("price", 0.65, 0.55), ("balance", 0.4, 0.9)], "model string, a double, b double")
    return fusion.reciprocal_ranks(models(t), "model", "m", "s", weights=fusion.quality_weights(metrics, "model", "a", "b"))


@query(f"WITH r AS (SELECT m, row_number() OVER (PARTITION BY model ORDER BY s, m) - 1 AS p FROM ({MODELS})) SELECT m, sum(p)::BIGINT AS points FROM r GROUP BY 1")
def borda(t: Tables):
    return fusion.borda(models(t), "model", "m", "s")


@query(f"WITH r AS (SELECT m, rank() OVER (PARTITION BY model ORDER BY s DESC) AS r FROM ({MODELS})) SELECT m, exp(avg(ln(r))) AS rank_mean FROM r GROUP BY 1", "rank_mean")
def geometric_rank(t: Tables):
    return fusion.geometric_rank(models(t), "model", "m", "s")


@query(f"WITH f AS (SELECT CASE model WHEN 'balance' THEN 'money' ELSE 'sales' END AS f, m, sum(s * CASE model WHEN 'count' THEN 2.0 ELSE 1.0 END) / sum(CASE model WHEN 'count' THEN 2.0 ELSE 1.0 END) AS v FROM ({MODELS}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY round(v, 6) DESC, m) AS r FROM f) SELECT m, count(*) AS families FROM r WHERE r <= 30 GROUP BY 1 HAVING count(*) >= 2")
def family_consensus(t: Tables):
    return fusion.family_consensus(models(t), "model", "m", "s", {"count": "sales", "price": "sales", "balance": "money"}, {"count": 2.0})


@query(f"WITH a AS (SELECT m, s AS x FROM ({MODELS}) WHERE model = 'count'), b AS (SELECT m, s AS y FROM ({MODELS}) WHERE model = 'balance'), j AS (SELECT m, 100 * (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE) / count(*) OVER () AS l, 100 * (rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE) / count(*) OVER () AS r FROM a JOIN b USING (m)) SELECT m, l AS left_percentile, r AS right_percentile, (l + r) / 2 AS consensus FROM j", "left_percentile right_percentile consensus")
def percentile_consensus(t: Tables):
    s = models(t)
    return fusion.percentile_consensus(s.where("model = 'count'"), s.where("model = 'balance'"), "m", "s")


FUSED = f"WITH a AS (SELECT m, s AS score, s AS n FROM ({MODELS}) WHERE model = 'count'), b AS (SELECT m, s AS score FROM ({MODELS}) WHERE model = 'price'), j AS (SELECT m, coalesce(a.score * 100 / max(a.score) OVER (), 0) AS x, coalesce(b.score * 100 / max(b.score) OVER (), 0) AS y, 0.4::DOUBLE * coalesce(n / (n + 10), 1) AS wx FROM a FULL JOIN b USING (m)) SELECT m, x AS count, y AS price, (x * wx + y * 0.6::DOUBLE) / (wx + 0.6::DOUBLE) AS fused FROM j"


def fused(t: Tables):
    s = models(t).withColumnRenamed("s", "score")
    tables = {"count": s.where("model = 'count'").select("m", "score", F.col("score").alias("n")), "price": s.where("model = 'price'").select("m", "score")}
    return fusion.evidence_fusion(tables, "m", {"count": 0.4, "price": 0.6}, {"count": "n"})


@query(FUSED, "count price fused")
def evidence_fusion(t: Tables):
    return fused(t)


@query(f"WITH f AS (SELECT m, round(fused, 6) AS fused FROM ({FUSED})), q AS (SELECT greatest(40, quantile_cont(fused, 0.75)) AS q3, greatest(25, quantile_cont(fused, 0.5)) AS q2 FROM f) SELECT m, least(3, CASE WHEN fused >= q3 THEN 1 WHEN fused >= q2 THEN 2 ELSE 3 END + (m % 10 = 0)::INT) AS tier FROM f, q")
def tiers(t: Tables):
    f = fused(t).select("m", F.round("fused", 6).alias("fused"))
    return fusion.tiers(f, "fused", F.col("m") % 10 == 0).select("m", "tier")


@query("SELECT p_partkey, (CASE WHEN p_size <= 10 THEN 3 ELSE 0 END + CASE WHEN p_retailprice > 1200 THEN 2 ELSE 0 END + CASE WHEN p_type LIKE 'ECONOMY%' THEN 1 ELSE 0 END)::DOUBLE AS rule_score, CASE WHEN p_size > 45 THEN 'rejected' WHEN rule_score >= 6 THEN 'A' WHEN rule_score >= 3 THEN 'B' WHEN rule_score >= 1 THEN 'C' ELSE 'rejected' END AS rule_tier FROM part", "rule_score")
def rule_tiers(t: Tables):
    rules = {"small": (F.col("p_size") <= 10, 3.0), "dear": (F.col("p_retailprice") > 1200, 2.0), "economy": (F.startswith("p_type", F.lit("ECONOMY")), 1.0)}
    return fusion.rule_score(t.part, rules, F.col("p_size") > 45).select("p_partkey", "rule_score", "rule_tier")


@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2", "total")
def tumbling_windows(t: Tables):
    w = windows.windowed(t.events, "ts", "1 hour", keys=["event_type"], value="value")
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total")


@query("SELECT epoch(time_bucket(INTERVAL 1 DAY, ts) - to_days(k))::BIGINT AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def sliding_windows(t: Tables):
    w = windows.windowed(t.events, "ts", "2 days", "1 day", ["event_type"])
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS i FROM f) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS stop, count(*) AS n FROM i GROUP BY user_id, i")
def session_windows(t: Tables):
    s = windows.sessions(t.events, "ts", "30 minutes", ["user_id"])
    return s.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n")


@query()
def bootstrap_interval(t: Tables):
    return stats.bootstrap_means(t.orders, "o_orderkey", "o_totalprice", 2000)


@query()
def permutation_test(t: Tables):
    return stats.permutation_p(t.customer, "c_custkey", "c_acctbal", F.col("c_mktsegment") == "BUILDING", 2000)


@query()
def p_values(t: Tables):
    w = stats.welch_t(arms(t), ["g"], "v", F.col("c"), with_p=True)
    return w.withColumn("normal", dist.normal_two_sided("t"))


@query(f"WITH s AS ({LIST}) SELECT count(*) AS genes, sum(round(s * 100)::BIGINT)::BIGINT AS cents FROM s")
def list_totals(t: Tables):
    scores = t.lineitem.groupBy("l_partkey").agg(F.bround(F.sum("l_extendedprice"), 2).alias("s"))
    return scores.agg(F.count("*").alias("genes"), F.sum(F.round(F.col("s") * 100).cast("long")).alias("cents"))
