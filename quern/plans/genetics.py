"""Queries of p-values, instruments, estimates and their diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import fusion, genesets, mr, stats
from quern.plans.analytics import COHEN_V, HARMONISED, LABELLED, MOMENTS, RANKED, arms, harmonised, labelled
from quern.plans.checks import PRIORITIES, priorities
from quern.plans.registry import Tables, query

SIMPSON = "CASE WHEN i = 0 OR i = 600 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


def normal_p(z: str) -> str:
    """SQL of the two-sided normal tail, by Simpson's rule on the density from 0 to |z|."""
    return f"CASE WHEN ({z}) IS NOT NULL THEN (1 - 2 * list_sum([{SIMPSON} * exp(-power(least(abs({z}), 9.0) * i / 600.0::DOUBLE, 2) / 2) for i in range(0, 601)]) * least(abs({z}), 9.0) / 1800 / sqrt(2 * pi())) END"


def t_p(t: str, n: str) -> str:
    """SQL of the two-sided t tail with n degrees of freedom: the density over the angle atan(t / sqrt(n))."""
    return f"(1 - 2 * exp(lgamma(({n} + 1) / 2) - lgamma({n} / 2)) / sqrt(pi()) * list_sum([{SIMPSON} * power(cos(atan(abs({t}) / sqrt({n})) * i / 600.0::DOUBLE), {n} - 1) for i in range(0, 601)]) * atan(abs({t}) / sqrt({n})) / 1800)"


def adjusted(rows: str, keys: str) -> str:
    """SQL that adds q, the step-up adjustment of p over all rows."""
    return f"(SELECT *, least(1, min(p * n_ / i_) OVER (ORDER BY i_ DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (SELECT *, count(*) OVER () AS n_, row_number() OVER (ORDER BY p, {keys}) AS i_ FROM ({rows})))"


WELCH = f"SELECT g, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)) AS df FROM ({MOMENTS}) WHERE n1 > 1 AND n0 > 1"
STUDENT = f"SELECT g, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)) AS t, (n1 + n0 - 2)::DOUBLE AS df FROM ({MOMENTS}) WHERE n1 > 1 AND n0 > 1"


@query(f"SELECT g, t, df, p, q FROM {adjusted(f'SELECT *, {t_p("t", "df")} AS p FROM ({WELCH})', 'g')}", "t df p q")
def welch_p(t: Tables):
    from quern.operators.ranks import benjamini_hochberg

    return benjamini_hochberg(stats.welch_t(arms(t), ["g"], "v", F.col("c"), with_p=True), "p").select("g", "t", "df", "p", "q")


@query(f"SELECT g, t, {t_p('t', 'df')} AS p FROM ({STUDENT})", "t p")
def student_p(t: Tables):
    return stats.student_t(arms(t), ["g"], "v", F.col("c"), with_p=True).select("g", "t", "p")


@query(f"SELECT g, n, {t_p('t', '(n - 1)::DOUBLE')} AS p FROM (SELECT l_suppkey AS g, count(*) AS n, avg(l_tax - l_discount + 0.01) * sqrt(count(*)) / stddev_samp(l_tax - l_discount) AS t FROM lineitem GROUP BY 1 HAVING count(*) >= 3)", "p")
def paired_p(t: Tables):
    l = t.lineitem.withColumnRenamed("l_suppkey", "g").withColumn("after", F.col("l_tax") + 0.01)
    return stats.paired_t(l, ["g"], "l_discount", "after", with_p=True).select("g", "n", "p")


@query(f"WITH a AS (SELECT g, count(*) FILTER (c)::DOUBLE AS n1, count(*) FILTER (NOT c)::DOUBLE AS n0, coalesce(sum(r) FILTER (c), 0) AS s, sum(t * t - 1) AS ties FROM ({RANKED}) GROUP BY 1), u AS (SELECT *, s - n1 * (n1 + 1) / 2 AS u FROM a), z AS (SELECT *, sign(u - n1 * n0 / 2) * greatest(abs(u - n1 * n0 / 2) - 0.5, 0) / nullif(sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))), 0) AS z FROM u) SELECT g, {normal_p('z')} AS p FROM z", "p")
def mann_whitney_p(t: Tables):
    return stats.mann_whitney(labelled(t), ["g"], "s", F.col("c"), with_p=True).select("g", "p")


@query(f"WITH k AS (SELECT s AS threshold, count(*) FILTER (c) AS p, count(*) FILTER (NOT c) AS n FROM ({LABELLED}) GROUP BY 1) SELECT threshold, sum(p) OVER w / sum(p) OVER () AS tpr, sum(n) OVER w / sum(n) OVER () AS fpr, sum(p) OVER w / sum(p) OVER () - sum(n) OVER w / sum(n) OVER () AS youden FROM k WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)", "tpr fpr youden")
def roc_points(t: Tables):
    return stats.roc_points(labelled(t), "s", F.col("c"))


@query(f"WITH p AS (SELECT *, (o_orderkey * 7919 % 2001 - 1000) / 400.0::DOUBLE AS z FROM orders), s AS (SELECT o_custkey, count(*) AS k, sum(o_totalprice * z) / sqrt(sum(o_totalprice * o_totalprice)) AS z, greatest(count(*) FILTER (z > 0), count(*) FILTER (z < 0)) / count(*) AS agreement FROM p GROUP BY 1) SELECT o_custkey, k, z, agreement, p, q FROM {adjusted(f'SELECT *, {normal_p("z")} AS p FROM s', 'o_custkey')}", "z agreement p q")
def stouffer_evidence(t: Tables):
    o = t.orders.withColumn("z", (F.col("o_orderkey") * 7919 % 2001 - 1000) / 400.0)
    return fusion.stouffer_evidence(o, "o_custkey", "z", "z", "o_totalprice", with_p=True)


@query("WITH p AS (SELECT s_nationkey AS g, (s_suppkey * 7919 % 10007 + 1) / 10008.0::DOUBLE AS p FROM supplier), s AS (SELECT g, count(*) AS k, -2 * sum(ln(p)) AS chi2 FROM p GROUP BY 1 HAVING count(*) >= 2) SELECT g, k, chi2, exp(-chi2 / 2) * list_sum([exp(j * ln(chi2 / 2) - lgamma(j + 1)) for j in range(0, k)]) AS p FROM s", "chi2 p")
def fisher_p(t: Tables):
    p = t.supplier.select(F.col("s_nationkey").alias("g"), ((F.col("s_suppkey") * 7919 % 10007 + 1) / 10008.0).alias("p"))
    return stats.fisher_combined(p, ["g"], "p")


UPPER = "list_sum([exp(lgamma(n_set + 1) - lgamma(j + 1) - lgamma(n_set - j + 1) + lgamma(big - n_set + 1) - lgamma(drawn - j + 1) - lgamma(big - n_set - drawn + j + 1) - lgamma(big + 1) + lgamma(drawn + 1) + lgamma(big - drawn + 1)) for j in range(n_hit, least(n_set, drawn) + 1) if big - n_set - drawn + j >= 0])"
ENRICHED = f"WITH c AS (SELECT DISTINCT l_partkey AS m FROM lineitem WHERE l_quantity >= 49), z AS (SELECT (SELECT count(*) FROM part) AS big, (SELECT count(*) FROM c) AS drawn), s AS (SELECT p_type, count(*) AS n_set, count(m) AS n_hit, any_value(big) AS big, any_value(drawn) AS drawn FROM part LEFT JOIN c ON m = p_partkey, z GROUP BY 1 HAVING count(m) >= 1) SELECT p_type, n_set, n_hit, least(1, {UPPER}) AS p FROM s"


@query(f"SELECT p_type, n_set, n_hit, p, q FROM {adjusted(ENRICHED, 'p_type')}", "p q")
def over_representation_p(t: Tables):
    universe = t.part.select(F.col("p_partkey").alias("m"), "p_type")
    chosen = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("m"))
    return genesets.over_representation(universe, chosen, universe, "m", "p_type").select("p_type", "n_set", "n_hit", "p", "q")


PAIRS = f"WITH v AS ({PRIORITIES}) SELECT x.g AS a, y.g AS b, count(*) AS n, corr(x.v, y.v) AS r FROM v x JOIN v y ON x.u = y.u AND x.g < y.g GROUP BY 1, 2 HAVING count(*) >= 3"


@query(f"SELECT a, b, n, r, p, q FROM {adjusted(f'SELECT *, {t_p("r * sqrt((n - 2) / (1 - r * r))", "(n - 2)::DOUBLE")} AS p FROM ({PAIRS})', 'a, b')}", "r p q")
def correlation_p(t: Tables):
    return stats.with_correlation_p(stats.correlations(priorities(t), "u", "g", "v"))


@query(f"WITH v AS ({PRIORITIES}), r AS (SELECT y.g, count(*) AS n, corr(x.v, y.v) AS r FROM v x JOIN v y ON x.u = y.u AND x.g <> y.g WHERE x.g LIKE '1%' GROUP BY 1), p AS (SELECT *, {normal_p('r * sqrt(n)')} / 2 AS p FROM r) SELECT g, n, r, r * -2 AS predicted, p FROM p", "r predicted p")
def knockout_by_correlation(t: Tables):
    r = stats.partner_correlations(priorities(t), "u", "g", "v", "1-URGENT")
    return genesets.knockout_by_correlation(stats.with_correlation_p(r, method="normal"), "r").select("g", "n", "r", "predicted", "p")


IDS = "SELECT *, 'chr' || l_linenumber || '_' || l_orderkey || '_' || CASE WHEN l_partkey % 2 = 0 THEN 'A' ELSE 'C' END || '_' || CASE WHEN l_suppkey % 2 = 0 THEN 'g' ELSE 't' END || '_b38' AS id, (l_orderkey * 31 + l_linenumber * 7919) % 100003 / 100003.0::DOUBLE AS p FROM lineitem"


def variants(t: Tables):
    id_ = F.concat(F.lit("chr"), "l_linenumber", F.lit("_"), "l_orderkey", F.lit("_"), F.when(F.col("l_partkey") % 2 == 0, "A").otherwise("C"), F.lit("_"), F.when(F.col("l_suppkey") % 2 == 0, "g").otherwise("t"), F.lit("_b38"))
    return t.lineitem.withColumn("id", id_).withColumn("p", (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7919) % 100003 / 100003.0)


@query(f"SELECT id, string_split(id, '_')[1][4:] AS chr, string_split(id, '_')[2]::BIGINT AS pos, string_split(id, '_')[3] AS ref, string_split(id, '_')[4] AS alt FROM ({IDS})")
def variant_ids(t: Tables):
    return mr.parse_variant(variants(t), "id").select("id", "chr", "pos", "ref", "alt")


@query(f"SELECT l_suppkey::VARCHAR AS gene, id AS snp, l_linenumber::VARCHAR AS chr, l_orderkey AS pos, upper(string_split(id, '_')[4]) AS effect_allele, string_split(id, '_')[3] AS other_allele, l_discount AS beta, l_tax AS se, p, l_quantity AS eaf, 'blood' AS tissue FROM ({IDS}) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY p, id) <= 50", "p")
def exposure_table(t: Tables):
    v = variants(t).withColumn("g", F.concat("l_suppkey", F.lit("_v1")))
    return mr.to_exposure(v, "g", "id", "l_discount", "l_tax", "p", "l_quantity", "blood")


@query(f"WITH m AS (SELECT l_suppkey AS gene, l_partkey AS snp, min(p) AS p, array_to_string(list_sort(list(DISTINCT l_returnflag)), '+') AS tissues FROM ({IDS}) GROUP BY 1, 2) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY gene ORDER BY p, snp) <= 50", "p")
def tissue_matches(t: Tables):
    return mr.tissue_matches(variants(t).withColumnsRenamed({"l_suppkey": "gene", "l_partkey": "snp"}), "gene", "snp", "l_returnflag", "p")


@query("WITH v AS (SELECT l_suppkey AS g, l_orderkey, l_linenumber, (l_discount - 0.045) AS b, 0.01 + l_tax / 10 AS s, l_quantity / 100 AS f, 200000.0::DOUBLE AS n FROM lineitem), r AS (SELECT *, 2 * b * b * f * (1 - f) / (2 * b * b * f * (1 - f) + 2 * s * s * n * f * (1 - f)) AS r2 FROM v), k AS (SELECT *, sum(r2) OVER w AS r2_all, count(*) OVER w AS k FROM r WINDOW w AS (PARTITION BY g)) SELECT g, l_orderkey, l_linenumber, r2, r2_all, k, r2_all * (n - k - 1) / (k * (1 - r2_all)) AS f_all FROM k", "r2 r2_all f_all")
def f_from_r2(t: Tables):
    v = t.lineitem.select(F.col("l_suppkey").alias("g"), "l_orderkey", "l_linenumber", (F.col("l_discount") - 0.045).alias("b"), (0.01 + F.col("l_tax") / 10).alias("s"), (F.col("l_quantity") / 100).alias("f"), F.lit(200000.0).alias("n"))
    return mr.f_from_r2(v, ["g"], "b", "s", "f", "n").drop("b", "s", "f", "n")


@query(f"SELECT gene, chr, pos, beta_out / beta AS ratio, se_out / abs(beta) AS ratio_se FROM ({HARMONISED})", "ratio ratio_se")
def wald_ratios(t: Tables):
    return mr.wald(harmonised(t)).select("gene", "chr", "pos", "ratio", "ratio_se")


EGGER = f"WITH h AS (SELECT gene, 1 / power(se_out, 2) AS w, abs(beta) AS x, beta_out * CASE WHEN beta < 0 THEN -1 ELSE 1 END AS y FROM ({HARMONISED})), s AS (SELECT gene, count(*) AS n_snp, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy, sum(w * y * y) AS yy FROM h GROUP BY 1 HAVING count(*) >= 3), e AS (SELECT *, w * xx - x * x AS d, (w * xy - x * y) / (w * xx - x * x) AS slope, (xx * y - x * xy) / (w * xx - x * x) AS intercept FROM s), v AS (SELECT *, greatest(1, sqrt(greatest(0, yy - intercept * y - slope * xy) / (n_snp - 2))) AS v FROM e) SELECT gene, v * sqrt(w / d) AS slope_se, v * sqrt(xx / d) AS intercept_se, intercept, (n_snp - 2)::DOUBLE AS df FROM v"


@query(f"SELECT gene, slope_se, intercept_se, {t_p('intercept / intercept_se', 'df')} AS intercept_p FROM ({EGGER})", "slope_se:4 intercept_se intercept_p")
def egger_errors(t: Tables):
    from quern.functions import dist

    e = mr.egger(harmonised(t), ["gene"])
    return e.select("gene", "slope_se", "intercept_se", dist.t_two_sided(F.col("intercept") / F.col("intercept_se"), F.col("n_snp") - 2).alias("intercept_p"))


@query(f"SELECT gene, chr, pos, 1 / sqrt(sum(beta * beta / power(se_out, 2)) OVER w - beta * beta / power(se_out, 2)) AS se FROM ({HARMONISED}) WINDOW w AS (PARTITION BY gene) QUALIFY count(*) OVER w > 1", "se:5")
def leave_one_out_errors(t: Tables):
    h = harmonised(t).withColumn("snp", F.struct("chr", "pos"))
    return mr.leave_one_out(h, ["gene"], "snp").select("gene", "snp.chr", "snp.pos", "se")


MODE = f"""WITH r AS (SELECT gene, beta_out / beta AS r, power(beta / se_out, 2) AS w FROM ({HARMONISED})),
a AS (SELECT gene, count(*) AS n_snp, stddev_samp(r) AS sd, median(r) AS med, min(r) AS lo, max(r) AS hi FROM r GROUP BY 1),
m AS (SELECT gene, 1.4826 * median(abs(r - med)) AS mad FROM r JOIN a USING (gene) GROUP BY 1),
h AS (SELECT *, 0.9 * least(coalesce(sd, 0), mad) / power(n_snp, 0.2) AS h FROM a JOIN m USING (gene)),
g AS (SELECT gene, h, i, lo - 3 * h + i * (hi - lo + 6 * h) / 127 AS x FROM h, range(128) t(i) WHERE h > 0),
d AS (SELECT gene, i, x, sum(exp(-power((x - r) / h, 2) / 2)) AS s, sum(w * exp(-power((x - r) / h, 2) / 2)) AS v FROM g JOIN r USING (gene) GROUP BY 1, 2, 3),
b AS (SELECT gene, arg_max(x, s) AS simple_mode, arg_max(x, v) AS weighted_mode FROM d GROUP BY 1)
SELECT gene, n_snp, coalesce(simple_mode, med) AS simple_mode, coalesce(weighted_mode, med) AS weighted_mode FROM h LEFT JOIN b USING (gene)"""


@query(MODE, "simple_mode weighted_mode")
def mode_estimates(t: Tables):
    return mr.modes(harmonised(t), ["gene"])


@query(f"WITH h AS ({HARMONISED}), m AS ({MODE}) SELECT gene, 'wald_ratio' AS method, 1::BIGINT AS n_snp, beta_out / beta AS beta FROM h QUALIFY count(*) OVER (PARTITION BY gene) = 1 UNION ALL SELECT gene, 'ivw', count(*), sum(beta * beta_out / power(se_out, 2)) / sum(beta * beta / power(se_out, 2)) FROM h GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT gene, 'simple_mode', n_snp, simple_mode FROM m WHERE n_snp > 1 UNION ALL SELECT gene, 'weighted_mode', n_snp, weighted_mode FROM m WHERE n_snp > 1", "beta")
def method_table(t: Tables):
    return mr.all_methods(harmonised(t), ["gene"], ["chr", "pos"]).where("method not in ('egger', 'weighted_median')")


@query(f"WITH r AS (SELECT gene, chr, pos, beta_out / beta AS ratio, power(beta / se_out, 2) AS weight FROM ({HARMONISED})), q AS (SELECT *, weight * power(ratio - sum(weight * ratio) OVER w / sum(weight) OVER w, 2) AS q, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY gene)), p AS (SELECT *, {normal_p('sqrt(q)')} AS p FROM q) SELECT gene, chr, pos, weight, q, p, p * n < 0.05 AS outlier FROM p", "weight q p")
def radial_outliers(t: Tables):
    return mr.radial(harmonised(t), ["gene"], ["chr", "pos"])


@query(f"WITH s AS (SELECT gene, sum(power(beta / se, 2) / (power(beta / se, 2) + 31682)) AS r2_exposure, sum(power(beta_out / se_out, 2) / (power(beta_out / se_out, 2) + 49998)) AS r2_outcome FROM ({HARMONISED}) GROUP BY 1), f AS (SELECT *, atanh(least(sqrt(r2_exposure), 1 - 1e-12)) AS a, atanh(least(sqrt(r2_outcome), 1 - 1e-12)) AS b FROM s), z AS (SELECT *, (a - b) / sqrt(1 / 31681.0::DOUBLE + 1 / 49997.0::DOUBLE) AS z FROM f) SELECT gene, r2_exposure, r2_outcome, z, r2_exposure > r2_outcome AS right_direction, {normal_p('z')} AS p FROM z", "r2_exposure r2_outcome z p")
def steiger(t: Tables):
    return mr.steiger(harmonised(t), ["gene"], 31684, 50000, with_p=True)


def log_bf(b: str, s: str) -> str:
    return f"0.5 * (ln(1 - 0.0225 / (0.0225 + {s} * {s})) + 0.0225 / (0.0225 + {s} * {s}) * {b} * {b} / ({s} * {s}))"


@query(
    f"""WITH l AS (SELECT gene, {log_bf('beta', 'se')} AS a, {log_bf('beta_out', 'se_out')} AS b FROM ({HARMONISED})), x AS (SELECT gene, max(a) AS ma, max(b) AS mb, max(a + b) AS mc FROM l GROUP BY 1),
s AS (SELECT gene, count(*) AS n_snp, any_value(ma) + ln(sum(exp(a - ma))) AS la, any_value(mb) + ln(sum(exp(b - mb))) AS lb, any_value(mc) + ln(sum(exp(a + b - mc))) AS lc FROM l JOIN x USING (gene) GROUP BY 1),
h AS (SELECT gene, n_snp, [0.0, la + ln(1e-4), lb + ln(1e-4), la + lb + ln(greatest(1 - exp(lc - la - lb), 1e-300)) + 2 * ln(1e-4), lc + ln(1e-5)] AS h FROM s), t AS (SELECT gene, n_snp, [exp(v - list_max(h)) for v in h] AS e FROM h)
SELECT gene, n_snp, e[1] / list_sum(e) AS pp0, e[2] / list_sum(e) AS pp1, e[3] / list_sum(e) AS pp2, e[4] / list_sum(e) AS pp3, e[5] / list_sum(e) AS pp4 FROM t""",
    "pp0 pp1 pp2 pp3 pp4",
)
def shared_signal(t: Tables):
    return mr.coloc(harmonised(t), ["gene"])


HALF = f"SELECT gene, count(*) AS n_snp, sum(beta * beta_out / power(se_out, 2)) / sum(beta * beta / power(se_out, 2)) AS beta, 1 / sqrt(sum(beta * beta / power(se_out, 2))) AS se, min(f) AS f_min FROM ({HARMONISED}) WHERE chr % 2 = {{}} GROUP BY 1"


def half(t: Tables, k: int):
    """The fixed-effect estimate of each gene from one half of the variants."""
    w = F.lit(1.0) / (F.col("se_out") * F.col("se_out"))
    h = harmonised(t).where(F.col("chr") % 2 == k)
    return h.groupBy("gene").agg(F.count("*").alias("n_snp"), (F.sum(w * F.col("beta") * F.col("beta_out")) / F.sum(w * F.col("beta") * F.col("beta"))).alias("beta"), (F.lit(1.0) / F.sqrt(F.sum(w * F.col("beta") * F.col("beta")))).alias("se"), F.min("f").alias("f_min"))


@query(f"WITH a AS ({HALF.format(0)}), b AS ({HALF.format(1)}) SELECT gene, (a.beta / power(a.se, 2) + b.beta / power(b.se, 2)) / (power(a.se, -2) + power(b.se, -2)) AS beta, 1 / sqrt(power(a.se, -2) + power(b.se, -2)) AS se, sign(a.beta) = sign(b.beta) AS consistent FROM a JOIN b USING (gene)", "beta se")
def replicated(t: Tables):
    return mr.replicate(half(t, 0), half(t, 1), "gene")


@query(f"WITH a AS ({HALF.format(0)}), b AS ({HALF.format(1)} HAVING count(*) > 1) SELECT gene, a.beta AS left_beta, b.beta AS right_beta, CASE WHEN b.beta IS NULL THEN 'left_only' WHEN a.beta IS NULL THEN 'right_only' WHEN sign(a.beta) = sign(b.beta) THEN 'consistent' ELSE 'opposite' END AS consistency FROM a FULL JOIN b USING (gene)", "left_beta right_beta")
def consistency(t: Tables):
    return mr.consistency(half(t, 0), half(t, 1).where("n_snp > 1"), "gene")


@query(f"SELECT gene, n_snp, CASE WHEN n_snp = 1 AND f_min < 20 THEN 'single_variant|weak_instrument' WHEN n_snp = 1 THEN 'single_variant' WHEN f_min < 20 THEN 'weak_instrument' ELSE 'OK' END AS status FROM ({HALF.format(0)})")
def result_status(t: Tables):
    return mr.status(half(t, 0).withColumn("f_min", F.col("f_min") - 10)).select("gene", "n_snp", "status")


@query(f"WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 97 + 1 AS b FROM lineitem WHERE l_quantity > 45), v AS (SELECT g, d, (g * 7919 % 101) / 400.0::DOUBLE AS p FROM ({COHEN_V})), j AS (SELECT e.a, e.b, x.d AS dx, x.p AS px, y.d AS dy, y.p AS py FROM e LEFT JOIN v x ON x.g = e.a LEFT JOIN v y ON y.g = e.b), k AS (SELECT *, coalesce(sign(dx) = sign(dy), false) AS concordant, coalesce(px < 0.05, false)::INT + coalesce(py < 0.05, false)::INT AS n FROM j) SELECT a, b, concordant, n + (concordant AND n = 2)::INT AS evidence, CASE n + (concordant AND n = 2)::INT WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS priority FROM k")
def bridge_edges(t: Tables):
    e = t.lineitem.where("l_quantity > 45").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 97 + 1).alias("b")).distinct()
    v = stats.cohens_d(arms(t), ["g"], "v", F.col("c")).select("g", F.col("d").alias("beta"), (F.col("g") * 7919 % 101 / 400.0).alias("p"))
    return mr.bridge(e, v, "a", "b", "g", "beta", "p").select("a", "b", "concordant", "evidence", "priority")


@query()
def graded_instruments(t: Tables):
    v = variants(t).select(F.col("l_suppkey").alias("gene"), F.col("l_orderkey").alias("pos"), "p")
    return mr.graded_clump(v, ["gene"], "pos", "p", (20000.0, 5000.0, 1000.0), 5)
