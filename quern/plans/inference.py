"""Queries of simulated nulls, shrunk variances and kernel scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import moderated, presso, setnull
from quern.plans.analytics import HARMONISED, MOMENTS, arms, harmonised
from quern.plans.genetics import adjusted, normal_p, t_p
from quern.plans.registry import Tables, query

GENE, SNP = ["gene"], ["chr", "pos"]


def instruments(t: Tables):
    return harmonised(t).select("gene", "chr", "pos", "beta", "se", "beta_out", "se_out")


RESIDUALS = f"WITH h AS (SELECT gene, abs(beta) AS x, beta_out * CASE WHEN beta < 0 THEN -1 ELSE 1 END AS y, power(se_out, -2) AS w FROM ({HARMONISED})), l AS (SELECT *, count(*) OVER g AS n, (sum(w * x * y) OVER g - w * x * y) / (sum(w * x * x) OVER g - w * x * x) AS rest FROM h WINDOW g AS (PARTITION BY gene)) SELECT gene, count(*) AS n_snp, sum(w * x * y) / sum(w * x * x) AS beta, sum(w * power(y - rest * x, 2)) AS rss FROM l WHERE n >= 4 GROUP BY 1"


@query(RESIDUALS, "beta rss")
def presso_residuals(t: Tables):
    return presso.residual_sums(instruments(t), GENE, SNP)


@query()
def presso_results(t: Tables):
    return presso.presso(instruments(t), GENE, SNP)[0]


@query()
def presso_outliers(t: Tables):
    return presso.presso(instruments(t), GENE, SNP)[1]


def polygamma(x: str, power: int) -> str:
    """SQL of the tail of the sums 1 / (x + i)^power from i = 0: 60 terms and the rest by the formula of Euler and Maclaurin."""
    return f"(list_sum([power(({x}) + i, -{power}) for i in range(0, 60)]) + power(({x}) + 60, 1 - {power}) / ({power} - 1) + power(({x}) + 60, -{power}) / 2 + {power} * power(({x}) + 60, -{power} - 1) / 12)"


#: digamma(x) as ln(y) - 1 / 2y - 1 / 12y^2 at y = x + 200, less the steps up to there
DIGAMMA = "(ln(({0}) + 200) - 0.5 / (({0}) + 200) - 1 / (12 * power(({0}) + 200, 2)) - list_sum([1 / (({0}) + i) for i in range(0, 200)]))"
MODERATED = f"""
WITH RECURSIVE a AS (SELECT *, (n1 + n0 - 2)::DOUBLE AS d, ((n1 - 1) * coalesce(v1, 0) + (n0 - 1) * coalesce(v0, 0)) / (n1 + n0 - 2) AS s2 FROM ({MOMENTS}) WHERE n1 > 0 AND n0 > 0 AND n1 + n0 > 2),
e AS (SELECT ln(s2) - {DIGAMMA.format("d / 2")} + ln(d / 2) AS e, {polygamma("d / 2", 2)} AS t FROM a),
m AS (SELECT avg(e) AS mean, var_samp(e) - avg(t) AS spread FROM e),
b AS (SELECT 0 AS i, ln(1e-4::DOUBLE) AS low, ln(1e8::DOUBLE) AS high FROM m WHERE spread > 0 UNION ALL SELECT i + 1, CASE WHEN {polygamma("exp((low + high) / 2)", 2)} > spread THEN (low + high) / 2 ELSE low END, CASE WHEN {polygamma("exp((low + high) / 2)", 2)} > spread THEN high ELSE (low + high) / 2 END FROM b, m WHERE i < 60),
p AS (SELECT CASE WHEN spread > 0 THEN (SELECT 2 * exp(low) FROM b WHERE i = 60) ELSE 'inf'::DOUBLE END AS d0, mean FROM m),
v AS (SELECT d0, CASE WHEN d0 = 'inf'::DOUBLE THEN exp(mean) ELSE exp(mean + {DIGAMMA.format("d0 / 2")} - ln(d0 / 2)) END AS v0 FROM p),
s AS (SELECT g, n1, n0, m1 - m0 AS difference, CASE WHEN v.d0 = 'inf'::DOUBLE THEN v.v0 ELSE (v.d0 * v.v0 + d * s2) / (v.d0 + d) END AS variance, least(d + v.d0, sum(d) OVER ()) AS df FROM a, v)
SELECT *, difference / sqrt(variance * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)) AS t FROM s"""


@query(f"SELECT g, n1, n0, difference, variance, t, df, p, q FROM {adjusted(f'SELECT *, {t_p("t", "df")} AS p FROM ({MODERATED})', 'g')}", "difference variance:2 t df:4 p q")
def moderated_t(t: Tables):
    return moderated.moderated_t(arms(t), ["g"], "v", F.col("c"))


LEVELS = "SELECT o_custkey AS m, sum(o_totalprice) AS s FROM orders GROUP BY 1"
OF_NATION = "SELECT c_nationkey AS k, c_custkey AS m FROM customer"


def levels(t: Tables):
    return t.orders.groupBy(F.col("o_custkey").alias("m")).agg(F.sum("o_totalprice").alias("s"))


def of_nation(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("m"))


@query(
    f"""WITH r AS (SELECT m, row_number() OVER (ORDER BY s DESC, m) AS place, count(*) OVER () AS n FROM ({LEVELS})),
w AS (SELECT k, place, n, sum((x.m IS NOT NULL)::INT) OVER (PARTITION BY k ORDER BY place ROWS UNBOUNDED PRECEDING) AS i, sum((x.m IS NOT NULL)::INT) OVER (PARTITION BY k) AS h FROM (SELECT DISTINCT k FROM ({OF_NATION})) CROSS JOIN r LEFT JOIN ({OF_NATION}) x USING (k, m)),
s AS (SELECT k, count(DISTINCT m) AS n_set FROM ({OF_NATION}) GROUP BY 1)
SELECT k, n_set, max(h)::BIGINT AS n_hits, max(n)::BIGINT AS n_ranked, coalesce(max(CASE WHEN h > 0 THEN abs(i / h - place / n) END), 0) AS es FROM w JOIN s USING (k) GROUP BY 1, 2""",
    "es",
)
def set_deviations(t: Tables):
    return setnull.deviations(levels(t), of_nation(t), "m", "s", "k")


@query()
def permuted_enrichment(t: Tables):
    return setnull.permuted_enrichment(levels(t), of_nation(t), "m", "s", "k")


MATRIX = "SELECT l_suppkey AS m, l_returnflag || '-' || l_linenumber AS s, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2"
GROUPS_OF = "SELECT s_nationkey % 5 AS k, s_suppkey AS m FROM supplier"
KERNEL = f"""WITH x AS ({MATRIX}), h AS (SELECT m, stddev_samp(v) / 4 AS h FROM x GROUP BY 1 HAVING stddev_samp(v) > 0),
z AS (SELECT a.m, a.s, (a.v - b.v) / h AS z FROM x a JOIN x b USING (m) JOIN h USING (m)),
d AS (SELECT m, s, avg(CASE WHEN z >= 0 THEN 1 - {normal_p("z")} / 2 ELSE {normal_p("z")} / 2 END) AS density FROM z GROUP BY 1, 2)"""
WALK = f"""{KERNEL},
r AS (SELECT m, s, row_number() OVER (PARTITION BY s ORDER BY round(density, 9) DESC, m) AS l, count(*) OVER (PARTITION BY s) AS p FROM d),
w AS (SELECT r.s, g.k, tau, l, p, x.m IS NOT NULL AS hit, CASE WHEN x.m IS NOT NULL THEN power(abs(p - l + 1 - p / 2.0::DOUBLE), tau) END AS w FROM r CROSS JOIN (SELECT DISTINCT k FROM ({GROUPS_OF})) g CROSS JOIN (SELECT unnest([0.25, 0.5, 1.0, 2.0])::DOUBLE AS tau) LEFT JOIN ({GROUPS_OF}) x ON x.k = g.k AND x.m = r.m),
c AS (SELECT *, count(*) FILTER (hit) OVER a AS n, coalesce(CASE WHEN sum(w) OVER a > 0 THEN coalesce(sum(w) OVER o, 0) / sum(w) OVER a ELSE count(*) FILTER (hit) OVER o / nullif(count(*) FILTER (hit) OVER a, 0) END, 0) - count(*) FILTER (NOT hit) OVER o / nullif(count(*) FILTER (NOT hit) OVER a, 0) AS y FROM w WINDOW a AS (PARTITION BY s, k, tau), o AS (PARTITION BY s, k, tau ORDER BY l ROWS UNBOUNDED PRECEDING)),
e AS (SELECT s, k, tau, greatest(0, max(y)) AS up, least(0, min(y)) AS low FROM c WHERE n > 0 AND n < p GROUP BY 1, 2, 3),
f AS (SELECT s, k, tau, true AS mx_diff, up + low AS score FROM e UNION ALL SELECT s, k, tau, false, CASE WHEN round(up + low, 9) > 0 THEN up ELSE low END FROM e)"""


def matrix(t: Tables):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("m"), F.concat("l_returnflag", F.lit("-"), "l_linenumber").alias("s")).agg(F.avg("l_quantity").alias("v"))


def groups_of(t: Tables):
    return t.supplier.select((F.col("s_nationkey") % 5).alias("k"), F.col("s_suppkey").alias("m"))


@query(f"{KERNEL} SELECT m, s, density FROM d", "density")
def kernel_density(t: Tables):
    return setnull.kernel_density(matrix(t), "s", "m", "v")


@query(f"{WALK} SELECT s, k, tau, mx_diff, score FROM f", "score")
def kernel_scores(t: Tables):
    return setnull.kernel_scores(matrix(t), groups_of(t), "s", "m", "v", "k")


@query(f"{WALK}, b AS (SELECT k, tau, mx_diff, avg(score) AS mean, stddev_pop(score) AS sd, avg(abs(score)) AS mean_abs FROM f GROUP BY 1, 2, 3) SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(mean_abs, 9) DESC, tau, mx_diff DESC) AS place FROM b QUALIFY place <= 2", "mean sd mean_abs")
def kernel_settings(t: Tables):
    return setnull.best_settings(setnull.kernel_scores(matrix(t), groups_of(t), "s", "m", "v", "k"), "s", "k")
