"""Queries of filters, column checks, texts, top rows, sets and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import schema
from quern.functions import scalar
from quern.operators import collapse, fusion, genesets, graph, joins, norm, sets, stats, topk
from quern.plans.analytics import MODELS, models
from quern.plans.registry import Tables, query

P = "(p_partkey * 7919 % 10007 + 1) / 10008.0::DOUBLE"


def p_of(key: str):
    return (F.col(key) * 7919 % 10007 + 1) / 10008.0


@query(f"SELECT * FROM (SELECT upper(trim(' ' || p_name || ' ')) AS symbol, ln(p_retailprice / 1300) / ln(2) AS lfc, {P} AS padj FROM part) WHERE abs(lfc) > 0.1 AND padj < 0.3", "lfc padj")
def differential_filter(t: Tables):
    d = t.part.select(scalar.symbol(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("symbol"), F.log2(F.col("p_retailprice") / 1300).alias("lfc"), p_of("p_partkey").alias("padj"))
    return d.where((F.abs("lfc") > 0.1) & (F.col("padj") < 0.3))


def holes(t: Tables):
    """x has nulls, y NaN and infinities, label the texts of missing values."""
    x, y = F.when(F.col("p_size") % 7 != 0, F.col("p_size")), F.when(F.col("p_size") % 5 == 0, float("nan")).when(F.col("p_size") % 11 == 0, float("inf")).otherwise(F.col("p_retailprice"))
    return t.part.select("p_partkey", x.alias("x"), y.alias("y"), F.when(F.col("p_size") % 3 == 0, "---").when(F.col("p_size") % 4 == 0, " NA ").otherwise(F.col("p_brand")).alias("label"))


@query("SELECT p_partkey, p_size AS x FROM part WHERE p_size % 7 <> 0 AND p_size % 5 <> 0")
def complete_cases(t: Tables):
    return schema.complete_cases(holes(t), ["x", "y"]).select("p_partkey", "x")


@query("SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size::DOUBLE END AS x, CASE WHEN p_size % 5 <> 0 AND p_size % 11 <> 0 THEN p_retailprice END AS y, CASE WHEN p_size % 3 <> 0 AND p_size % 4 <> 0 THEN p_brand END AS label FROM part")
def missing_values(t: Tables):
    return schema.missing_to_null(holes(t)).withColumn("x", F.col("x").cast("double"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 1 AND 50")
def expectations(t: Tables):
    return schema.expect(schema.require_columns(t.part, ["p_partkey", "p_size"]), size=F.col("p_size").between(1, 50), price=F.col("p_retailprice") > 0).select("p_partkey", "p_size", "p_retailprice")


@query("SELECT unnest(['economy', 'brass', 'word']) AS label, unnest([avg(regexp_matches(p_type, '^ECONOMY')::INT), avg(regexp_matches(p_type, 'BRASS$')::INT), avg(regexp_matches(p_type, '^[A-Z ]+$')::INT)]) AS share FROM part", "share")
def identifier_kinds(t: Tables):
    return schema.looks_like(t.part, "p_type", {"economy": "^ECONOMY", "brass": "BRASS$", "word": "^[A-Z ]+$"})


@query("SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS' THEN 'brass' WHEN p_retailprice > 1300 THEN 'dear' WHEN p_size < 20 THEN 'small' ELSE 'other' END AS label FROM part")
def later_rules_override(t: Tables):
    rules = [(F.col("p_size") < 20, "small"), (F.col("p_retailprice") > 1300, "dear"), (F.endswith("p_type", F.lit("BRASS")), "brass")]
    return t.part.select("p_partkey", scalar.overridden(F.lit("other"), rules).alias("label"))


def measures(t: Tables):
    return t.lineitem.select(F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), (F.col("l_quantity") * 2 + F.col("l_tax")).alias("c"), (F.col("l_quantity") + 1e-9).alias("d"), F.lit(3.0).alias("e"))


def means_of(df):
    """name and mean of the columns that are left."""
    return collapse.unpivot(df.agg(*[F.avg(c).alias(c) for c in df.columns]), [], df.columns, "name", "mean")


MEASURES = "(SELECT l_quantity AS a, l_discount AS b, l_quantity * 2 + l_tax AS c, l_quantity + 1e-9 AS d, 3.0::DOUBLE AS e FROM lineitem)"


@query(f"WITH s AS (SELECT [avg(a), avg(b), avg(c), avg(d), avg(e)] AS m, [var_pop(a), var_pop(b), var_pop(c), var_pop(d), var_pop(e)] AS v FROM {MEASURES}), u AS (SELECT unnest(['a', 'b', 'c', 'd', 'e']) AS name, unnest(m) AS mean, unnest(v) AS v FROM s) SELECT name, mean FROM u WHERE v > 0", "mean")
def constant_columns(t: Tables):
    return means_of(schema.drop_constant_columns(measures(t), list("abcde")))


@query(f"SELECT 'd' AS name, 'a' AS same_as FROM {MEASURES} HAVING bool_and(round(a, 6) = round(d, 6))")
def repeated_columns(t: Tables):
    found = schema.duplicate_columns(measures(t), list("abcde"))
    return t.spark.createDataFrame(list(found.items()), "name string, same_as string")


@query(f"WITH s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, abs(corr(a, b)) AS ab, abs(corr(a, c)) AS ac, abs(corr(b, c)) AS bc, var_pop(a) AS va, var_pop(c) AS vc FROM {MEASURES}) SELECT 'b' AS name, mb AS mean FROM s WHERE ab < 0.95 AND bc < 0.95 UNION ALL SELECT CASE WHEN va < vc THEN 'c' ELSE 'a' END, CASE WHEN va < vc THEN mc ELSE ma END FROM s WHERE ac > 0.95", "mean")
def correlated_columns(t: Tables):
    return means_of(schema.drop_correlated_columns(measures(t).select("a", "b", "c"), ["a", "b", "c"]))


@query("WITH c AS (SELECT l_orderkey AS cell, count(*) FILTER (l_quantity > 10) AS n_genes, sum(CASE WHEN l_partkey % 10 = 0 THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice) AS mito_share FROM lineitem GROUP BY 1) SELECT * FROM c WHERE n_genes BETWEEN 2 AND 5 AND mito_share <= 0.2", "mito_share")
def cell_quality(t: Tables):
    d = t.lineitem.select(F.col("l_orderkey").alias("cell"), F.concat(F.when(F.col("l_partkey") % 10 == 0, "MT-").otherwise("G"), "l_partkey").alias("gene"), "l_quantity", "l_extendedprice")
    seen = d.groupBy("cell").agg(F.count_if(F.col("l_quantity") > 10).alias("n_genes"))
    return collapse.cell_quality(d, "cell", "gene", "l_extendedprice", "MT-", 0, 1000, 0.2).drop("n_genes").join(seen, "cell").where(F.col("n_genes").between(2, 5))


@query("SELECT l_suppkey AS g, count(*) AS n, sum(l_discount) AS total FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1 HAVING max(abs(l_discount)) > 0", "total")
def nonzero_rows(t: Tables):
    d = t.lineitem.select(F.col("l_suppkey").alias("g"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_discount")).otherwise(0.0).alias("v"))
    return collapse.drop_all_zero(d, "g", "v").groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


TITLE = "array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_type, ' ')], ' ')"


@query(f"WITH n AS (SELECT CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) WHEN 2 THEN upper(p_type) ELSE {TITLE} END AS name, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1) SELECT p_partkey, coalesce(a.name, b.name, c.name, d.name) AS matched, coalesce(a.n, b.n, c.n, d.n) AS n FROM part LEFT JOIN n a ON a.name = p_type LEFT JOIN n b ON b.name = lower(p_type) LEFT JOIN n c ON c.name = upper(p_type) LEFT JOIN n d ON d.name = {TITLE} WHERE coalesce(a.n, b.n, c.n, d.n) IS NOT NULL")
def case_fallback(t: Tables):
    n = t.part.where("p_size > 25").groupBy(F.when(F.col("p_size") % 4 == 0, F.col("p_type")).when(F.col("p_size") % 4 == 1, F.lower("p_type")).when(F.col("p_size") % 4 == 2, F.upper("p_type")).otherwise(F.initcap("p_type")).alias("name")).agg(F.count("*").alias("n"))
    return joins.match_case(t.part.select("p_partkey", "p_type"), "p_type", n, "name").select("p_partkey", "matched", "n")


@query("SELECT l_orderkey || ':' || l_linenumber AS line, CASE WHEN l_partkey::VARCHAR < l_suppkey::VARCHAR THEN l_partkey || '_' || l_suppkey ELSE l_suppkey || '_' || l_partkey END AS pair FROM lineitem")
def keys_of_lines(t: Tables):
    return t.lineitem.select(scalar.composite_key("l_orderkey", "l_linenumber").alias("line"), scalar.pair_key("l_partkey", "l_suppkey").alias("pair"))


@query(f"SELECT p_partkey, p_size / 100.0::DOUBLE AS low, p_size / 50.0::DOUBLE AS high, format('{{:,.3f}}', p_retailprice * 10) AS price, exp(p_size / 50.0::DOUBLE - 0.5) AS odds_ratio, exp(p_size / 50.0::DOUBLE - 0.5 - 1.96 * 0.1) AS ci_low, exp(p_size / 50.0::DOUBLE - 0.5 + 1.96 * 0.1) AS ci_high, -log10({P}) * sign(p_size - 25) AS signed, -log10({P}) * (p_size - 25) AS weighted, p_size::DOUBLE AS hours, translate(p_alleles, 'ACGT', 'TGCA') AS complement FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'CG' ELSE 'T' END AS p_alleles FROM part)", "low high odds_ratio ci_low ci_high signed weighted hours")
def text_numbers(t: Tables):
    d = t.part.withColumn("ci", F.format_string("(%.2f-%.2f)", F.col("p_size") / 100, F.col("p_size") / 50)).withColumn("b", F.col("p_size") / 50 - 0.5).withColumn("s", F.lit(0.1)).withColumn("p", p_of("p_partkey")).withColumn("fc", (F.col("p_size") - 25).cast("double"))
    d = d.withColumn("x", F.col("p_retailprice") * 10).withColumn("hr", F.concat("p_size", F.lit("hr"))).withColumn("al", F.lower(F.when(F.col("p_size") % 3 == 0, "A").when(F.col("p_size") % 3 == 1, "CG").otherwise("T")))
    low, high = scalar.confidence_interval("ci")
    return d.select("p_partkey", low.alias("low"), high.alias("high"), scalar.formatted("x").alias("price"), *scalar.odds_ratio("b", "s"), scalar.signed_log_p("p", "fc").alias("signed"), scalar.weighted_log_p("p", "fc").alias("weighted"), schema.number(F.regexp_replace("hr", "hr$", "")).alias("hours"), scalar.complement(F.col("al")).alias("complement"))


@query("SELECT p_partkey, log2(CASE WHEN p_size > 10 THEN p_retailprice ELSE min(CASE WHEN p_size > 10 THEN p_retailprice END) OVER (PARTITION BY p_brand) END) AS x FROM part", "x")
def safe_log2(t: Tables):
    d = t.part.select("p_partkey", "p_brand", F.when(F.col("p_size") > 10, F.col("p_retailprice")).otherwise(-1.0 * F.col("p_size")).alias("v"))
    return norm.safe_log2(d, "v", ["p_brand"], "x").select("p_partkey", "x")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS rank FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25")
def top_rows(t: Tables):
    best = topk.top(t.orders, 25, ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"])
    return topk.rank_column(best, ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "o_totalprice", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_custkey, o_orderkey, o_totalprice - 150000 AS v FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY abs(o_totalprice - 150000) DESC, o_orderkey) = 1", "v:2")
def strongest_per_key(t: Tables):
    return topk.strongest_per_key(t.orders.withColumn("v", F.col("o_totalprice") - 150000), ["o_custkey"], "v", ["o_orderkey"]).select("o_custkey", "o_orderkey", "v")


@query("WITH h AS (SELECT event_type, hour(ts)::INT AS h, avg(value) AS m FROM events GROUP BY 1, 2) SELECT event_type, h, m FROM h QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY m DESC, h) = 1", "m")
def peak_hour(t: Tables):
    h = t.events.groupBy("event_type", F.hour("ts").alias("h")).agg(F.avg("value").alias("m"))
    return topk.top_per_group(h, ["event_type"], [F.desc("m"), "h"])


@query("SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def union_columns(t: Tables):
    return sets.union([t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))])


@query("SELECT l_partkey, l_suppkey, CASE min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) WHEN 1 THEN 'R' WHEN 2 THEN 'A' ELSE 'N' END AS source, count(*) AS n_sources FROM lineitem GROUP BY 1, 2")
def first_source(t: Tables):
    e = t.lineitem.select("l_partkey", "l_suppkey", F.col("l_returnflag").alias("source"), F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3).alias("_p"))
    return sets.first_source(e, ["l_partkey", "l_suppkey"], "source", "_p")


@query("WITH f AS (SELECT l_partkey AS k, l_returnflag AS f, max(l_discount) AS s FROM lineitem GROUP BY 1, 2) SELECT k, 0.4 * coalesce(max(s) FILTER (f = 'R'), 0) + 0.3 * coalesce(max(s) FILTER (f = 'A'), 0) + 0.3 * coalesce(max(s) FILTER (f = 'N'), 0) AS combined, count(DISTINCT f)::INT AS coverage FROM f GROUP BY 1", "combined")
def weighted_best(t: Tables):
    frames = [t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"), F.col("l_discount").alias("s")) for f in "RAN"]
    return collapse.weighted_best(frames, "k", "s", (0.4, 0.3, 0.3))


@query("WITH f AS (SELECT l_partkey AS k, l_returnflag AS f, max(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2) SELECT k, array_to_string(list_sort(list(f)), '|') AS sources, count(*) AS n_sources, max(s) AS best, first(f ORDER BY s DESC, f DESC) AS best_source FROM f GROUP BY 1 HAVING count(*) >= 3", "best:2")
def best_source(t: Tables):
    return collapse.supported(t.lineitem.withColumnRenamed("l_partkey", "k"), "k", "l_returnflag", "l_extendedprice", 3)


@query("SELECT user_id, ln(1 + count(*) FILTER (event_type = 'click')) AS log_click, ln(1 + count(*) FILTER (event_type IN ('view', 'purchase'))) AS log_seen, ln(1 + count(*)) AS log_all, ln(1 + count(DISTINCT props)) AS log_papers, count(*) FILTER (event_type = 'click') / count(*) AS share_click, count(*) FILTER (event_type IN ('view', 'purchase')) / count(*) AS share_seen FROM events GROUP BY 1", "log_click log_seen log_all log_papers share_click share_seen")
def action_profile(t: Tables):
    return collapse.action_profile(t.events, "user_id", "event_type", {"click": ["click"], "seen": ["view", "purchase"]}, "props")


@query("WITH s AS (SELECT DISTINCT s_nationkey AS s, l_partkey % 97 AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), n AS (SELECT s, count(*) AS n FROM s GROUP BY 1) SELECT x.s AS a, y.s AS b, any_value(p.n) AS n_a, any_value(q.n) AS n_b, count(*) AS shared, count(*) / (any_value(p.n) + any_value(q.n) - count(*)) AS jaccard FROM s x JOIN s y ON x.m = y.m AND x.s < y.s JOIN n p ON p.s = x.s JOIN n q ON q.s = y.s GROUP BY 1, 2", "jaccard")
def set_overlaps(t: Tables):
    s = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("s"), (F.col("l_partkey") % 97).alias("m"))
    return sets.overlaps(s, "s", "m")


@query("WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS l, b.vec_id AS r, list_dot_product(a.v, b.v) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0) SELECT l, r, score, dense_rank() OVER (PARTITION BY l ORDER BY score DESC)::INT AS rank FROM p QUALIFY dense_rank() OVER (PARTITION BY l ORDER BY score DESC) <= 3", "score")
def pair_scores(t: Tables):
    left, right = t.embeddings.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "l"), t.embeddings.where("vec_id % 5 <> 0").withColumnRenamed("vec_id", "r")
    return fusion.pair_scores(left, right, ["label"], "embedding", "l", "r", 3)


PRIORITIES = "SELECT o_custkey AS u, o_orderpriority AS g, round_even(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2"


def priorities(t: Tables):
    return t.orders.groupBy(F.col("o_custkey").alias("u"), F.col("o_orderpriority").alias("g")).agg(F.bround(F.sum("o_totalprice"), 2).alias("v"))


@query(f"WITH v AS ({PRIORITIES}), r AS (SELECT x.g AS a, y.g AS b, corr(x.v, y.v) AS r FROM v x JOIN v y ON x.u = y.u AND x.g < y.g GROUP BY 1, 2 HAVING count(*) >= 3) SELECT a, b, r, a[1]::INT // 3 AS a_module, b[1]::INT // 3 AS b_module FROM r WHERE abs(r) > 0.001 AND a[1]::INT // 3 <> b[1]::INT // 3", "r")
def cross_module(t: Tables):
    r = stats.correlations(priorities(t), "u", "g", "v")
    modules = t.orders.select(F.col("o_orderpriority").alias("g")).distinct().withColumn("m", F.floor(F.substring("g", 1, 1).cast("int") / 3).cast("int"))
    return graph.cross_module(r, modules, "a", "b", "r", "g", "m", 0.001)


@query("SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS BUILDING, (c_mktsegment = 'MACHINERY')::INT AS MACHINERY FROM customer")
def one_hot(t: Tables):
    return collapse.one_hot(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY"])


@query(f"WITH r AS (SELECT model, m, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2.0::DOUBLE AS r FROM ({MODELS})), c AS (SELECT corr(x.r, y.r) AS c FROM r x JOIN r y ON x.m = y.m AND x.model < y.model GROUP BY x.model, y.model) SELECT count(*) AS n_pairs, avg(c) AS stability FROM c", "stability")
def rank_stability(t: Tables):
    return genesets.rank_stability(models(t), "model", "m", "s")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 <> 0 AND l_suppkey % 2 = 0 THEN 'transductive' ELSE 'inductive' END AS eval_mode FROM lineitem")
def known_split(t: Tables):
    parts = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    known = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return joins.split_known(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), {"l_partkey": parts, "l_suppkey": known}).select("l_orderkey", "l_linenumber", "eval_mode")


@query(f"WITH n AS (SELECT x.m, x.s * y.s AS score FROM ({MODELS}) x JOIN ({MODELS}) y ON x.m = y.m AND x.model = 'count' AND y.model = 'balance') SELECT m, score FROM n", "score:2")
def product_scores(t: Tables):
    s = models(t)
    return fusion.product_scores(s.where("model = 'count'"), s.where("model = 'balance'"), ["m"], "s")


@query("SELECT l_suppkey, avg(l_discount) AS mean, stddev_pop(l_discount) AS sd, count(l_discount) AS n FROM lineitem GROUP BY 1", "mean sd")
def run_average(t: Tables):
    return fusion.run_average(t.lineitem, ["l_suppkey"], "l_discount")


RANKS = f"SELECT m, (rank() OVER (PARTITION BY model ORDER BY s DESC) + (count(*) OVER (PARTITION BY model, s) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY model) AS u FROM ({MODELS})"


@query(f"WITH r AS ({RANKS}), i AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY u) AS i, count(*) OVER (PARTITION BY m) AS n FROM r) SELECT m, n, max(greatest(i / n - u, u - (i - 1) / n)) AS d FROM i GROUP BY 1, 2", "d")
def rank_uniformity(t: Tables):
    return fusion.rank_uniformity(models(t), "model", "m", "s")


@query(f"WITH r AS ({RANKS}), i AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY u) AS i, count(*) OVER (PARTITION BY m) AS n FROM r) SELECT m, least(1, min(list_sum([gamma(n + 1) / gamma(j + 1) / gamma(n - j + 1) * power(u, j) * power(1 - u, n - j) for j in range(i, n + 1)])) * any_value(n)) AS rho FROM i GROUP BY 1", "rho")
def rho_scores(t: Tables):
    return fusion.rho_scores(models(t), "model", "m", "s")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def anti_dear_orders(t: Tables):
    dear = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.keep_keys(t.customer, dear, ["c_custkey"], negate=True).select("c_custkey", "c_name")


@query("SELECT l_partkey FROM lineitem EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 49")
def rest_of_parts(t: Tables):
    return sets.difference(t.lineitem, t.lineitem.where("l_quantity >= 49"), ["l_partkey"])


NESTED = "SELECT DISTINCT k AS s, l_partkey AS m FROM lineitem, (SELECT unnest([20, 40, 47, 50]) AS k) WHERE l_quantity >= k"


@query(f"WITH s AS ({NESTED}), n AS (SELECT s, count(*) AS n FROM s GROUP BY 1), o AS (SELECT x.s AS a, y.s AS b, count(*) AS k FROM s x JOIN s y ON x.m = y.m AND x.s <> y.s GROUP BY 1, 2) SELECT a AS child, b AS parent, k AS shared FROM o JOIN n x ON o.a = x.s JOIN n y ON o.b = y.s WHERE k / x.n::DOUBLE > 0.9 AND k / y.n::DOUBLE < 0.9")
def nested_sets(t: Tables):
    s = t.lineitem.withColumn("s", F.explode(F.array(*[F.lit(k) for k in (20, 40, 47, 50)]))).where("l_quantity >= s").select("s", F.col("l_partkey").alias("m")).distinct()
    return sets.containment(s, "s", "m")


@query("SELECT a.o_orderkey AS at_order, b.o_orderkey AS span_order FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate > b.o_orderdate AND a.o_orderdate <= b.o_orderdate + INTERVAL 30 DAY")
def orders_within_a_month(t: Tables):
    day = 86_400_000
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at"))
    spans = o.select(F.col("o_orderkey").alias("span_order"), "k", (F.col("at") + 1).alias("low"), (F.col("at") + 30 * day).alias("high"))
    return joins.in_range(o.withColumnRenamed("o_orderkey", "at_order"), "at", spans, "low", "high", 30 * day, ["k"]).select("at_order", "span_order")
