"""Queries of scans, projections, joins, aggregates, windows, top-k and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scalar
from quern.operators import collapse, genesets, intervals, joins, norm, ranks, sets, topk
from quern.plans.registry import Tables, query
from quern.schema import quality_report, resolve_columns

YEARLY = "SELECT year(l_shipdate)::INT AS sample, l_partkey AS gene, round_even(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2"


def yearly(t: Tables):
    """value of each part (gene) in each year (sample), to the cent."""
    return t.lineitem.groupBy(F.year("l_shipdate").alias("sample"), F.col("l_partkey").alias("gene")).agg(F.bround(F.sum("l_extendedprice"), 2).alias("value"))


RANKSUM = f"""
WITH e AS ({YEARLY}),
r AS (SELECT sample, gene, rank() OVER (PARTITION BY sample ORDER BY value) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2.0::DOUBLE AS r FROM e),
a AS (SELECT sample, count(*) AS n, count(*) FILTER (p_type LIKE 'ECONOMY%') AS n1, sum(CASE WHEN p_type LIKE 'ECONOMY%' THEN r ELSE 0 END) AS s1,
             count(*) FILTER (p_size <= 10) AS n2, sum(CASE WHEN p_size <= 10 THEN r ELSE 0 END) AS s2
      FROM r JOIN part ON gene = p_partkey GROUP BY sample)
SELECT sample, coalesce((s1 - n1 * (n + 1) / 2) / nullif(n1 * (n - n1) / 2.0::DOUBLE, 0), 0) AS economy, coalesce((s2 - n2 * (n + 1) / 2) / nullif(n2 * (n - n2) / 2.0::DOUBLE, 0), 0) AS small FROM a
"""


def rank_sums(t: Tables):
    genes = t.part.select(F.col("p_partkey").alias("gene"), "p_type", "p_size")
    expr = yearly(t).join(genes, "gene")
    return genesets.rank_sum_scores(expr, "sample", "gene", "value", {"economy": F.startswith("p_type", F.lit("ECONOMY")), "small": F.col("p_size") <= 10})


@query(RANKSUM, "economy small")
def ranksum_enrichment(t: Tables):
    return rank_sums(t)


@query(f"WITH s AS ({RANKSUM}), z AS (SELECT *, coalesce((economy - avg(economy) OVER ()) / nullif(stddev_samp(economy) OVER (), 0), 0) AS z1, coalesce((small - avg(small) OVER ()) / nullif(stddev_samp(small) OVER (), 0), 0) AS z2 FROM s) SELECT *, z1 + z2 - abs(z1 - z2) AS coactivation FROM z", "economy small z1 z2 coactivation")
def coactivation_index(t: Tables):
    return genesets.coactivation(rank_sums(t), "economy", "small")


for how, f in {"max": "max", "median": "median", "mean": "avg", "sum": "sum"}.items():

    @query(f"SELECT p_brand, year(l_shipdate)::INT AS y, {f}(round(l_extendedprice * 100)::BIGINT)::DOUBLE AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2", "value:5", f"collapse_{how}")
    def _collapse(t: Tables, how=how):
        rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", F.year("l_shipdate").alias("y"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"))
        return collapse.collapse(rows, ["p_brand", "y"], "value", how)


@query(f"WITH e AS (SELECT e.*, p_brand FROM ({YEARLY}) e JOIN part ON gene = p_partkey), m AS (SELECT p_brand, gene, row_number() OVER (PARTITION BY p_brand ORDER BY round(avg(value), 6) DESC, gene) AS i FROM e GROUP BY 1, 2) SELECT e.p_brand, e.gene, e.sample, e.value FROM e JOIN m USING (p_brand, gene) WHERE i = 1", "value:2")
def collapse_best_mean(t: Tables):
    e = yearly(t).join(t.part.select(F.col("p_partkey").alias("gene"), "p_brand"), "gene")
    return collapse.collapse_to_best(e, "gene", "p_brand", "sample", "value").select("p_brand", "gene", "sample", "value")


@query("SELECT o_orderkey AS id, o_totalprice AS amount, 31684 AS samplesize FROM orders", "amount")
def resolve_columns_cast(t: Tables):
    return resolve_columns(t.orders, {"id": ["ORDER_ID", "O_ORDERKEY"], "amount": ["total", "o_totalprice"], "samplesize": ["n"]}, {"samplesize": 31684})


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE abs(l_discount) > 0.05 AND l_tax < 0.03", "l_discount l_tax")
def threshold_filter(t: Tables):
    return t.lineitem.where((F.abs("l_discount") > 0.05) & (F.col("l_tax") < 0.03)).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'copyright')")
def keyword_any(t: Tables):
    return t.documents.where(scalar.contains_any("text", ["License", "copyright"])).select("doc_id", "source")


@query("SELECT p_partkey, p_type LIKE 'ECONOMY_%' OR p_type LIKE 'PROMO_%' AS family FROM part")
def prefix_family(t: Tables):
    return t.part.select("p_partkey", scalar.of_family("p_type", ["ECONOMY", "PROMO"]).alias("family"))


@query("SELECT p_partkey, CASE WHEN p_retailprice >= 1500 THEN 'high' WHEN p_retailprice >= 1200 THEN 'mid' ELSE 'low' END AS band, upper(trim(p_brand)) AS brand, split_part(p_type, ' ', 1) AS kind, least(2.0::DOUBLE, greatest(0.5::DOUBLE, p_retailprice / 1000)) AS clipped, ln(1 + p_retailprice) AS log_price FROM part", "clipped log_price")
def scalar_projections(t: Tables):
    price = F.col("p_retailprice")
    return t.part.select("p_partkey", F.when(price >= 1500, "high").when(price >= 1200, "mid").otherwise("low").alias("band"), scalar.symbol("p_brand").alias("brand"), scalar.first_part("p_type", " ").alias("kind"), scalar.clip(price / 1000, 0.5, 2.0).alias("clipped"), F.log1p(price).alias("log_price"))


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey", "o_totalprice")
def inner_join(t: Tables):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey", "total:2")
def left_enrich(t: Tables):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left").na.fill(0, ["n"]).na.fill(0.0, ["total"])


@query("SELECT DISTINCT c_nationkey AS a, s_nationkey AS b, x.n_name AS a_n_name, y.n_name AS b_n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation x ON x.n_nationkey = c_nationkey LEFT JOIN nation y ON y.n_nationkey = s_nationkey")
def two_alias_self_join(t: Tables):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = o.select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).distinct()
    return joins.annotate_ends(edges, "a", "b", t.nation, "n_nationkey", ["n_name"]).select("a", "b", "a_n_name", "b_n_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_keys(t: Tables):
    keys = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return joins.keep_keys(t.orders, keys, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_keys(t: Tables):
    return joins.keep_keys(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], negate=True).select("c_custkey", "c_name")


@query("WITH p AS (SELECT l_suppkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), q AS (SELECT l_suppkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45 GROUP BY 1) SELECT k, p.v AS left_v, q.v AS right_v, CASE WHEN p.v IS NULL THEN 'right' WHEN q.v IS NULL THEN 'left' ELSE 'both' END AS side FROM p FULL JOIN q USING (k)", "left_v right_v")
def full_compare(t: Tables):
    part = lambda c: t.lineitem.where(c).groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    return joins.compare(part("l_returnflag = 'R'"), part("l_returnflag = 'A' and l_quantity > 45"), ["k"], "v")


@query("WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders), l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS i FROM lineitem) SELECT o_custkey, o_orderkey, l_partkey FROM o JOIN l ON o_orderkey = l_orderkey WHERE o.i = 1 AND l.i = 1")
def dedup_then_join(t: Tables):
    o = topk.first_per_key(t.orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"])
    l = topk.first_per_key(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"])
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "l_partkey")


for last, word in ((False, "first"), (True, "last")):
    order = "o_orderdate, o_orderkey" if not last else "o_orderdate DESC, o_orderkey DESC"

    @query(f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {order}) AS i FROM orders) ON c_custkey = o_custkey AND i = 1", name=f"{word}_match_lookup")
    def _lookup(t: Tables, last=last):
        return joins.lookup(t.customer.select("c_custkey"), t.orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], ["o_orderdate", "o_orderkey"], last).select("c_custkey", "o_orderkey")


@query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def explode_one_to_many(t: Tables):
    return joins.expand(t.part, "p_type", " ", "word").select("p_partkey", "word")


SETS = "SELECT DISTINCT l_suppkey AS s, p_type AS m FROM lineitem JOIN part ON l_partkey = p_partkey"


def type_sets(t: Tables):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("s"), F.col("p_type").alias("m")).distinct()


@query(f"WITH s AS ({SETS}), n AS (SELECT s, count(*) AS n FROM s GROUP BY 1), o AS (SELECT x.s AS a, y.s AS b, count(*) AS k FROM s x JOIN s y ON x.m = y.m AND x.s <> y.s GROUP BY 1, 2) SELECT a AS child, b AS parent, k AS shared FROM o JOIN n x ON o.a = x.s JOIN n y ON o.b = y.s WHERE k / x.n::DOUBLE > 0.9 AND k / y.n::DOUBLE < 0.9")
def containment_pairs(t: Tables):
    return sets.containment(type_sets(t), "s", "m")


@query("WITH s AS (SELECT o_orderpriority AS s, c_nationkey AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT m FROM s GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT s) FROM s)")
def nway_intersection(t: Tables):
    s = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("s"), F.col("c_nationkey").alias("m"))
    return sets.intersection(s, "s", "m")


@query("WITH s AS (SELECT DISTINCT l_returnflag AS s, l_partkey AS m FROM lineitem), p AS (SELECT m, string_agg(s, '|' ORDER BY s) AS sets FROM s GROUP BY 1) SELECT sets, count(*) AS n_members FROM p GROUP BY 1")
def membership_patterns(t: Tables):
    return sets.membership_counts(t.lineitem.select(F.col("l_returnflag").alias("s"), F.col("l_partkey").alias("m")), "s", "m")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(t: Tables):
    return sets.difference(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t: Tables):
    return sets.union([t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))], ["k"])


@query(f"WITH e AS ({YEARLY}), b AS (SELECT sample, gene FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value DESC, gene) AS i FROM e) WHERE i <= 50), s AS (SELECT x.sample AS a, y.sample AS b, count(*) AS k FROM b x JOIN b y ON x.gene = y.gene AND x.sample < y.sample GROUP BY 1, 2), n AS (SELECT sample, count(*) AS n FROM b GROUP BY 1), c AS (SELECT count(*) AS c FROM n) SELECT sum(k / (x.n + y.n - k)::DOUBLE) * 2 / (any_value(c) * (any_value(c) - 1)) AS mean_jaccard FROM s JOIN n x ON s.a = x.sample JOIN n y ON s.b = y.sample, c", "mean_jaccard")
def jaccard_topk(t: Tables):
    return sets.mean_jaccard_of_tops(yearly(t), "sample", "gene", "value", 50)


@query("SELECT DISTINCT least(x, y) AS x, greatest(x, y) AS y FROM (SELECT c_nationkey AS x, s_nationkey AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey) WHERE x <> y")
def undirected_dedup(t: Tables):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    return sets.undirected(o.select(F.col("c_nationkey").alias("x"), F.col("s_nationkey").alias("y")), "x", "y")


@query("WITH e AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS s FROM events), f AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) < 86400 THEN 0 ELSE 1 END AS new FROM e), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s RANGE UNBOUNDED PRECEDING) AS island FROM f) SELECT user_id, min(s)::DOUBLE AS start, max(s)::DOUBLE AS stop, count(*) AS n_rows FROM i GROUP BY user_id, island", "start stop")
def islands(t: Tables):
    e = t.events.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("s"))
    return intervals.islands(e, "s", 86400, ["user_id"])


@query("SELECT event_id, o_orderkey FROM events JOIN orders ON user_id = o_custkey AND ts >= o_orderdate AND ts <= o_orderdate + INTERVAL 30 DAY")
def bin_range_join(t: Tables):
    e = t.events.select("event_id", F.col("user_id").alias("k"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("low"))
    day = 86_400_000
    return joins.in_range(e, "at", o.withColumn("high", F.col("low") + 30 * day), "low", "high", 30 * day, ["k"]).select("event_id", "o_orderkey")


@query("SELECT l_suppkey, avg(l_discount) AS mean, min(l_tax) AS least, count(DISTINCT l_partkey) AS parts, max(l_extendedprice) AS most FROM lineitem GROUP BY 1", "mean least most")
def agg_mixed(t: Tables):
    return t.lineitem.groupBy("l_suppkey").agg(F.avg("l_discount").alias("mean"), F.min("l_tax").alias("least"), F.countDistinct("l_partkey").alias("parts"), F.max("l_extendedprice").alias("most"))


@query("SELECT event_type, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS sd, max(value) AS most, count(value) AS n FROM events GROUP BY 1", "mean median sd most")
def group_summary(t: Tables):
    return collapse.summary(t.events, ["event_type"], "value")


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS names, count(DISTINCT o_orderpriority)::INT AS n_names FROM orders GROUP BY 1")
def sorted_set_string(t: Tables):
    return collapse.joined_names(t.orders, ["o_custkey"], "o_orderpriority")


@query("SELECT l_partkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS sources, count(DISTINCT l_returnflag) AS n_sources, max(l_extendedprice) AS best, arg_max(l_returnflag, {'a': l_extendedprice, 'b': l_returnflag}) AS best_source FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) >= 2", "best")
def having_distinct(t: Tables):
    return collapse.supported(t.lineitem, "l_partkey", "l_returnflag", "l_extendedprice")


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (o_orderpriority = '5-LOW') AS \"5-LOW\" FROM orders GROUP BY 1")
def crosstab(t: Tables):
    return collapse.crosstab(t.orders, "o_orderstatus", "o_orderpriority", ["1-URGENT", "5-LOW"])


@query("SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'O') AS \"O\", sum(l_quantity) FILTER (l_linestatus = 'F') AS \"F\" FROM lineitem GROUP BY 1", "O F")
def pivot_sum(t: Tables):
    return collapse.pivot(t.lineitem, "l_returnflag", "l_linestatus", ["O", "F"], "l_quantity")


@query("SELECT l_orderkey, l_linenumber, 'l_discount' AS name, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem", "value")
def melt(t: Tables):
    return collapse.unpivot(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(t: Tables):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query(
    "WITH b AS (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS least, max(value) AS most, ln(1 + count(value)) AS log_n, median(value) AS median, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1), "
    "j AS (SELECT * FROM events JOIN b USING (event_type) WHERE value IS NOT NULL), "
    "m AS (SELECT event_type, avg(abs(value - mean)) AS mad, avg(CASE WHEN value < mean - sd THEN 1.0 ELSE 0 END) AS low_tail, avg(CASE WHEN value > mean + sd THEN 1.0 ELSE 0 END) AS high_tail, avg(power(value - mean, 3)) / any_value(power(sd, 3)) AS skewness, avg(power(value - mean, 4)) / any_value(power(sd, 4)) - 3 AS kurtosis FROM j GROUP BY 1), "
    "c AS (SELECT event_type, least(floor((value - least) / (most - least) * 10), 9) AS b, count(*) / any_value(n)::DOUBLE AS p FROM j GROUP BY 1, 2), h AS (SELECT event_type, -sum(p * ln(p)) AS entropy FROM c GROUP BY 1) "
    "SELECT event_type, mean, sd, least, most, log_n, median, most - least AS spread, skewness, kurtosis, q1, q3, n, q3 - q1 AS iqr, sd / abs(mean) AS cv, mad, low_tail, high_tail, entropy FROM b JOIN m USING (event_type) JOIN h USING (event_type)",
    "mean sd least most log_n median spread skewness kurtosis q1 q3 iqr cv mad low_tail high_tail entropy",
)
def distribution_profile(t: Tables):
    return collapse.distribution_profile(t.events, ["event_type"], "value")


@query("WITH r AS (SELECT year(l_shipdate)::INT AS y, l_returnflag AS kind, l_orderkey AS cell, l_partkey AS gene, l_quantity AS v FROM lineitem), c AS (SELECT y, kind FROM r GROUP BY 1, 2 HAVING count(DISTINCT cell) >= 3), g AS (SELECT y, kind, gene, sum(v) AS total FROM r JOIN c USING (y, kind) GROUP BY 1, 2, 3) SELECT *, ln(1 + total * 1e6 / sum(total) OVER (PARTITION BY y, kind)) AS log_cpm FROM g", "total log_cpm")
def pseudobulk_cpm_log(t: Tables):
    r = t.lineitem.select(F.year("l_shipdate").alias("y"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("v"))
    return collapse.pseudobulk(r, "y", "kind", "cell", "gene", "v")


@query("WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2) SELECT label, (i - 1)::INT AS i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m", "x")
def mean_embedding(t: Tables):
    return collapse.mean_vector(t.embeddings, ["label"], "embedding").select("label", F.posexplode("embedding").alias("i", "x"))


@query("WITH m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1), s AS (SELECT vec_id, e.label, list_cosine_similarity(embedding::DOUBLE[], c) AS cosine FROM embeddings e JOIN c USING (label)) SELECT vec_id, label, cosine FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(cosine, 9) DESC, vec_id) AS i FROM s) WHERE i <= 5", "cosine")
def cosine_topk(t: Tables):
    centre = collapse.mean_vector(t.embeddings, ["label"], "embedding", normalise=False).withColumnRenamed("embedding", "centre")
    s = t.embeddings.join(centre, "label").select("vec_id", "label", scalar.cosine("embedding", "centre").alias("cosine"))
    return topk.top_per_group(s, ["label"], [F.desc(F.round("cosine", 9)), "vec_id"], 5)


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS i FROM lineitem) WHERE i <= 50")
def top50_per_group(t: Tables):
    return topk.top_per_group(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 50).select("l_suppkey", "l_orderkey", "l_linenumber")


for method, f in {"average": "rank() OVER w + (count(*) OVER (PARTITION BY o_orderstatus, o_orderdate) - 1) / 2.0::DOUBLE", "min": "(rank() OVER w)::INT", "dense": "(dense_rank() OVER w)::INT", "ordinal": "(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey))::INT"}.items():

    @query(f"SELECT o_orderkey, {f} AS r FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate)", "r" if method == "average" else "", f"{method}_rank")
    def _rank(t: Tables, method=method):
        return ranks.rank(t.orders, "o_orderdate", ["o_orderstatus"], method, ties=["o_orderkey"], name="r").select("o_orderkey", "r")


@query("SELECT c_custkey, 100 * (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY c_mktsegment) AS percentile FROM customer", "percentile")
def percentile_of_score(t: Tables):
    return ranks.percentile_of_score(t.customer, "c_acctbal", ["c_mktsegment"]).select("c_custkey", "percentile")


P = "SELECT p_partkey, p_brand, (p_partkey * 7919 % 10007 + 1) / 10008.0::DOUBLE AS p FROM part"


def with_p(t: Tables):
    return t.part.select("p_partkey", "p_brand", ((F.col("p_partkey") * 7919 % 10007 + 1) / 10008.0).alias("p"))


@query(f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM ({P})) SELECT p_partkey, least(1.0::DOUBLE, min(p * n / i) OVER (PARTITION BY p_brand ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM o", "q")
def bh_adjust(t: Tables):
    return ranks.benjamini_hochberg(with_p(t), "p", ["p_brand"]).select("p_partkey", "q")


@query(f"SELECT p_partkey, least(1.0::DOUBLE, p * count(*) OVER (PARTITION BY p_brand)) AS q FROM ({P})", "q")
def bonferroni(t: Tables):
    return ranks.bonferroni(with_p(t), "p", ["p_brand"]).select("p_partkey", "q")


LIST = "SELECT l_partkey AS gene, round_even(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY 1"


@query(f"WITH g AS (SELECT gene, s, p_brand FROM ({LIST}) JOIN part ON gene = p_partkey), b AS (SELECT DISTINCT p_brand AS b FROM part), w AS (SELECT b, gene, row_number() OVER (PARTITION BY b ORDER BY s DESC, gene) AS i, p_brand = b AS hit FROM g, b), h AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY b) AS n, count(*) OVER (PARTITION BY b) AS m FROM w), r AS (SELECT *, sum(CASE WHEN hit THEN 1.0::DOUBLE / n ELSE -1.0::DOUBLE / (m - n) END) OVER (PARTITION BY b ORDER BY i) AS walk FROM h), e AS (SELECT b AS p_brand, any_value(n) AS n_hits, max(walk) AS hi, least(0.0, min(walk)) AS lo FROM r GROUP BY 1) SELECT p_brand, n_hits, CASE WHEN hi >= -lo THEN hi ELSE lo END AS score FROM e WHERE n_hits > 0", "score")
def running_enrichment(t: Tables):
    scores = t.lineitem.groupBy(F.col("l_partkey").alias("gene")).agg(F.bround(F.sum("l_extendedprice"), 2).alias("s"))
    members = t.part.select(F.col("p_partkey").alias("gene"), "p_brand")
    return genesets.running_enrichment(scores.join(members.select("gene"), "gene", "left_semi"), members, "gene", "s", "p_brand")


for nm, f, run in (
    ("zscore", "coalesce((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 0)", lambda e: norm.zscore(e, "value", ["sample"], name="v")),
    ("minmax", "coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0)", lambda e: norm.minmax(e, "value", ["sample"], name="v")),
    ("max_share", "value * 100 / max(value) OVER w", lambda e: norm.max_share(e, "value", ["sample"], name="v")),
    ("log2_cpm", "log2(1 + value * 1e6 / sum(value) OVER w)", lambda e: norm.log2_cpm(e, "value", "sample", name="v")),
    ("batch_centre", "value - avg(value) OVER (PARTITION BY gene, sample % 2) + avg(value) OVER (PARTITION BY gene)", lambda e: norm.batch_centre(e.withColumn("_b", F.col("sample") % 2), "value", "gene", "_b", name="v")),
):

    @query(f"SELECT sample, gene, {f} AS v FROM ({YEARLY}) WINDOW w AS (PARTITION BY sample)", "v:5" if nm == "batch_centre" else "v", nm)
    def _norm(t: Tables, run=run):
        return run(yearly(t)).select("sample", "gene", "v")


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value, gene) AS i FROM ({YEARLY})), m AS (SELECT i, avg(value) AS v FROM r GROUP BY 1) SELECT sample, gene, v FROM r JOIN m USING (i)", "v:5")
def quantile_norm(t: Tables):
    return norm.quantile_normalise(yearly(t), "value", "sample", "gene", "v").select("sample", "gene", "v")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey LIMIT 500")
def priority_topup(t: Tables):
    return topk.priority_topup(t.orders, F.col("o_orderpriority") == "1-URGENT", "o_totalprice", 500, ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@query("SELECT * FROM (SELECT c_custkey, 'up' AS side FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20) UNION ALL SELECT * FROM (SELECT c_custkey, 'down' FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20)")
def both_ends(t: Tables):
    return topk.both_ends(t.customer, "c_acctbal", 20, ["c_custkey"]).select("c_custkey", "side")


@query("SELECT c AS \"column\", (SELECT count(*) FROM part) AS rows, m AS missing FROM (SELECT 'p_partkey' AS c, count(*) - count(p_partkey) AS m FROM part UNION ALL SELECT 'p_name', count(*) - count(p_name) FROM part UNION ALL SELECT 'p_brand', count(*) - count(p_brand) FROM part UNION ALL SELECT 'p_type', count(*) - count(p_type) FROM part UNION ALL SELECT 'p_size', count(*) - count(p_size) FROM part UNION ALL SELECT 'p_retailprice', count(*) - count(p_retailprice) FROM part)")
def quality(t: Tables):
    return quality_report(t.part).select("column", "rows", "missing")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, length(props)::INT AS n FROM events")
def json_field(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").alias("n"))


@query()
def seeded_sample(t: Tables):
    return topk.sample_rows(t.customer, 100, 42, "c_custkey").select("c_custkey", "c_name")


@query()
def distance_clump(t: Tables):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_orderkey").cast("double").alias("pos"), (F.col("l_discount") + F.col("l_linenumber") / 1000.0).alias("p"))
    return intervals.clump(rows, ["l_suppkey"], "pos", "p", 50.0)
