"""Queries of graphs and of scores over named sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import genesets, graph, stats
from quern.plans.analytics import CLOSURE, EDGES, edges
from quern.plans.checks import PRIORITIES, priorities
from quern.plans.registry import Tables, query
from quern.plans.relational import YEARLY, yearly

SOURCES = f"SELECT DISTINCT src AS node FROM ({EDGES}) WHERE w >= 3"


def sources(t: Tables):
    return edges(t).where("w >= 3").select(F.col("src").alias("node")).distinct()


HOPS = f"WITH RECURSIVE c AS ({CLOSURE}), s AS ({SOURCES}), r AS (SELECT node AS source, node, 0 AS hops FROM s UNION SELECT source, dst, hops + 1 FROM r JOIN c ON src = node WHERE hops < 3), d AS (SELECT source, node, min(hops) AS hops FROM r GROUP BY 1, 2)"


@query(f"{HOPS} SELECT source AS node, count(*) AS reached, count(*) / sum(hops) AS closeness, sum(1.0::DOUBLE / hops) AS harmonic FROM d WHERE hops > 0 GROUP BY 1", "closeness harmonic")
def closeness(t: Tables):
    return graph.closeness(edges(t), sources(t), 3)


@query(f"{HOPS} SELECT count(*) AS pairs, avg(hops) AS mean_hops, max(hops) AS longest FROM d WHERE hops > 0", "mean_hops")
def path_lengths(t: Tables):
    return graph.reach(edges(t), sources(t), 3)


TWO_STEPS = f"c AS MATERIALIZED ({CLOSURE}), s AS ({SOURCES}), p AS (SELECT s.node AS source, x.dst AS mid, y.dst AS target FROM s JOIN c x ON x.src = s.node JOIN c y ON y.src = x.dst WHERE y.dst <> s.node AND NOT EXISTS (SELECT 1 FROM c z WHERE z.src = s.node AND z.dst = y.dst)), n AS (SELECT source, target, count(*) AS n FROM p GROUP BY 1, 2)"


@query(f"WITH {TWO_STEPS}, b AS (SELECT mid AS node, sum(1.0::DOUBLE / n) AS b FROM p JOIN n USING (source, target) GROUP BY 1) SELECT DISTINCT dst AS node, coalesce(b, 0) AS betweenness FROM s JOIN c ON src = s.node LEFT JOIN b ON b.node = dst", "betweenness")
def betweenness(t: Tables):
    return graph.betweenness(edges(t), sources(t), 2)


@query(f"WITH {TWO_STEPS}, f AS (SELECT node AS a, dst AS b, 1.0::DOUBLE AS f FROM s JOIN c ON src = node UNION ALL SELECT source, mid, 1.0::DOUBLE / n FROM p JOIN n USING (source, target) UNION ALL SELECT mid, target, 1.0::DOUBLE / n FROM p JOIN n USING (source, target)), e AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, sum(f) AS betweenness FROM f GROUP BY 1, 2) SELECT * FROM e WHERE round(betweenness, 9) <= (SELECT quantile_cont(round(betweenness, 9), 0.95) FROM e)", "betweenness")
def without_bridges(t: Tables):
    scores = graph.edge_betweenness(edges(t), sources(t), 2).withColumn("betweenness", F.round("betweenness", 9))
    return graph.without_bridges(edges(t), scores)


@query(f"WITH RECURSIVE c AS ({CLOSURE}), r AS (SELECT src AS node, src AS low FROM c UNION SELECT dst, low FROM r JOIN c ON src = node AND low < dst) SELECT node, min(low) AS component FROM r GROUP BY 1")
def component_labels(t: Tables):
    return graph.components(edges(t))


CORE = f"WITH e0 AS MATERIALIZED ({CLOSURE})" + "".join(f", e{i} AS MATERIALIZED (SELECT src, dst FROM e{i - 1} WHERE src IN (SELECT src FROM e{i - 1} GROUP BY 1 HAVING count(*) >= 3) AND dst IN (SELECT src FROM e{i - 1} GROUP BY 1 HAVING count(*) >= 3))" for i in range(1, 25)) + " SELECT src, dst FROM e24 WHERE src < dst"


@query(CORE)
def core3_edges(t: Tables):
    return graph.kcore(edges(t), 3)


EIGEN = f"WITH c AS MATERIALIZED ({CLOSURE}), x0 AS MATERIALIZED (SELECT DISTINCT src AS node, 1.0::DOUBLE AS x FROM c)" + "".join(f", y{i} AS MATERIALIZED (SELECT p.node, p.x + sum(c.w * q.x) AS x FROM x{i - 1} p JOIN c ON c.src = p.node JOIN x{i - 1} q ON q.node = c.dst GROUP BY p.node, p.x), x{i} AS MATERIALIZED (SELECT node, x / sqrt((SELECT sum(x * x) FROM y{i})) AS x FROM y{i})" for i in range(1, 5)) + " SELECT node, x AS score FROM x4"


@query(EIGEN, "score")
def eigenvector4(t: Tables):
    return graph.eigenvector(edges(t), 4)


HITS = f"WITH e AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({EDGES})), h0 AS MATERIALIZED (SELECT DISTINCT src AS node, 1.0::DOUBLE AS h FROM e)" + "".join(f", a{i} AS MATERIALIZED (SELECT dst AS node, sum(h) AS a FROM e JOIN h{i - 1} ON src = node GROUP BY 1), g{i} AS MATERIALIZED (SELECT src AS node, sum(a) AS h FROM e JOIN a{i} ON dst = node GROUP BY 1), h{i} AS MATERIALIZED (SELECT node, h / (SELECT sum(h) FROM g{i}) AS h FROM g{i})" for i in range(1, 4)) + ", a AS (SELECT dst AS node, sum(h) AS a FROM e JOIN h3 ON src = node GROUP BY 1), b AS (SELECT node, a / (SELECT sum(a) FROM a) AS a FROM a) SELECT node, coalesce(h, 0) AS hub, coalesce(a, 0) AS authority FROM h3 FULL JOIN b USING (node)"


@query(HITS, "hub authority")
def hits3(t: Tables):
    return graph.hits(edges(t), 3)


SHAPE = f"WITH c AS MATERIALIZED ({CLOSURE}), d AS (SELECT src AS node, count(*) AS degree, sum(w) AS strength FROM c GROUP BY 1), t AS (SELECT x.src AS node, count(*) AS t FROM c x JOIN c y ON x.src = y.src AND x.dst < y.dst JOIN c z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1), m AS (SELECT node, degree, strength, coalesce(t, 0) AS triangles FROM d LEFT JOIN t USING (node))"


def shape(t: Tables):
    return graph.degrees(edges(t)).join(graph.triangles(edges(t)).select("node", "triangles"), "node")


@query(f"{SHAPE} SELECT node, 2.0::DOUBLE * (degree + triangles) / ((degree + 1) * degree) AS density FROM m", "density")
def density_scores(t: Tables):
    return graph.density_scores(edges(t))


@query(f"{SHAPE} SELECT node, degree, strength, triangles FROM m WHERE degree > (SELECT median(degree) FROM m) AND strength > (SELECT median(strength) FROM m)", "strength")
def above_medians(t: Tables):
    return graph.above_medians(shape(t), ["degree", "strength"]).select("node", "degree", "strength", "triangles")


@query(f"{SHAPE} SELECT node, coalesce(degree / (SELECT max(degree) FROM m), 0) / 2 + coalesce(triangles / nullif((SELECT max(triangles) FROM m), 0), 0) / 2 AS hub_score FROM m", "hub_score")
def hub_scores(t: Tables):
    return graph.hub_score(shape(t), ["degree", "triangles"]).select("node", "hub_score")


INSIDE = f"WITH n AS (SELECT p_partkey AS node FROM part WHERE p_size <= 20), e AS (SELECT src, dst, w FROM ({EDGES}) WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n))"


def small(t: Tables):
    return t.part.where("p_size <= 20").select(F.col("p_partkey").alias("node"))


@query(f"{INSIDE} SELECT src, dst, w FROM e")
def induced_edges(t: Tables):
    return graph.induced(edges(t), small(t)).select("src", "dst", "w")


@query(f"{INSIDE} SELECT node FROM n WHERE node NOT IN (SELECT src FROM e UNION ALL SELECT dst FROM e)")
def isolated_nodes(t: Tables):
    return graph.isolated(edges(t), small(t))


@query(f"{HOPS}, t AS (SELECT p_partkey AS t FROM part WHERE p_size <= 20), x AS (SELECT src AS node, count(*) AS direct, avg(w) AS mean_weight FROM c JOIN t ON dst = t GROUP BY 1), f AS (SELECT source AS node, count(*) FILTER (hops = 2) AS indirect, avg(hops) AS mean_hops FROM d JOIN t ON node = t WHERE hops > 0 GROUP BY 1) SELECT node, coalesce(direct, 0) AS direct, coalesce(indirect, 0) AS indirect, mean_weight, mean_hops FROM s LEFT JOIN x USING (node) LEFT JOIN f USING (node)", "mean_weight mean_hops")
def connectivity(t: Tables):
    return graph.connectivity(edges(t), sources(t), small(t), 3)


TYPED = "WITH r AS (SELECT DISTINCT 'supplier' AS kind_a, l_suppkey::VARCHAR AS a, 'part' AS kind_b, l_partkey::VARCHAR AS b, 1.0::DOUBLE AS w, 'sells' AS etype FROM lineitem UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, 'nation', s_nationkey::VARCHAR, s_acctbal, 'sits' FROM supplier), n AS (SELECT kind, name, dense_rank() OVER (PARTITION BY kind ORDER BY name) - 1 AS id FROM (SELECT kind_a AS kind, a AS name FROM r UNION SELECT kind_b, b FROM r))"


def typed(t: Tables):
    sells = t.lineitem.select(F.lit("supplier").alias("kind_a"), F.col("l_suppkey").cast("string").alias("a"), F.lit("part").alias("kind_b"), F.col("l_partkey").cast("string").alias("b")).distinct()
    sits = t.supplier.select(F.lit("supplier").alias("kind_a"), F.col("s_suppkey").cast("string").alias("a"), F.lit("nation").alias("kind_b"), F.col("s_nationkey").cast("string").alias("b"), F.col("s_acctbal").alias("w"))
    return graph.typed_graph(sells=sells, sits=sits)


@query(f"{TYPED} SELECT kind, name, id FROM n")
def typed_nodes(t: Tables):
    return typed(t)[0].select("kind", "name", F.col("id").cast("long").alias("id"))


@query(f"{TYPED} SELECT etype, x.id AS src, y.id AS dst, w FROM r JOIN n x ON x.kind = kind_a AND x.name = a JOIN n y ON y.kind = kind_b AND y.name = b", "w")
def typed_edges(t: Tables):
    return typed(t)[1].select("etype", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "w")


@query()
def clique_scores(t: Tables):
    return graph.maximal_cliques_score(edges(t), 100_000)


SETS = "SELECT p_brand AS name, p_partkey AS gene FROM part"


def brands(t: Tables):
    return t.part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("gene"))


@query(f"SELECT sample, name, avg(ln(value + 1)) AS score FROM ({YEARLY}) JOIN ({SETS}) USING (gene) GROUP BY 1, 2", "score")
def set_means(t: Tables):
    return genesets.mean_scores(yearly(t).withColumn("value", F.log1p("value")), brands(t), "sample", "gene", "value", "name")


@query(f"WITH e AS ({YEARLY}), s AS ({SETS}), m AS (SELECT gene, avg(value) AS m FROM e GROUP BY 1), b AS (SELECT gene, floor((rank() OVER (ORDER BY m) - 1) / nullif(count(*) OVER () - 1, 0)::DOUBLE * (24 - 1e-9)) AS b FROM m), o AS (SELECT sample, name, avg(value) AS v FROM e JOIN s USING (gene) GROUP BY 1, 2), w AS (SELECT name, b, count(*) AS w FROM s JOIN b USING (gene) GROUP BY 1, 2), v AS (SELECT sample, b, avg(value) AS v FROM e JOIN b USING (gene) GROUP BY 1, 2), c AS (SELECT sample, name, sum(v * w) / sum(w) AS c FROM v JOIN w USING (b) GROUP BY 1, 2) SELECT sample, name, v - c AS score FROM o JOIN c USING (sample, name)", "score:4")
def module_scores(t: Tables):
    return genesets.module_scores(yearly(t), brands(t), "sample", "gene", "value", "name")


@query(f"WITH g AS (SELECT sample, name, exp(avg(ln(value + 1))) - 1 AS g FROM ({YEARLY}) JOIN ({SETS}) USING (gene) GROUP BY 1, 2) SELECT sample, name, g / sum(g) OVER (PARTITION BY sample) AS fraction FROM g", "fraction")
def marker_fractions(t: Tables):
    return genesets.marker_fractions(yearly(t), brands(t), "sample", "gene", "value", "name")


@query(f"WITH t AS (SELECT DISTINCT l_suppkey AS cluster, l_partkey AS gene FROM lineitem WHERE l_quantity >= 45), n AS (SELECT name, count(*) AS n FROM ({SETS}) GROUP BY 1), h AS (SELECT cluster, name, count(*) AS h FROM t JOIN ({SETS}) USING (gene) GROUP BY 1, 2), b AS (SELECT cluster, name, h / n AS share FROM h JOIN n USING (name) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY h / n DESC, name) = 1) SELECT cluster, CASE WHEN share >= 0.1 THEN name ELSE 'Unknown' END AS name, coalesce(share, 0) AS share FROM (SELECT DISTINCT cluster FROM t) LEFT JOIN b USING (cluster)", "share")
def cluster_kinds(t: Tables):
    tops = t.lineitem.where("l_quantity >= 45").select(F.col("l_suppkey").alias("cluster"), F.col("l_partkey").alias("gene"))
    return genesets.annotate_clusters(tops, brands(t), "cluster", "gene", "name")


DELTA = "SELECT l_suppkey AS kind, count(*) FILTER (l_returnflag = 'R') AS n1, count(*) FILTER (l_returnflag <> 'R') AS n0, avg(l_discount) FILTER (l_returnflag = 'R') - avg(l_discount) FILTER (l_returnflag <> 'R') AS delta FROM lineitem GROUP BY 1"


def deltas(t: Tables):
    return genesets.condition_delta(t.lineitem.withColumnRenamed("l_suppkey", "kind"), "kind", "l_discount", F.col("l_returnflag") == "R")


@query(DELTA, "delta")
def condition_delta(t: Tables):
    return deltas(t)


@query(f"SELECT * FROM (SELECT kind, n1, n0, round(delta, 9) AS delta FROM ({DELTA})) WHERE n1 >= 10 AND n0 >= 10 AND abs(delta) >= 0.001 ORDER BY abs(delta) DESC, kind LIMIT 5", "delta")
def effect_kinds(t: Tables):
    return genesets.effect_kinds(deltas(t).withColumn("delta", F.round("delta", 9)), "kind", 0.001)


@query("WITH c AS (SELECT o_orderkey AS cell, o_orderpriority AS kind FROM orders), x AS (SELECT DISTINCT l_orderkey AS cell, l_partkey % 50 AS gene FROM lineitem), n AS (SELECT kind, count(*) AS n FROM c GROUP BY 1), s AS (SELECT kind, gene, count(*) / any_value(n) AS share FROM x JOIN c USING (cell) JOIN n USING (kind) GROUP BY 1, 2 HAVING count(*) / any_value(n) > 0.08), p AS (SELECT DISTINCT p_partkey % 50 AS l, (p_partkey * 7 + 3) % 50 AS r FROM part) SELECT a.kind AS sender, b.kind AS receiver, l, r FROM p JOIN s a ON a.gene = l JOIN s b ON b.gene = r WHERE a.kind <> b.kind")
def expressed_pairs(t: Tables):
    counts = t.lineitem.select(F.col("l_orderkey").alias("cell"), (F.col("l_partkey") % 50).alias("gene"))
    cells = t.orders.select(F.col("o_orderkey").alias("cell"), F.col("o_orderpriority").alias("kind"))
    pairs = t.part.select((F.col("p_partkey") % 50).alias("l"), ((F.col("p_partkey") * 7 + 3) % 50).alias("r"))
    return genesets.expressed_pairs(counts, cells, pairs, "cell", "kind", "gene", "l", "r", 0.08)


@query("SELECT l_suppkey AS gene, count(*) FILTER (l_tax > 0.07) AS n_sig, count(*) FILTER (l_discount > 0.09) AS n_corr, 2 * count(*) FILTER (l_tax > 0.07) + 0.5 * count(*) FILTER (l_discount > 0.09) + 0.1 * avg(l_quantity) + 0.05 * max(l_quantity) AS score FROM lineitem GROUP BY 1", "score")
def perturbation_scores(t: Tables):
    return genesets.perturbation_score(t.lineitem.withColumnRenamed("l_suppkey", "gene"), "gene", F.col("l_tax") > 0.07, F.col("l_discount") > 0.09, "l_quantity")


ORTHOLOGS = "SELECT DISTINCT upper(trim(s)) AS g, upper(trim(unnest(string_split(h, '|')))) AS ortholog FROM (SELECT ' part' || p_partkey AS s, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'h' || p_size ELSE 'h' || p_size || '|k' || p_size END AS h FROM part)"


def orthologs(t: Tables):
    h = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("h"), "p_size")).otherwise(F.concat(F.lit("h"), "p_size", F.lit("|k"), "p_size"))
    table = t.part.select(F.concat(F.lit(" part"), "p_partkey").alias("s"), h.alias("h"))
    genes = t.part.select(F.concat(F.lit("Part"), F.col("p_partkey") + 50).alias("gene"))
    return genesets.map_orthologs(genes, "gene", table, "s", "h")


@query(f"SELECT 'Part' || (p_partkey + 50) AS gene, ortholog FROM part JOIN ({ORTHOLOGS}) ON g = 'PART' || (p_partkey + 50) WHERE ortholog <> ''")
def mapped_orthologs(t: Tables):
    return orthologs(t)[0]


@query(f"SELECT 'Part' || (p_partkey + 50) AS gene FROM part WHERE 'PART' || (p_partkey + 50) NOT IN (SELECT g FROM ({ORTHOLOGS}) WHERE ortholog <> '')")
def unmapped_genes(t: Tables):
    return orthologs(t)[1]


@query(f"WITH v AS ({PRIORITIES}), s AS (SELECT u, max(v) FILTER (g LIKE '1%') AS t, max(v) FILTER (g LIKE '2%') AS a, max(v) FILTER (g LIKE '3%') AS b, max(v) FILTER (g LIKE '5%') AS c FROM v GROUP BY 1), l AS (SELECT t, unnest(['2-HIGH', '3-MEDIUM', '5-LOW']) AS g, unnest([a, b, c]) AS v FROM s), r AS (SELECT g, count(*) AS n, regr_slope(v, t) AS slope, corr(v, t) AS r, avg(t) AS mt, stddev_samp(v) AS sv FROM l WHERE t IS NOT NULL AND v IS NOT NULL GROUP BY 1) SELECT g, n, r, -slope * mt AS effect, -slope * mt / sv AS d FROM r", "r effect:2 d")
def virtual_knockout(t: Tables):
    return genesets.virtual_knockout(priorities(t).where("g not like '4%'"), "u", "g", "v", "1-URGENT", 100).select("g", "n", "r", "effect", "d")
