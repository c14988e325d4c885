"""Small cases worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quern import schema
from quern.functions import dist, scalar
from quern.operators import collapse, fusion, genesets, graph, intervals, joins, mr, norm, ranks, sets, stats, topk

P = [0.01, 0.04, 0.03, 0.005, 0.04]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_ranks(spark):
    d = frame(spark, list(enumerate(P)) + [(9, None)], "i int, p double")
    assert column(ranks.rank(d, "p"), "rank", "i") == [2, 4.5, 3, 1, 4.5, None]
    assert column(ranks.rank(d, "p", method="dense"), "rank", "i") == [2, 4, 3, 1, 4, None]
    assert column(ranks.rank(d, "p", method="min", descending=True), "rank", "i")[:5] == [4, 1, 3, 5, 1]
    assert column(ranks.benjamini_hochberg(d, "p"), "q", "i")[:5] == pytest.approx([0.025, 0.04, 0.04, 0.025, 0.04])
    s = frame(spark, [(1,), (2,), (2,), (3,)], "x int")
    assert column(ranks.percentile_of_score(s, "x"), "percentile", "x")[1] == 62.5


def test_tests_of_two_groups(spark):
    d = frame(spark, [(3.0, True), (4.0, True), (5.0, True), (1.0, False), (2.0, False), (3.0, False)], "v double, c boolean")
    w = stats.welch_t(d, [], "v", F.col("c"), with_p=True).first()
    assert (w.t, w.df) == (pytest.approx(2.449490, abs=1e-6), pytest.approx(4)) and w.p == pytest.approx(0.0705, abs=1e-4)
    assert stats.cohens_d(d, [], "v", F.col("c")).first().d == pytest.approx(2.0)
    r = stats.random_effects(frame(spark, [(0.2, 0.04), (1.2, 0.04), (0.7, 0.04)], "d double, v double"), [], "d", "v").first()
    assert (r.q, r.tau2, r.i2, r.effect, r.se) == tuple(pytest.approx(x, abs=1e-6) for x in (12.5, 0.21, 84, 0.7, 0.288675))
    f = stats.fisher_combined(frame(spark, [(0.01,), (0.04,)], "p double"), [], "p").first()
    assert (f.chi2, f.p) == (pytest.approx(15.648092, abs=1e-6), pytest.approx(0.00352962, abs=1e-8))
    a = frame(spark, [(0.1, False), (0.4, False), (0.35, True), (0.8, True)], "s double, c boolean")
    assert stats.auc(a, [], "s", F.col("c")).first().auc == 0.75


def test_distributions(spark):
    d = frame(spark, [(1.0, 4.0)], "x double, n double")
    r = d.select(dist.normal_cdf("x").alias("a"), dist.t_two_sided("x", "n").alias("b"), dist.chi2_upper("x", "n").alias("c"), dist.chi2_upper_even(F.col("x"), 4).alias("d"), dist.f_upper("x", "n", 5.0).alias("e"), dist.normal_quantile(F.lit(0.975)).alias("f"), dist.hypergeometric_upper(F.lit(10), F.lit(4), F.lit(3), F.lit(2)).alias("g")).first()
    assert r.a == pytest.approx(0.841344746, abs=1e-9) and r.b == pytest.approx(0.373900966, abs=1e-8)
    assert r.c == pytest.approx(0.909795990, abs=1e-8) and r.d == pytest.approx(r.c, abs=1e-9)
    assert r.f == pytest.approx(1.959963985, abs=1e-8) and r.g == pytest.approx(1 / 3, abs=1e-9) and 0.4 < r.e < 0.55


def test_rank_sum(spark):
    d = frame(spark, [("s", i, float(i)) for i in range(1, 5)], "s string, g int, v double")
    r = genesets.rank_sum_scores(d, "s", "g", "v", {"a": F.col("g") >= 3, "none": F.lit(False), "all": F.lit(True)}).first()
    assert (r.a, r.none, r.all) == (1.0, 0.0, 0.0)
    z = frame(spark, [(0.5, 2.0)], "a double, b double")
    assert z.select(scalar.twice_the_lesser("a", "b")).first()[0] == 1.0


def test_islands_and_clump(spark):
    d = frame(spark, [(x,) for x in (100, 200, 300, 900, 950)], "p int")
    assert [tuple(r)[:2] for r in intervals.islands(d, "p", 500).orderBy("start").collect()] == [(100, 300), (900, 950)]
    c = frame(spark, [("g", 1.0, 0.5), ("g", 2.0, 0.1), ("g", 5.0, 0.2), ("g", None, 0.0)], "g string, pos double, p double")
    assert sorted(r.pos for r in intervals.clump(c, ["g"], "pos", "p", 2.0).collect()) == [2.0, 5.0]


def test_sets(spark):
    s = frame(spark, [("x", m) for m in "abc"] + [("y", m) for m in "bcd"], "s string, m string")
    assert column(sets.overlaps(s, "s", "m"), "jaccard", "a") == [0.5]
    assert column(sets.intersection(s, "s", "m"), "m", "m") == ["b", "c"]
    assert {(r.sets, r.n_members) for r in sets.membership_counts(s, "s", "m").collect()} == {("x", 1), ("x|y", 2), ("y", 1)}


def test_graph(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("d", "d")], "src string, dst string")
    hops = {(r.node, r.hop) for r in graph.khop(e, frame(spark, [("a",)], "node string")).collect()}
    assert hops == {("b", 1), ("c", 2)}
    assert {(r.node, r.component) for r in graph.components(e).collect()} == {*((n, "a") for n in "abcd"), ("x", "x"), ("y", "x")}
    assert {r.node: r.hops for r in graph.distances(e, frame(spark, [("a",)], "node string")).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    k4 = frame(spark, [(i, j) for i in range(4) for j in range(i)] + [(3, 9)], "src int, dst int")
    assert {(r.node, r.triangles) for r in graph.triangles(k4).collect()} == {(0, 3), (1, 3), (2, 3), (3, 3), (9, 0)}
    assert graph.kcore(k4, 3).count() == 6
    assert {(r.node, r.cliques, r.score) for r in graph.maximal_cliques_score(k4).collect()} == {(i, 1, 3) for i in range(4)}
    assert sum(r.rank for r in graph.pagerank(k4, 20).collect()) == pytest.approx(1)
    n = graph.negative_edges(k4, frame(spark, [(i,) for i in (0, 1, 2, 3, 9)], "node int"), 2, 1).collect()
    assert len(n) == 2 and all((r.src, r.dst) in {(0, 9), (1, 9), (2, 9)} for r in n)


def test_components_against_union_find(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    parent = list(range(120))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in graph.components(frame(spark, pairs, "src int, dst int")).collect()}
    assert got == {n: find(n) for p in pairs for n in p if p[0] != p[1]}


def test_instruments(spark):
    cols = "gene string, chr string, pos int, effect_allele string, other_allele string, beta double, se double, eaf double, p double"
    e = frame(spark, [("N", "1", 1, "A", "G", 0.5, 0.1, 0.3, 1e-10), ("N", "1", 2, "G", "A", -0.3, 0.08, 0.45, 5e-9), ("N", "1", 3, "A", "G", 0.4, 0.1, 0.2, 1e-9), ("N", "1", 4, "A", "G", 0.4, 0.1, 0.2, 1e-9)], cols)
    o = frame(spark, [("1", 1, "A", "G", 0.2, 0.05, 0.32, 0.01), ("1", 2, "G", "A", -0.1, 0.04, 0.47, 0.05), ("1", 3, "G", "A", 0.1, 0.05, 0.8, 0.05), ("1", 4, "C", "T", 0.1, 0.05, 0.8, 0.05)], cols.replace("gene string, ", ""))
    h = mr.harmonise(e, o, ["chr", "pos"])
    rows = {r.pos: r for r in h.collect()}
    assert set(rows) == {1, 2, 3} and rows[3].beta_out == -0.1 and rows[3].eaf_out == pytest.approx(0.2)
    assert (rows[1].f, rows[2].f) == (pytest.approx(25), pytest.approx(14.0625))
    assert mr.ivw(h.where("pos < 3"), ["gene"]).first().beta == pytest.approx(58.75 / 156.25)
    pp = mr.coloc(h, ["gene"]).first()
    assert sum(pp[f"pp{i}"] for i in range(5)) == pytest.approx(1)
    assert mr.steiger(h, ["gene"], 31684, 50000).first().right_direction


def test_fusion(spark):
    s = frame(spark, [("a", "x", 3.0), ("a", "y", 1.0), ("b", "x", 2.0), ("b", "y", 5.0), ("c", "x", 1.0), ("c", "y", 1.0)], "model string, m string, s double")
    two = s.where("model <> 'c'")
    assert column(fusion.reciprocal_ranks(two, "model", "m", "s"), "rrf", "m") == pytest.approx([1 / 61 + 1 / 62] * 2)
    assert 1 / 61 + 1 / 62 == pytest.approx(0.0325225, abs=1e-7)
    assert column(fusion.borda(s, "model", "m", "s"), "points", "m") == [1, 1]
    rho = column(fusion.rho_scores(two, "model", "m", "s"), "rho", "m")
    assert all(0 < x <= 1 for x in rho)


def test_missing_values(spark):
    d = schema.missing_to_null(frame(spark, [(1.0, "a"), (math.nan, "---"), (None, "")], "x double, t string"))
    r = d.agg(F.max("x"), F.count("x"), F.count("t")).first()
    assert tuple(r) == (1.0, 1, 1)
    with pytest.raises(ValueError):
        schema.resolve_columns(d, {"z": ["q"]})
    with pytest.raises(ValueError):
        schema.expect(d, positive=F.col("x") > 5)


def test_columns(spark):
    d = frame(spark, [(float(i), 2.0 * i, 1.0, float(i % 3)) for i in range(20)], "a double, b double, c double, d double")
    assert "c" not in schema.drop_constant_columns(d, ["a", "b", "c"]).columns
    assert schema.drop_correlated_columns(d, ["a", "b", "d"]).columns == ["b", "c", "d"]
    assert schema.duplicate_columns(d.withColumn("e", F.col("a")), ["a", "b", "e"]) == {"e": "a"}


def test_texts(spark):
    d = frame(spark, [("(-0.3 - 0.4)",), ("(0.8-1.2)",), ("none",)], "t string")
    low, high = scalar.confidence_interval("t")
    assert [tuple(r) for r in d.select(low, high).collect()] == [(-0.3, 0.4), (0.8, 1.2), (None, None)]
    p = frame(spark, [("MKRDE",)], "s string").select(*scalar.protein_features("s")).first()
    assert p.n_residues == 5 and p.net_charge == 0


def test_lookups_and_ranges(spark):
    d, t = frame(spark, [("a",), ("b",)], "k string"), frame(spark, [("a", 1, "x"), ("a", 2, "y")], "k string, i int, v string")
    assert column(joins.lookup(d, t, ["k"], ["i"]), "v", "k") == ["x", None]
    assert column(joins.lookup(d, t, ["k"], ["i"], last=True), "v", "k") == ["y", None]
    points, spans = frame(spark, [(5,), (15,), (25,)], "at int"), frame(spark, [(0, 15), (14, 16)], "lo int, hi int")
    assert joins.in_range(points, "at", spans, "lo", "hi", 4).count() == 3
    e = frame(spark, [("a", "b"), ("b", "c")], "x string, y string")
    k = frame(spark, [("a",), ("b",)], "k string")
    assert joins.ends_among(e, "x", "y", k, "k").count() == 1 and joins.ends_among(e, "x", "y", k, "k", "either").count() == 2


def test_norms_and_topk(spark):
    d = frame(spark, [("s", 1.0), ("s", 3.0), ("t", 5.0), ("t", 5.0)], "g string, v double")
    assert column(norm.zscore(d, "v", ["g"]), "z", "g", "v") == pytest.approx([-0.70710678, 0.70710678, 0, 0])
    assert column(norm.minmax(d, "v", ["g"]), "scaled", "g", "v") == [0, 1, 0, 0]
    assert column(topk.priority_topup(frame(spark, [(1, 1.0), (2, 9.0), (3, 5.0)], "k int, s double"), F.col("k") == 1, "s", 2, ["k"]), "k", "k") == [1, 2]
    a = topk.sample_rows(frame(spark, [(i,) for i in range(50)], "k int"), 5, 3, "k")
    assert column(a, "k", "k") == column(a.repartition(7), "k", "k")
    assert collapse.collapse_to_best(frame(spark, [("p", "g", "s", 1.0), ("q", "g", "s", 2.0)], "p string, g string, s string, v double"), "p", "g", "s", "v").first().p == "q"


def test_random_statistics(spark):
    d = frame(spark, [(i, float(i % 10), i % 2 == 0) for i in range(400)], "k int, v double, c boolean")
    b = stats.bootstrap_means(d, "k", "v", 200).first()
    assert b.low < b.mean < b.high and b.high - b.low < 1.5 and abs(b.bias) < 0.1
    assert stats.permutation_p(d, "k", "v", F.col("c"), 100).first().p <= 0.05


def test_empty_tables(spark):
    e = frame(spark, [], "src int, dst int")
    assert graph.components(e).count() == 0 and graph.triangles(e).count() == 0 and graph.pagerank(e, 2).count() == 0
    assert ranks.benjamini_hochberg(frame(spark, [], "p double"), "p").count() == 0
    assert stats.random_effects(frame(spark, [], "d double, v double"), [], "d", "v").count() == 0


def test_betweenness(spark):
    path = frame(spark, [("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    nodes = frame(spark, [(n,) for n in "abcd"], "node string")
    got = {r.node: r.betweenness for r in graph.betweenness(path, nodes).collect()}
    assert got == {"a": 0.0, "b": 4.0, "c": 4.0, "d": 0.0} or {k: v for k, v in got.items() if v} == {"b": 4.0, "c": 4.0}
    square = frame(spark, [(0, 1), (1, 2), (2, 3), (3, 0)], "src int, dst int")
    got = {r.node: r.betweenness for r in graph.betweenness(square, frame(spark, [(i,) for i in range(4)], "node int")).collect()}
    assert all(v == pytest.approx(1.0) for v in got.values())


def test_learning(spark):
    import numpy as np

    from quern.operators import learning

    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), float(i % 2)) for i in range(300)]
    rows = [(i, a + 2 * y, b, y) for i, a, b, y in rows]
    d = frame(spark, rows, "k int, a double, b double, y double")
    p = learning.platt_scale(d, "a", "y").agg(F.avg(F.when(F.col("y") == 1, F.col("calibrated"))), F.avg(F.when(F.col("y") == 0, F.col("calibrated")))).first()
    assert p[0] > 0.6 > 0.4 > p[1]
    s = {r.feature: r.frequency for r in learning.stability_selection(d, ["a", "b"], "y", 0.05, "k", draws=4).collect()}
    assert s["a"] == 1.0
    assert all(r.vif == pytest.approx(1, abs=0.2) for r in learning.variance_inflation(d, ["a", "b"]).collect())
    a, x = np.array([[1.0, 0.2], [0.1, 1.0], [0.5, 0.4]]), np.array([0.7, 0.3])
    assert learning.non_negative_fit(a, a @ x) == pytest.approx(x)
    assert learning.non_negative_fit(a, -np.ones(3)) == pytest.approx([0, 0])
    sig = frame(spark, [("g1", "t", 1.0), ("g2", "t", 0.1), ("g1", "b", 0.2), ("g2", "b", 1.0)], "g string, kind string, w double")
    mix = frame(spark, [("s", "g1", 0.7 + 0.06), ("s", "g2", 0.07 + 0.3)], "s string, g string, v double")
    got = {r.kind: r.fraction for r in learning.deconvolve(mix, sig, "s", "g", "v", "kind", "w").collect()}
    assert got == pytest.approx({"t": 0.7, "b": 0.3})
    v = frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "i int, v array<double>")
    assert len(learning.pca(v, "v", 1).first().components) == 1


def test_bootstrap_ranks(spark):
    s = frame(spark, [(m, x, float(v)) for m, vs in {"a": (3, 2, 1), "b": (3, 1, 2), "c": (2, 3, 1)}.items() for x, v in zip("xyz", vs, strict=True)], "model string, m string, s double")
    for r in fusion.bootstrap_ranks(s, "model", "m", "s", replicates=50).collect():
        assert r.low <= r.rrf <= r.high


def test_pagerank_until_it_converges(spark):
    pairs = [(0, i) for i in range(1, 6)] + [(i, i + 1) for i in range(5, 30)]
    near = {}
    for x, y in pairs:
        near.setdefault(x, []).append(y)
        near.setdefault(y, []).append(x)
    want = dict.fromkeys(near, 1 / len(near))
    for _ in range(300):
        want = {x: 0.15 / len(near) + 0.85 * sum(want[y] / len(near[y]) for y in near[x]) for x in near}
    edges = frame(spark, pairs, "src int, dst int")
    got = {r.node: r.rank for r in graph.pagerank(edges, None, tolerance=1e-7).collect()}
    assert got == pytest.approx(want, abs=2e-5)
    five = {r.node: r.rank for r in graph.pagerank(edges, 5).collect()}
    assert max(abs(five[x] - want[x]) for x in want) > 1e-3


def test_replicates_of_the_registered_queries(spark, monkeypatch):
    from quern.plans import analytics

    seen = {}
    for name in ("bootstrap_means", "permutation_p"):
        monkeypatch.setattr(analytics.stats, name, lambda *a, _n=name: seen.setdefault(_n, a[-1]))
    tables = analytics.Tables(spark, "/root/testdata/sf0.001")
    analytics.bootstrap_interval(tables)
    analytics.permutation_test(tables)
    assert seen == {"bootstrap_means": 2000, "permutation_p": 2000}


def test_fisher_takes_all_parts(spark):
    import quern.plans.analytics  # noqa: F401
    from quern.plans.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    brands = [r["count"] for r in spark.read.parquet(f"{folder}/part.parquet").groupBy("p_brand").count().collect()]
    got = [r.k for r in QUERIES["fisher_combined_all"].frame(spark, folder).collect()]
    assert sorted(got) == sorted(n for n in brands if n >= 2)
