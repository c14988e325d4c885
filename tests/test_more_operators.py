"""Operators of estimates, graphs and texts against plain Python."""

import itertools
import math
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from quern import schema
from quern.functions import dist, scalar
from quern.operators import graph, intervals, joins, mr, stats


def variants(seed=1, genes=6):
    rng = random.Random(seed)
    rows = []
    for g in range(genes):
        for i in range(rng.choice([1, 2, 5, 30])):
            rows.append((g, i, rng.uniform(0.05, 0.5), rng.uniform(0.01, 0.05), rng.gauss(0.1, 0.1), rng.uniform(0.01, 0.1)))
    return rows


def median(x):
    x = sorted(x)
    return (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2


def test_modes(spark):
    rows = variants()
    df = spark.createDataFrame(rows, "gene int, snp int, beta double, se double, beta_out double, se_out double")
    for r in mr.modes(df, ["gene"]).collect():
        own = [(x[4] / x[2], (x[2] / x[5]) ** 2) for x in rows if x[0] == r.gene]
        ratios = [a for a, _ in own]
        n, med = len(own), median(ratios)
        mean = sum(ratios) / n
        sd = math.sqrt(sum((a - mean) ** 2 for a in ratios) / (n - 1)) if n > 1 else 0
        h = 0.9 * min(sd, 1.4826 * median([abs(a - med) for a in ratios])) / n**0.2
        if h == 0:
            assert r.simple_mode == r.weighted_mode == med
            continue
        lo, step = min(ratios) - 3 * h, (max(ratios) - min(ratios) + 6 * h) / 127
        for weights, got in (([1] * n, r.simple_mode), ([w for _, w in own], r.weighted_mode)):
            at = lambda x: sum(w * math.exp(-(((x - a) / h) ** 2) / 2) for a, w in zip(ratios, weights))  # noqa: B023, E731
            assert abs((got - lo) / step - round((got - lo) / step)) < 1e-6
            assert at(got) >= max(at(lo + i * step) for i in range(128)) * (1 - 1e-12)


def test_graded_clump(spark):
    rows = [("a", 10 * i, (i * 7 % 11 + 1) / 100) for i in range(11)] + [("b", 0, 0.1), ("b", 1, 0.2)]
    df = spark.createDataFrame(rows, "g string, pos int, p double")
    got = mr.graded_clump(df, ["g"], "pos", "p", (1000.0, 25.0, 5.0), 3).collect()
    grades = {r.g: r.grade for r in got}
    assert grades == {"a": 1, "b": -1} and sum(r.g == "b" for r in got) == 2
    kept = sorted(r.pos for r in got if r.g == "a")
    assert all(y - x > 25 for x, y in zip(kept, kept[1:])) and len(kept) >= 3


def test_edge_and_node_betweenness(spark):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(12), 2))) for _ in range(20)}
    near = {n: set() for n in range(12)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = Counter()
    for s in range(12):
        hops, paths, queue = {s: 0}, Counter({s: 1}), deque([s])
        while queue:
            x = queue.popleft()
            for y in near[x]:
                if y not in hops:
                    hops[y] = hops[x] + 1
                    queue.append(y)
                if hops[y] == hops[x] + 1:
                    paths[y] += paths[x]
        depends = Counter()
        for y in sorted(hops, key=hops.get, reverse=True):
            for x in near[y]:
                if hops.get(x, 99) == hops[y] - 1:
                    flow = paths[x] / paths[y] * (1 + depends[y])
                    want[tuple(sorted((x, y)))] += flow
                    depends[x] += flow
    e = spark.createDataFrame(list(edges), "src int, dst int")
    nodes = spark.createDataFrame([(n,) for n in range(12)], "node int")
    got = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(e, nodes, 12).collect()}
    assert set(got) == edges and all(abs(got[k] - want[k]) < 1e-9 for k in edges)
    kept = graph.without_bridges(e, graph.edge_betweenness(e, nodes, 12), 0.9).count()
    assert 0 < kept < len(edges)


def test_cliques(spark):
    rng = random.Random(9)
    edges = {tuple(sorted(rng.sample(range(10), 2))) for _ in range(24)}
    linked = lambda c: all(tuple(sorted(p)) in edges for p in itertools.combinations(c, 2))
    cliques = [c for k in range(3, 7) for c in itertools.combinations(range(10), k) if linked(c) and not any(linked((*c, x)) for x in range(10) if x not in c)]
    got = {r.node: (r.cliques, r.score) for r in graph.maximal_cliques_score(spark.createDataFrame(list(edges), "src int, dst int")).collect()}
    want = {n: (sum(n in c for c in cliques), sum(len(c) - 1 for c in cliques if n in c)) for n in range(10) if any(n in c for c in cliques)}
    assert got == want


def test_rules_and_names(spark):
    df = spark.createDataFrame([(1, "Abc"), (5, "ABC"), (9, "abc"), (7, "xyz"), (None, None)], "x int, name string")
    rules = [(F.col("x") > 0, "a"), (F.col("x") > 4, "b"), (F.col("x") > 8, "c")]
    assert [r[0] for r in df.select(scalar.overridden(F.lit("-"), rules)).collect()] == ["a", "b", "c", "b", "-"]
    names = spark.createDataFrame([("abc", 1), ("ABC", 2), ("Xyz", 3)], "n string, v int")
    got = {r.x: (r.matched, r.v) for r in joins.match_case(df, "name", names, "n").collect()}
    assert got == {1: ("abc", 1), 5: ("ABC", 2), 9: ("abc", 1), 7: ("Xyz", 3)}


def test_clump_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(intervals, "TOGETHER", 20)
    rng = random.Random(11)
    rows = [(g, float(rng.randint(0, 3000)), rng.randint(1, 60) / 100, i) for i, g in enumerate(rng.choices("ab", k=300))]
    for window in (0.0, 7.0, 40.0, 5000.0):
        want = set()
        for g in "ab":
            kept = []
            for _, x, _, i in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
                if all(abs(x - y) > window for y in kept):
                    kept.append(x)
                    want.add((g, x))
        got = intervals.clump(spark.createDataFrame(rows, "g string, pos double, p double, i int"), ["g"], "pos", "p", window).collect()
        assert len(got) == len(want) and {(r.g, r.pos) for r in got} == want


def test_permutations_against_a_whole_order(spark):
    rng = random.Random(12)
    for keys in (range(500), [0] * 300 + list(range(1, 201))):
        rows = [(k, rng.gauss(0.0, 1.0), rng.random() < 0.2) for k in keys]
        df = spark.createDataFrame(rows, "k int, v double, c boolean")
        hashed = df.crossJoin(spark.range(1, 61).select(F.col("id").cast("int").alias("r"))).withColumn("h", F.xxhash64(F.lit(7), "k", "r")).collect()
        n1 = sum(c for *_, c in rows)
        difference = lambda cases, rest: sum(cases) / len(cases) - sum(rest) / len(rest)
        observed = difference([v for _, v, c in rows if c], [v for _, v, c in rows if not c])
        extreme = 0
        for r in range(1, 61):
            order = [x.v for x in sorted((x for x in hashed if x.r == r), key=lambda x: (x.h, x.k, x.v))]
            extreme += abs(difference(order[:n1], order[n1:])) >= abs(observed)
        got = stats.permutation_p(df, "k", "v", F.col("c"), 60).first()
        assert got.observed == pytest.approx(observed) and got.p == pytest.approx((extreme + 1) / 61)


def test_log_factorial(spark):
    got = spark.range(0, 400).union(spark.createDataFrame([(10_000_000,)], "id long")).select("id", dist.log_factorial(F.col("id")).alias("f")).collect()
    assert all(r.f == pytest.approx(math.lgamma(r.id + 1), rel=1e-14, abs=1e-13) for r in got)


def test_quality_report_counts_distinct_values(spark):
    df = spark.createDataFrame([(i % 7, None if i % 2 else "x") for i in range(100)], "a int, b string")
    got = {r.column: r for r in schema.quality_report(df).collect()}
    assert (got["a"].rows, got["a"].missing, got["a"].distinct) == (100, 0, 7)
    assert (got["b"].missing, got["b"].distinct, got["b"].smallest) == (50, 1, "x")
