"""Communities, skeletons, null graphs, negative samples, information and count models against plain numpy."""

import itertools
import math
from collections import Counter
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import communities, countmodels, information, modules, nullgraph, sampling, skeleton


def modularity(edges, label):
    m = sum(w for _, _, w in edges)
    k = Counter()
    for a, b, w in edges:
        k[a] += w
        k[b] += w
    inside, total = Counter(), Counter()
    for a, b, w in edges:
        if label[a] == label[b]:
            inside[label[a]] += w
    for n, x in k.items():
        total[label[n]] += x
    return sum(inside[c] / m - (total[c] / (2 * m)) ** 2 for c in total)


def local_louvain(edges, seed):
    """One node after another, then contraction."""
    rng, where = np.random.default_rng(seed), {}
    weights = Counter()
    for a, b, w in edges:
        weights[a, b] += w
        weights[b, a] += w
    two_m = sum(weights.values())
    nodes = sorted({a for a, _ in weights})
    where = {n: n for n in nodes}
    while True:
        k, near = Counter(), {}
        for (a, b), w in weights.items():
            k[a] += w
            if a != b:
                near.setdefault(a, []).append((b, w))
        label, total, moved = {n: n for n in k}, Counter(k), True
        while moved:
            moved = False
            for n in rng.permutation(sorted(k)).tolist():
                own, links = label[n], Counter()
                for b, w in near.get(n, []):
                    links[label[b]] += w
                total[own] -= k[n]
                best = max(links | Counter({own: links[own]}) or {own: 0}, key=lambda c: (links[c] - k[n] * total[c] / two_m, c == own))
                if links[best] - k[n] * total[best] / two_m > links[own] - k[n] * total[own] / two_m + 1e-12:
                    label[n], moved = best, True
                total[label[n]] += k[n]
        where = {n: label[c] for n, c in where.items()}
        if len(set(label.values())) == len(label):
            return where
        merged = Counter()
        for (a, b), w in weights.items():
            merged[label[a], label[b]] += w
        weights = merged


def test_louvain(spark):
    rng = np.random.default_rng(1)
    group = {n: n // 12 for n in range(36)}
    edges = [(a, b, float(rng.integers(1, 4))) for a, b in itertools.combinations(range(36), 2) if rng.random() < (0.45 if group[a] == group[b] else 0.04)]
    edges += [(100, 100 + i, 1.0) for i in range(1, 30)]  # a hub and its leaves
    df = spark.createDataFrame([*edges, (3, 3, 9.0), (7, 8, -1.0)], "src int, dst int, w double")
    found = communities.louvain(df).collect()
    label = {r.node: r.community for r in found}
    assert len(found) == len(label) == len({x for e in edges for x in e[:2]})
    got, best = modularity(edges, label), max(modularity(edges, local_louvain(edges, s)) for s in range(3))
    assert got >= 0.98 * best, (got, best)
    assert len({label[100 + i] for i in range(30)}) == 1
    measured = communities.modularity(spark.createDataFrame(edges, "src int, dst int, w double"), spark.createDataFrame(list(label.items()), "node int, community int")).first()[0]
    assert math.isclose(measured, got, rel_tol=1e-9)
    assert communities.louvain(df.limit(0)).count() == 0


def test_moves_never_lose(spark):
    """Every batch of moves that is let through raises modularity."""
    rng = np.random.default_rng(5)
    edges = {tuple(sorted(rng.choice(40, 2, replace=False).tolist())): float(rng.integers(1, 9)) for _ in range(200)}
    rows = [(a, b, w) for (a, b), w in edges.items()]
    k = Counter()
    for a, b, w in rows:
        k[a] += w
        k[b] += w
    two_m = sum(k.values())
    label = {n: n % 9 for n in k}
    total = Counter()
    for n, c in label.items():
        total[c] += k[n]
    offers = []
    for n in k:
        if label[n] % 2:
            continue
        links = Counter()
        for a, b, w in rows:
            if n in (a, b):
                links[label[b if a == n else a]] += w
        gain, to = max((links[c] - links[label[n]] - k[n] * (total[c] - total[label[n]] + k[n]) / two_m, c) for c in range(1, 9, 2))
        if gain > 0:
            offers.append((n, k[n], label[n], to, gain))
    moves = communities._accepted(spark.createDataFrame(offers, "node int, k double, own int, to int, gain double"), two_m).collect()
    assert 0 < len(moves) <= len(offers)
    assert modularity(rows, label | {m.node: m.to for m in moves}) > modularity(rows, label)


def naive_skeleton(c, n, alpha):
    p, z_limit = len(c), NormalDist().inv_cdf(1 - alpha / 2)
    adj = {i: set(range(p)) - {i} for i in range(p)}
    separated, level = {}, 0
    while level == 0 or any(len(a) - 1 >= level for a in adj.values()):
        if n - level - 3 <= 0:
            break
        gone = {}
        for i in range(p):
            for j in adj[i]:
                for s in itertools.combinations(sorted(adj[i] - {j}), level):
                    at = [i, j, *s]
                    q = np.linalg.inv(c[np.ix_(at, at)])
                    z = math.sqrt(n - level - 3) * abs(math.atanh(-q[0, 1] / math.sqrt(q[0, 0] * q[1, 1])))
                    if z <= z_limit:
                        key = (min(i, j), max(i, j))
                        gone[key] = min(gone.get(key, (9e9, ())), (z, s))
        for i, j in gone:
            adj[i].discard(j)
            adj[j].discard(i)
        separated |= gone
        level += 1
    return {(i, j) for i in range(p) for j in adj[i] if i < j}, separated


def test_skeleton(spark):
    rng = np.random.default_rng(3)
    n, p = 300, 9
    x = rng.normal(size=(n, p))
    for i in range(1, p):
        x[:, i] += 0.8 * x[:, (i - 1) // 2] + (0.6 * x[:, i - 2] if i > 4 else 0)
    c = np.corrcoef(x.T)
    rows = [(j, i, float(c[i, j])) if (i + j) % 2 else (i, j, float(c[i, j])) for i, j in itertools.combinations(range(p), 2)]
    edges, removed = skeleton.skeleton(spark.createDataFrame(rows, "a int, b int, r double"), n, 0.05)
    want, separated = naive_skeleton(c, n, 0.05)
    assert {(e.a, e.b) for e in edges.collect()} == want and 5 < len(want) < 30
    got = {(r.a, r.b): (r.z, tuple(r.given)) for r in removed.collect()}
    assert set(got) == set(separated) and max(len(s) for _, s in got.values()) >= 2
    for k, (z, s) in got.items():
        assert math.isclose(z, separated[k][0], abs_tol=1e-6) and s == separated[k][1]
    assert skeleton.skeleton(spark.createDataFrame([], "a int, b int, r double"), 10)[0].count() == 0


def test_rewired(spark):
    rng = np.random.default_rng(2)
    edges = {tuple(sorted(rng.choice(25, 2, replace=False).tolist())) for _ in range(70)} | {(0, i) for i in range(1, 20)}
    df = spark.createDataFrame([*edges, (3, 3), next((b, a) for a, b in edges)], "src int, dst int")
    degree = Counter(x for e in edges for x in e)
    out = nullgraph.rewired(df, replicates=3, rounds=5)
    by_rep = {}
    for r in out.collect():
        assert r.src < r.dst
        by_rep.setdefault(r.rep, []).append((r.src, r.dst))
    assert set(by_rep) == {1, 2, 3}
    for own in by_rep.values():
        assert len(own) == len(set(own)) == len(edges) and Counter(x for e in own for x in e) == degree
        assert len(set(own) - edges) > 20
    assert set(by_rep[1]) != set(by_rep[2])
    triangles = lambda e: sum(all(tuple(sorted(p)) in e for p in itertools.combinations(t, 2)) for t in itertools.combinations(range(25), 3))
    got = {r.rep: r.triangles for r in nullgraph.triangle_counts(out).collect()}
    assert all(got.get(k, 0) == triangles(set(e)) for k, e in by_rep.items())


def test_against_rewired(spark):
    clique = [(a, b) for a, b in itertools.combinations(range(8), 2)]
    ring = [(i, i + 1) for i in range(8, 60)] + [(60, 0)] + [(i, i + 7) for i in range(8, 50, 3)]
    rows = {r.measure: r for r in nullgraph.against_rewired(spark.createDataFrame(clique + ring, "src int, dst int"), spark.createDataFrame([(i,) for i in range(8)], "node int"), replicates=9, rounds=6).collect()}
    degree = Counter(x for e in clique + ring for x in e)
    assert math.isclose(rows["transitivity"].observed, 3 * 56 / sum(d * (d - 1) / 2 for d in degree.values()), rel_tol=0.05)
    assert rows["density"].observed == 1.0 and rows["density"].p == rows["transitivity"].p == 0.1 and rows["density"].mean < 0.9


def test_negative_edges_by_degree(spark):
    edges = [("a", i) for i in range(12)] + [("b", i) for i in range(4)] + [("c", 0)]
    df = spark.createDataFrame([*edges, ("a", 0), (None, 3)], "src string, dst int")
    extra = spark.createDataFrame([("d",)], "node string"), spark.createDataFrame([(i,) for i in range(16)], "node int")
    n = 20_000
    got = sampling.negative_edges_by_degree(df, n, sources=extra[0], targets=extra[1]).collect()
    assert len(got) == n and not {(r.src, r.dst) for r in got} & set(edges)
    out, back = Counter(a for a, _ in edges), Counter(b for _, b in edges)
    weight = {(a, b): max(out[a], 1) ** 0.75 * max(back[b], 1) ** 0.75 for a in "abcd" for b in range(16) if (a, b) not in edges}
    counts, total = Counter((r.src, r.dst) for r in got), sum(weight.values())
    assert set(counts) <= set(weight)
    chi2 = sum((counts[p] - n * w / total) ** 2 / (n * w / total) for p, w in weight.items())
    assert chi2 < len(weight) + 5 * math.sqrt(2 * len(weight))
    every = sampling.negative_edges_by_degree(df, len(weight), sources=extra[0], targets=extra[1], distinct=True).collect()
    assert {(r.src, r.dst) for r in every} == set(weight) and len(every) == len(weight)
    with pytest.raises(ValueError):
        sampling.negative_edges_by_degree(df, len(weight) + 1, sources=extra[0], targets=extra[1], distinct=True)
    assert sampling.negative_edges_by_degree(df, 0).count() == 0


def test_negative_pool(spark):
    nodes = spark.createDataFrame([(i,) for i in range(2000)], "node int")
    degrees = nodes.where("node % 2 = 0").withColumn("degree", F.lit(9).cast("long"))
    got = sampling.negative_pool(nodes, degrees).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 2001)) and len({r.node for r in got}) == 2000
    early = sum(r.degree == 0 for r in got[:200])
    assert 165 < early < 198  # ten times the weight


def naive_information(x, y, k):
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    sizes = Counter(y)
    at = [i for i in range(len(x)) if sizes[y[i]] > 1]
    terms = []
    for i in at:
        gaps = sorted(abs(x[i] - x[j]) for j in at if j != i and y[j] == y[i])
        own = min(k, sizes[y[i]] - 1)
        d = gaps[own - 1]
        m = sum(abs(x[i] - x[j]) < d - 1e-9 or d == 0 and x[i] == x[j] for j in at)
        terms.append((psi(own), psi(sizes[y[i]]), psi(max(m, 1))))
    a, b, c = np.mean(terms, axis=0)
    return max(0.0, psi(len(at)) + a - b - c)


@pytest.mark.parametrize("stretch", [7, 4096])
def test_mutual_information(spark, monkeypatch, stretch):
    monkeypatch.setattr(information, "STRETCH", stretch)
    rng = np.random.default_rng(4)
    y = ["a"] * 200 + ["b"] * 240 + ["c"] * 57 + ["d"] * 2 + ["e"]
    data = {"near": rng.normal(size=500) + np.array([{"a": 0, "b": 2, "c": 5, "d": 1, "e": 0}[v] for v in y]), "none": rng.normal(size=500), "whole": rng.integers(0, 6, 500).astype(float)}
    rows = [(y[i], *(float(data[f][i]) for f in data)) for i in range(500)] + [(None, 1.0, 1.0, 1.0), ("a", None, None, None)]
    got = {r.feature: r for r in information.mutual_information(spark.createDataFrame(rows, "y string, near double, none double, whole double"), list(data), "y").collect()}
    for f, x in data.items():
        assert got[f].n == 499 and math.isclose(got[f].mi, naive_information(x, y, 3), abs_tol=1e-9), f
    assert got["near"].mi > 0.5 > got["none"].mi


def test_select_features(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 300)
    a, b, c = rng.normal(size=300) + 2 * y, rng.normal(size=300) + y, rng.normal(size=300)
    rows = [(int(y[i]), float(a[i]), float(a[i] + 0.01 * c[i]), float(b[i]), float(c[i])) for i in range(300)]
    got = {r.feature: r for r in information.select_features(spark.createDataFrame(rows, "y int, a double, twin double, b double, c double"), ["a", "twin", "b", "c"], "y", most=3).collect()}
    assert len(got) == 3 and {"a", "twin"} <= set(got)
    assert got["a"].kept != got["twin"].kept and sum(r.kept for r in got.values()) == 2


def test_count_test(spark):
    rng = np.random.default_rng(7)
    samples, depth = 10, rng.uniform(0.5, 2, 10)
    case = np.array([0] * 5 + [1] * 5)
    rows, counts = [], {}
    for g in range(40):
        base, fold, a = rng.uniform(5, 300), (4.0 if g < 5 else 1.0), 0.1
        mu = base * depth * np.where(case == 1, fold, 1)
        counts[g] = rng.negative_binomial(1 / a, 1 / (1 + a * mu))
        rows += [(g, j, int(counts[g][j]), bool(case[j])) for j in range(samples)]
    counts[98] = np.array([0] * 5 + [3, 0, 8, 1, 2])
    rows += [(98, j, int(counts[98][j]), bool(case[j])) for j in range(samples)] + [(99, j, 0, bool(case[j])) for j in range(samples)] + [(0, None, 5, True), (97, 0, None, True)]
    df = spark.createDataFrame(rows, "g int, s int, y int, c boolean")
    whole = [g for g in counts if (counts[g] > 0).all()]
    logs = np.array([np.log(counts[g]) for g in whole])
    size = np.exp(np.sort(logs - logs.mean(1, keepdims=True), axis=0)[(len(whole) - 1) // 2])
    got_size = {r.s: r["size"] for r in countmodels.size_factors(df.where("s is not null and y is not null"), "s", "g", "y").collect()}
    assert np.allclose([got_size[j] for j in range(samples)], size)
    spread = {r.g: r for r in countmodels.dispersions(df.where("s is not null and y is not null").select("g", F.col("s"), F.col("y").cast("double").alias("y"), F.col("c").cast("int").alias("x")).join(spark.createDataFrame([(j, float(size[j])) for j in range(samples)], "s int, size double"), "s"), "g").collect()}
    for g, y in counts.items():
        v = y / size
        own = ((v[case == 0].var(ddof=1) + v[case == 1].var(ddof=1)) / 2 - v.mean() * (1 / size).mean()) / v.mean() ** 2
        assert math.isclose(spread[g].own, max(1e-8, own), rel_tol=1e-9)
        low, high = sorted((spread[g].own, spread[g].trend))
        assert low * (1 - 1e-9) <= spread[g].dispersion <= high * (1 + 1e-9)
    out = {r.g: r for r in countmodels.count_test(df, "s", "g", "y", "c").collect()}
    assert set(out) == set(counts), (set(counts) - set(out), set(out) - set(counts))
    for g, y in counts.items():
        a, b = out[g].dispersion, np.array([math.log(y.mean() + 0.1), 0.0])
        x = np.stack([np.ones(samples), case], 1)
        for _ in range(300):
            mu = size * np.exp(np.clip(x @ b, -60, 60))
            w = mu / (1 + a * mu)
            new = np.linalg.solve(x.T @ (w[:, None] * x) + 1e-6 * np.eye(2), x.T @ (w * (x @ b + (y - mu) / mu)))
            b = np.clip(b + np.clip(new - b, -5, 5), -30, 30)
        if g == 98:
            assert out[g].log2_fold > 5 and out[g].p > 0.05
            continue
        se = math.sqrt(np.linalg.inv(x.T @ (w[:, None] * x))[1, 1])
        assert math.isclose(out[g].log2_fold, b[1] / math.log(2), abs_tol=1e-6) and math.isclose(out[g].se, se / math.log(2), rel_tol=1e-5)
        assert math.isclose(out[g].p, math.erfc(abs(b[1] / se) / math.sqrt(2)), rel_tol=1e-4, abs_tol=1e-12)
    assert all(out[g].q < 0.01 for g in range(5)) and sum(out[g].q < 0.05 for g in range(5, 40)) <= 4


def expression(seed, members=200, samples=40):
    """Three groups of members that follow a profile each, the rest noise."""
    rng = np.random.default_rng(seed)
    profiles = rng.normal(size=(3, samples))
    x = rng.normal(size=(members, samples))
    for i in range(members):
        if i % 5 < 3:
            x[i] = profiles[i % 5] * rng.uniform(0.7, 1) + x[i] * 0.6
    return x


def overlap(c, power):
    a = np.abs(c) ** power
    np.fill_diagonal(a, 0)
    k = a.sum(1)
    return (a @ a + a) / (np.minimum(k[:, None], k[None, :]) + 1 - a)


def local_linkage(d):
    """Average linkage, one merge after another: {members: height}, leaves first."""
    clusters, sums, merges = {i: (i,) for i in range(len(d))}, {(i, j): d[i, j] for i in range(len(d)) for j in range(i + 1, len(d))}, []
    while len(clusters) > 1:
        (a, b), _ = min(sums.items(), key=lambda e: (round(e[1] / (len(clusters[e[0][0]]) * len(clusters[e[0][1]])), 12), e[0]))
        merges.append((clusters[a], clusters[b], sums[a, b] / (len(clusters[a]) * len(clusters[b]))))
        for c in clusters:
            if c not in (a, b):
                x, y = (min(a, c), max(a, c)), (min(b, c), max(b, c))
                sums[x] += sums.pop(y)
        del sums[a, b]
        clusters[a] = clusters[a] + clusters.pop(b)
    return merges


def local_cut(merges, n, least, gap, top):
    heights = sorted(h for _, _, h in merges)
    low = heights[max(0, math.ceil(0.05 * len(heights)) - 1)]
    limit = low + top * (heights[-1] - low)
    state, module = {(i,): (True, 0.0) for i in range(n)}, {}
    for a, b, h in merges:
        if h > limit:
            continue
        sa, sb = state.pop(a), state.pop(b)
        alone = lambda s, c: s[0] and len(c) >= least and h - s[1] / max(len(c) - 1, 1) >= gap * (h - low)  # noqa: B023, E731
        pa, pb = alone(sa, a) and (alone(sb, b) or not sb[0]), alone(sb, b) and (alone(sa, a) or not sa[0])
        for c, p, s, o in ((a, pa, sa, sb), (b, pb, sb, sa)):
            if p or s[0] and not o[0]:
                module |= {m: min(c) if p else None for m in c}
        state[a + b] = (sa[0] and sb[0] and not pa and not pb, sa[1] + sb[1] + h)
    for c, s in state.items():
        for m in c:
            if m not in module:
                module[m] = min(c) if s[0] and len(c) >= least else None
    return module


@pytest.mark.parametrize("block", [64, 512])
def test_topological_overlap(spark, block):
    c = np.corrcoef(expression(1, 90))
    rows = [(i, j, float(c[i, j])) for i, j in itertools.combinations(range(90), 2)]
    got = {(r.a, r.b): r.overlap for r in modules.topological_overlap(spark.createDataFrame([*rows, (4, 4, 1.0)], "a int, b int, r double"), 6, block=block).collect()}
    want = overlap(c, 6)
    assert len(got) == len(rows) and all(math.isclose(got[i, j], want[i, j], rel_tol=1e-9) for i, j, _ in rows)


def test_modules_equal_a_local_linkage(spark):
    n = 200  # the whole tree must be the same, merge by merge
    want = overlap(np.corrcoef(expression(2, n)), 6)
    distances = 1 - want
    rows = [(i, j, float(distances[i, j])) for i, j in itertools.combinations(range(n), 2)]
    merges = modules.average_linkage(spark.createDataFrame(rows, "a int, b int, d double"))
    tree = merges.collect()
    local = local_linkage(distances)
    assert len(tree) == n - 1 and np.allclose(sorted(r.height for r in tree), sorted(h for _, _, h in local), atol=1e-9)
    assert {(r.a, r.b, r.n_a, r.n_b) for r in tree} == {(min(a), min(b), len(a), len(b)) if min(a) < min(b) else (min(b), min(a), len(b), len(a)) for a, b, _ in local}
    members = spark.createDataFrame([(i,) for i in range(n)], "member int")
    got = {r.member: r.module for r in modules.cut_modules(merges, members, least=20).collect()}
    assert got == local_cut(local, n, 20, 0.25, 0.99)
    sizes = Counter(m for m in got.values() if m is not None)
    assert len(sizes) == 3 and all(got[x] == x % 5 for x in got if x % 5 < 3 and got[x] is not None) and min(sizes.values()) > 25


def test_soft_thresholds(spark):
    c = np.corrcoef(expression(3, 80))
    rows = [(i, j, float(c[i, j])) for i, j in itertools.combinations(range(80), 2)]
    for r in modules.soft_thresholds(spark.createDataFrame(rows, "a int, b int, r double"), (1, 4, 9)).collect():
        a = np.abs(c) ** r.power
        np.fill_diagonal(a, 0)
        k = a.sum(1)
        bins = np.minimum(9, ((k - k.min()) / ((k.max() - k.min()) / 10)).astype(int))
        x = [np.log10(k[bins == i].mean() if (bins == i).any() else k.min() + (i + 0.5) * (k.max() - k.min()) / 10) for i in range(10)]
        y = [np.log10((bins == i).mean() + 1e-9) for i in range(10)]
        assert math.isclose(r.fit, np.corrcoef(x, y)[0, 1] ** 2, rel_tol=1e-6) and math.isclose(r.slope, np.polyfit(x, y, 1)[0], rel_tol=1e-6)
        assert math.isclose(r.mean_k, k.mean()) and math.isclose(r.max_k, k.max())
