"""Simulated nulls, shrunk variances, kernels and distributed orders against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import dist
from quern.operators import moderated, norm, order, presso, ranks, setnull


def rows_of(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for gene, n, bad in ((1, 12, 2), (2, 30, 0), (3, 3, 0), (4, 8, 1), (5, 4, 0)):
        for i in range(n):
            x, s = rng.uniform(0.1, 0.5), rng.uniform(0.02, 0.05)
            y = 0.4 * x + rng.normal(0, s) + (1.2 if i < bad else 0)
            rows.append((gene, i, float(x * (-1) ** i), 0.02, float(y * (-1) ** i), float(s)))
    return rows


SCHEMA = "gene int, snp int, beta double, se double, beta_out double, se_out double"


def test_presso(spark):
    """The draws come from the same column expressions; everything else is recomputed one replicate and variant at a time."""
    rows, replicates = rows_of(), 400
    df = spark.createDataFrame(rows + [(1, 99, None, 0.1, 0.1, 0.1), (1, 98, 0.1, 0.0, 0.1, 0.1)], SCHEMA)
    results, variants = presso.presso(df, ["gene"], ["snp"], replicates=replicates, level=0.1)
    got = {r.gene: r for r in results.collect()}
    outliers = {(r.gene, r.snp): r for r in variants.collect()}
    keyed = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.xxhash64("gene", "snp")).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    zx, zy = presso._normals(42, F.col("key"), F.col("r"))
    u = presso.uniform(F.lit(42), F.lit(3), F.col("key"), F.col("r"))
    draws = {(d.gene, d.snp, d.r): (d.zx, d.zy, d.u) for d in keyed.select("gene", "snp", "r", zx.alias("zx"), zy.alias("zy"), u.alias("u")).collect()}
    z = np.array([d[:2] for d in draws.values()])
    assert np.abs(z.mean(0)).max() < 0.03 and np.abs(z.std(0) - 1).max() < 0.03 and abs(np.corrcoef(z.T)[0, 1]) < 0.03

    def slopes(x, y, w):
        xx, xy = w * x * x, w * x * y
        return (xy.sum() - xy) / (xx.sum() - xx)

    assert set(got) == {1, 2, 4, 5}
    for gene, r in got.items():
        own = [v for v in rows if v[0] == gene]
        sign = np.sign([v[2] for v in own])
        x, sx, y, sy = np.abs([v[2] for v in own]), np.array([v[3] for v in own]), np.array([v[4] for v in own]) * sign, np.array([v[5] for v in own])
        w, n = 1 / sy**2, len(own)
        rest = slopes(x, y, w)
        gap = y - rest * x
        sums, gaps = [], []
        for k in range(1, replicates + 1):
            d = np.array([draws[gene, v[1], k][:2] for v in own])
            rx, ry = x + sx * d[:, 0], rest * x + sy * d[:, 1]
            g = ry - slopes(rx, ry, w) * rx
            sums.append((w * g * g).sum())
            gaps.append(g * g)
        beta = (w * x * y).sum() / (w * x * x).sum()
        assert r.n_snp == n and math.isclose(r.beta, beta) and math.isclose(r.rss, (w * gap**2).sum(), rel_tol=1e-9)
        assert math.isclose(r.p, np.mean(np.array(sums) > (w * gap**2).sum()), abs_tol=1e-12)
        if r.p >= 0.1:
            assert r.n_outliers == 0 and r.beta_corrected is None and (gene, 0) not in outliers
            continue
        p = np.minimum(1, (np.array(gaps) > gap**2).mean(0) * n)
        assert [outliers[gene, v[1]].p for v in own] == pytest.approx(p.tolist())
        out = p <= 0.1
        assert [outliers[gene, v[1]].outlier for v in own] == out.tolist() and r.n_outliers == out.sum()
        kept = (w * x * y)[~out].sum() / (w * x * x)[~out].sum()
        assert math.isclose(r.beta_corrected, kept) and math.isclose(r.distortion, (beta - kept) / abs(kept))
        rate, above = max(0, (n - 2 * out.sum()) / (n - out.sum())), 0
        for k in range(1, replicates + 1):
            times = []
            for v, o in zip(own, out):
                term = c = math.exp(-rate)
                t = 0
                for j in range(1, 17):
                    t += draws[gene, v[1], k][2] > c
                    term *= rate / j
                    c += term
                times.append(1 if o else t)
            times = np.array(times)
            b = (times * w * x * y).sum() / (times * w * x * x).sum()
            above += abs((beta - b) / abs(b)) > abs(r.distortion)
        assert math.isclose(r.distortion_p, above / replicates, abs_tol=1e-12)
    assert got[1].n_outliers >= 2 and abs(got[1].beta_corrected - 0.4) < 0.2


def polygamma(x):
    """(digamma, trigamma) by differences of lgamma and by their sums."""
    i = np.arange(200_000)
    return math.log(x + 200_000) - 0.5 / (x + 200_000) - (1 / (x + i)).sum(), (1 / (x + i) ** 2).sum() + 1 / (x + 200_000) + 0.5 / (x + 200_000) ** 2


def test_digamma_and_trigamma(spark):
    xs = [0.5, 1.0, 1.5, 3.0, 17.25, 400.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", dist.digamma(F.col("x")).alias("d"), dist.trigamma(F.col("x")).alias("t"), dist.trigamma_inverse(dist.trigamma(F.col("x"))).alias("i"), (dist.trigamma(F.col("x") + 1e-4) - dist.trigamma(F.col("x") - 1e-4)).alias("n"), dist.tetragamma(F.col("x")).alias("tt")).collect()
    for r in got:
        d, t = polygamma(r.x)
        assert math.isclose(r.d, d, rel_tol=1e-9, abs_tol=1e-10) and math.isclose(r.t, t, rel_tol=1e-9) and math.isclose(r.i, r.x, rel_tol=1e-8) and math.isclose(r.n / 2e-4, r.tt, rel_tol=1e-5)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_moderated_t(spark, spread):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(60):
        sd = math.exp(rng.normal(0, spread))
        rows += [(g, bool(c), float(rng.normal(c * (g < 5) * 3, sd))) for c in (0, 0, 0, 0, 1, 1, 1)]
    rows += [(100, True, 1.0), (101, True, 1.0), (101, False, None), (102, False, 2.0), (102, True, None)]
    got = {r.g: r for r in moderated.moderated_t(spark.createDataFrame(rows, "g int, c boolean, v double"), ["g"], "v", F.col("c")).collect()}
    assert set(got) == set(range(60))
    s2, diff = [], []
    for g in range(60):
        a, b = (np.array([v for x, c, v in rows if x == g and c == k]) for k in (True, False))
        s2.append((a.var(ddof=1) * 2 + b.var(ddof=1) * 3) / 5)
        diff.append(a.mean() - b.mean())
    s2 = np.array(s2)
    d, t = polygamma(2.5)
    e = np.log(s2) - d + math.log(2.5)
    excess = e.var(ddof=1) - t
    if excess > 0:
        low, high = 1e-4, 1e6
        for _ in range(200):
            mid = math.sqrt(low * high)
            low, high = (mid, high) if polygamma(mid)[1] > excess else (low, mid)
        d0, v0 = 2 * low, math.exp(e.mean() + polygamma(low)[0] - math.log(low))
        post, df = (d0 * v0 + 5 * s2) / (d0 + 5), min(d0 + 5, 300)
    else:
        post, df = np.full(60, math.exp(e.mean())), 300
    for g in range(60):
        assert math.isclose(got[g].t, diff[g] / math.sqrt(post[g] * (1 / 3 + 1 / 4)), rel_tol=1e-6) and math.isclose(got[g].df, df, rel_tol=1e-6)
    assert all(0 < r.p <= r.q <= 1 for r in got.values())


def test_permuted_enrichment(spark):
    rng = np.random.default_rng(2)
    ranked = [(f"m{i}", float(rng.normal())) for i in range(80)] + [("null", None)]
    sets = [("top", m) for m, _ in sorted(ranked[:-1], key=lambda x: -x[1])[:8]] + [("mixed", f"m{i}") for i in range(0, 80, 9)] + [("mixed", "m0"), ("mixed", "absent"), ("none", "absent"), ("all", "null")] + [("all", f"m{i}") for i in range(80)]
    got = {r.k: r for r in setnull.permuted_enrichment(spark.createDataFrame(ranked, "m string, s double"), spark.createDataFrame(sets, "k string, m string"), "m", "s", "k", replicates=300).collect()}
    listed = [m for m, s in sorted(((m, s) for m, s in ranked if s is not None), key=lambda x: (-x[1], x[0]))]

    def walk(hits):
        at = np.array([m in hits for m in listed])
        return np.abs(np.cumsum(at) / at.sum() - np.arange(1, len(listed) + 1) / len(listed)).max() if at.any() else 0.0

    for k, r in got.items():
        members = {m for s, m in sets if s == k}
        assert r.n_set == len(members) and math.isclose(r.es, walk(members), abs_tol=1e-12)
        if not r.n_hits:
            assert (r.nes, r.p) == (0, 1)
            continue
        size = min(r.n_set, 80)
        null = []
        for i in range(1, 301):
            drawn = set(np.random.default_rng([42, 80, size, i]).choice(80, size, replace=False, shuffle=False).tolist())
            null.append(walk({listed[j] for j in drawn}))
        null = np.array(null)
        assert math.isclose(r.p, (null >= r.es - 1e-15).mean(), abs_tol=0.011)
        assert math.isclose(r.nes, (r.es - null.mean()) / null.std() if null.std() > 1e-15 else r.es, abs_tol=1e-6)
    assert got["top"].p < 0.01 and got["top"].nes > 3


@pytest.mark.parametrize("block", [3, 2048])
def test_kernel_scores(spark, block):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(12, 7)).round(2)
    values[3] = 1.0
    rows = [(f"g{i}", f"s{j}", float(values[i, j])) for i in range(12) for j in range(7)] + [("g0", "s9", None)]
    df = spark.createDataFrame(rows, "m string, s string, v double")
    phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    want = {(f"g{i}", f"s{j}"): sum(phi((values[i, j] - y) / (values[i].std(ddof=1) / 4)) for y in values[i]) / 7 for i in range(12) if i != 3 for j in range(7)}
    got = {(r.m, r.s): r.density for r in setnull.kernel_density(df, "s", "m", "v", block).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    sets = {"a": {"g0", "g5", "g7"}, "b": {"g1", "g3", "absent"}, "all": {f"g{i}" for i in range(12)}}
    scores = setnull.kernel_scores(df, spark.createDataFrame([(k, m) for k, x in sets.items() for m in x], "k string, m string"), "s", "m", "v", "k", taus=(0.25, 2.0))
    scored = {(r.s, r.k, r.tau, r.mx_diff): r.score for r in scores.collect()}
    assert {k for _, k, _, _ in scored} == {"a", "b"}
    for (s, k, tau, diff), score in scored.items():
        listed = sorted((m for m, x in want if x == s), key=lambda m: (-round(want[m, s], 9), m))
        p, y, walk = len(listed), 0.0, [0.0]
        weight = {m: abs(p - l + 1 - p / 2) ** tau for l, m in enumerate(listed, 1)}
        total, hits = sum(weight[m] for m in listed if m in sets[k]), sum(m in sets[k] for m in listed)
        for m in listed:
            y += weight[m] / total if m in sets[k] else -1 / (p - hits)
            walk.append(y)
        up, low = max(walk), min(walk)
        assert math.isclose(score, up + low if diff else (up if round(up + low, 9) > 0 else low), abs_tol=1e-9)


def test_normal_tail():
    z = np.linspace(-9, 30, 2000)
    want = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in z])
    assert np.allclose(dist.normal_upper_array(z), want, rtol=1e-12, atol=0)


def test_orders_by_ranges(spark):
    rng = np.random.default_rng(8)
    rows = [(("a", "b", None)[int(rng.integers(0, 3))], int(rng.integers(0, 9)) if i % 10 else None, i) for i in range(600)] + [("a", 5, 1000 + i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = {r.id: r.place for r in order.place(df, [F.asc_nulls_last("v"), F.desc("id")], ["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, -r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
    present = [r[1] for r in rows if r[1] is not None]
    for method, f in {"min": lambda v: 1 + sum(x > v for x in present), "dense": lambda v: 1 + len({x for x in present if x > v}), "average": lambda v: sum(x > v for x in present) + (present.count(v) + 1) / 2}.items():
        for r in ranks.rank(df, "v", method=method, descending=True).collect():
            assert r["rank"] == (None if r.v is None else f(r.v))
    ordinal = {r.id: r["rank"] for r in ranks.rank(df, "v", method="ordinal", ties=["id"]).collect()}
    assert [i for _, i in sorted((p, i) for i, p in ordinal.items() if p)] == [r[2] for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2]))]
    z = {r.id: r.z for r in norm.zscore(df, "v").collect()}
    assert all((z[i] is None) == (v is None) and (v is None or math.isclose(z[i], (v - np.mean(present)) / np.std(present, ddof=1))) for _, v, i in rows)
    p = df.withColumn("p", (F.col("v") + 1) / 10)
    q = {r.id: r.q for r in ranks.benjamini_hochberg(p, "p").collect()}
    n = len(present)
    adjusted = {v: min(1, min((x + 1) / 10 * n / sum(y <= x for y in present) for x in present if x >= v)) for v in set(present)}
    assert all((q[i] is None) == (v is None) and (v is None or math.isclose(q[i], adjusted[v])) for _, v, i in rows)
    assert order.place(df.limit(0), ["v"]).count() == 0 and ranks.benjamini_hochberg(p.limit(0), "p").count() == 0
