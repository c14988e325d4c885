import numpy as np

from quern.operators import neighbours


def graph_of(spark, x, ids=None, **how):
    rows = [(int(i), [float(v) for v in r], "x") for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return neighbours.neighbour_graph(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string"), "vec_id", "embedding", **how)


def test_recall_of_the_neighbour_graph(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 500)  # four parts a tree
    monkeypatch.setattr(neighbours, "MEET", 8)  # nodes that many name are several groups
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((20, 16))[rng.integers(0, 20, 1500)] * 1.5 + rng.standard_normal((1500, 16))).round(6)
    got = graph_of(spark, x, k=10)[0].collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, 1)[:, :10]
    assert len(got) == 15000 and all(abs(r.distance - d[r.id, r.neighbour]) < 1e-9 for r in got)
    found = {(r.id, r.neighbour) for r in got}
    assert sum((i, int(j)) in found for i, row in enumerate(want) for j in row) / 15000 >= 0.95


def test_copies_nulls_and_small_tables(spark):
    x = [[0.0, 0.0]] * 300 + [[1.0, 0.0], [0.0, 3.0]]
    graph, members = graph_of(spark, x, k=5)
    assert [(r.id, r.neighbour, r["rank"], round(r.distance, 6)) for r in graph.orderBy("id", "rank").collect()] == [(0, 300, 1, 1.0), (0, 301, 2, 3.0), (300, 0, 1, 1.0), (300, 301, 2, 3.162278), (301, 0, 1, 3.0), (301, 300, 2, 3.162278)]
    assert members.where("id = 0").count() == 300 and members.count() == 302
    empty = spark.createDataFrame([(None, [1.0]), (1, None)], "vec_id long, embedding array<double>")
    graph, members = neighbours.neighbour_graph(empty, "vec_id", "embedding")
    assert graph.count() == 0 and members.count() == 0


def test_variable_features_against_numpy(spark):
    rng = np.random.default_rng(5)
    m = rng.poisson((0.5 + rng.gamma(1.0, 3.0, (60, 1))) * rng.gamma(2.0, 0.5, (60, 40)))
    m[7] = 0
    rows = [(f, s, float(m[f, s])) for f in range(60) for s in range(40) if m[f, s] or f == 7]
    got = {r.feature: r for r in neighbours.variable_features(spark.createDataFrame(rows, "g long, s long, n double"), "g", "s", "n", 40).collect()}
    x = m / m.sum(0) * 1e4
    mean, var = x.mean(1), x.var(1, ddof=1)
    low, high = np.log1p(mean).min(), np.log1p(mean).max()
    bins = np.clip(np.ceil((np.log1p(mean) - low) * 20 / (high - low)), 1, 20)
    assert sorted(r["rank"] for r in got.values()) == list(range(1, 61)) and got[7].dispersion is None
    for f in range(60):
        assert abs(got[f].mean - np.log1p(mean[f])) < 1e-9
        if f != 7:
            with_it = [g for g in range(60) if bins[g] == bins[f] and g != 7]
            d = np.log(var[with_it] / mean[with_it])
            own = np.log(var[f] / mean[f])
            assert abs(got[f].dispersion - own) < 1e-9
            assert abs(got[f].normalised - (1.0 if len(d) == 1 else (own - d.mean()) / d.std(ddof=1))) < 1e-7
    assert neighbours.variable_features(spark.createDataFrame([], "g long, s long, n double"), "g", "s", "n", 40).count() == 0
