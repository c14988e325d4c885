"""Steps whose work or results went wrong on larger tables."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import scalar
from quern.operators import fusion, graph, intervals, mr, order, presso, ranks, sets, setnull
from quern.plans import analytics, files
from quern.plans.registry import Tables
from quern.sources import readers
from tests.test_inference import SCHEMA, rows_of

DATA = "/root/testdata/sf0.001"


def test_adjusted_values_that_change_when_computed_again(spark):
    """Sums over a shuffle differ in their last bits from one evaluation to the next; here the difference is larger."""
    again = F.udf(lambda i: random.random(), "double").asNondeterministic()
    df = spark.range(50).withColumn("p", again("id"))
    q = ranks.benjamini_hochberg(df, "p").collect()
    assert len(q) == 50 and all(r.q is not None and r.q >= r.p * (1 - 1e-9) for r in q)
    assert sorted(r["rank"] for r in ranks.rank(df, "p", method="min").collect()) == list(range(1, 51))


def test_pairs_of_parts_are_counted_once_by_enough_tasks(spark, monkeypatch):
    t = Tables(spark, DATA)
    assert analytics.edges(t) is analytics.edges(t)
    monkeypatch.setattr(analytics, "LINES_A_TASK", 500)
    tasks = 1 + t.lineitem.count() // 500
    assert tasks > 4 and analytics.together(t).rdd.getNumPartitions() == tasks
    assert sorted(analytics.together(t).collect()) == sorted(analytics.edges(t).collect())


def test_closeness_where_nothing_is_reached(spark):
    """Without a first step all hops are the literal 0, and 1 / hops must not be folded into an error."""
    edges, nodes = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"), spark.createDataFrame([(1,), (9,)], "node long")
    for e, sources in ((edges, nodes.where("node > 9")), (edges, nodes.where("node = 9")), (edges.where("src > 9"), nodes)):
        assert graph.closeness(e, sources, 3).collect() == [] and graph.reach(e, sources, 3).collect()[0].pairs == 0
    assert [tuple(r) for r in graph.closeness(edges, nodes, 3).collect()] == [(1, 2, 2 / 3, 1.5)]


def test_presso_in_pieces(spark, monkeypatch):
    """Draws in numpy are those of the column expressions; a group in pieces gives what it gives as a whole."""
    key = spark.range(7).select("id", F.xxhash64("id").alias("key"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("r"))
    want = np.array([r.u for r in key.select("id", "r", presso.uniform(F.lit(42), F.lit(3), F.col("key"), F.col("r")).alias("u")).orderBy("id", "r").collect()])
    keys = np.array([r[0] for r in key.select("key", "id").distinct().orderBy("id").collect()])
    assert (presso.uniforms(42, 3, keys, 9).ravel() == want).all()
    df = spark.createDataFrame(rows_of(), SCHEMA)
    tables = []
    for size in (1000, 5):
        monkeypatch.setattr(presso, "WHOLE", size)
        tables.append([sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect()) for d in presso.presso(df, ["gene"], ["snp"], replicates=100, level=0.1)])
    assert tables[0] == tables[1] and tables[0][0] and tables[0][1]


def test_presso_draws_once(spark, monkeypatch):
    """Two hashes for two normal draws, in blocks that nothing outlives; a group in one piece is redrawn in the same task."""
    n, replicates, hashed, plain = 40, 300, [], presso._bits
    rng = np.random.default_rng(5)
    se = rng.uniform(0.02, 0.05, n)
    table = pa.table({"key": rng.integers(-(2**62), 2**62, n), "x": rng.uniform(0.1, 0.5, n), "sx": rng.uniform(0.01, 0.02, n), "sy": se, "w": se**-2.0, "rest": rng.uniform(0.3, 0.5, n), "gap2": rng.uniform(0, 0.004, n)})
    monkeypatch.setattr(presso, "_bits", lambda begun, rounds, h, spare: hashed.append(h.size) or plain(begun, rounds, h, spare))
    got = []
    for block in (1 << 15, 64, 7):
        monkeypatch.setattr(presso, "BLOCK", block)
        piece = presso._Piece(table, replicates, 42)
        got += [piece.beyond(), piece.beyond(*piece.sums())]
        assert sum(hashed) == 6 * n * replicates and max(hashed) <= max(block, n)
        hashed.clear()
    for rss, above in got[1:]:
        assert np.allclose(rss, got[0][0], rtol=1e-12) and (above == got[0][1]).all()
    keyed = spark.createDataFrame([(i, int(k)) for i, k in enumerate(table["key"].to_pylist())], "id int, key long").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    want = keyed.select("id", "r", *presso._normals(42, F.col("key"), F.col("r"))).orderBy("id", "r").toPandas().to_numpy()
    for b, dx, dy, _ in presso._Piece(table, replicates, 42)._draws():
        for d, z, scale, middle in ((dx, want[:, 2], piece.sx, piece.x), (dy, want[:, 3], np.ones(n), piece.y)):
            assert np.allclose(d, z.reshape(n, replicates)[:, b] * scale[:, None] + middle[:, None], atol=1e-11)
    monkeypatch.undo()
    monkeypatch.setattr(presso, "_redrawn", None)
    results = presso.presso(spark.createDataFrame(rows_of(), SCHEMA), ["gene"], ["snp"], replicates=100, level=0.1)[0].collect()
    assert any(r.distortion_p is not None for r in results)


def test_mean_jaccard_without_common_members(spark):
    """SQL's sum over no pair is null."""
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 1.0)], "s string, m int, v double")
    assert sets.mean_jaccard_of_tops(df, "s", "m", "v", 5).collect()[0][0] is None


def test_containment_compares_contents(spark, monkeypatch):
    rows = [(f"x{i}", m) for i in range(30) for m in range(10)] + [(f"y{i}", m) for i in range(3) for m in (0, 1, None)] + [("z", 0), (None, 1)]
    seen, plain = [], sets._contained
    monkeypatch.setattr(sets, "_contained", lambda s, *a: seen.append(s.select("s").distinct().count()) or plain(s, *a))
    got = sorted(sets.containment(spark.createDataFrame(rows, "s string, m int"), "s", "m", 0.6).collect())
    assert seen == [3]  # 30 equal sets are one content
    assert [tuple(r) for r in got] == sorted([(f"y{j}", f"x{i}", 2) for j in range(3) for i in range(30)] + [("z", f"x{i}", 1) for i in range(30)] + [("z", f"y{j}", 1) for j in range(3)])


def test_gene_set_lines_are_split_once(spark, tmp_path):
    path = str(tmp_path / "sets")
    spark.createDataFrame([("a\td\t" + "\t".join(f" g{i}" for i in range(40)),)], "value string").write.text(path)
    df = readers.gmt(spark, path, "X")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in plan.split("Generate explode")[0] and df.count() == 40


def test_text_files_in_pieces(spark, monkeypatch):
    """Each file has the head and the tail, and readers find the same rows in many files as in one."""
    t = Tables(spark, DATA)
    whole = [sorted(map(str, q(t).collect())) for q in (files.series_values, files.sparse_matrix, files.gzip_counts, files.chemical_actions)]
    monkeypatch.setattr(files, "LINES_A_FILE", 60)
    path = files.series(t)
    texts = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    n = texts.select("file").distinct().count()
    assert n > 2 and texts.where("value = '!series_matrix_table_begin'").select("file").distinct().count() == n
    monkeypatch.setattr(files, "LINES_A_FILE", 700)
    assert [sorted(map(str, q(t).collect())) for q in (files.series_values, files.sparse_matrix, files.gzip_counts, files.chemical_actions)] == whole


def test_exact_quantiles_by_ranges(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 9, 2, 2, 2, 7, 30, 4]] + [(None,)], "v double")
    want = df.agg(*[F.percentile("v", x) for x in (0.01, 0.5, 0.77, 1.0)]).first()
    assert np.allclose(list(order.quantiles(df, "v", a=0.01, b=0.5, c=0.77, d=1.0).first()), list(want), rtol=1e-15)


def test_settled_groups_are_not_clumped_again(spark, monkeypatch):
    seen, plain = [], intervals.clump
    monkeypatch.setattr(intervals, "clump", lambda d, *a: seen.append(d.select("g").distinct().count()) or plain(d, *a))
    rows = [("a", 100 * i, 0.1 * i) for i in range(5)] + [("b", 10 * i, 0.1 * i) for i in range(5)] + [("c", 0, 0.5), (None, 1, 0.1)]
    got = mr.graded_clump(spark.createDataFrame(rows, "g string, pos int, p double"), ["g"], "pos", "p", (50.0, 5.0), 3)
    assert got.columns == ["g", "grade", "pos", "p"] and seen == [3, 2]
    assert sorted({(r.g, r.grade) for r in got.collect()}) == [("a", 0), ("b", 1), ("c", -1)] and got.count() == 11


def test_isoelectric_counts_go_along(spark):
    df = spark.createDataFrame([("acdk",)], "s string").select(*scalar.protein_profile("s"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" in plan and not any("translate" in x for x in plan.split("lambdafunction(")[1:2])


def test_kernel_widths_that_change_when_computed_again(spark):
    """A width that differs between the two sides of a cell must not part them (on a cluster its last bits depend on which rows come first)."""
    again = F.udf(lambda i: i + 1e-9 * random.random(), "double").asNondeterministic()
    df = spark.range(60).select((F.col("id") % 5).alias("m"), "id", again("id").alias("v"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = setnull.kernel_density(df, "id", "m", "v", 4).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert len(got) == 60 and all(r.density > 0.03 for r in got)


def test_pair_scores_in_cells(spark, monkeypatch):
    """Cells of any size find what a join of all rows finds: ties, copies, vectors of one direction, odd vectors."""
    rng, nan = random.Random(3), float("nan")
    vectors = [[float(rng.randint(-2, 2)) for _ in range(3)] for _ in range(60)] + [[1.0, 1.0, 1.0]] * 20 + [[0.1, 0.2, 0.3]] * 5 + [[0.0] * 3, None, [], [1.0], [1.0, None, 2.0], [nan, 1.0, 0.0], [1e200] * 3]
    rows = [(i, "ab"[i % 2] if i % 17 else None, v) for i, v in enumerate(vectors)] + [(1, "b", [2.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>")
    l, r = df.withColumnRenamed("id", "l"), df.withColumnRenamed("id", "r")
    both = l.join(r.withColumnRenamed("v", "w"), "g").select("l", "r", scalar.dot("v", "w").alias("score"))
    want = both.withColumn("rank", F.dense_rank().over(W.partitionBy("l").orderBy(F.desc("score")))).where("rank <= 3").collect()
    for size in (4096, 4):
        monkeypatch.setattr(fusion, "PAIR_ROWS", size)
        got = fusion.pair_scores(l, r, ["g"], "v", "l", "r", 3)
        assert sorted(map(str, got.collect())) == sorted(map(str, want))
    x = np.random.default_rng(1).integers(-3, 4, (70, 5)) / 10
    i, j, score = fusion.best_pairs(x[:30], x, 3, 7, 11)
    exact = sum(x[:30, t][:, None] * x[:, t][None] for t in range(5))
    assert {*zip(i.tolist(), j.tolist(), score.tolist())} == {(a, b, s) for a in range(30) for b, s in enumerate(exact[a].tolist()) if s in sorted({*exact[a].tolist()})[-3:]}


def test_random_non_edges_number_nodes_by_ranges(spark, monkeypatch):
    """Not all nodes in one task, and the same draws as by one window."""
    nodes = spark.range(50).select((F.col("id") * 7).alias("node"))
    edges = spark.createDataFrame([(0, 7), (7, 14)], "src long, dst long")
    seen, plain = [], graph.place
    monkeypatch.setattr(graph, "place", lambda *a, **k: seen.append(1) or plain(*a, **k))
    got = graph.negative_edges(edges, nodes, 40, 1).collect()
    monkeypatch.setattr(graph, "place", lambda df, by, name: df.withColumn(name, F.row_number().over(W.orderBy(*by))))
    assert seen == [1] and len(got) == 40 and sorted(got) == sorted(graph.negative_edges(edges, nodes, 40, 1).collect())
