import os

import duckdb

from quern.llm import mixing, queries

DATA = "/root/testdata/sf0.001"


def fill(sizes, weights=(3, 1, 2), share=1.5, epochs=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: epochs * sizes[s] for s in names}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total >= cap[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        target |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
        free -= over
    return target


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 500, None: 90, "é": 3}, {"a": 5}, {"a": 0, "b": 7}, {chr(97 + i): 7 * i * i for i in range(20)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df, (3, 1, 2), 1.5, 2.0).collect()}
        want = fill(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes), sizes


def test_against_sql(spark):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = c.sql(queries.OP9_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op9_mixing(spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)
    for column in ("doc_id", "size", "source_size", "taken"):
        assert (want[column] == got[column]).all()
    assert ((want.target - got.target).abs() < 1e-6).all()
    again = queries.op9_mixing(spark, DATA).repartition(7).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (again.taken == got.taken).all()
    source = spark.read.parquet(f"{DATA}/documents.parquet").toPandas().set_index("doc_id").source
    taken = got.groupby(source.loc[got.doc_id].to_numpy()).agg({"taken": "sum", "target": "first", "size": "max"})
    assert ((taken.taken - taken.target).abs() <= taken["size"]).all() and (got.taken <= 2 * got["size"]).all()


def test_odd_rows(spark):
    rows = [(1, None, "a b", "old"), (1, None, "a b", "old"), (None, "s", None, "x"), (3, "s", "", "x"), (4, "t", "w " * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and sorted(r.size for r in got) == [0, 0, 2, 2, 5000]
    assert all(r.reps <= 2 for r in got)
    assert mixing.repeat_rows(mixing.mix(docs)).count() == sum(r.reps for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_border_among_equal_rows(spark):
    rows = [(i, "a", "w " * 5) for i in range(100)] + [(7, "b", "w " * 10)] * 400 + [(i, "b", "w " * 10) for i in range(100, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs.repartition(4)).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("source"):
        assert abs((g["size"] * g.reps).sum() - g.target.iloc[0]) <= g["size"].max()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert sorted(zip(got.doc_id, got.reps)) == sorted(zip(again.doc_id, again.reps))
