"""Fill-in-middle: cuts against Python slices, the scan against a byte-wise run, SQL, long texts."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import fim, queries

from .test_chatformat import DATA, duck, same_as_sql

TEXTS = ["", "a", "é", "aé漢😀" * 9, "<P>", "a<S", "<S>" * 3, "x" * 500, "漢" * 300, " lead and trail ", "l1\nl2\n\nl4", None]


def expected(doc_id, text):
    t, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    if h4 % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_against_sql(spark):
    same_as_sql(queries.op13_fill_in_middle(spark, DATA).toPandas(), duck().sql(queries.OP13_SQL).df())


@pytest.mark.parametrize("chunk", [1, 3, 64, 1 << 16])
def test_texts_and_chunks(spark, chunk):
    rows = [(i, t) for i, t in enumerate(TEXTS * 6)] + [(None, "no id"), (3, "same id"), (3, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("extra", F.lit(1))
    got = fim.fill_in_middle(df, chunk=chunk).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((key((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output)) for r in got)) == sorted(key((i, *expected(i, t))) for i, t in rows)
    assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(i), t or "") for i, t in rows)
    assert all(r.extra == 1 for r in got)
    assert fim.fill_in_middle(df.limit(0), chunk=chunk).count() == 0


@pytest.mark.parametrize("name", list(fim.UNITS))
def test_functions_compose(name):
    a = fim.UNITS[name]()
    rng = np.random.default_rng(5)
    data = bytes(rng.choice([10, 32, 65, 0xC3, 0xA9, 0xE6, 0xBC, 0xF0, 0x9F, 0xFF], 5000).astype(np.uint8))

    def walk(part, state):
        places = []
        for i, b in enumerate(part):
            x = int(a.table[state, b])
            places += [i] if x >= 128 else []
            state = x & 127
        return state, places

    pieces = [data[i : i + n] for i, n in ((0, 1), (0, 511), (0, 512), (0, 513), (7, 2000), (0, 5000))] + [b""]
    ends, counts = fim.summaries(pieces, a)
    for p, e, c in zip(pieces, ends, counts):
        for s in range(a.states):
            state, places = walk(p, s)
            assert (e[s], c[s]) == (state, len(places))
    for s in range(a.states):
        for index in (0, 1, 57, 400, 10**6):
            got = fim.locate(pieces, np.full(len(pieces), s), np.full(len(pieces), index), a)
            want = [(walk(p, s)[1][index : index + 1] or [-1])[0] for p in pieces]
            assert got.tolist() == want


@pytest.mark.parametrize("units,split", [("lines", lambda t: t.splitlines(keepends=True)), ("words", None)])
def test_other_units(spark, units, split):
    import re

    split = split or (lambda t: re.findall(r"^\s*\S+\s*|\S+\s*", t))
    texts = ["a b\nc d\ne", "  first second\tthird", "\n\nx\n", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fim.cuts(df, units=units, chunk=4).collect():
        parts, at = split(texts[r.doc_id]), list(r.cut_bytes)
        assert r.n == len(parts)
        assert at == [len("".join(parts[:k])) for k in (r.prefix_units, r.prefix_units + r.middle_units)]


def test_giant_text(spark):
    text = "añ漢😀 word\n" * 400_000
    df = spark.createDataFrame([(i, text if i else "short") for i in range(3)], "doc_id long, text string")
    for r in fim.fill_in_middle(df).collect():
        t = text if r.doc_id else "short"
        want = expected(r.doc_id, t)
        assert (r.n, r.form, r.prefix_units, r.middle_units) == want[:4] and r.output == want[4]
