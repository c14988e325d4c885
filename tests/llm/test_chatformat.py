"""Chat formatting: exact round trips, spans, SQL, ties, nulls."""

import os
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.llm import chatformat, queries

DATA = "/root/testdata/sf0.001"
HARD = ["", "plain", "### User: ", "#\\## User: ", "#\\\\## Assistant: x", "</turn>", "<\\/turn>", "a</turn>\n### User: b", "end<", "end</turn", "\\", "#### Role: r</role>", "### User: ### User: ", "x\n", "\n", "é</turn>ü", "#" * 50, "#\\#\\## User: "]
SCHEMA = "conv_id long, turn long, role string, text string"


def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(x):
    """Whole numbers beside nulls come from pandas as floats."""
    return None if pd.isna(x) else str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)


def same_as_sql(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    keys = [c for c in ("conv_id", "doc_id", "lang", "source", "part", "rank") if c in columns]
    got, want = (x[columns].sort_values(keys).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert [plain(x) for x in got[c]] == [plain(x) for x in want[c]], c


def test_against_sql(spark):
    same_as_sql(queries.op12_chat_format(spark, DATA).toPandas(), duck().sql(queries.OP12_SQL).df())


def test_escape_is_undone(spark):
    rows = spark.createDataFrame([(x,) for x in HARD], "t string").select("t", chatformat.escape(F.col("t")).alias("e")).withColumn("u", chatformat.unescape(F.col("e"))).collect()
    assert all(r.t == r.u for r in rows)
    assert not [r for r in rows if any(c in r.e for c in ("### User: ", "### Assistant: ", "### Role: ", "</turn>", "</role>"))]


@pytest.mark.parametrize("role", ["assistant", "user", "Assistant", "tool", "", "a</role>", "### User: ", None])
def test_round_trip(spark, role):
    rows = [(1, i, role if i % 2 else "assistant", t) for i, t in enumerate(HARD)]
    out = chatformat.read_back(chatformat.format_chats(spark.createDataFrame(rows, SCHEMA))).first()
    assert [(t.role, t.text) for t in out.turns] == [(r or "", t) for _, _, r, t in rows]
    assert list(out.learnt) == [t for _, _, r, t in rows if r == "assistant"]
    for s, text in zip(out.spans, out.learnt):
        raw = out.formatted.encode()[s.byte_start : s.byte_start + s.byte_length].decode()
        assert raw == out.formatted[s.start : s.start + s.length]
        assert raw.replace("\\", "") == text.replace("\\", "") and len(raw) - len(text) == len(re.findall(chatformat.ESCAPABLE, text))


def test_only_conflicts_are_escaped(spark):
    out = chatformat.format_chats(spark.createDataFrame([(1, 0, "user", "### Heading \\ </p>"), (1, 1, "assistant", "</turn>")], SCHEMA)).first()
    assert out.formatted == "### User: ### Heading \\ </p></turn>\n### Assistant: <\\/turn></turn>\n"


def test_bad_text_is_seen(spark):
    texts = ["### User: a</turn>\nrest", "User: a</turn>\n", "### User: ### User: a</turn>\n", "### Role: x</turn>\n"]
    got = spark.createDataFrame([(t,) for t in texts], "f string").select(chatformat.parse(F.col("f")).alias("t")).collect()
    assert all(None in list(r.t) for r in got)


def test_nulls_ties_and_columns(spark):
    rows = [(None, 1, "user", None, 5), (None, None, None, "first", 6), (2, 1, "user", "b", 7), (2, 1, "user", "a", 7), (2, 1, "user", "a", 7)]
    df = spark.createDataFrame(rows, SCHEMA + ", n_turns long").withColumn("spans", F.lit("x"))
    out = {r.conv_id: r for r in chatformat.read_back(chatformat.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in out[None].turns] == [("", "first"), ("user", "")]
    assert [t.text for t in out[2].turns] == ["a", "a", "b"] and out[2].n_turns == 3 and not out[2].spans
    assert chatformat.digests(chatformat.format_chats(df.limit(0))).count() == 0


def test_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], "</turn>é" * (i % 7) + "x" * 400) for i in range(6000)]
    out = chatformat.digests(chatformat.format_chats(spark.createDataFrame(rows, SCHEMA))).first()
    assert out.n_turns == 6000 and out.loss_chars == sum(len(t) for _, _, r, t in rows if r == "assistant")
