"""Source divergence: against SQL, a dense brute force, radix selection against sorting, nulls, many sources."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import divergence, queries

from .test_chatformat import DATA, duck, same_as_sql


def brute(rows, least=3, top=200):
    """rows: (text, lang, source). All pairs of sources over all kept terms, densely."""
    rows = [tuple(x or "" for x in r) for r in rows]
    cut = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [(cut(t), s) for t, a, s in rows if a == lang]
        seen = Counter(w for t, _ in mine for w in set(t))
        kept = [w for w, n in seen.items() if n >= least]
        count = {s: Counter(w for t, z in mine if z == s for w in t if seen[w] >= least) for s in {s for _, s in mine}}
        total = sum(count.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in count.items():
            pairs = [(-sum(f(p(c, w), p(d, w)) for w in kept), t.encode()) for t, d in count.items() if t != s]
            terms = [(-f(p(c, w), p(total, w)), w.encode()) for w in kept if c[w] and p(c, w) > p(total, w)]
            out += [(lang, s, "pair", t.decode(), -v, i + 1) for i, (v, t) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def audit(spark, rows, **more):
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("clash")).withColumn("n", F.lit(0))
    return sorted(tuple(r) for r in divergence.audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(n, sources, seed=3):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "ÉTÉ", "été", "x1y", "漢字", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]]
    return [(" ".join(rng.choice(words, rng.integers(0, 30))), ("en", "fr", None)[rng.integers(0, 3)], f"s{rng.integers(0, sources)}") for _ in range(n)]


def test_against_sql(spark):
    same_as_sql(queries.op11_source_divergence(spark, DATA).toPandas(), duck().sql(queries.OP11_SQL).df())


def test_against_brute_force(spark):
    rows = corpus(150, 5) + [(None, "en", "s0"), ("rare words only", "de", "s1"), ("", "de", "s2"), ("same", None, None), ("same", "", ""), ("same", None, None)]
    assert audit(spark, rows) == brute(rows)
    assert audit(spark, rows, top=3) == brute(rows, top=3)
    assert audit(spark, []) == []


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_of_sources(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", block)
    rows = corpus(120, 9, seed=8)
    assert audit(spark, rows) == brute(rows)


def test_salted_groups_and_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MAX_BROADCAST_GROUPS", 0)
    rows = corpus(120, 4, seed=9)
    assert audit(spark, rows, top=5) == brute(rows, top=5)


@pytest.mark.parametrize("k", [1, 7, 200])
def test_radix_selection(spark, k):
    rng = np.random.default_rng(k)
    values = [0, 0, 0, 1, 2, 3, 2**11, 2**11 - 1, 2**11 + 1, 2**40, 2**40 + 1, 2**60 + 5, 10**18, 10**18 - 1] + [int(x) for x in rng.integers(0, 2**60, 200)] + [77] * 300
    rows = [(("a", "b", None)[i % 3], v, f"{'é' * (i % 4)}t{i:05d}"[: 3 + i % 9] + str(i)) for i, v in enumerate(values)]
    got = divergence.top_of_groups(spark.createDataFrame(rows, "g string, v long, t string").where("g is not null"), ["g"], "v", "t", k, bool(k % 2)).collect()
    for g in "ab":
        want = sorted(((-v, t.encode()) for x, v, t in rows if x == g))[:k]
        assert sorted((-r.v, r.t.encode()) for r in got if r.g == g) == want
    same = spark.createDataFrame([("g", 5, "t")] * 9 + [("g", 4, "u")], "g string, v long, t string")
    assert [(r.v, r.t) for r in divergence.top_of_groups(same, ["g"], "v", "t", 4, True).collect()] == [(5, "t")] * 4


def test_long_text(spark):
    rows = [("Ab " * 900_000 + "é" * 3_000_000, "en", "s1"), ("ab cd", "en", "s2"), ("ab cd", "en", "s2"), ("CD", "en", "s1")]
    assert audit(spark, rows) == brute(rows)
