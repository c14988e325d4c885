import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quern.llm import suffixes


def brute(rows):
    blobs = [(t or "").encode() for t in rows]
    n = Counter(b[i : i + 200] for b in blobs for i in range(len(b) - 199))
    out = []
    for b in blobs:
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if n[b[i : i + 200]] > 1:
                covered[i : i + 200] = True
        kept = np.frombuffer(b, np.uint8)[~covered].tobytes()
        out.append((len(b), int(covered.sum()), int((np.diff(covered.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdefé \n", k=rng.randint(0, 900))) for _ in range(10)]
    out = [None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 180]
    for _ in range(25):
        kind = rng.random()
        if kind < 0.2:
            out.append(rng.choice(base))
        elif kind < 0.7:
            parts = []
            for _ in range(rng.randint(1, 4)):
                b = rng.choice(base)
                i = rng.randint(0, max(0, len(b) - 1))
                parts += [b[i : i + rng.choice([150, 199, 200, 201, 300])], "".join(rng.choices("ghij", k=rng.randint(0, 3)))]
            out.append("".join(parts))
        else:
            out.append("".join(rng.choices("klmnop ", k=rng.randint(0, 700))))
    return out


def test_cover():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 2000)
    for seed in (1, 2):
        texts = rows(seed)
        docs = spark.createDataFrame([(i // 2 if i % 5 == 0 else i, t, i, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, n_removed int, extra double").repartition(4)
        want = Counter((i // 2 if i % 5 == 0 else i, *w[:4]) for i, w in enumerate(brute(texts)))
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs).collect())
        assert got == want


def test_texts_and_other_columns(spark):
    passage = "é" * 150
    docs = spark.createDataFrame([(1, "a" + passage + "b", "s", None), (2, passage, None, 2.5), (3, None, "t", 1.0), (None, "own", "u", 0.0)], "doc_id long, text string, source string, x double")
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs, with_text=True).collect()}
    assert (got[1].text, got[1].source, got[1].x) == ("ab", "s", None)
    assert (got[2].text, got[2].source, got[2].x) == ("", None, 2.5)
    assert got[3].text is None and got[3].source == "t" and got[None].text == "own"
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_columns_keep_their_types(spark):
    rows = [("a", "q" * 300, bytearray(b"\xff\x00"), float("nan"), {"k": 1}), ("b", "q" * 250, None, None, None), (None, None, None, 1.0, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, raw binary, x double, `m.n` map<string,int>").withColumn("three", F.lit(3))
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs, with_text=True).collect()}
    assert (got["a"].text, got["a"].n_removed, got["a"].raw, got["a"]["m.n"], got["a"].three) == ("", 300, b"\xff\x00", {"k": 1}, 3)
    assert np.isnan(got["a"].x) and got["b"].raw is None and got["b"].n_removed == 250 and got[None].x == 1.0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quern_blocks")]


def test_very_long_texts(spark):
    rng = random.Random(5)
    long, other = ("".join(rng.choices("abcdefgh \n", k=n)) for n in (6_000_000, 1_000_000))
    passage = long[3_000_000:3_000_300]
    docs = spark.createDataFrame([(1, long), (2, other + passage), (3, "own")], "doc_id int, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(docs).collect()}
    assert got == {1: (6_000_000, 300, 1), 2: (1_000_300, 300, 1), 3: (3, 0, 0)}
