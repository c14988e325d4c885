import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import langid

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return langid.train(docs, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, sample_per_lang=80)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = langid.identify(docs.select("doc_id", "text", "lang"), model).withColumn("held", langid.held_out()).toPandas()
    assert (rows.held == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    held = rows[rows.held]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert rows.score.between(0, 1).all()


def test_odd_texts(spark, model):
    texts = [None, "", " \n", "12 !?", "é", "the and of " * 30000, "a", "a"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang_pred string")
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in range(4))
    assert got[5].lang_pred == "en" and got[6].lang_pred == got[7].lang_pred and got[6].score == got[7].score


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id int, text string, lang string")
    model = langid.train(docs)
    assert model.langs == []
    assert [r.lang_pred for r in langid.identify(docs, model).collect()] == ["und", "und"]
    assert langid.identify(docs.limit(0), model).count() == 0


def naive_buckets(text):
    codes = [ord(c) for c in f" {text.lower()}   "]
    out = []
    for i in range(len(codes) - 3):
        h = 0
        for order in (1, 2, 3, 4):
            h = (h ^ codes[i + order - 1]) * 0x9E3779B1 & 0xFFFFFFFF
            h ^= h >> 15
            out.append((h * (0x85EBCA6B + 2 * order) & 0xFFFFFFFF) >> 17)
    return out


def test_against_naive_counts_and_scores(spark):
    rng = random.Random(3)
    alphabets = {"a": "abcde é", "b": "defgh ü", "c": "xyzab ñ"}
    rows = [(k, "".join(rng.choices(v, k=rng.randint(1, 80)))) for k, v in alphabets.items() for _ in range(12)]
    rows += [rows[0]] * 3 + [("a", None), (None, "abc")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = langid.train(docs.repartition(3))
    langs, counts, sizes = sorted(alphabets), {}, {}
    for k in langs:
        sizes[k] = sum(x == k and t is not None for x, t in rows)
        n = Counter(b for t in {t for x, t in rows if x == k and t is not None} for b in naive_buckets(t))
        total = sum(n.values()) + langid.BUCKETS
        counts[k] = lambda b, n=n, total=total: math.log((n[b] + 1) / total)
    assert model.langs == langs
    for b in range(0, langid.BUCKETS, 97):
        assert all(abs(model.weights[b, i] - counts[k](b)) < 1e-4 for i, k in enumerate(langs))
    texts = ["".join(rng.choices("abcdefghxyz éüñ", k=rng.randint(1, 60))) for _ in range(40)] + ["ab " * 6000, "é" * 5000]
    for t, got in zip(texts, langid.score_texts(model, texts), strict=True):
        if not any(map(str.isalpha, t)):
            assert got["lang_pred"] == "und"
            continue
        scores = [math.log(sizes[k] / sum(sizes.values())) + sum(map(counts[k], naive_buckets(t))) for k in langs]
        p = [math.exp(s - max(scores)) for s in scores]
        assert got["lang_pred"] == langs[p.index(1.0)] and abs(got["score"] - 1 / sum(p)) < 2e-3


def test_language_of_one_repeated_text(spark):
    docs = spark.createDataFrame([("a", f"text {i}") for i in range(300)] + [("b", "xyz")] * 300, "lang string, text string")
    model = langid.train(docs, sample_per_lang=2)
    assert langid.score_texts(model, ["xyz xyz"])[0]["lang_pred"] == "b"
