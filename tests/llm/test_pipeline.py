"""The stages over a small folder, each against what a plain reading of its input gives."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_mixing import fill
from tests.llm.test_suffixes import brute

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "encoding":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, docs := spark.read.parquet(str(tmp_path / name)))

    before, after = (d.toPandas() for d in seen["language"])
    letters = before.text.map(lambda t: any(map(str.isalpha, t)))
    assert set(after.doc_id) == set(before.doc_id[letters])

    before, after = (d.toPandas() for d in seen["near_duplicates"])
    assert after.text.is_unique and set(after.doc_id) <= set(before.doc_id)
    assert set(before.doc_id[~before.text.isin(before.text[before.duplicated("text", keep=False)])]) >= set(after.doc_id[~after.text.isin(before.text[before.duplicated("text", keep=False)])])

    before, after = (d.toPandas() for d in seen["repeated_passages"])
    want = dict(zip(before.doc_id, (w[4].decode("utf-8", "ignore") for w in brute(before.text)), strict=True))
    assert dict(zip(after.doc_id, after.text, strict=True)) == want and (after.n_chars == after.text.map(len)).all()

    before, after = (d.toPandas() for d in seen["mixture"])
    words = lambda t: len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t))
    sizes = before.text.map(words).groupby(before.source).sum().to_dict()
    largest = before.text.map(words).groupby(before.source).max()
    taken = after.text.map(words).groupby(after.source).sum()
    target = fill(sizes)
    assert all(abs(taken.get(s, 0) - target[s]) <= largest[s] for s in sizes)
    assert max(Counter(after.doc_id).values()) <= 2

    before, after = (d.toPandas() for d in seen["encoding"])
    assert sorted(before.doc_id) == sorted(after.doc_id) and (after.n_tokens == after.ids.map(len)).all()


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
