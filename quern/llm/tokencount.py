"""Token counts by a two-tier lookup: a broadcast table of frequent pre-tokens, then worker caches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fields, narrow_batches, per_text

#: Entries of the broadcast table and bytes of its longest key: at most about 3 MB in all.
TABLE_ENTRIES = 32_768
KEY_BYTES = 48
#: Texts that the table's frequencies are taken from; they decide only what is looked up fast, never a count.
TABLE_SAMPLE = 3000
#: Texts longer than so many bytes aren't in that sample, so that it fits one task.
SAMPLE_BYTES = 1 << 16
#: Entries a worker caches before it starts afresh.
CACHE_ENTRIES = 300_000

_RESULT = pa.struct([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def frequent_pretokens(docs: DataFrame, text: str = "text", entries: int = TABLE_ENTRIES) -> list[bytes]:
    """The commonest runs without white space in a bounded sample of the texts.

    The sampled texts themselves go to one task, which counts their runs and passes on the
    commonest: no pre-token is shuffled, and the driver gets `entries` short keys at most.
    """
    n = docs.count()  # from the file footers
    share = min(1.0, TABLE_SAMPLE / max(1, n))
    sample = docs.select(F.col(text).cast("binary").alias("t")).where(F.length("t") <= SAMPLE_BYTES).where(F.pmod(F.xxhash64("t", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches):
        from collections import Counter

        held: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(w for w in t.split() if len(w) <= KEY_BYTES)
        top = sorted(held.items(), key=lambda x: (-x[1], x[0]))[:entries]
        if top:
            yield pa.record_batch([pa.array([w for w, _ in top], pa.binary())], names=["w"])

    top = sample.distinct().coalesce(1).mapInArrow(count, "w binary")
    return [bytes(r[0]) for r in top.collect()]


def _counter(path: str, table: dict[bytes, int]):
    """A function from UTF-8 bytes to the number of tokens that the tokenizer file gives.

    A run without ASCII white space is encoded on its own: the tokenizer drops white space and
    never joins across it. That is checked against the file's own pre-tokenizer in the tests.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    class Cache(dict):
        def __missing__(self, run: bytes) -> int:
            n = len(tokenizer.encode(run.decode("utf-8"), add_special_tokens=False).ids)
            if len(run) <= KEY_BYTES:
                if len(self) >= CACHE_ENTRIES:
                    self.clear()
                    self.update(table)
                self[run] = n
            return n

    cache = Cache(table)
    return lambda text: sum(map(cache.__getitem__, text.split()))


def count_tokens(docs: DataFrame, path: str, text: str = "text", table: list[bytes] | None = None) -> DataFrame:
    """docs with n_bytes (UTF-8) and n_tokens of every whole text.

    path is a tokenizer file of the tokenizers library that drops white space, on every
    executor. Null and empty texts have 0 bytes and 0 tokens. Existing columns n_bytes and
    n_tokens give way; repeated rows stay. Special strings inside texts count as the library
    takes them by default.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    narrow_batches(spark)
    tokenizer = Tokenizer.from_file(path)
    runs = frequent_pretokens(docs, text) if table is None else table
    lengths = {run: len(e.ids) for run, e in zip(runs, tokenizer.encode_batch([r.decode("utf-8") for r in runs], add_special_tokens=False), strict=True)}
    shared = spark.sparkContext.broadcast(lengths)

    def setup():
        count = _counter(path, shared.value)
        return lambda texts: [{"n_bytes": len(t), "n_tokens": count(t)} if t else {"n_bytes": 0, "n_tokens": 0} for t in texts]

    return fields(docs.withColumn("_tokens", per_text(setup, _RESULT, text)), "_tokens", ["n_bytes", "n_tokens"])
