"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fields, narrow_batches, per_text

#: Lengths of the character n-grams.
ORDERS = (1, 2, 3, 4)
#: Hash buckets of the n-grams.
BUCKETS = 1 << 15
#: Most labelled texts of one language that training reads; the sample is the one with the lowest seeded hashes.
SAMPLE_PER_LANG = 4000
#: Most languages of a model: bounds the broadcast matrix to BUCKETS * MAX_LANGS floats.
MAX_LANGS = 256
UNDETERMINED = "und"

_RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
_MULTIPLIER = np.uint32(0x9E3779B1)


@dataclass
class Model:
    """langs in order and a (BUCKETS, langs) matrix of log probabilities, plus log priors."""

    langs: list[str]
    weights: np.ndarray
    priors: np.ndarray


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points between blanks; three trailing blanks keep n-grams inside the text."""
    return np.frombuffer(f" {text.lower()}   ".encode("utf-32-le", "surrogatepass"), np.uint32)


def _buckets(codes: np.ndarray) -> list[np.ndarray]:
    """For every n-gram length the bucket of the n-gram that starts at each position but the last three."""
    n = max(0, len(codes) - (max(ORDERS) - 1))
    h, out = np.zeros(n, np.uint32), []
    for order in ORDERS:
        h = (h ^ codes[order - 1 : order - 1 + n]) * _MULTIPLIER
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x85EBCA6B + 2 * order)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Count hashed n-grams of a bounded sample of labelled texts; null texts and labels are left out.

    sample_per_lang bounds the sample: texts of a language are kept with the probability that
    gives so many, decided by a hash of the text, so reruns learn the same; one text at least.
    A text that stands in many rows of a language is learned once. An empty training set gives
    a model without languages.
    """
    labelled = docs.select(F.col(text).alias("_t"), F.col(lang).alias("_l"), (F.lit(True) if where is None else where).alias("_w"))
    labelled = labelled.where("_w and _t is not null and _l is not null").select("_t", "_l")
    place = F.pmod(F.xxhash64("_t", F.lit(11)), F.lit(1 << 20))
    found = labelled.groupBy("_l").agg(F.count("*"), F.min(place)).limit(MAX_LANGS + 1).collect()
    sizes, least = {r[0]: r[1] for r in found}, {r[0]: r[2] for r in found}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    below = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(max(least[k] + 1.0, min(1.0, sample_per_lang / sizes[k]) * (1 << 20))))])
    sample = labelled.where(place < F.element_at(below, F.col("_l"))).distinct()
    narrow_batches(docs.sparkSession)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = held.setdefault(k, np.zeros(BUCKETS, np.int64))
                codes = _codes(t)
                for at in range(0, len(codes), 1 << 20):
                    for b in _buckets(codes[at : at + (1 << 20) + max(ORDERS) - 1]):
                        counts += np.bincount(b, minlength=BUCKETS)
        for k, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([k] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # at most BUCKETS * MAX_LANGS rows
    totals = np.ones((BUCKETS, len(langs)))
    order = {k: i for i, k in enumerate(langs)}
    totals[table["bucket"].to_numpy(), [order[k] for k in table["lang"].to_pylist()]] += table["n"].to_numpy()
    sizes_in_order = np.array([sizes[k] for k in langs], float)
    return Model(langs, np.log(totals / totals.sum(0)).astype(np.float32), np.log(sizes_in_order / sizes_in_order.sum()))


def _pieces(codes: Iterable[np.ndarray], width: int):
    """Yield lists of (text, codes) of about width codes; a longer text goes in overlapping pieces. Codes are taken one by one."""
    held, size, lap = [], 0, max(ORDERS) - 1
    for i, c in enumerate(codes):
        for at in range(0, max(1, len(c) - lap), width):
            held.append((i, c[at : at + width + lap]))
            size += len(held[-1][1])
            if size >= width:
                yield held
                held, size = [], 0
    if held:
        yield held


def score_texts(model: Model, texts: list[str | None]) -> list[dict]:
    """The likeliest language of each text with its posterior probability.

    The texts of a batch are one sparse matrix in row form: the buckets of all n-grams beside
    each other and the offset of each text. Its product with the matrix of log probabilities is
    a sum of rows between offsets.
    """
    out: list[dict] = [{"lang_pred": UNDETERMINED, "score": 0.0} for _ in texts]
    worded = [i for i, t in enumerate(texts) if t is not None and model.langs and any(map(str.isalpha, t))]
    if not worded:
        return out
    width, lap = max(1 << 12, (1 << 20) // len(model.langs)), max(ORDERS) - 1
    totals = np.tile(model.priors, (len(worded), 1))
    for piece in _pieces((_codes(texts[i]) for i in worded), width):
        rows, parts = zip(*piece, strict=True)
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        inside = np.ones(ends[-1], bool)
        inside[(ends[:, None] - np.arange(1, lap + 1)).ravel()] = False
        offsets = np.concatenate([[0], np.cumsum(lengths - lap)[:-1]])
        for b in _buckets(np.concatenate([*parts, np.zeros(lap, np.uint32)])):
            np.add.at(totals, list(rows), np.add.reduceat(model.weights[b[inside]], offsets, axis=0, dtype=np.float64))
    p = np.exp(totals - totals.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    for i, best, row in zip(worded, p.argmax(1).tolist(), p.tolist(), strict=True):
        out[i] = {"lang_pred": model.langs[best], "score": row[best]}
    return out


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score: the matrix is broadcast, whole texts are scored in batches.

    A null text and one without a letter get und and 0; so does every text if the model has no
    languages. Existing columns lang_pred and score give way. Repeated rows stay.
    """
    narrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        model = shared.value
        return lambda texts: score_texts(model, texts)

    return fields(docs.withColumn("_langid", per_text(setup, _RESULT, text, as_bytes=False)), "_langid", ["lang_pred", "score"])


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is a multiple of five; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
