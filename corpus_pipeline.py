"""From raw documents to token ids: language, near duplicates, repeated passages, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, langid, mixing, neardup, suffixes
from quern.llm.common import written
from quern.llm.queries import split_pattern, table, tokenizer_path

#: Least posterior probability of a document's language.
LEAST_SCORE = 0.5
#: Weights in turn over the sources, words of the mix per word of the input, most repetitions.
WEIGHTS, SHARE, MAX_EPOCHS = (3, 1, 2), 1.5, 2.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with that language; those without a letter or with a doubtful one go."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    found = langid.identify(docs, langid.train(docs, where=fold != 0))
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.drop_near_duplicates(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in two places; n_chars follows the text."""
    left = suffixes.remove_repeats(docs, with_text=True)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat_rows(mixing.mix(docs, WEIGHTS, SHARE, MAX_EPOCHS)).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes they decode to."""
    out = bpe.digest(docs, tokenizer_path("byte_bpe_50k.tiktoken"), split_pattern(), with_ids=True)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: SQL can't express the sketches, alignments and merges of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
