"""From raw documents to token ids: five stages, each written as Parquet and read as the next one's input.

All but the last return the columns of documents. Nothing passes between stages but their tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.llm import bpe, langid, line_dedup, mixing, simhash
from larder.runtime import materialize

#: Every line with a word takes part, as in op4: a line in a script without spaces is one word.
MIN_WORDS = 1
#: Words of a shingle and differing bits of linked fingerprints, as op10 has them.
SHINGLE_WORDS, DIFFERING_BITS = 3, 2
#: No source is thinned out: the budget lets each document through at least once, and repeats those of
#: sources that are too small for the target, at most twice.
MIX = mixing.Mix(entropy=0.95, repeats=2.0)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; others go."""
    return langid.keep_identified(docs)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one."""
    return line_dedup.remove_lines(docs, min_words=MIN_WORDS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that fingerprints connect the one with the smallest id."""
    return simhash.keep_one(docs, words=SHINGLE_WORDS, budget=DIFFERING_BITS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks, once at least."""
    return mixing.mix_sources(docs, MIX).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of token ids and of the text decoded from them."""
    return bpe.digests(docs, bpe.public_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("line dedup", deduplicate_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_texts),
]

#: SQL expresses neither the text models nor BPE: tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
