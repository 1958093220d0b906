"""Corpus preparation: five operators, one after the other, on ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; its result is written as Parquet and read again. The mixing
stage sorts; the last one reads that order off the written files.

Any column may be null, and columns of any other names pass through all stages
but the last, unread. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, gam, jaccard, mixing, suffix
from tidemark.llm.common import numbered, ship_package, stored, table
from tidemark.llm.queries import vocab_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: a score of 0.3 or more.

    A null text is scored as the empty one; repeated rows are judged alike;
    without labels every document has the same score."""
    return gam.keep_good(docs, gam.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the smallest id.

    A null id is smaller than any; of rows that share id and text one stays.
    Null, empty and blank texts are copies of each other."""
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat elsewhere; n_chars follows the text.

    No row goes. A null text stays null, with a null n_chars; a text that repeats
    whole becomes empty; a repeated row loses what it shares with its like."""
    cut = suffix.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that mixes the sources to their weights.

    Null is a source like any other; rows of one source are in the order of a
    hash of the id, equal rows next to each other."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of their decoding,
    and its position: the order of ``docs``, which is the mix.

    A null text has no ids; a null id stays null; a column of ``docs`` that is
    named position is replaced."""
    return bpe.encode_digests(numbered(docs, "position"), vocab_path(), with_ids=True, position="position")


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("mixing sources", mix_sources), ("BPE", encode)]

#: SQL cannot express the learnt, hashed and byte-wise stages; the tests compare
#: every stage's rows, texts and order with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages make of ``documents``; sorted by position they
    are in the order of the mix."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
