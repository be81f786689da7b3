"""From documents to packed training sequences: quality, language, near-copies,
packing. Each stage calls one operator of the llm subpackage on all that the one
before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import op2_quality, op6_language, op7_simhash, op9_packing
from weftgraph.llm.common import table, written

#: Shingles of five words, of which near copies share four fifths (Jaccard, exact).
WORDS = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least a half for quality. The model is learnt from the
    labelled rows that are not held out.

    A null text scores as an empty one, a null key has a score like any other; repeated
    rows are judged alike and all stay or go; a score of just a half stays. Without a text
    of each class nothing is judged and all stay. Any columns, clashing names included,
    come out as they went in; an empty table stays empty."""
    return op2_quality.keep_good(docs, op2_quality.fit(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters or without a
    verdict of at least a half go.

    A null or empty text has no letters. Null keys are kept apart by text and source;
    repeated rows share a verdict; of equally likely languages the one that sorts first
    is the verdict, and a posterior of just a half stays. Without any language label
    nothing is judged and all stay. Columns come out as they went in; an empty table stays
    empty."""
    return op6_language.keep_identified(docs, op6_language.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id. Fingerprints
    give candidates, and all links are verified on whole sets of shingles.

    Null texts count as empty, and all texts without words are one group. Null keys come
    last; of equal keys the least digest of key and text stays; of rows equal in both any
    one. A similarity of just four fifths links. Columns come out as they went in; an empty
    table stays empty."""
    return op7_simhash.keep_one(docs, WORDS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces in sequences of at most 2048 tokens.

    A null or empty text is its end id alone; null keys and repeated rows are packed like
    any other, each on its own; of equal lengths the order of the pieces decides. Extra
    columns are not read; an empty table gives no pieces."""
    pieces = op9_packing.cut(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    narrow = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return op9_packing.assign(narrow).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("language", language), ("near_copies", near_copies), ("packing", packing)]

#: Compression and fingerprints have no SQL: the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written as Parquet and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return stage_last(spark, docs, sf_dir)


def stage_last(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, docs, sf_dir)
