"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's docs. All but the last keep the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossaflow.llm import mixing, ngram_join, packing, quality_rules, queries, suffix_dedup
from glossaflow.llm.common import Scratch

#: Near-duplicates: shingles of five words with a similarity of 0.8 or more.
NEAR = ngram_join.Join(5, 80, 100)
#: Repeated passages: any 200 bytes, about 35 words, that also start elsewhere.
PASSAGE = suffix_dedup.Shape(200, 64, "byte")
#: Tokens of a sequence.
SEQUENCE = 1024


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the last policy of the quality rules keeps. Null and empty texts are too short and go; repeated rows stay or go together."""
    return quality_rules.keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least id, null only if all are; of repeated rows one. A text without words is like its equals only."""
    return ngram_join.one_of_each(docs, NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand more than once. Null and empty texts stay as they are; a text of which nothing is left goes; repeated rows repeat each other."""
    return suffix_dedup.cut_rows(docs, PASSAGE)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target weights. A null source or language is a value of its own; a text without tokens weighs nothing; repeated rows stay or go together."""
    return mixing.sample(docs, queries.MARGINS, queries.TOPICS, queries.KEEP, vocabulary=queries.VOCABULARY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document and its place. A null or empty text is the end mark alone; repeated rows are packed each."""
    return packing.pack_documents(docs, queries.VOCABULARY, queries.END_ID, SEQUENCE)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("mixing to target weights", mixture), ("best-fit packing", packed)]

#: Connected components and raking cannot be put into SQL; tests hold each stage against a brute-force version over what the stage before it kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents."""
    docs = queries.documents(spark, sf_dir)
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(f"stage{i}", docs)
    return docs
