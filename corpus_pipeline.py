"""A training-data pipeline over ``documents``: each stage works on all rows that its predecessor kept.

quality: rows that the ordinal classifier rejects go. lines: repeated chunks of lines, and repeated lines of 50 words or more, go. near: of each
group of near duplicates (five words, similarity 0.8) the row with the smallest doc_id stays. mix:
texts are repeated or cut so that sources meet their target weights. pack: windows of 2048 tokens.

Defined cases: null and empty texts, and those without a word, are rejected by quality, with or without
labels; texts that lines empties pass near (they link with nothing) and are never taken by mix. Without
labels quality keeps all rows with a word. Null ids are rows like any other, and come first in lines and
last in near; a null source is a source. Rows that repeat id and text stay or go together, and near keeps
all of them if one stays. Ties go to the smaller doc_id. Very long texts pass whole; a task holds one text
at a time with a few dozen bytes of working memory for each of its bytes. An empty table gives an empty
result. Other columns of documents are kept up to mix, whatever their names; n_chars is set anew where a
text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import jaccard, line_chunks, mixing, ordinal, packing
from weft.llm.common import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = ordinal.train(docs, ordinal.graded(table(spark, sf_dir, "labels")))
    return ordinal.selected(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_chunks.line_dedup(docs, passages=True).drop("_removed")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
