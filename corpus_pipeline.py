"""A training-data pipeline over documents: quality rules, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on everything that the one before it kept. All stages but the last return the columns
of documents; the last returns, for each document that is left, its token count and the digests of its ids and of what
these decode to, with the ids themselves. Columns with other names come along up to the last stage, whatever they are called;
an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import op2_near_dedup, op5_decontaminate, op6_lines, op8_bpe, op10_quality
from wordloom.llm.common import read, saved
from wordloom.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their hosts' boilerplate lines. Null and empty texts have too few words
    and go. Repeated rows are judged one by one, alike. A null source is a host; a null doc_id loses no lines."""
    return op10_quality.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each repeated line left in the one of the smallest doc_id only. No row goes: a text may become empty,
    null stays null, and a null doc_id loses nothing. Rows that repeat a doc_id are one document."""
    return op6_lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each class of near-duplicates, with all its rows. Texts without words are near
    only to equal ones (null as empty). A null doc_id stays."""
    return op2_near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item; one item is enough to remove a document, with all its rows. Null and
    empty texts hold none; a null doc_id can't be named, so it stays. An empty benchmark removes nothing."""
    return op5_decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; null and empty texts have no tokens. Rows are taken one by one."""
    return op8_bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"), keep=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("bpe", bpe)]
#: SQL has no merging of byte pairs; tests/llm/test_pipeline.py holds the rows, and each stage, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each one's result is written to the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
