"""From documents to packed token ids: quality rules, line dedup, near duplicates, mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as
the next stage's documents.  All but the last return the columns of ``documents``.

Null and empty texts, and those of fewer than ten words, fail the quality rules and go there; a null id, language
or source stays null throughout, and a null source is one of the mix's sources.  Rows equal in id and text are
one document to the line stage and one row after the near-duplicate stage; of equal lines and of near
duplicates the first by id stays (null last).  The mix repeats rows that it takes more than once.  Texts of
any length are worked on whole, an empty table passes every stage, and columns beyond those of ``documents``
are left behind by the first one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, lines, mixing, neardup, quality
from quillgraph.llm.common import Table, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the full policy keeps."""
    return quality.keep_documents(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occurred before; those that lose their last words go."""
    return lines.remove_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8."""
    return neardup.keep_one(docs.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source weights takes them."""
    return mixing.take(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, packed, with digests of the ids and of the text that they decode to."""
    return bpe.encode_table(docs, "text", ("doc_id", "lang", "source"), keep_text=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("encode", encode),
]

#: Segment joins, MinHash components and BPE aren't SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = Table(stage(spark, docs, sf_dir), f"pipeline-{name}").df()
    return docs
