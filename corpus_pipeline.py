"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage
before it kept. All stages but the last return the columns of ``documents``, other
columns of the input among them whatever their names. Null texts count as empty; a
document without words has no near-duplicates, one without letters is of no
language. A null key is no key: such rows are judged by their texts alone. Rows that
repeat are judged alike by the first two stages and the fourth, and the third keeps
one of them. Ties between copies go to the smallest key, then to the text. Empty
tables give empty tables with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import group_join, hyperlang, packing, quality, token_efficiency
from seriesloom.llm.queries import WORD_BPE
from seriesloom.llm.shared import release, settle, table

#: The stages use fitted models and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees take for quality 1."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose n-gram profile is like one of the table's languages."""
    return hyperlang.keep_identified(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id."""
    return group_join.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and the length counted anew where they were."""
    clean = token_efficiency.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows (see ``packing.pack_documents``), their ids as a checksum."""
    pieces = packing.pack_documents(docs, WORD_BPE, window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("secret_scan", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder for the next, and deleted once that is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
