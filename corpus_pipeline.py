"""From raw documents to piece ids: quality, near duplicates, benchmark passages, secrets, encoding.

Each stage takes the documents that the one before it kept, as a table, and returns documents; the last one returns ids.
Every stage works on whole texts, however long, and on an empty table; further columns of documents are kept, whatever their names, by all
but the last. Rows with a null id or text, repeated rows and equal texts are rows like others unless a stage says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import decontamination, jaccard, pieces, quality, secrets, training
from panelyard.llm.cases import PIECES
from panelyard.llm.common import free_name
from panelyard.plans import stage

#: Texts that score less are refused.
LEAST_QUALITY = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts score by the bias alone. Equal texts have equal scores, so they stay or go together.
    """
    return quality.good_texts(docs, _table(spark, sf_dir, "labels"), LEAST_QUALITY,
                              learn_rows=training.remainder(F.col("doc_id"), 5) != 0)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Rows without words or without an id are in no group and stay. Of rows that repeat the kept id the first in the order of all columns stays.
    """
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none and stay, as do all documents if the benchmark is empty; equal texts stay or go together, whatever their ids.
    """
    return decontamination.clean_texts(docs, _table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text where it changes.

    Null and empty texts stay as they are; repeated rows are marked alike.
    """
    spans, text = free_name(docs, "spans"), free_name(docs, "clean")
    found = secrets.with_spans(docs, name=spans)
    clean = found.withColumn(text, secrets.redacted("text", spans))
    changed = {"text": F.col(text), "n_chars": F.when(F.size(spans) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return clean.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids): the sampled pieces of every document.

    A null text has a null n_pieces and null ids, an empty one no piece. Rows of one id and text are cut alike.
    """
    cut = pieces.encode(docs, pieces.model_bytes(PIECES))
    return cut.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("piece_encoding", piece_encoding),
]

#: SQL has no regularised-leader updates, alignments or lattices; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on documents; each but the last is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
