"""Licences by the digest of a canonical text.

A text is lower-cased, loses its copyright lines, is cut into runs of letters and digits (so
punctuation, layout and comment marks vanish), and spellings that mean the same become one. The SHA-256 of
these words, joined by one space, is looked up among the digests of known licences: a join by
digest, of whole documents and of each of their lines (notices are lines).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import Rows
from panelyard.llm.license_texts import KNOWN
from panelyard.plans import stage

#: Spellings that count as equal, British or long form first.
EQUAL_WORDS = {
    "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "analogue": "analog",
    "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "categorise": "categorize",
    "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses",
    "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
COPYRIGHT = r"(?m)^[ \t]*[#*/;%-]*[ \t]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9<\[{])|\(c\)|©|all rights reserved)[^\n]*$"
WORD = r"[^\W_]+"


def canonical(text: str | None) -> str:
    """The words that count, joined by one space; '' for null."""
    text = (text or "").lower()
    if "copyright" in text or "(c)" in text or "©" in text or "all rights reserved" in text:
        text = re.sub(COPYRIGHT, "", text)
    words = re.findall(WORD, text)
    return " ".join([EQUAL_WORDS.get(w, w) for w in words])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, license): one row per digest; of licences with equal texts the first by name."""
    rows = sorted({(digest(canonical(text)), name) for name, text in texts if canonical(text)})
    return spark.createDataFrame(rows, "digest string, license string").groupBy("digest").agg(
        F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, digest, license, notices), one row per input row.

    ``n_words`` and ``digest`` are those of the canonical whole text, ``license`` the licence that this
    digest names (or null), ``notices`` the sorted licences that single lines name, with repetitions. Null
    and empty texts are the empty text and match nothing; null and repeated ids stay rows of their own.
    ``known``: (digest, license); nulls there are passed over, of rows with one digest the first by name
    counts. Any number of documents may share a digest: the known side has one row for each. An empty table
    gives an empty result; other columns are not read.
    """
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("whole", pa.bool_()), ("digest", pa.string()),
                        ("n_words", pa.int64())])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for row, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py() or ""
                whole = canonical(text)
                out.add(row, key, True, digest(whole), whole.count(" ") + 1 if whole else 0, size=160)
                for line in text.split("\n"):
                    if line := canonical(line):
                        out.add(row, key, False, digest(line), None, size=160)
                if out.full():
                    yield out.batch()
        yield out.batch()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).alias("text"))
    rows = rows.mapInArrow(units, "row long, id long, whole boolean, digest string, n_words long")
    # Written, so that its size is known and a small table of licences moves in place of all lines.
    table = stage(known.where("digest is not null and license is not null").groupBy("digest").agg(
        F.min("license").alias("license")), "known")
    met = rows.join(table, "digest", "left").where("whole or license is not null")
    return met.groupBy("row").agg(
        F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
        F.max(F.expr("if(whole and n_words > 0, license, null)")).alias("license"),
        F.sort_array(F.collect_list(F.expr("if(whole, null, license)"))).alias("notices")).drop("row")
