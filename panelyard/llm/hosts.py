"""Quality rules judged by host.

Every text is counted whole and held against rules. Failures are added up by host; a host's rate of failure under
each rule is drawn towards that of all hosts by a beta prior, whose strength comes from how much hosts differ beyond chance
(the analysis-of-variance estimate of the intraclass correlation). A host that fails most of its documents loses
the others too.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import Rows, WordHashes, run_hashes
from panelyard.plans import attach, stage, with_row

#: Words of a window that may be met again.
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
#: A document fails a rule where its condition holds. The first two are enough to refuse it.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("short", "repeats")
#: A host is refused if it fails a rule at a higher rate, after shrinking.
HOST_LIMIT = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(h: np.ndarray, k: int = WINDOW) -> int:
    """Words inside runs of ``k`` word hashes that occur more than once."""
    runs = run_hashes(h, k)
    order = np.argsort(runs)
    same = runs[order[1:]] == runs[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(runs), np.int64)
    again[order[1:][same]] = again[order[:-1][same]] = 1
    edges = np.zeros(len(h) + 1, np.int64)
    edges[:len(runs)] += again
    edges[k:] -= again
    return int((np.cumsum(edges)[:-1] > 0).sum())


def counts_of(text: str, hashes: WordHashes) -> tuple[int, ...]:
    """The values of ``COUNTS`` of one text."""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip(SPACES)]
    return (len(words), len(text) - len(raw) + len(raw.translate(None, SPACES)), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), repeated_words(hashes.of(words)))


def text_counts(docs: DataFrame, id_col: str, text_col: str, host: Column) -> DataFrame:
    """(id, host, and ``COUNTS``) of every row; a null text counts as the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(limit=200_000)
        rows = Rows(pa.schema([("id", pa.int64()), ("host", pa.string()), *[(c, pa.int64()) for c in COUNTS]]))
        for batch in batches:
            for key, name, text in zip(*(batch.column(i) for i in range(3))):
                rows.add(key.as_py(), name.as_py(), *counts_of(text.as_py() or "", hashes), size=96)
                if rows.full():
                    yield rows.batch()
        yield rows.batch()

    read = docs.select(F.col(id_col).cast("long").alias("id"), host.cast("string").alias("host"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, ", ".join(["id long", "host string", *[f"{c} long" for c in COUNTS]]))


def host_rates(counted: DataFrame, rules: Mapping[str, str] = RULES) -> DataFrame:
    """(host, n_docs, and per rule ``failed_<rule>`` and the shrunk ``rate_<rule>``) of every host that is not null.

    With one host, one document per host or no more spread than chance gives, every host has the rate of all of them.
    """
    failures = [F.count_if(F.expr(condition)).alias(f"failed_{rule}") for rule, condition in rules.items()]
    hosts = stage(counted.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), *failures), "hosts")

    n = F.col("n_docs").cast("double")
    totals = [F.count("*").cast("double").alias("hosts"), F.sum(n).alias("docs"), F.sum(n * n).alias("squares")]
    for rule in rules:
        k = F.col(f"failed_{rule}").cast("double")
        totals += [F.sum(k).alias(f"all_{rule}"), F.sum(k * k / n).alias(f"between_{rule}")]
    out = with_row(hosts, hosts.agg(*totals))
    others = F.nullif(F.col("hosts"), F.lit(1.0)) - 1
    size = (F.col("docs") - F.col("squares") / F.col("docs")) / others
    for rule in rules:
        k, total, between = F.col(f"failed_{rule}"), F.col(f"all_{rule}"), F.col(f"between_{rule}")
        among = (between - total * total / F.col("docs")) / others
        within = F.try_divide(total - between, F.col("docs") - F.col("hosts"))
        alike = F.try_divide(among - within, among + (size - 1) * within)
        strength = (1 - alike) / alike
        mean = total / F.col("docs")
        out = out.withColumn(f"rate_{rule}", F.when(alike > 1e-9, (k + mean * strength) / (n + strength)).otherwise(mean))
    return out.select("host", "n_docs", *[f"failed_{r}" for r in rules], *[f"rate_{r}" for r in rules])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | Column = "source",
           rules: Mapping[str, str] = RULES, base: tuple[str, ...] = BASE, limit: float = HOST_LIMIT) -> DataFrame:
    """(id, host, counts, base_failed, host_failed, kept) of every row of ``docs``.

    ``base_failed`` says that a rule of ``base`` fails the row, ``host_failed`` that its host's shrunk rate of some
    rule is above ``limit``; ``kept`` that neither holds. ``host_col`` is a name or an expression, for tables of URLs.
    Null and empty texts have no words and fail by that; rows without a host are judged by their own text only and
    count for no host. Repeated rows count each time, null ids like others, very long texts whole. An empty table gives an
    empty result; other columns are not read, whatever their names.
    """
    host = F.col(host_col) if isinstance(host_col, str) else host_col
    counted = stage(text_counts(docs, id_col, text_col, host), "counted")
    bad = F.greatest(F.lit(0.0), *[F.col(f"rate_{rule}") for rule in rules]) > limit
    hosts = host_rates(counted, rules).select("host", bad.alias("host_failed"))
    failed = F.expr(" or ".join(f"({rules[rule]})" for rule in base))
    return attach(counted, hosts, ["host"]).select(
        "id", "host", *COUNTS, failed.alias("base_failed"), F.coalesce("host_failed", F.lit(False)).alias("host_failed")
    ).withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
