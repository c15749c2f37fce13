"""Secrets in texts: three patterns, and strings that look random to character Markov models.

Two first-order Markov models, of random strings and of ordinary identifiers, give each run of 20
characters or more a log-likelihood ratio; where it exceeds a threshold per transition the run is a
secret. Both are trained on labelled samples of a bounded number of texts: random are the values that the
patterns find, ordinary the other runs of eight characters or more whose digits, if any, stand at the end. Everything is DataFrame and SQL functions;
positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.plans import stage

#: The patterns, in the order in which kinds are listed; runs that fail the least length are dropped.
ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run of 32 or more; shorter ones never overlap it
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS = 8, 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
ORDINARY, NAME = r"[A-Za-z0-9+/_=-]{8,}", r"^[A-Za-z_-]+[0-9]{0,4}$"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Texts in the training sample, weight of a character's own share in that of a transition, nats per transition.
SAMPLE, SMOOTH, LEAST_RATIO = 4_000, 4.0, 0.5

SPAN = "struct<start:int,kind:int,end:int>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: int, pattern: str, guard: str, keep: str = "true") -> str:
    """SQL array of spans: matches and the pieces between them give the positions.

    ``keep`` tests a match ``m`` and its second group ``v``. Texts that fail ``guard`` cannot match and are not searched.
    """
    p = _quoted(pattern)
    values = f"regexp_extract_all(text, {p}, 2)" if kind == 0 else f"regexp_extract_all(text, {p}, 0)"
    return f"""
      CASE WHEN text IS NOT NULL AND {guard} THEN aggregate(
        arrays_zip(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), {values}),
        named_struct('at', 0, 'out', CAST(array() AS ARRAY<{SPAN}>)),
        (done, x) -> named_struct(
          'at', done.at + length(x.`0`) + coalesce(length(x.`1`), 0),
          'out', IF(x.`1` IS NULL OR NOT ({keep.replace("m!", "x.`1`").replace("v!", "x.`2`")}), done.out,
            array_append(done.out, named_struct('start', done.at + length(x.`0`), 'kind', {kind},
                                                'end', done.at + length(x.`0`) + length(x.`1`))))),
        done -> done.out)
      ELSE CAST(array() AS ARRAY<{SPAN}>) END"""


BASE = [
    _spans(0, ASSIGN, "(contains(text, '=') OR contains(text, ':'))", f"length(v!) >= {LEAST_VALUE}"),
    _spans(1, ACCESS, "contains(text, 'AKIA')", f"length(m!) >= {LEAST_ACCESS}"),
    _spans(2, HEX, "true"),
]


def training_sample(docs: DataFrame, id_col: str, text_col: str, rows: int = SAMPLE) -> DataFrame:
    """(random, run): runs of ``rows`` different texts, those with the smallest MD5 of id and text; all, if there are fewer."""
    h = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.col(text_col)))
    texts = docs.select(h.alias("h"), F.col(text_col).alias("text")).where("text is not null")
    # Few hashes are sorted, however many there are: those below a bound, which grows while repeated rows leave too few.
    share = (rows + 8 * math.sqrt(rows)) / max(1, texts.count())
    while True:
        bound = F.col("h") < F.lit(f"{int(share * (1 << 60)):015x}") if share < 1 else F.lit(True)
        least = texts.where(bound).select("h").distinct().orderBy("h").limit(rows)
        found = least.agg(F.count("*").alias("n"), F.max("h").alias("last")).first()
        if found.n >= rows or share >= 1:
            break
        share *= 4
    chosen = texts.where(F.col("h") <= F.lit(found.last)).groupBy("h").agg(F.min("text").alias("text"))
    chosen = stage(chosen.select("text"), "sample")
    values = f"""concat(
        filter(regexp_extract_all(text, {_quoted(ASSIGN)}, 2), x -> length(x) >= {LEAST_VALUE}),
        filter(regexp_extract_all(text, {_quoted(ACCESS)}, 0), x -> length(x) >= {LEAST_ACCESS}),
        regexp_extract_all(text, {_quoted(HEX)}, 0))"""
    rest = f"""filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text,
        {_quoted(ASSIGN)}, ' '), {_quoted(ACCESS)}, ' '), {_quoted(HEX)}, ' '), {_quoted(ORDINARY)}, 0),
        x -> x RLIKE {_quoted(NAME)})"""
    one = chosen.selectExpr("true AS random", f"explode({values}) AS run")
    return one.union(chosen.selectExpr("false AS random", f"explode({rest}) AS run"))


def log_ratios(sample: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition, row by row of the alphabet; both models are smoothed."""
    pairs = sample.selectExpr("random", "run", "explode(sequence(1, length(run) - 1)) AS i").selectExpr(
        "random", "substring(run, i, 2) AS pair")
    counts = pairs.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=.-]{2}$")).groupBy("random", "pair").agg(F.count("*").alias("n"))
    seen = {(r.random, r.pair): r.n for r in counts.collect()}  # at most two tables of the alphabet squared
    k = len(ALPHABET)
    total = {(kind, a): sum(seen.get((kind, a + b), 0) for b in ALPHABET) for kind in (True, False) for a in ALPHABET}
    met = {(kind, b): sum(seen.get((kind, a + b), 0) for a in ALPHABET) for kind in (True, False) for b in ALPHABET}
    every = {kind: sum(total[kind, a] for a in ALPHABET) for kind in (True, False)}

    def log_share(kind: bool, a: str, b: str) -> float:
        alone = (met[kind, b] + 0.5) / (every[kind] + 0.5 * k)  # of the character after any other
        return math.log((seen.get((kind, a + b), 0) + SMOOTH * alone) / (total[kind, a] + SMOOTH))

    return [log_share(True, a, b) - log_share(False, a, b) for a in ALPHABET for b in ALPHABET]


def _ratio(run: str, places: str, table: str) -> str:
    """SQL log-likelihood ratio per transition of a string of the alphabet."""
    codes = f"transform(split({run}, ''), c -> element_at({places}, ascii(c) + 1))"
    return f"""aggregate({codes}, named_struct('last', -1, 'sum', 0D),
        (done, c) -> named_struct('last', c, 'sum', IF(done.last < 0, 0D,
          done.sum + element_at({table}, done.last * {len(ALPHABET)} + c + 1))),
        done -> done.sum / (length({run}) - 1))"""


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
               name: str = "spans") -> DataFrame:
    """``docs`` with the spans (start, kind, end) of each row, by start, kind (a number into KINDS) and end.

    Pattern spans are leftmost and non-overlapping per kind; a random span overlaps none of them. Null and
    empty texts have no span; null and repeated ids are rows like any other; an empty table gives an empty result.
    Without any value in the sample random strings are taken as uniform. The rows are neither moved nor merged; ``name`` must be
    a new column.
    """
    table = log_ratios(training_sample(docs, id_col, text_col, sample))
    places = "array(" + ", ".join(str(max(0, ALPHABET.find(chr(b)))) for b in range(128)) + ")"
    weights = "array(" + ", ".join(f"{x!r}D" for x in table) + ")"
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    rows = rows.selectExpr("row", "text", f"concat({', '.join(BASE)}) AS base", f"{_spans(3, CANDIDATE, 'true')} AS runs")
    judged = f"""filter(runs, r -> NOT exists(base, b -> b.start < r.end AND r.start < b.end)
        AND {_ratio("substring(text, r.start + 1, r.end - r.start)", places, weights)} >= {LEAST_RATIO}D)"""
    return rows.selectExpr("row.*", f"array_sort(concat(base, IF(size(runs) > 0, {judged}, runs))) AS `{name}`")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id, text, spans) for every row; see ``with_spans``. Other columns are not read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_spans(rows, "id", "text", sample)


def listed(spans: str = "spans", kinds: str = "true") -> Column:
    """The spans as kind:start:end, joined by commas. ``kinds``: SQL test of a span ``s``."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform(filter({spans}, s -> {kinds}), s -> concat_ws(':', "
                  f"element_at({names}, s.kind + 1), s.start, s.end)), ',')")


def redacted(text: str = "text", spans: str = "spans", mark: str = "[secret]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    return F.expr(f"""IF(text IS NULL OR size({spans}) = 0, {text}, aggregate({spans},
        named_struct('at', 0, 'out', ''),
        (done, s) -> named_struct('at', greatest(done.at, s.end), 'out', IF(s.start < done.at, done.out,
          concat(done.out, substring({text}, done.at + 1, s.start - done.at), {_quoted(mark)}))),
        done -> concat(done.out, substring({text}, done.at + 1))))""")
