"""One registered query per corpus operator, over its whole table, with SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import (decontamination, hosts, importance, jaccard, licenses, pieces, pivots, quality, ranked, secrets,
                           sharding, substrings, toxicity, training)
from panelyard.llm.license_texts import KNOWN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def case(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    same = ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in licenses.EQUAL_WORDS.items())
    return (f"array_to_string(list_transform(regexp_extract_all(regexp_replace(lower({text}), {quoted(licenses.COPYRIGHT)}, '', 'g'), "
            f"'[\\p{{L}}\\p{{N}}]+'), lambda w: coalesce((MAP {{{same}}})[w], w)), ' ')")


@case(f"""
WITH known AS (
  SELECT sha256({_canonical_sql("t")}) AS digest, min(l) AS license
  FROM (VALUES {", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)}) v(l, t) GROUP BY 1),
whole AS (SELECT doc_id, {_canonical_sql("coalesce(text, '')")} AS c, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
noted AS (
  SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices
  FROM (SELECT doc_id, {_canonical_sql("l")} AS c FROM (SELECT doc_id, unnest(lines) AS l FROM whole))
  JOIN known ON digest = sha256(c) GROUP BY doc_id)
SELECT w.doc_id, CAST(CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS BIGINT) AS n_words,
  sha256(c) AS text_sha256, k.license, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN known k ON k.digest = sha256(c) LEFT JOIN noted n ON n.doc_id = w.doc_id
""")
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"), licenses.known_licenses(spark))
    return found.select(F.col("id").alias("doc_id"), "n_words", F.col("digest").alias("text_sha256"), "license",
                        F.array_join("notices", ",").alias("notices"))


SHARDS = [f"shard-{i:02d}" for i in range(32)]


@case(f"""
WITH RECURSIVE names AS (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 2, '0') AS name FROM range({len(SHARDS)}) r(i)),
numbers AS (
  SELECT i, CAST('0x' || substr(md5('offset:' || name), 1, 12) AS BIGINT) % {sharding.SLOTS} AS o,
    CAST('0x' || substr(md5('skip:' || name), 1, 12) AS BIGINT) % {sharding.SLOTS - 1} + 1 AS s FROM names),
-- s to the power of p - 2 is the inverse of s modulo a prime p
inverse AS (
  SELECT i, s, CAST({sharding.SLOTS - 2} AS BIGINT) AS e, s AS b, CAST(1 AS BIGINT) AS v FROM numbers
  UNION ALL
  SELECT i, s, e // 2, b * b % {sharding.SLOTS}, CASE WHEN e % 2 = 1 THEN v * b % {sharding.SLOTS} ELSE v END
  FROM inverse WHERE e > 0),
prefer AS (SELECT n.i, n.o, n.s, v.v FROM numbers n JOIN inverse v ON v.i = n.i AND v.e = 0),
turns AS (
  SELECT CAST(-1 AS BIGINT) AS t, range({sharding.SLOTS}) AS free, CAST(NULL AS BIGINT) AS slot
  UNION ALL
  SELECT t, list_filter(free, lambda x: x <> slot), slot FROM (
    SELECT u.t + 1 AS t, u.free,
      (p.o + p.s * list_min(list_transform(u.free,
        lambda x: (x - p.o + {sharding.SLOTS}) * p.v % {sharding.SLOTS}))) % {sharding.SLOTS} AS slot
    FROM turns u JOIN prefer p ON p.i = (u.t + 1) % {len(SHARDS)} WHERE len(u.free) > 0))
SELECT doc_id, k.slot, name AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)
  % {sharding.SLOTS} AS slot FROM documents) k
JOIN turns ON turns.slot = k.slot JOIN names ON names.i = turns.t % {len(SHARDS)}
""")
def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents"), "doc_id", SHARDS).withColumnRenamed("key", "doc_id")


@case(r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * k >= 80 * (len(x.s) + len(y.s) - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS n, doc_id AS r FROM sets UNION SELECT reach.n, b FROM reach JOIN both_ways ON a = reach.r)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT n, min(r) AS component_id FROM reach GROUP BY n) c ON c.n = s.doc_id
""")
def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, folder, "documents"))
    return found.toDF("doc_id", "n_shingles", "component_id")


def _judged(found: DataFrame, of: int, held: int, least: float) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), (training.remainder(F.col("id"), of) == held).alias("held_out"),
                        "score", (F.col("score") >= least).cast("int").alias("predicted"))


@case(r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
runs AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM texts WHERE len(w) >= 35),
named AS (SELECT r, i, array_to_string(w[i:i+34], ' ') AS run FROM runs),
again AS (SELECT run FROM named GROUP BY run HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + o AS j FROM named JOIN again USING (run), range(35) x(o)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM texts),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS left_text
  FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(left_text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
""")
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeated(table(spark, folder, "documents")).kept().withColumnRenamed("id", "doc_id")


@case()
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"),
                                     learn_rows=training.remainder(F.col("doc_id"), 3) != 1)
    return _judged(found, 3, 1, 0.7)


@case()
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"),
                                   learn_rows=training.remainder(F.col("doc_id"), 5) != 0)
    return _judged(found, 5, 0, 0.3)


_PARTS = [(0, secrets.ASSIGN, 2), (1, secrets.ACCESS, 0), (2, secrets.HEX, 0), (3, secrets.CANDIDATE, 0)]
_ALPHABET = quoted(secrets.ALPHABET)


@case(f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(
    f"SELECT r, {kind} AS kind, string_split_regex(text, {quoted(p)}) AS p, regexp_extract_all(text, {quoted(p)}, 0) AS m, "
    f"regexp_extract_all(text, {quoted(p)}, {group}) AS v FROM docs" for kind, p, group in _PARTS)}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
placed AS (
  SELECT r, kind, m[i] AS s, v[i] AS v, CAST(list_sum(list_transform(p[1:i], lambda x: len(x)))
    + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS BIGINT) AS a FROM each),
spans AS (
  SELECT r, kind, a, a + len(s) AS z, s FROM placed
  WHERE kind >= 2 OR kind = 0 AND len(v) >= {secrets.LEAST_VALUE} OR kind = 1 AND len(s) >= {secrets.LEAST_ACCESS}),
base AS (SELECT * FROM spans WHERE kind < 3),
runs AS (SELECT * FROM spans c WHERE kind = 3 AND NOT EXISTS (
  SELECT 1 FROM base b WHERE b.r = c.r AND b.a < c.z AND c.a < b.z)),
sample AS (
  SELECT min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text)
  ORDER BY md5(min(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text)) LIMIT {secrets.SAMPLE}),
words AS (
  SELECT true AS random, unnest(list_filter(regexp_extract_all(text, {quoted(secrets.ASSIGN)}, 2),
    lambda x: len(x) >= {secrets.LEAST_VALUE})) AS run FROM sample
  UNION ALL SELECT true, unnest(list_filter(regexp_extract_all(text, {quoted(secrets.ACCESS)}, 0),
    lambda x: len(x) >= {secrets.LEAST_ACCESS})) FROM sample
  UNION ALL SELECT true, unnest(regexp_extract_all(text, {quoted(secrets.HEX)}, 0)) FROM sample
  UNION ALL SELECT false, unnest(list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text,
    {quoted(secrets.ASSIGN)}, ' ', 'g'), {quoted(secrets.ACCESS)}, ' ', 'g'), {quoted(secrets.HEX)}, ' ', 'g'),
    {quoted(secrets.ORDINARY)}, 0), lambda x: regexp_matches(x, {quoted(secrets.NAME)}))) FROM sample),
pairs AS (SELECT random, substr(run, i, 2) AS pair FROM (SELECT random, run, unnest(range(1, len(run))) AS i FROM words)
  WHERE regexp_matches(pair, '^[A-Za-z0-9+/_=.-]{{2}}$')),
counted AS (SELECT random, pair, count(*) AS n FROM pairs GROUP BY ALL),
letters AS (SELECT substr({_ALPHABET}, i, 1) AS c FROM range(1, {len(secrets.ALPHABET) + 1}) t(i)),
kinds AS (SELECT unnest([true, false]) AS random),
grid AS (
  SELECT k.random, x.c AS a, y.c AS b, coalesce(n, 0) AS n FROM kinds k CROSS JOIN letters x CROSS JOIN letters y
  LEFT JOIN counted c ON c.random = k.random AND c.pair = x.c || y.c),
shares AS (
  SELECT random, a, b, ln((n + {secrets.SMOOTH}e0 * (sum(n) OVER (PARTITION BY random, b) + 0.5e0)
    / (sum(n) OVER (PARTITION BY random) + 0.5e0 * {len(secrets.ALPHABET)})) / (sum(n) OVER (PARTITION BY random, a) + {secrets.SMOOTH}e0)) AS l
  FROM grid),
ratios AS (SELECT x.a || x.b AS pair, x.l - y.l AS l FROM shares x JOIN shares y ON x.a = y.a AND x.b = y.b AND x.random AND NOT y.random),
scored AS (
  SELECT r, 3 AS kind, a, z FROM (SELECT r, a, z, s, unnest(range(1, len(s))) AS i FROM runs) u JOIN ratios ON pair = substr(s, i, 2)
  GROUP BY r, a, z, s HAVING sum(l) / (len(s) - 1) >= {secrets.LEAST_RATIO}e0),
every AS (SELECT r, kind, a, z FROM base UNION ALL SELECT r, kind, a, z FROM scored),
named AS (SELECT *, [{", ".join(quoted(k) for k in secrets.KINDS)}][kind + 1] || ':' || a || ':' || z AS label FROM every)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(label, ',' ORDER BY a, kind, z) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(label, ',' ORDER BY a, kind, z), '') AS spans
FROM docs LEFT JOIN named USING (r) GROUP BY r, doc_id
""")
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))
    count = lambda k: F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as bigint)")
    return found.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"),
                        count(2).alias("n_hex"), F.sha2(secrets.listed(kinds="s.kind < 3"), 256).alias("base_sha256"),
                        secrets.listed().alias("spans"))


#: The model file, read by the driver.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@case()
def op10_sampled_pieces(spark: SparkSession, folder: str) -> DataFrame:
    cut = pieces.encode(table(spark, folder, "documents"), pieces.model_bytes(PIECES))
    return cut.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


@case()
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.toDF("doc_id", "item_id", "score", "first_word", "end_word")


@case(r"""
WITH RECURSIVE good AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS ra, a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
counted AS (SELECT ra, count(*) AS n FROM links GROUP BY ra),
pairs AS (SELECT DISTINCT a, b FROM links),
reach AS (SELECT DISTINCT a AS n, a AS r FROM pairs UNION SELECT reach.n, pairs.b FROM reach JOIN pairs ON pairs.a = reach.r),
least AS (SELECT n, min(r) AS component FROM reach GROUP BY n),
every AS (SELECT row_number() OVER () AS r, vec_id FROM embeddings)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, coalesce(l.component, e.vec_id) AS component_id,
  e.vec_id = coalesce(l.component, e.vec_id) AS kept
FROM every e LEFT JOIN least l ON l.n = e.vec_id
LEFT JOIN (SELECT good.vec_id, n FROM counted JOIN good ON good.r = ra) c ON c.vec_id = e.vec_id
""")
def op9_embedding_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = pivots.near_duplicates(table(spark, folder, "embeddings")).toDF("vec_id", "n_links", "component_id")
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@case(r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
terms AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
tfs AS (SELECT r, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT r, count(*) AS n FROM terms GROUP BY r),
totals AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2e0 * all_docs + 2) / (2e0 * df + 1))) AS BIGINT) AS w FROM dfs, totals),
norms AS (SELECT r, 75 + (25 * n * all_docs) // all_terms AS m FROM sizes, totals),
asked AS (
  SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scores AS (
  SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN norms USING (r) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS n FROM scores WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM ranked WHERE n <= 20
""")
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    postings = ranked.index(table(spark, folder, "documents"))
    found = ranked.search(postings, table(spark, folder, "benchmark"))
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


_FEATURES = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


@case(f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS (SELECT r, unnest({_FEATURES}) AS word FROM docs),
target AS (SELECT unnest({_FEATURES}) AS word FROM benchmark),
every AS (SELECT word FROM words UNION SELECT word FROM target),
crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT CAST(i AS BIGINT) AS i FROM range(256) r(i))),
bytes AS (
  SELECT word, list_transform(range(0, len(hex(encode(word))) // 2),
    lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM every),
buckets AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) % {importance.BUCKETS} AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS s FROM words JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM words) AS all_s, (SELECT count(*) FROM target) AS all_t),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1e0) * (all_s + {importance.BUCKETS})
    / ((coalesce(s, 0) + 1e0) * (all_t + {importance.BUCKETS})))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM buckets) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals),
weights AS (
  SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS w FROM words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight, coalesce(w, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' ||
    substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (r)),
able AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n_able FROM scored
  WHERE n_features >= {importance.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {importance.PERCENT} * n_able // 100 THEN place END AS rank
FROM scored LEFT JOIN able USING (r)
""")
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = importance.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


_RULES_SQL = ", ".join(f"CASE WHEN {condition} THEN 1 ELSE 0 END AS f_{rule}" for rule, condition in hosts.RULES.items())


@case(f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
texts AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM docs),
runs AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM texts WHERE len(w) >= 5),
named AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS run FROM runs),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM named),
repeats AS (SELECT r, count(DISTINCT i + o) AS n FROM again, range(5) x(o) WHERE again.n > 1 GROUP BY r),
counted AS (
  SELECT t.r, doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM texts t LEFT JOIN repeats p ON p.r = t.r),
failed AS (SELECT *, {_RULES_SQL} FROM counted),
by_rule AS (UNPIVOT (SELECT host, {", ".join(f"f_{rule}" for rule in hosts.RULES)} FROM failed WHERE host IS NOT NULL)
  ON {", ".join(f"f_{rule}" for rule in hosts.RULES)} INTO NAME rule VALUE f),
hosts AS (SELECT rule, host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(f) AS DOUBLE) AS k FROM by_rule GROUP BY ALL),
totals AS (SELECT rule, CAST(count(*) AS DOUBLE) AS "H", sum(n) AS "N", sum(n * n) AS "R", sum(k) AS "K", sum(k * k / n) AS "Q" FROM hosts GROUP BY rule),
spread AS (SELECT rule, "K" / "N" AS mean, ("Q" - "K" * "K" / "N") / nullif("H" - 1, 0) AS among, ("K" - "Q") / nullif("N" - "H", 0) AS within,
  ("N" - "R" / "N") / nullif("H" - 1, 0) AS size FROM totals),
alike AS (SELECT rule, mean, (among - within) / nullif(among + (size - 1) * within, 0) AS a FROM spread),
rates AS (
  SELECT host, CASE WHEN a > 1e-9 THEN (k + mean * (1 - a) / a) / (n + (1 - a) / a) ELSE mean END AS rate FROM hosts JOIN alike USING (rule)),
refused AS (SELECT host FROM rates GROUP BY host HAVING max(rate) > {hosts.HOST_LIMIT})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  {" OR ".join(f"f_{rule} = 1" for rule in hosts.BASE)} AS base_failed, host IS NOT NULL AND host IN (FROM refused) AS host_failed,
  NOT ({" OR ".join(f"f_{rule} = 1" for rule in hosts.BASE)}) AND NOT (host IS NOT NULL AND host IN (FROM refused)) AS kept
FROM failed
""")
def op13_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = hosts.judged(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "host_failed", "kept")
