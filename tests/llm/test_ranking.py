"""Lexical search, importance draws and host rules against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import hosts, importance, ranked
from panelyard.llm.common import WordHashes
from tests.llm.helpers import COLUMNS, awkward_texts, documents, lowered, sentence, words_of


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    common = [(200 + i, f"tall ships {'sail ' * (i % 4)}home, NEAR the café-9 {sentence(rng, 30)}") for i in range(60)]
    return awkward_texts(rng) + common + [(260, "tall ships sail home"), (261, "tall ships sail home"), (262, "!!! ...")]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def queries_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in texts], "item_id long, text string")


# --- search -----------------------------------------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))


def all_scores(rows, query):
    docs = [(key, terms_of(text)) for key, text in rows]
    n_docs, n_terms = sum(1 for _, t in docs if t), sum(len(t) for _, t in docs)
    counts = [Counter(t) for _, t in docs]
    df = Counter(term for c in counts for term in c)
    out = []
    for (key, t), c in zip(docs, counts):
        score = 0
        for term in terms_of(query):
            if c[term]:
                m = 75 + 25 * len(t) * n_docs // n_terms
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                score += w * (1_000_000_000 * c[term] // (1000 * c[term] + 12 * m))
        if score > 0:
            out.append((score, key))
    return sorted(out, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


QUERIES = [(1, "tall ships SAIL home"), (2, "ships"), (3, "café-9 café"), (4, None), (5, ""), (6, "nobody wrote this_"),
           (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w9 w9"), (8, "same é 日本"), (8, "same é 日本"), (9, "tall w17 near 9 the")]


@pytest.mark.parametrize("block_words", [1 << 20, 900])
def test_search_matches_all_scores(spark, rows, monkeypatch, block_words):
    monkeypatch.setattr(ranked, "BLOCK_WORDS", block_words)
    # Functions travel by reference to their module: a worker has its own constants, so small blocks come from more partitions.
    docs = documents(spark, rows).repartition(1 if block_words > 1000 else 9)
    got = defaultdict(list)
    for r in ranked.search(ranked.index(docs), queries_of(spark, QUERIES), k=7).collect():
        got[(r.item_id, r.text)].append((r["rank"], r.score, r.id))
    for item, text in {(i, t) for i, t in QUERIES}:
        want = [(i + 1, s, key) for i, (s, key) in enumerate(all_scores(rows, text)[:7])] * QUERIES.count((item, text))
        assert sorted(got[(item, text)], key=repr) == sorted(want, key=repr), text


def test_search_in_groups_of_queries(spark, rows, monkeypatch):
    postings = ranked.index(documents(spark, rows))
    whole = ranked.search(postings, queries_of(spark, QUERIES), k=3).collect()
    monkeypatch.setattr(ranked, "GROUP_TERMS", 4)
    assert Counter(ranked.search(postings, queries_of(spark, QUERIES), k=3).collect()) == Counter(whole)


def test_search_of_nothing(spark, rows, empty):
    none = queries_of(spark, [])
    assert ranked.search(ranked.index(empty), queries_of(spark, QUERIES)).count() == 0
    assert ranked.search(ranked.index(documents(spark, rows)), none).count() == 0
    assert ranked.search(ranked.index(documents(spark, [(1, None), (2, ""), (None, "--")])), queries_of(spark, QUERIES)).count() == 0
    with pytest.raises(ValueError):
        ranked.search(ranked.index(empty), none.withColumn("Rank", F.lit(1)))


def test_search_opens_few_intervals():
    """The best documents of a block against all of them, also with a limit from elsewhere."""
    rng = np.random.default_rng(3)
    n, terms = 3000, 12
    norm = rng.integers(80, 160, n)
    lists = []
    for t in range(terms):
        at = np.flatnonzero(rng.random(n) < 0.02 * (t + 1))
        lists.append((t, at.astype(np.int32), rng.integers(1, 9, len(at)).astype(np.int32)))
    dense = np.zeros((terms, n), np.int64)
    for t, at, c in lists:
        dense[t, at] = 1_000_000_000 * c.astype(np.int64) // (1000 * c.astype(np.int64) + 12 * norm[at])
    weight = rng.integers(1, 5000, terms)
    total = weight @ dense
    order = sorted(range(n), key=lambda d: (-total[d], d))[:20]
    want = sorted((int(total[d]), -d) for d in order)
    arrays = np.zeros(terms, np.int64), np.arange(terms), weight
    best = ranked._Best(ranked._Group(*arrays), ranked._Maxima(lists, norm), 20)
    best.run(None)
    assert sorted(best.found[0]) == want
    best = ranked._Best(ranked._Group(*arrays, least={0: want[0][0]}), ranked._Maxima(lists, norm), 20)
    best.run(None)
    assert sorted(best.found[0]) == want


# --- importance -------------------------------------------------------------------------------


def features_of(text, run):
    words = [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))]
    return words, [" ".join(words[i:i + k]) for k in range(1, run + 1) for i in range(len(words) - k + 1)]


def drawn(rows, target, run, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features_of(text, run)[1]))
    for text in target:
        t.update(map(bucket, features_of(text, run)[1]))
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for key, text in rows:
        words, features = features_of(text, run)
        h = int(hashlib.sha256(f"{importance.SEED}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in features)
        out.append([key, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    chosen = percent * len(able) // 100
    ranks = [(*r, i + 1 if i < chosen else None) for i, r in enumerate(able)] + [(*r, None) for r in out if r[1] < least]
    return Counter((r[0], *r[2:]) for r in ranks)


@pytest.mark.parametrize("run,buckets,percent", [(1, 10_000, 10), (3, 50, 55)])
def test_draw(spark, rows, run, buckets, percent):
    target = ["tall ships sail home", "near the café", "w1 w2 w3", None, ""]
    docs = documents(spark, rows)
    got = importance.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, buckets=buckets,
                               run=run)
    assert Counter(tuple(r) for r in got.collect()) == drawn(rows, target, run, buckets, percent, importance.LEAST_WORDS)


def test_draw_of_nothing(spark, rows, empty):
    target = spark.createDataFrame([], "text string")
    assert importance.resampled(empty, target).count() == 0
    got = importance.resampled(documents(spark, rows), target)
    assert Counter(tuple(r) for r in got.collect()) == drawn(rows, [], 1, importance.BUCKETS, 10, 20)
    assert importance.resampled(documents(spark, [(1, None), (None, "a b")]), target).where("rank is null").count() == 2


def test_portions_of_a_long_text(monkeypatch):
    rng = random.Random(1)
    text = sentence(rng, 500) + " É" + "x" * 300 + " " + sentence(rng, 40)
    whole = [(n, sorted(p.tolist())) for n, p in importance.Buckets(997).of(text, 3)]
    monkeypatch.setattr(importance, "PORTION", 64)
    parts = list(importance.Buckets(997).of(text, 3))
    assert len(parts) > 20 and sum(n for n, _ in parts) == whole[0][0]
    assert sorted(np.concatenate([p for _, p in parts]).tolist()) == whole[0][1]


@pytest.mark.parametrize("digit,tile", [(11, 1 << 18), (9, 7)])
def test_radix_ranks(spark, digit, tile):
    rng = random.Random(digit)
    values = [(rng.choice([-(1 << 63), (1 << 63) - 1, 0, -1, 5, rng.randrange(-99, 99)]), rng.randrange(4), i) for i in range(300)]
    df = spark.createDataFrame(values, "a long, b long, i long").repartition(5)
    got = importance.radix_ranks(df, [(F.col("a"), True), (F.col("b"), False)], "place", digit, tile).collect()
    got.sort(key=lambda r: r.place)
    assert [r.place for r in got] == list(range(1, 301))
    assert [(r.a, r.b) for r in got] == [v[:2] for v in sorted(values, key=lambda v: (-v[0], v[1]))]
    assert sorted(r.i for r in got) == list(range(300))


def test_radix_ranks_of_equal_rows(spark):
    same = spark.range(40).select(F.lit(3).cast("long").alias("a"))
    assert [r.p for r in importance.radix_ranks(same, [(F.col("a"), False)], "p").orderBy("p").collect()] == list(range(1, 41))
    assert importance.radix_ranks(same.limit(0), [(F.col("a"), False)], "p").count() == 0


# --- hosts ------------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = words_of(text)
    runs = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    again = {i + o for i in range(len(words) - 4) if runs[tuple(words[i:i + 5])] > 1 for o in range(5)}
    lines = [line for line in text.split("\n") if words_of(line)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(again))


def test_counts_of_texts(rows):
    rng = random.Random(2)
    texts = [t for _, t in rows] + ["a b c d e a b c d e", "x " * 30, "é#|日本\n\n a\na\n a\n", "    $$", "a\x1cb c\x85d",
                                     " ".join(rng.choice("ab") for _ in range(200))]
    for text in texts:
        assert hosts.counts_of(text or "", WordHashes()) == plain_counts(text), text


def plain_rates(by_host, rule):
    n = {h: len(v) for h, v in by_host.items()}
    k = {h: sum(rule(c) for c in v) for h, v in by_host.items()}
    H, N, mean = len(n), sum(n.values()), sum(k.values()) / sum(n.values())
    if H < 2 or N == H:
        return {h: mean for h in n}
    among = sum(n[h] * (k[h] / n[h] - mean) ** 2 for h in n) / (H - 1)
    within = sum(k[h] * (1 - k[h] / n[h]) for h in n) / (N - H)
    size = (N - sum(v * v for v in n.values()) / N) / (H - 1)
    below = among + (size - 1) * within
    alike = (among - within) / below if below else 0
    if alike <= 1e-9:
        return {h: mean for h in n}
    a, b = mean * (1 - alike) / alike, (1 - mean) * (1 - alike) / alike
    return {h: (k[h] + a) / (n[h] + a + b) for h in n}


RULES = {"short": lambda c: c[0] < 10, "repeats": lambda c: 100 * c[5] > 20 * c[0], "symbols": lambda c: 10 * c[2] > c[1],
         "lines": lambda c: 10 * c[4] > 3 * c[3]}


def test_hosts(spark):
    rng = random.Random(5)
    good = lambda: sentence(rng, 40)
    rows = [(i, good(), f"host{i % 7}") for i in range(140)]
    rows += [(200 + i, "buy now $$$ " * 3 if i % 10 else good(), "spam") for i in range(60)]
    rows += [(300 + i, "line of text here\n" * 9, "lines") for i in range(20)] + [(330, good(), "spam"), (331, good(), "lines")]
    rows += [(400, "two words", "lone"), (401, None, "host1"), (402, "", None), (None, good(), None), (403, good(), None), (3, good(), "spam")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.withColumns({c: F.lit("own") for c in ("id", "host", "n_docs", "kept", "n_words", "rate_short")})
    by_host = defaultdict(list)
    for _, text, host in rows:
        if host is not None:
            by_host[host].append(plain_counts(text))
    rates = {name: plain_rates(by_host, rule) for name, rule in RULES.items()}
    bad = {h for h in by_host if max(r[h] for r in rates.values()) > hosts.HOST_LIMIT}
    assert {"spam", "lines"} <= bad and not {f"host{i}" for i in range(7)} & bad
    counted = hosts.text_counts(df, "doc_id", "text", F.col("source"))
    for r in hosts.host_rates(counted).collect():
        for name in RULES:
            assert r[f"rate_{name}"] == pytest.approx(rates[name][r.host], abs=1e-12)
    want = Counter()
    for key, text, host in rows:
        c = plain_counts(text)
        base = RULES["short"](c) or RULES["repeats"](c)
        want[(key, host, *c, base, host in bad, not base and host not in bad)] += 1
    assert Counter(tuple(r) for r in hosts.judged(df).collect()) == want


def test_hosts_with_nothing_to_tell_apart(spark, empty):
    assert hosts.judged(empty).count() == 0
    rng = random.Random(4)
    one = spark.createDataFrame([(i, sentence(rng, 30), "h") for i in range(3)], "doc_id long, text string, source string")
    assert hosts.judged(one).where("kept").count() == 3
    each = spark.createDataFrame([(i, sentence(rng, 30), f"h{i}") for i in range(3)] + [(9, "x", "h9")], one.schema)
    assert {r.id for r in hosts.judged(each).where("kept").collect()} == {0, 1, 2}
    assert {r.id for r in hosts.judged(each, host_col=F.concat("source", F.lit("!"))).where("kept").collect()} == {0, 1, 2}
