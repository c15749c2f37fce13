import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelyard.llm import common, jaccard, pivots, substrings
from panelyard.llm.components import components
from tests.llm.helpers import COLUMNS, Groups, awkward_texts, documents, lowered, sentence, words_of


def shingles(text):
    w = words_of(lowered(text))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected_groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    groups = Groups()
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if None not in (i, j) and x and y and 100 * len(x & y) >= 80 * len(x | y):
                groups.link(i, j)
    return Counter((i, len(s), None if i is None else groups.find(i) if s else i) for i, s in sets)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_all_pairs(spark, seed):
    rows = awkward_texts(random.Random(seed))
    found = jaccard.near_duplicates(documents(spark, rows)).collect()
    assert Counter((r.id, r.n, r.component) for r in found) == expected_groups(rows)


def test_pairs_of_a_large_group_are_listed_in_portions():
    """Nine groups of 512 by 512 classes: 2.4 million pairs in one batch, listed 131,072 at a time."""
    rng = np.random.default_rng(0)
    size, groups = 512, 9
    base = rng.integers(0, 2**63, (8, 8)).astype(np.uint64)
    bits = base[rng.integers(0, 8, 2 * size)]
    bits[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 2 * size).astype(np.uint64)
    at = rng.permutation(2 * size)
    sketch = [bits[a].tobytes() for a in at]
    n = np.full(2 * size, 60)
    one = {"i": 0, "j": 0, "left": np.arange(2 * size) < size, "at": at, "comp": at + 1000, "n": n}
    parts = [pa.table({"key": np.full(2 * size, g), **{c: np.broadcast_to(v, 2 * size) for c, v in one.items()}, "sketch": sketch})
             for g in range(groups)]
    batch = pa.concat_tables(parts).combine_chunks().to_batches()[0]
    met = jaccard.Met(80)
    tracemalloc.start()
    met.compare(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = set()
    for r in met.flush().to_pylist():
        cells = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).reshape(256, 256)
        got |= {((r["bx"] << 8) + x, (r["by"] << 8) + y) for x, y in np.argwhere(cells).tolist()}
    apart = np.bitwise_count(bits[at[:size], None] ^ bits[None, at[size:]]).sum(axis=2)
    near = np.argwhere(apart * 180 <= 20 * 120)
    assert got == {tuple(sorted((int(at[x]), int(at[size + y])))) for x, y in near.tolist()} and got
    assert peak < 60e6


def test_near_duplicates_over_all_edit_rates(spark):
    """Pairs on both sides of the threshold, in short and long sets."""
    rng = random.Random(5)
    rows = []
    for size in (5, 6, 8, 11, 17, 25, 40, 64, 90, 130):
        for _ in range(12):
            words = sentence(rng, size, 10**6).split()
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.randrange(0, 1 + size // 20 + 1)):
                words[rng.randrange(size)] = "changed"
            rows.append((len(rows), " ".join(words[: size - rng.randrange(0, 1 + size // 12)])))
    found = jaccard.near_duplicates(documents(spark, rows)).collect()
    assert Counter((r.id, r.n, r.component) for r in found) == expected_groups(rows)


def test_large_group_of_loose_copies(spark):
    """Copies of one text that are near to some and not to others: every link counts."""
    rng = random.Random(6)
    base = sentence(rng, 120, 10**6).split()
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    found = jaccard.near_duplicates(documents(spark, rows)).collect()
    assert Counter((r.id, r.n, r.component) for r in found) == expected_groups(rows)


def test_pairs_of_blocks_in_many_partitions(spark):
    """Places of 200 partitions: pairs keep their classes, whatever bits their numbers take."""
    base = np.sort(np.random.default_rng(7).integers(0, 2**63, 100).astype(np.uint64))
    tokens = [np.delete(base, i) for i in range(12)]
    at = [(p << 33) + p % 3 * 300 for p in (0, 1, 2, 63, 64, 65, 66, 127, 128, 129, 198, 199)]
    rows = [(1, a, p % 2, 99, bytearray(jaccard.parity_bits(t))) for p, (a, t) in enumerate(zip(at, tokens))]
    found = jaccard.across(spark.createDataFrame(rows, "key long, at long, comp long, n long, sketch binary"), 80)
    places = spark.createDataFrame([(a, p, p % 2) for p, a in enumerate(at)], "at long, class long, comp long").repartition(200, "at")
    sets = spark.createDataFrame([(p, bytearray(t.tobytes())) for p, t in enumerate(tokens)], "class long, tokens binary")
    got = Counter((r.a, r.b) for r in jaccard.linked_across(found, places, sets, 80).collect())
    assert got == Counter((a, b) for a in range(12) for b in range(a + 1, 12, 2))


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 200))) for _ in range(2))
        assert jaccard.bits_apart(jaccard.parity_bits(x), jaccard.parity_bits(y)) <= len(np.setxor1d(x, y))


def test_pairs_at_once_are_pairs_one_by_one():
    rng = np.random.default_rng(4)
    raw = [jaccard.parity_bits(np.unique(rng.integers(0, 2**63, rng.integers(1, 500)).astype(np.uint64))) for _ in range(60)]
    x, y = rng.integers(0, 60, 500), rng.integers(0, 60, 500)
    assert jaccard.Sketches(raw).apart(x, y).tolist() == [jaccard.bits_apart(raw[a], raw[b]) for a, b in zip(x, y)]


def test_one_of_each_keeps_columns(spark):
    rows = awkward_texts(random.Random(4))
    docs = documents(spark, rows)
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    groups = expected_groups(rows)
    chosen = {c for i, n, c in groups if n and i is not None}
    got = Counter(r.doc_id for r in left.collect())
    assert {i for i in got if i is not None and i in chosen} == chosen
    assert all(got[i] == 1 for i in chosen)
    assert got[None] == 3 and got[140] == got[141] == got[142] == 1


def expected_kept(rows, k):
    runs = Counter()
    for _, t in rows:
        w = words_of(t)
        runs.update(tuple(w[j:j + k]) for j in range(len(w) - k + 1))
    out = Counter()
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for j in range(len(w) - k + 1):
            if runs[tuple(w[j:j + k])] > 1:
                gone.update(range(j, j + k))
        left = [x for j, x in enumerate(w) if j not in gone]
        out[i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("k", [35, 12])
def test_repeated_words_match_all_runs(spark, k):
    rows = awkward_texts(random.Random(9))
    found = substrings.repeated(documents(spark, rows), k=k)
    got = Counter(tuple(r) for r in found.kept().collect())
    want = expected_kept(rows, k)
    assert got == want


def test_repeated_words_of_rows_without_an_id(spark):
    rng = random.Random(12)
    passage = sentence(rng, 40, 10**6)
    rows = [(i, f"{sentence(rng, 20, 10**6)} {passage} {sentence(rng, 25, 10**6)}") for i in (None, 2, None, 4, 4)]
    rows += [(None, sentence(rng, 90, 10**6)), (4, sentence(rng, 90, 10**6))]
    got = substrings.repeated(documents(spark, rows)).kept().collect()
    assert Counter(tuple(r) for r in got) == expected_kept(rows, 35)
    assert sorted(r.n_removed for r in got) == [0, 0, 40, 40, 40, 40, 40]


def test_passages_are_paths(spark):
    rng = random.Random(2)
    passage = sentence(rng, 80, 10**6)
    rows = [(i, f"{sentence(rng, 30, 10**6)} {passage} {sentence(rng, 30, 10**6)}") for i in range(6)]
    found = substrings.repeated(documents(spark, rows))
    by_row = {}
    for r in found.passages().collect():
        by_row.setdefault(r.id, []).append((r.path, r.start, r.end))
    assert len(by_row) == 6
    paths = [sorted((p, e - s) for p, s, e in spans) for spans in by_row.values()]
    assert all(p == paths[0] for p in paths)  # the same paths of the same lengths in every row
    for i, spans in by_row.items():
        assert min(s for _, s, _ in spans) == 30 and max(e for _, _, e in spans) == 110


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 100, 50)
    for width in (1, 2, 3, 7, 8, 28, 50):
        assert (substrings.least_of(x, width) == [x[i:i + width].min() for i in range(51 - width)]).all()


def test_keys_met_again(spark):
    rng = random.Random(0)
    rows = [(rng.randrange(2000), i) for i in range(3000)] + [(7, i) for i in range(9000)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = {(r.k, r.v) for r in common.keys_met_again(df, ["k"], ["v"], 8).collect()}
    held = Counter(k for k, _ in rows)
    assert {x for x in rows if held[x[0]] > 1} <= got <= set(rows)
    assert len(got) <= sum(n for n in held.values() if n > 1) + 16


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40, 100)] + [(5, j) for j in range(200, 260)] + [(9, 9), (None, 3), (1, 2), (2, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 40 for i in range(40, 101)} | {5: 5} | {j: 5 for j in range(200, 260)} | {1: 1, 2: 1}
    assert got == want


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(
        {c: F.lit(1) for c in ("id", "vec", "class", "n", "near", "pivot")})


def test_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 16))
    near = base[:40] + rng.normal(size=(40, 16)) * 0.05
    hot = np.repeat(base[:1], 60, 0) + rng.normal(size=(60, 16)) * 0.02
    data = np.concatenate([base, near, hot, base[:30], base[:1].repeat(20, 0)]).astype(np.float32)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(data)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15),
           (905, [float("inf")] + [1.0] * 15), (906, [1.0] * 8), (None, data[0].tolist())]
    rows += [(i, x, 0) for i, x in odd]
    got = {r.id: (r.n_links, r.component) for r in pivots.near_duplicates(vectors(spark, rows)).collect()}
    x = data.astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = (x @ x.T) >= 0.9
    np.fill_diagonal(close, False)
    same = (data[:, None] == data[None]).all(2) & ~np.eye(len(data), dtype=bool)
    close |= same
    found = sum(got[i][0] for i in range(len(data)))
    assert 0.95 * close.sum() <= found <= close.sum()  # never a pair below the cosine
    assert all(got[i][0] <= close[i].sum() for i in range(len(data)))
    groups = Groups()
    for a, b in zip(*np.nonzero(close)):
        groups.link(int(a), int(b))
    assert np.mean([got[i][1] == groups.find(i) for i in range(len(data))]) > 0.98
    assert all(got[i] == (0, i) for i, _ in odd if i is not None) and got[None] == (0, None)


def test_vectors_of_several_lengths(spark):
    """Each length is an index of its own; none is left out, however rare."""
    rng = np.random.default_rng(5)
    rows, of = [], {}
    for size, many in ((2, 3), (3, 40), (8, 200), (40, 6)):
        base = rng.normal(size=(many, size))
        base[1] = base[0]
        base[2] = base[0] * 3
        for x in base:
            of[len(rows)] = x.astype(np.float32)
            rows.append((len(rows), x.astype(np.float32).tolist(), 0))
    got = {r.id: (r.n_links, r.component) for r in pivots.near_duplicates(vectors(spark, rows)).collect()}
    groups, links = Groups(), Counter()
    for i, x in of.items():
        for j, z in of.items():
            if i != j and len(x) == len(z) and x.astype(float) @ z / np.linalg.norm(x.astype(float)) / np.linalg.norm(z.astype(float)) >= 0.9:
                links[i] += 1
                groups.link(i, j)
    found = sum(got[i][0] for i in of)
    assert 0.95 * links.total() <= found <= links.total()
    for first in (0, 3, 43, 243):
        assert got[first][0] >= 2 and {got[first + k][1] for k in range(3)} == {first}


def test_rounded_vectors_never_refuse_a_close_pair():
    rng = np.random.default_rng(8)
    for size in (1, 3, 64, 700):
        x = pivots.unit(rng.normal(size=(200, size)) * rng.choice([1e-3, 1, 30], size=(1, size)))
        y = pivots.unit(x + rng.normal(size=x.shape) * 0.45 * np.abs(x).mean())
        both = np.concatenate([x, y])
        rounded = pivots.Rounded.back(pivots.Rounded.of(both))
        a, b = np.meshgrid(np.arange(400), np.arange(400))
        may, cosine = rounded.may_reach(a.ravel(), b.ravel(), 0.9), np.einsum("ij,ij->i", both[a.ravel()], both[b.ravel()])
        assert may[cosine >= 0.9].all() and not may[cosine < 0.85].any()


@pytest.mark.parametrize("wide, need", [(4, 2), (9, 3), (1, 1)])
def test_retrieved_pairs(monkeypatch, wide, need):
    """By shared pivots counted one by one; each pair in the first list that it shares only, whatever the portions."""
    rng = np.random.default_rng(wide)
    near = np.sort(np.array([rng.choice(20, wide, replace=False) for _ in range(60)], np.int32), axis=1)
    sets = [set(r) for r in near.tolist()]
    for at_once in (1 << 21, 50):
        monkeypatch.setattr(pivots, "AT_ONCE", at_once)
        pairs = []
        for pivot in range(20):
            rows = np.flatnonzero((near == pivot).any(1))
            if not len(rows):
                continue
            half = len(rows) // 2
            for left, right in ((rows, rows), (rows[:half], rows[half:])):
                found = [(a, b) for p, q in pivots.retrieved(near, pivot, need, left, right) for a, b in zip(p.tolist(), q.tolist())]
                if left is rows:
                    pairs += found
                else:
                    assert sorted(found) == sorted(x for x in ((a, b) for a in left for b in right)
                                                   if len(sets[x[0]] & sets[x[1]]) >= need and min(sets[x[0]] & sets[x[1]]) == pivot)
        assert sorted(pairs) == [(a, b) for a in range(60) for b in range(a + 1, 60) if len(sets[a] & sets[b]) >= need]


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(1)[:, None] * a
    z /= np.linalg.norm(z, axis=1)[:, None]
    b = 0.9005 * a + np.sqrt(1 - 0.9005**2) * z
    data = np.concatenate([a, b])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, embedding array<double>")
    found = pivots.near_duplicates(df)
    assert found.agg(F.sum("n_links")).first()[0] >= 0.9 * 2 * len(a)


@pytest.mark.parametrize("many, width", [(32, 64), (335, 64), (1500, 64), (4743, 64), (4743, 128), (15000, 64), (1500, 8), (1500, 2)])
def test_nearest_pivots_grow_with_their_number(many, width):
    """Pivots of up to 100 million vectors: pairs with a cosine of exactly 0.9 share enough of them."""
    rng = np.random.default_rng(many + width)
    p, x, z = (rng.normal(size=(n, width)) for n in (many, 1000, 1000))
    p, x = pivots.unit(p), pivots.unit(x)
    y = 0.9 * x + np.sqrt(0.19) * pivots.unit(z - (z * x).sum(1, keepdims=True) * x)
    near = pivots.nearest_for(p, 0.9, pivots.SHARED)
    a, b = (np.argsort(-(v @ p.T), axis=1)[:, :near] for v in (x, y))
    recall = np.mean([len(np.intersect1d(i, j)) >= pivots.SHARED for i, j in zip(a, b)])
    print(many, width, near, recall)
    assert recall >= 0.9 and near >= min(many, pivots.NEAREST)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], COLUMNS)
    assert jaccard.near_duplicates(docs).count() == 0
    assert jaccard.one_of_each(docs).count() == 0
    found = substrings.repeated(docs)
    assert found.kept().count() == 0 and found.passages().count() == 0
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
