"""Near-duplicate documents by parity sketches of their word shingles.

A document's set holds the hashes of its distinct runs of five words. Its tokens are dealt by
hash to the blocks of a sketch whose length follows the size band, and XORed there. A block
differs between two documents only if it holds a token of their symmetric difference, so the
number of differing blocks (and of differing bits) never exceeds that difference. With sizes p
and q, similarity t means a symmetric difference of at most (1 - t) / (1 + t) * (p + q):
pigeonhole over the blocks then leaves at least one common block for every pair to be found.

Blocks with two tokens or more are *dense*; they are the join keys, as a block of one token is
shared by all documents with that token. Any total order of keys will do for the pigeonhole:
two documents that differ in at most d tokens and have a dense block in common meet in the
first d + 1 dense keys of either. So a document needs no more keys than d + 1, and it takes its rarest, by counts over
all documents. One with fewer dense blocks than d + 1 adds its keys of single tokens, and one
that lacks even those adds its empty blocks. No key, pair or document is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.common import (U, Rows, WordHashes, free_name, keys_met_again, list_array, mix, partitions_for,
                                  run_hashes, signed)
from panelyard.llm.components import components
from panelyard.plans import stage

DENSE, SINGLE, EMPTY = 0, 1, 2
#: Rows of one key that meet in one call; larger groups meet portion by portion.
PORTION = 512
#: Pairs that a task lists at a time; each takes about a hundred bytes then.
PAIRS = 1 << 17


def shingle_set(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, none has none."""
    if not words:
        return np.zeros(0, U)
    return np.unique(run_hashes(hashes.of(words), min(size, len(words))))


def bands_of(n: int, percent: int) -> list[int]:
    """The size bands in which a set of ``n`` tokens can meet a partner at least as large."""
    return sorted({n.bit_length() - 1, (n * 100 // percent).bit_length() - 1})


def most_apart(n: int, percent: int) -> int:
    """The largest symmetric difference between a set of ``n`` tokens and any partner it links with."""
    return n * (100 - percent) // percent


def block_keys(tokens: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, kinds, number of non-empty blocks) of one sketch.

    A key names band, block and the block's parity; its low byte holds band and kind.
    """
    # Just over the largest difference, and 1.3 to 2.6 tokens a block where sizes allow.
    blocks = max(most_apart(2 << band, percent) + 1, int((1 << band) / 1.3))
    at = ((tokens >> U(32)) * U(blocks)) >> U(32)  # tokens are sorted, so are blocks
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    parity = np.bitwise_xor.reduceat(tokens, start)
    several = np.diff(np.r_[start, len(tokens)]) > 1
    kinds = np.where(several, DENSE, SINGLE)
    full = at[start]
    if several.sum() > most_apart(len(tokens), percent):
        full, parity, kinds = full[several], parity[several], kinds[several]
    elif len(start) <= most_apart(len(tokens), percent):
        rest = np.setdiff1d(np.arange(blocks, dtype=U), full)
        full = np.r_[full, rest]
        parity = np.r_[parity, np.zeros(len(rest), U)]
        kinds = np.r_[kinds, np.full(len(rest), EMPTY)]
    name = mix(parity ^ mix(full * U(64) + U(band)))
    return (name & ~U(0xFF)) | U(band << 2) | kinds.astype(U), kinds, len(start)


def parity_bits(tokens: np.ndarray) -> bytes:
    """One bit for each token or more, a power of two: the parity of the tokens dealt to it."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """Differing bits; the longer sketch is folded to the length of the shorter one."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


class Sketches:
    """Parity bits of many rows, by length, for comparing many pairs at once."""

    def __init__(self, raw: list[bytes]):
        self.size = np.array([len(r) for r in raw])
        self.row = np.zeros(len(raw), np.int64)
        self.bits: dict[int, np.ndarray] = {}
        for size in np.unique(self.size).tolist():
            here = np.flatnonzero(self.size == size)
            self.row[here] = np.arange(len(here))
            self.bits[size] = np.frombuffer(b"".join([raw[i] for i in here.tolist()]), U).reshape(len(here), -1)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Differing bits of each pair, the longer sketch folded."""
        out = np.zeros(len(x), np.int64)
        both = np.stack([self.size[x], self.size[y]], axis=1)
        for p, q in np.unique(both, axis=0).tolist():
            here = np.flatnonzero((both[:, 0] == p) & (both[:, 1] == q))
            short = min(p, q) // 8
            a, b = (self.bits[k].reshape(len(self.bits[k]), -1, short) for k in (p, q))
            a, b = np.bitwise_xor.reduce(a, axis=1), np.bitwise_xor.reduce(b, axis=1)
            step = max(1, PAIRS // short)
            for lo in range(0, len(here), step):
                part = here[lo:lo + step]
                out[part] = np.bitwise_count(a[self.row[x[part]]] ^ b[self.row[y[part]]]).sum(axis=1)
        return out


SIGNED = "id long, n long, class long, other long, counts array<int>, keys array<long>, sketch binary"


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, seed: int) -> DataFrame:
    """Size, class (hash of the set), block keys and parity bits of every row.

    ``other`` is a second hash of the set. Keys and bits are given once per class and task.
    ``counts``: for each band its number, its dense and its non-empty blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(seed), set()
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("other", pa.int64()),
                            ("counts", pa.list_(pa.int32())), ("sketch", pa.binary())])
        rows, keys = Rows(schema), []

        def flush() -> pa.RecordBatch:
            out = rows.batch()
            columns = [*out.columns[:5], list_array(keys, pa.int64()), out.column(5)]
            keys.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*schema.names[:5], "keys", "sketch"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                tokens = shingle_set(text.encode().lower().split() if text else [], hashes, size)
                name = hashlib.blake2b(tokens.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
                low, high = np.frombuffer(name, np.int64).tolist()
                if not len(tokens) or low in seen:
                    rows.add(key, len(tokens), low, high, None, None)
                    keys.append(None)
                else:
                    seen.add(low)
                    counts, mine = [], []
                    for band in bands_of(len(tokens), percent):
                        found, kinds, full = block_keys(tokens, band, percent)
                        counts += [band, int((kinds == DENSE).sum()), full]
                        mine.append(signed(found))
                    rows.add(key, len(tokens), low, high, counts, parity_bits(tokens),
                             size=64 + 9 * sum(map(len, mine)))
                    keys.append(np.concatenate(mine))
                if rows.full():
                    yield flush()
        yield flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SIGNED)


def rare_keys(signed_docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(key, class) rows that can lead to a link: of each class the rarest keys, as many as needed.

    Keys that no other class has come first in the order and need not be shipped again, so a
    class that has enough of them is done.
    """
    all_keys = signed_docs.where("keys is not null").select(F.explode("keys").alias("key"), "class")
    met = stage(keys_met_again(all_keys, ["key"], ["class"], partitions_for(signed_docs)).distinct(), "keys")
    seen = met.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    rows = met.join(seen, "key").join(classes.select("class", "n", "counts"), "class").select(
        "key", "class", "held", F.col("key").bitwiseAND(F.lit(3)).alias("kind"),
        F.shiftright(F.col("key").bitwiseAND(F.lit(255)), 2).alias("band"),
        F.expr(f"n * {100 - percent} div {percent} + 1").alias("need"),
        "counts")
    rows = rows.withColumn("at", F.expr("if(counts[0] = band, 0, 3)"))
    rows = rows.select("key", "class", "held", "kind", "band", "need",
                       F.expr("counts[at + 1]").alias("dense"), F.expr("counts[at + 2]").alias("full"))
    by = Window.partitionBy("class", "band")
    rare = by.orderBy((F.col("kind") > DENSE), "held", "key")  # dense keys first
    mixed = by.orderBy((F.col("kind") == EMPTY), "held", "key")  # dense and single ones alike
    ranked = rows.select(
        "key", "class", "held", "kind", "need", "dense", "full",
        F.row_number().over(rare).alias("place"), F.row_number().over(mixed).alias("place_mixed"),
        F.sum((F.col("kind") == DENSE).cast("int")).over(by).alias("dense_met"),
        F.sum((F.col("kind") != EMPTY).cast("int")).over(by).alias("full_met"))
    # Keys of its own come first, so of the shared ones a class needs only what is left.
    kept = ranked.where(
        ((F.col("kind") == DENSE) & (F.col("place") <= F.col("need") - (F.col("dense") - F.col("dense_met"))))
        | ((F.col("dense") < F.col("need")) & (F.col("kind") != EMPTY)
           & (F.col("place_mixed") <= F.col("need") - (F.col("full") - F.col("full_met"))))
        | ((F.col("full") < F.col("need"))))
    return stage(kept.select("key", "class"), "rare")


def may_link(p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(p, q) >= percent * np.maximum(p, q)


def unlike_refused(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and parity bits leave a link possible."""
    info = classes.select("class", "n", "sketch")
    wide = (pairs.join(info.toDF("a", "na", "sa"), "a")
            .join(info.toDF("b", "nb", "sb"), "b")
            .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"))

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            apart = np.fromiter(map(bits_apart, f.sa, f.sb), np.int64, len(f))
            yield f.loc[apart * (100 + percent) <= (100 - percent) * (f.na + f.nb), ["a", "b"]]

    return wide.mapInPandas(test, "a long, b long")


def token_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, size: int,
               seed: int) -> DataFrame:
    """(class, tokens) of the wanted classes, from one text each."""
    chosen = classes.join(wanted, "class").select("class", "low_id")
    texts = docs.select(F.col(id_col).cast("long").alias("low_id"), F.col(text_col).alias("text"))
    rows = texts.join(chosen, "low_id").select("class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(seed)
        out = Rows(pa.schema([("class", pa.int64()), ("tokens", pa.binary())]))
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                tokens = shingle_set(text.encode().lower().split() if text else [], hashes, size)
                digest = hashlib.blake2b(tokens.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
                if np.frombuffer(digest, np.int64)[0] == name:  # an id may stand for several texts
                    out.add(name, tokens.tobytes(), size=8 * len(tokens))
                if out.full():
                    yield out.batch()
        yield out.batch()

    return stage(rows.mapInArrow(run, "class long, tokens binary").dropDuplicates(["class"]), "sets")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes whose sets are alike enough."""

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            good = np.zeros(len(f), bool)
            for i, (x, y) in enumerate(zip(f.ta, f.tb)):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield f.loc[good, ["a", "b"]]

    wide = pairs.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b")
    return wide.mapInPandas(test, "a long, b long")


class Met:
    """The pairs of classes that a task has compared, one byte each by pair of blocks: 1 for a pair, 2 for one that may link.

    Pairs share many keys, so each is compared once. No more than ``PAIRS`` pairs are listed at a time.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def flush(self) -> pa.RecordBatch:
        good = {code: np.packbits(cells == 2).tobytes() for code, cells in self.pairs.items() if (cells == 2).any()}
        self.pairs.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([bx for bx, _ in good], pa.int64()), pa.array([by for _, by in good], pa.int64()),
             pa.array(list(good.values()), pa.binary())], names=["bx", "by", "bits"])

    def compare(self, t: pa.RecordBatch) -> None:
        """The pairs of whole groups of rows (key, i, j, left, at, comp, n, sketch)."""
        percent = self.percent
        k, i, j, left, at, comp, n = (t.column(c).to_numpy(zero_copy_only=False) for c in range(7))
        new = np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(k)]
        lefts = np.add.reduceat(left.astype(np.int64), start)  # left rows come first in a group
        rights = np.repeat(end - start - lefts, lefts)
        begin = np.repeat(start + lefts, lefts)
        rows = np.flatnonzero(left)
        total = np.cumsum(rights)
        sketches = Sketches(t.column(7).to_pylist())
        # A place has up to 63 bits, so pairs are named by the numbers of places and blocks in this batch.
        places, place = np.unique(at, return_inverse=True)
        names, block = np.unique(at >> 8, return_inverse=True)
        for lo in range(0, int(total[-1]) if len(total) else 0, PAIRS):
            pair = np.arange(lo, min(lo + PAIRS, int(total[-1])))
            of = np.searchsorted(total, pair, side="right")
            x, y = rows[of], begin[of] + pair - (total[of] - rights[of])
            fits = (comp[x] != comp[y]) & may_link(n[x], n[y], percent)
            x, y = x[fits], y[fits]
            swap = at[x] > at[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            _, once = np.unique(place[x] * len(places) + place[y], return_index=True)
            x, y = x[once], y[once]
            blocks = block[x] * len(names) + block[y]
            cell = ((at[x] & 255) << 8) | (at[y] & 255)
            order = np.argsort(blocks, kind="stable")
            ends = np.flatnonzero(np.diff(blocks[order], append=-1))
            first = 0
            for end in ends.tolist():
                mine = order[first:end + 1]
                first = end + 1
                code = int(names[block[x[mine[0]]]]), int(names[block[y[mine[0]]]])
                done = self.pairs.setdefault(code, np.zeros(1 << 16, np.uint8))
                mine = mine[done[cell[mine]] == 0]
                done[cell[mine]] = 1
                near = sketches.apart(x[mine], y[mine]) * (100 + percent) <= (100 - percent) * (n[x[mine]] + n[y[mine]])
                done[cell[mine[near]]] = 2


def across(rows: DataFrame, percent: int) -> DataFrame:
    """(bx, by, bits, at): pairs of classes that share a key but no component yet and may link.

    ``rows``: key, at, comp, n, sketch. ``at`` numbers the classes; 256 neighbours are a block, and a result row has one
    bit for each pair of classes of two blocks, and the classes that occur there: no row per pair leaves a task. In each key the
    component with most rows is the main one; only rows outside it meet the rows of the key, in portions of bounded
    size.
    """
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("m"))
    main = per.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("main"), F.sum("m").alias("all"),
                                  F.count("*").alias("comps")).where("comps > 1")
    held = rows.join(main, "key").select(
        "key", "at", "comp", "n", "sketch", (F.col("comp") != F.col("main.comp")).alias("outer"),
        F.expr(f"cast(ceil((all - main.m) / {PORTION}) as int)").alias("lefts"),
        F.expr(f"cast(ceil(all / {PORTION}) as int)").alias("rights"))
    deal = lambda n: F.pmod(F.xxhash64("at"), F.col(n))
    each = [F.col(c) for c in ("at", "comp", "n", "sketch")]
    left = held.where("outer").select("key", deal("lefts").alias("i"), F.expr("explode(sequence(0, rights - 1))").alias("j"),
                                      F.lit(True).alias("left"), *each)
    right = held.select("key", deal("rights").alias("j"), F.expr("explode(sequence(0, lefts - 1))").alias("i"),
                        F.lit(False).alias("left"), *each)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, held = Met(percent), None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            k, i, j = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            if not len(k):
                continue
            # The last group may go on in the next batch; a group has a few portions of rows at most.
            cut = int(np.argmax((k == k[-1]) & (i == i[-1]) & (j == j[-1])))
            held = batch.slice(cut)
            if cut:
                met.compare(batch.slice(0, cut))
            if len(met.pairs) > 1000:
                yield met.flush()
        if held is not None:
            met.compare(held)
        yield met.flush()

    both = left.unionByName(right).select("key", "i", "j", "left", "at", "comp", "n", "sketch")
    dealt = both.repartition(partitions_for(rows), "key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("left"))
    found = dealt.mapInArrow(meet, "bx long, by long, bits binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)))

    def either(f: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in f.bits], axis=0)
        cells = np.unpackbits(bits).reshape(256, 256)
        at = np.union1d(np.flatnonzero(cells.any(1)) + (f.bx.iloc[0] << 8), np.flatnonzero(cells.any(0)) + (f.by.iloc[0] << 8))
        return pd.DataFrame({"bx": f.bx[:1], "by": f.by[:1], "bits": [bits.tobytes()], "at": [at]})

    # What many tasks say of two blocks comes together in two steps, a few hundred rows each.
    kind = "bx long, by long, bits binary, at array<long>"
    some = found.groupBy("bx", "by", "part").applyInPandas(either, kind)
    return some.groupBy("bx", "by").applyInPandas(either, kind)


def linked_across(found: DataFrame, places: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the pairs of ``across``: of each class one to every other component it reaches in a pair of blocks.

    ``places``: at, class, comp. A task holds the sets of two blocks of classes.
    """
    tokens = found.select(F.col("bx").alias("x"), F.col("by").alias("y"), F.explode("at").alias("at"))
    tokens = tokens.join(places, "at").join(sets, "class").select("x", "y", "at", "class", "comp", "tokens")

    def test(_, pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros((256, 256), bool)
        for b in pairs.bits:
            bits |= np.unpackbits(np.frombuffer(b, np.uint8)).reshape(256, 256).astype(bool)
        bx, by = int(pairs.bx.iloc[0]), int(pairs.by.iloc[0])
        of = {int(a): (name, comp, np.frombuffer(t, U)) for a, name, comp, t in zip(rows["at"], rows["class"], rows.comp, rows.tokens)}
        out = []
        for one in np.flatnonzero(bits.any(1)).tolist():
            name, comp, x = of[(bx << 8) + one]
            reached = {comp}
            others = [of[(by << 8) + two] for two in np.flatnonzero(bits[one]).tolist()]
            sizes = np.array([len(o[2]) for o in others])
            every = np.concatenate([o[2] for o in others])
            at = np.minimum(np.searchsorted(x, every), len(x) - 1)
            both = np.add.reduceat((x[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
            for o in np.flatnonzero(100 * both >= percent * (len(x) + sizes - both)).tolist():
                if others[o][1] not in reached:
                    reached.add(others[o][1])
                    out.append((name, others[o][0]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return found.select("bx", "by", "bits").groupBy("bx", "by").cogroup(tokens.groupBy("x", "y")).applyInPandas(
        test, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                    percent: int = 80) -> DataFrame:
    """(id, n, component): size of each row's set and the smallest id reachable by links, one row per input row.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets of ``size``-word
    shingles, ASCII letters lower-cased. Copies of one set are one class from the first pass on.
    Null or empty texts have no shingle and link with nothing; rows with a null id get a null
    component and link nothing either. Rows that repeat an id stay rows; their links are the id's. An
    empty table gives an empty result; other columns are not read.

    Sets are named by 64 bits; should two different sets share a name, all names are drawn
    again under another seed.
    """
    seed = 0
    while True:
        signed_docs = stage(signatures(docs, id_col, text_col, size, percent, seed), "signed")
        named = signed_docs.where("n > 0 and id is not null")
        ids = named.groupBy("class").agg(
            F.min("id").alias("low_id"), F.first("n").alias("n"), F.min("other").alias("o1"), F.max("other").alias("o2"))
        sketches = (signed_docs.where("counts is not null").select("class", "counts", "sketch")
                    .dropDuplicates(["class"]))
        classes = stage(ids.join(sketches, "class"), "classes")
        if classes.where("o1 <> o2").isEmpty():
            break
        seed += 1
    kept = rare_keys(signed_docs, classes, percent)
    # First each key's classes against its smallest one ...
    first = kept.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("top")).where("a < top")
    roots = stage(kept.join(first.select("key", "a"), "key"), "roots")
    stars = roots.where("class <> a").select("a", F.col("class").alias("b")).distinct()
    tried = stage(unlike_refused(stars, classes, percent), "pairs")
    sets = token_sets(roots.select("class").distinct(), docs, classes, id_col, text_col, size, seed)
    links = stage(linked(tried, sets, percent), "linked")
    # ... then what that left in different components, classes with the same smallest ones side by side.
    comps = components(links).withColumnRenamed("node", "class")
    info = classes.select("class", "n").join(
        roots.groupBy("class").agg(F.min("a").alias("root")), "class").join(comps, "class", "left")
    placed = info.select("class", "n", "root", F.coalesce("component", "class").alias("comp"))
    placed = stage(placed.repartitionByRange("root", "n", "class").sortWithinPartitions("root", "n", "class").select(
        "class", "n", "comp", F.monotonically_increasing_id().alias("at")), "places")
    apart = roots.select("key", "class").join(placed, "class")
    open_keys = apart.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2")
    rows = apart.join(open_keys.select("key"), "key", "left_semi").join(classes.select("class", "sketch"), "class")
    more = stage(across(rows.select("key", "at", "comp", "n", "sketch"), percent), "pairs")
    links = links.union(linked_across(more, placed.select("at", "class", "comp"), sets, percent))
    # Links between classes become links between the ids that stand for them.
    low = classes.select("class", "low_id")
    edges = links.join(low.toDF("a", "x"), "a").join(low.toDF("b", "y"), "b").select(
        F.col("x").alias("a"), F.col("y").alias("b"))
    # An id on rows of several classes ties these classes together.
    tied = named.groupBy("id").agg(F.min("class").alias("c1"), F.max("class").alias("c2")).where("c1 < c2")
    ties = named.join(tied.select("id"), "id", "left_semi").join(low, "class").select(
        F.col("id").alias("a"), F.col("low_id").alias("b"))
    found = stage(components(edges.union(ties)), "components")
    lowest = low.join(found.withColumnRenamed("node", "low_id"), "low_id", "left").select(
        "class", F.coalesce("component", "low_id").alias("component"))
    return signed_docs.select("id", "n", "class").join(lowest, "class", "left").select(
        "id", "n", F.expr("if(n > 0 and id is not null, component, id)").alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that remain when one of each component of near duplicates stays: that of the smallest id.

    Of rows that repeat an id the first in the order of all columns stays. Rows without words or without an id stay as they are.
    """
    found = near_duplicates(docs, id_col, text_col, size, percent).where("n > 0 and id is not null")
    found = stage(found, "found")
    # An id has one component, and is its smallest or goes with all its rows.
    out, again = free_name(docs, "gone"), free_name(docs, "again")
    gone = found.where("id <> component").select(F.col("id").alias(out)).distinct()
    twice = found.groupBy("id").agg(F.count("*").alias("m")).where("m > 1").select(F.col("id").alias(again))
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & F.col(id_col).isNotNull()
    key = F.col(id_col).cast("long")
    left = docs.where(worded).join(gone, key == F.col(out), "left_anti")
    single = left.join(twice, key == F.col(again), "left_anti")
    several = left.join(twice, key == F.col(again), "left_semi").groupBy(key.alias(again)).agg(
        F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return docs.where(~worded).union(single).union(several)
