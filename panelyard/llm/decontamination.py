"""Benchmark items in training texts, exact or edited.

Words are lower-cased runs of letters and digits (beyond ASCII, of anything but general punctuation). Smith-Waterman alignment of a
passage with the whole item decides: matches count 2, substitutions and gaps -1, and a score of half the best possible one is
contamination.

Seeds are ordered pairs of words, one or two places apart in the item and in the text. Two matches that follow each other in an
alignment with at most one error between them are such a seed, at its own position of the item; without an error it weighs 2, with one
1. A score is twice the matches less the errors, so the seeds of an alignment weigh its score less 2 or more: a passage whose seeds
weigh less holds no contamination. Each position left out takes 2 at most from that, so the commonest positions
of an item are not looked up, as many as leave a weight to ask for. Which these are (by counts over all items of the block) decides
the work and never the result: every alignment that counts lies in a passage, and of equal ones the one that ends first is given.

Items are joined block by block: a block of bounded size goes to all tasks, every text meets every block. More items
mean more blocks, not larger ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import U, Rows, WordHashes, mix

LEAST_WORDS, GAPS = 3, (1, 2)
MATCH, MISS, GAP = 2, -1, -1
LEAST_SCORE = 0.5
#: Characters of items in a block, about.
BLOCK = 8 << 20
#: Bytes of ASCII that separate words; dashes, quotes and the like beyond it.
BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
MARKS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f\uff00-\uff0f]")


def words_of(text: str | None) -> list[bytes]:
    if not text:
        return []
    if not text.isascii():
        text = MARKS.sub(" ", text)
    return text.lower().encode().translate(BREAKS).split()


def pair_hashes(h: np.ndarray, gap: int) -> np.ndarray:
    """Hash of each word with the word ``gap`` places on; equal pairs have equal hashes at any gap."""
    return mix(h[:-gap] * U(0x9E3779B97F4A7C15) + h[gap:] * U(0xD6E8FEB86659FD93))


class Seeds:
    """Look-up of seed hashes: a table of bits first, then the sorted hashes."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        bits = max(16, int(4 * max(1, len(self.sorted))).bit_length())
        self.mask = U((1 << bits) - 1)
        self.bits = np.zeros(1 << bits, bool)
        self.bits[(self.sorted & self.mask).astype(np.int64)] = True

    def places(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``runs``, rows in ``sorted``) of the seeds among the runs."""
        at = np.flatnonzero(self.bits[(runs & self.mask).astype(np.int64)])
        row = np.searchsorted(self.sorted, runs[at])
        good = self.sorted[np.minimum(row, len(self.sorted) - 1)] == runs[at]
        return at[good], row[good]


def best_alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(score, end in the passage) of the best local alignment, of equal ones the one that ends first."""
    row = np.zeros(len(passage) + 1, np.int64)
    slope = np.arange(len(passage) + 1) * GAP
    best, end = 0, 0
    for word in item:
        reach = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISS), row[1:] + GAP)
        row = np.r_[0, np.maximum(reach, 0)]
        row = np.maximum.accumulate(row - slope) + slope  # gaps along the passage
        at = int(row.argmax())
        if row[at] > best or row[at] == best and at < end:
            best, end = int(row[at]), at
    return best, end


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """(score as a share of the best possible one, start, end) of the best local alignment."""
    score, end = best_alignment(item, passage)
    if not score:
        return 0.0, 0, 0
    # From its end backwards the same alignment is the best one that starts there.
    _, back = best_alignment(item[::-1], passage[:end][::-1])
    return score / (MATCH * len(item)), end - back, end


def _counts_of(hashes: np.ndarray, seeds: np.ndarray, n: np.ndarray) -> np.ndarray:
    if not len(seeds):
        return np.zeros(len(hashes), np.int64)
    row = np.minimum(np.searchsorted(seeds, hashes), len(seeds) - 1)
    return np.where(seeds[row] == hashes, n[row], 0)


class Items:
    """A block of items with their seeds, ready for look-up.

    ``counts``: sorted seeds and how often they occur; without them the seeds of the items are counted.
    """

    def __init__(self, ids: list[int], texts: list[str], counts: tuple[np.ndarray, np.ndarray] | None = None, least: float = LEAST_SCORE):
        hashes = WordHashes()
        self.ids, self.words, found, need, errors = [], [], [], [], []
        words = [hashes.of(words_of(text)) for text in texts]
        if counts is None:
            pairs = [pair_hashes(h, gap) for h in words for gap in GAPS]
            counts = np.unique(np.concatenate([np.zeros(0, U), *pairs]), return_counts=True)
        for key, h in zip(ids, words):
            if len(h) < LEAST_WORDS:
                continue
            score = int(np.ceil(MATCH * least * len(h) - 1e-9))
            weight, places = max(1, score - 2), len(h) - 1
            some = min(places, places - (weight - 1) // 2 + 1 + places // 8)
            held = sum(np.r_[_counts_of(pair_hashes(h, g), *counts), np.zeros(g - 1, np.int64)] for g in GAPS)
            kept = np.sort(np.argsort(held, kind="stable")[:some])
            for gap in GAPS:
                at = kept[kept < len(h) - gap]
                found.append((pair_hashes(h, gap)[at], np.full(len(at), len(self.ids)), at, np.full(len(at), gap == 1)))
            need.append(weight - 2 * (places - len(kept)))
            errors.append(max(0, MATCH * len(h) - score))
            self.ids.append(key)
            self.words.append(h)
        none = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        runs, self.item, self.offset, self.next = (np.concatenate(x) for x in zip(none, *found))
        order = np.argsort(runs, kind="stable")
        runs, self.item, self.offset, self.next = runs[order], self.item[order], self.offset[order], self.next[order]
        self.need, self.errors = np.array(need, np.int64), np.array(errors, np.int64)
        self.seeds = Seeds(runs)
        self.first = np.searchsorted(runs, self.seeds.sorted)
        self.held = np.diff(np.r_[self.first, len(runs)])

    def passages(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of the stretches of a text whose seeds weigh enough for an item."""
        found = []
        for gap in GAPS:
            at, row = self.seeds.places(pair_hashes(h, gap))
            n = self.held[row]
            entry = np.repeat(self.first[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append((self.item[entry], np.repeat(at, n) - self.offset[entry], 1 + (self.next[entry] & (gap == 1))))
        item, diagonal, weight = (np.concatenate(x) for x in zip(*found))
        if not len(item):
            return
        enough = (np.bincount(item, weight, len(self.need)) >= self.need)[item]
        item, diagonal, weight = item[enough], diagonal[enough], weight[enough]
        # No more errors than an alignment may have lie between the diagonals of its matches.
        key = (item << 40) + diagonal
        order = np.argsort(key)
        key, item, diagonal = key[order], item[order], diagonal[order]
        total = np.r_[0, np.cumsum(weight[order])]
        reach = np.searchsorted(key, key + self.errors[item], side="right")
        good = total[reach] - total[:-1] >= self.need[item]
        item, diagonal = item[good], diagonal[good]
        for i in np.unique(item).tolist():
            size, slack = len(self.words[i]), int(self.errors[i])
            begin = np.unique(diagonal[item == i]) - slack
            # Stretches that overlap are one.
            new = np.flatnonzero(np.r_[True, np.diff(begin) > size + 2 * slack])
            for lo, hi in zip(new, np.r_[new[1:], len(begin)] - 1):
                yield i, max(0, int(begin[lo])), min(len(h), int(begin[hi]) + size + 2 * slack)

    def hits(self, text: str, hashes: WordHashes, least: float) -> dict[int, tuple[float, int, int]]:
        """Best alignment (score, start, end) of a text with each item that scores ``least`` or more."""
        h = hashes.of(words_of(text))
        best: dict[int, tuple[float, int, int]] = {}
        for i, lo, hi in self.passages(h):
            score, start, end = align(self.words[i], h[lo:hi])
            if score >= least and score > best.get(i, (0.0,))[0]:
                best[i] = score, lo + start, lo + end
        return best


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[list]:
    """Items in blocks of bounded size; equal items with one id once, null ids and texts left out."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = items.where("id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK)
    for b in range(blocks):
        yield items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()


def _item_blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator:
    """Ids and texts of each block, broadcast."""
    for rows in _blocks(benchmark, item_col, item_text_col):
        yield docs.sparkSession.sparkContext.broadcast(([r.id for r in rows], [r.text for r in rows]))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """(id, item, score, start, end): each text's best alignment with each item that scores ``least`` or more.

    Score is the share of the best possible score, start and end count words of the text. Null and empty texts and
    items, and items of fewer than three words, match nothing; where ``least`` asks for one matching word only, two words near each other are asked for. Rows that repeat an id each give their rows, null ids too. An empty table
    on either side gives an empty result; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    schema = "id long, item long, score double, start long, end long"
    out = docs.sparkSession.sql("SELECT 0L AS id, 0L AS item, 0D AS score, 0L AS start, 0L AS end").where("false")
    for block in _item_blocks(docs, benchmark, item_col, item_text_col):

        def match(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items, hashes = Items(*block.value, least=least), WordHashes()
            found = Rows(pa.schema([("id", pa.int64()), ("item", pa.int64()), ("score", pa.float64()),
                                    ("start", pa.int64()), ("end", pa.int64())]))
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for i, hit in items.hits(text.as_py(), hashes, least).items():
                        found.add(key, items.ids[i], *hit)
                yield found.batch()

        out = out.union(texts.mapInArrow(match, schema))
    return out


def clean_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                item_text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, as they are, that align with no item; null and empty texts are clean. Else as ``contaminated``."""
    place = docs.columns.index(text_col)
    out = docs
    for block in _item_blocks(docs, benchmark, item_col, item_text_col):

        def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items, hashes = Items(*block.value, least=least), WordHashes()
            for batch in batches:
                yield batch.filter(pa.array([not (t.is_valid and items.hits(t.as_py(), hashes, least))
                                             for t in batch.column(place)], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
