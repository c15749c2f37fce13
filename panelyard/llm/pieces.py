"""Sampled segmentations of texts into the pieces of a SentencePiece model, and back.

Every way to write a text in pieces is a path through a lattice; a path's weight is the product of its pieces' weights.
Forward filtering sums the weights of all paths that reach a place; backward sampling then draws the last piece, the one
before it and so on, each by its share of that sum, which draws whole paths by their weight. The draws come from a
counter under the row's key, so a row's segmentation is the same in every run, task and batch.

A merge model has ranks and no probabilities. Its pieces weigh as by Zipf's law, 1 / (rank + 2.7), to the power
``theta`` (smaller: more varied). Characters without a piece are written as byte pieces. Nothing is normalised and one blank
is put in front, so decoding gives back every text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelyard.llm.common import Prefix, U, list_array, mix

#: No piece goes across these runs: a word with the blank before it, a line end, further blanks.
RUN = re.compile(r"\n| ?[^ \n]+| +(?= [^ \n])| +")
THETA = 0.5
#: Runs and characters that are sampled at once; places of lattices that are kept for later; bits of a look-up.
RUNS, CHARACTERS, PLACES, TABLE_BITS = 50_000, 1 << 18, 1 << 19, 20


class Pieces:
    """The pieces of a model: id and logarithm of the weight by text, ids of the byte pieces, bytes by id."""

    def __init__(self, model: bytes, theta: float = THETA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.of: dict[str, tuple[int, float]] = {}
        self.byte = [0] * 256
        self.bytes: list[bytes] = []
        ranked = sorted((i for i in range(sp.get_piece_size())
                         if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))),
                        key=lambda i: (-sp.get_score(i), i))
        rank = {i: r for r, i in enumerate(ranked)}
        for i in range(sp.get_piece_size()):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(text[3:5], 16)] = i
                self.bytes.append(bytes([int(text[3:5], 16)]))
            elif i in rank:
                raw = text.replace("▁", " ")
                self.bytes.append(raw.encode())
                if RUN.fullmatch(raw):  # a piece that went across runs would never fit
                    self.of[raw] = (i, -theta * math.log(rank[i] + 2.7))
            else:
                self.bytes.append(b"")
        self.longest = max(map(len, self.of), default=1)
        self.rare = -theta * math.log(len(ranked) + 2.7)  # of one byte

        # Pieces by hash, in tables of which each holds what the one before had no room for.
        texts = list(self.of)
        size = np.array(list(map(len, texts)), np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(U)
        self.hash = Prefix(codes).runs(np.cumsum(size) - size, size)
        self.number = np.array([self.of[t][0] for t in texts], np.int32)
        self.weight = np.array([self.of[t][1] for t in texts])
        self.tables, left = [], np.arange(len(texts))
        while len(left):
            shift = U(TABLE_BITS * len(self.tables) % 40)
            table = np.full(1 << TABLE_BITS, -1, np.int32)
            slots = ((self.hash[left] >> shift) & U((1 << TABLE_BITS) - 1)).astype(np.int64)
            table[slots] = left
            self.tables.append((shift, table))
            left = left[table[slots] != left]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of the piece with each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        for shift, table in self.tables:
            row = table[((h >> shift) & U((1 << TABLE_BITS) - 1)).astype(np.int64)]
            good = (row >= 0) & (self.hash[row] == h)
            out[good] = row[good]
        return out


def runs_of(text: str) -> Iterator[tuple[list[str], int]]:
    """(runs, characters) of the text with a blank in front, some of them at a time; a long text is parted where a run ends."""
    lo, text = 0, " " + text if text else ""
    while lo < len(text):
        hi = lo + CHARACTERS
        # A blank between two words starts a run.
        while 0 <= (hi := text.find(" ", hi)) and (text[hi - 1] in " \n" or text[hi + 1:hi + 2] in ("", " ", "\n")):
            hi += 1
        hi = len(text) if hi < 0 else hi
        yield RUN.findall(text, lo, hi), hi - lo
        lo = hi


class Lattices:
    """The filtered lattices of runs, all at once.

    A node is a place in a run that some piece ends at, numbered by offset and run. Its entries, from ``first`` on, are these
    pieces: ``upto`` is the sum of a node's shares up to an entry, ``before`` the node that the piece starts
    from (-1: the start of the run), ``ids`` the piece, or minus the code point of a character that has none.
    Sums of weights are kept as logarithms, so a run may be of any length.
    """

    def __init__(self, pieces: Pieces, runs: list[str]):
        size = np.fromiter(map(len, runs), np.int32, len(runs))
        codes = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(size)
        n = len(codes)
        offset = np.arange(n, dtype=np.int32) - np.repeat(ends - size, size).astype(np.int32)
        levels = np.bincount(offset)
        # Few runs are long: sort the offsets as small numbers where they are small.
        order = np.argsort(offset.astype(np.uint8 if len(levels) < 256 else np.int32), kind="stable")
        node = np.empty(n, np.int32)
        node[order] = np.arange(n, dtype=np.int32)
        prefix = Prefix(codes.astype(U))
        found = []
        here = np.arange(n)
        for length in range(1, min(pieces.longest, len(levels)) + 1):
            here = here[offset[here] >= length - 1]
            row = pieces.find(prefix.runs(here - length + 1, length))
            good = row >= 0
            found.append((here[good], length, pieces.number[row[good]], pieces.weight[row[good]]))
            if length == 1 and not good.all():
                at = here[~good]
                code = codes[at].astype(np.int64)
                size_ = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
                ids = np.where(code < 0x80, np.array(pieces.byte)[np.minimum(code, 0x7F)], -code)
                found.append((at, 1, ids.astype(np.int32), pieces.rare * size_))
        counts = np.zeros(n, np.int32)
        for at, *_ in found:
            counts[node[at]] += 1
        first = np.cumsum(counts, dtype=np.int32) - counts
        total = int(counts.sum())
        free = first.copy()
        self.before, self.ids, share = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
        for at, length, ids, weight in found:
            place = free[node[at]]
            free[node[at]] += 1
            self.ids[place], share[place] = ids, weight
            inner = offset[at] >= length
            self.before[place] = np.where(inner, node[at - length * inner], -1)
        reach = np.zeros(n + 1)  # logarithm of the summed weight of the paths to a node; the last one is the start
        lo = entry = 0
        for width in levels.tolist():
            mine = counts[lo:lo + width]
            part = slice(entry, entry + int(mine.sum()))
            starts = first[lo:lo + width] - entry
            logs = share[part] + reach[self.before[part]]
            most = np.maximum.reduceat(logs, starts)
            ways = np.exp(logs - np.repeat(most, mine))
            sums = np.add.reduceat(ways, starts)
            share[part] = ways / np.repeat(sums, mine)
            reach[lo:lo + width] = most + np.log(sums)
            lo, entry = lo + width, part.stop
        # Added up entry by entry, so that a sum does not depend on the runs beside it.
        self.upto, last = share, first + counts - 1
        open_, at = np.arange(n), first.copy()
        while len(open_ := open_[at[open_] < last[open_]]):
            at[open_] += 1
            self.upto[at[open_]] += self.upto[at[open_] - 1]
        self.upto[last] = 1.0
        self.first = first
        self.ends = node[ends - 1]


class Sampler:
    """Samples segmentations of texts, many runs at once. The lattices of recent runs are kept, in bounded number."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.utf8: dict[int, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        self.end: dict[str, int] = {}
        self.first, self.before, self.ids, self.upto = (np.zeros(0, t) for t in (np.int32, np.int32, np.int32, np.float64))

    def ends_of(self, runs: list[str]) -> np.ndarray:
        """The last node of each run."""
        if len(self.first) > PLACES:
            self.forget()
        new = [run for run in dict.fromkeys(runs) if run not in self.end]
        if new:
            made = Lattices(self.pieces, new)
            nodes, entries = len(self.first), len(self.ids)
            self.end.update(zip(new, (made.ends + nodes).tolist()))
            self.first = np.concatenate([self.first, made.first + np.int32(entries)])
            self.before = np.concatenate([self.before, np.where(made.before < 0, made.before, made.before + np.int32(nodes))])
            self.ids, self.upto = np.concatenate([self.ids, made.ids]), np.concatenate([self.upto, made.upto])
        return np.fromiter(map(self.end.__getitem__, runs), np.int32, len(runs))

    def sample(self, runs: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all runs, one after the other; number of ids of each run)."""
        state = self.ends_of(runs)
        open_ = np.arange(len(runs))
        count = np.zeros(len(runs), np.int64)
        steps = []
        while len(open_):
            draw = mix(seeds[open_] + (U(len(steps)) * np.ones(1, U)) * U(0xD1B54A32D192ED03)) >> U(11)
            u = draw.astype(np.float64) * 2.0**-53
            entry = self.first[state]
            late = np.flatnonzero(u >= self.upto[entry])
            while len(late):  # nodes have few entries
                entry[late] += 1
                late = late[u[late] >= self.upto[entry[late]]]
            steps.append((open_, self.ids[entry]))
            count[open_] += 1
            state = self.before[entry]
            more = state >= 0
            open_, state = open_[more], state[more]
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for back, (at, ids) in enumerate(steps):
            out[ends[at] - 1 - back] = ids
        if (out < 0).any():
            out, count = self.in_bytes(out, count)
        return out, count

    def in_bytes(self, out: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with characters without a piece as their bytes."""
        rare = np.flatnonzero(out < 0)
        code = -out[rare].astype(np.int64)
        size = np.ones(len(out), np.int64)
        size[rare] += (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        longer = np.repeat(out, size)
        first = np.cumsum(size) - size
        for at, c in zip(first[rare].tolist(), code.tolist()):
            ids = self.utf8.get(c)
            if ids is None:
                ids = self.utf8[c] = [self.pieces.byte[b] for b in chr(c).encode()]
            longer[at:at + len(ids)] = ids
        starts = np.cumsum(count) - count
        return longer, np.add.reduceat(size, starts) if len(starts) else count

    def encode(self, texts: list[str], keys: list) -> list[np.ndarray]:
        """Ids of each text under its key."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        runs, seeds, owners, held = [], [], [], 0

        def flush() -> None:
            nonlocal held
            held = 0
            if not runs:
                return
            ids, count = self.sample(runs, np.concatenate(seeds))
            ends = np.cumsum(count)
            at = 0
            for owner, n in owners:
                first = ends[at - 1] if at else 0
                out[owner].append(ids[first:ends[at + n - 1]])
                at += n
            runs.clear(), seeds.clear(), owners.clear()

        for owner, (text, key) in enumerate(zip(texts, keys)):
            seed = U(xxhash.xxh3_64_intdigest(b"" if key is None else str(key).encode(), seed=0 if key is None else 1))
            at = 0
            for part, size in runs_of(text):
                runs += part
                seeds.append(mix(seed + np.arange(at, at + len(part), dtype=U) * U(0x9E3779B97F4A7C15)))
                owners.append((owner, len(part)))
                at, held = at + len(part), held + size
                if len(runs) >= RUNS or held >= CHARACTERS:
                    flush()
        flush()
        return [np.concatenate(p) if p else np.zeros(0, np.int32) for p in out]


def _packed(batches: Iterator[pa.RecordBatch], sizes) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the sizes of one's rows add up to a bounded number (or it is a single row)."""
    for batch in batches:
        start, held = 0, 0
        for i, size in enumerate(pc.fill_null(sizes(batch), 0).to_pylist()):
            if held and held + size > CHARACTERS:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


@cache
def _loaded(model: bytes, theta: float) -> Pieces:
    """The pieces of a model, once in a worker."""
    return Pieces(model, theta)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Decoder:
    """Texts of many lists of ids at once."""

    def __init__(self, pieces: Pieces):
        raw = pieces.bytes
        self.size = np.array([len(b) for b in raw], np.int64)
        self.place, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(raw), np.uint8)

    def texts(self, flat: np.ndarray, count: np.ndarray) -> pa.Array:
        """One text for each ``count`` of the ids in ``flat``, without the blank in front."""
        size = self.size[flat]
        ends = np.cumsum(size)
        at = np.repeat(self.place[flat] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        to = np.r_[0, ends][np.r_[0, np.cumsum(count)]]  # where each text starts and ends
        text = np.delete(self.data[at], to[:-1][np.diff(to) > 0])
        to = to - np.r_[0, np.cumsum(np.diff(to) > 0)]
        return pa.Array.from_buffers(pa.large_string(), len(count),
                                     [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(text)]).cast(pa.string())


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", theta: float = THETA) -> DataFrame:
    """(id, ids, round_trip): the sampled pieces of every row, one row per input row.

    ``round_trip`` says that the ids, decoded again, give the row's text. A null text has null ids and a null flag, an empty one no
    id. Rows with equal keys and texts are cut alike; null keys share a seed of their own. Long texts are sampled whole, in bounded
    portions. An empty table gives an empty result; other columns are not read. ``model`` is the content of a model file, a
    fixed size that is sent to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(shared.value, theta)
        sampler, decoder = Sampler(pieces), Decoder(pieces)
        for batch in _packed(batches, lambda b: pc.binary_length(b.column(1))):
            texts = batch.column(1).to_pylist()
            ids = sampler.encode([t or "" for t in texts], batch.column(0).to_pylist())
            back = decoder.texts(np.concatenate(ids) if ids else np.zeros(0, np.int64), np.array([len(i) for i in ids], np.int64))
            ids = [None if t is None else i for t, i in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(ids, pa.int32()), pc.equal(back, batch.column(1))],
                                             names=["id", "ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, round_trip boolean")


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the text of their ids; null ids give a null text, no id the empty one."""
    if text_col in rows.columns:
        raise ValueError(f"rows have a column named {text_col}")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    place = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(_loaded(shared.value, THETA))
        for batch in _packed(batches, lambda b: pc.list_value_length(b.column(place))):
            ids = batch.column(place)
            texts = decoder.texts(ids.flatten().to_numpy(), pc.fill_null(pc.list_value_length(ids), 0).to_numpy())
            texts = pc.if_else(pc.is_valid(ids), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, text_col])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(text_col, StringType())]))
