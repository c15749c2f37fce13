"""Words, hashes and streamed passes shared by the corpus operators.

Words are runs of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``). All hashes are
seeded by constants, so every task, retry and run gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

U = np.uint64
#: Bytes of text or of results that one Arrow batch may hold on the way out of a task.
BATCH_BYTES = 8 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64: a bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    """64-bit hash of a word, remembered; forgets all words when it holds ``limit`` of them."""

    def __init__(self, seed: int = 0, limit: int = 150_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def run_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (empty if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    factors = mix(np.arange(1 + seed, k + 1 + seed, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    total = h[:n] * factors[0]
    for i in range(1, k):
        total += h[i:n + i] * factors[i]
    return mix(total)


class Prefix:
    """Hashes of runs of any length from one pass over the parts: a polynomial modulo 2**64."""

    FACTOR = U(0x9E3779B97F4A7C15)
    INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self, h: np.ndarray):
        n = len(h)
        self.down = np.cumprod(np.r_[U(1), np.full(n, self.INVERSE)], dtype=U)
        up = np.cumprod(np.r_[U(1), np.full(max(0, n - 1), self.FACTOR)], dtype=U)[:n]
        self.sums = np.r_[U(0), np.cumsum(mix(h + U(1)) * up, dtype=U)]

    def runs(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of the ``length`` parts from each ``start`` on."""
        total = (self.sums[start + length] - self.sums[start]) * self.down[start]
        return mix(total + np.asarray(length).astype(U))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


class Rows:
    """Collects result rows and hands them out as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = BATCH_BYTES):
        self.schema, self.limit = schema, limit
        self.columns: list[list] = [[] for _ in schema]
        self.bytes = 0

    def add(self, *values, size: int = 64) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)
        self.bytes += size

    def full(self) -> bool:
        return self.bytes >= self.limit

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, t.type) for c, t in zip(self.columns, self.schema)], schema=self.schema)
        self.columns, self.bytes = [[] for _ in self.schema], 0
        return out


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One list per part, without a Python object per value; an absent part is a null list."""
    ends = np.cumsum([0 if p is None else len(p) for p in parts])
    mask = pa.array([p is None for p in parts], pa.bool_())
    values = np.concatenate([p for p in parts if p is not None] or [np.zeros(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32), pa.int32()), pa.array(values, kind), mask=mask)


def keys_met_again(rows: DataFrame, keys: list[str], rest: list[str], partitions: int) -> DataFrame:
    """The rows (at least) whose ``keys`` (BIGINT, not null) occur in more than one row.

    One range exchange on all columns, so equal keys are split over tasks when they are many.
    A sorted stream then keeps a row if a neighbour has its keys. The first and the last keys
    of a task may go on in another task and are kept too, so a few rows with keys of their
    own remain: count again on the (much smaller) result where that matters.
    """
    columns = [*keys, *rest]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sure, in_first = None, True, True  # the last row so far; whether it is kept anyway
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            n = batch.num_rows
            if not n:
                continue
            same = np.ones(n - 1, bool)
            for k in range(len(keys)):
                v = batch.column(k).to_numpy(zero_copy_only=False)
                same &= v[1:] == v[:-1]
            keep = np.r_[sure, same] | np.r_[same, False]
            if in_first:
                in_first = bool(same.all())
                keep[: n if in_first else int(np.argmin(same)) + 1] = True
            yield batch.slice(0, n - 1).filter(pa.array(keep[:-1]))
            held, sure = batch.slice(n - 1), bool(keep[-1])
        if held is not None:
            yield held

    spread = rows.select(*columns).repartitionByRange(partitions, *columns).sortWithinPartitions(*columns)
    return spread.mapInArrow(stream, spread.schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions_for(df: DataFrame, share: float = 1.0) -> int:
    """As many partitions as the session shuffles into, and at least as many as cores."""
    spark = df.sparkSession
    set_to = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, set_to, int(spark.sparkContext.defaultParallelism * share))

