"""Bootstrap samples of a table by cells of equal values."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.plans import stage

#: Numbers that a task adds up before it hands them on, and rows that it hands on, sorts by cell and draws at a time.
HELD, HANDED, SORTED, AT_ONCE = 1 << 23, 1 << 17, 1 << 16, 1 << 11


class Poisson:
    """Poisson numbers by inversion: 16 random bits decide nearly all of them, those on an edge of two numbers take more bits."""

    def __init__(self, rate: float, seed: Sequence[int]):
        self.edges = np.cumsum([math.exp(-rate) * rate ** k / math.factorial(k) for k in range(40)])
        steps = np.arange(65537) / 65536
        low, high = np.searchsorted(self.edges, steps[:-1], side="right"), np.searchsorted(self.edges, steps[1:], side="left")
        self.table = np.where(low == high, low, 255).astype(np.uint8)
        self.rng = np.random.Generator(np.random.SFC64(seed))

    def draw(self, *shape: int) -> np.ndarray:
        bits = self.rng.integers(0, 65536, shape, dtype=np.uint16)
        out = self.table[bits]
        open_ = np.nonzero(out == 255)
        out[open_] = np.searchsorted(self.edges, (bits[open_] + self.rng.random(len(open_[0]))) / 65536, side="right")
        return out


class Sums:
    """For every cell and sample: how often rows of the cell were drawn, and the sum of their labels."""

    def __init__(self, width: int, samples: int):
        self.width, self.samples = width, samples
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.times, self.labels = np.zeros((2, 0, self.samples))

    @property
    def full(self) -> bool:
        return 2 * self.samples * len(self.slots) > HELD

    def add(self, x: np.ndarray, y: np.ndarray, source: Poisson) -> None:
        x = np.ascontiguousarray(x) + 0.0  # one zero
        x[np.isnan(x)] = np.nan  # and one missing value
        keys = x.view(f"V{x.itemsize * self.width}").ravel().tolist()
        cells = np.array([self.slots.setdefault(key, len(self.slots)) for key in keys], dtype=np.int64)
        if (more := len(self.slots) - len(self.times)) > 0:
            self.times, self.labels = (np.concatenate([old, np.zeros((more, self.samples))]) for old in (self.times, self.labels))
        order = np.argsort(cells, kind="stable")
        cells, y = cells[order], y[order]
        for at in range(0, len(y), AT_ONCE):
            here = cells[at:at + AT_ONCE]
            first = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            drawn = source.draw(len(here), self.samples).astype(float)
            self.times[here[first]] += np.add.reduceat(drawn, first, axis=0)
            drawn *= y[at:at + AT_ONCE, None]
            self.labels[here[first]] += np.add.reduceat(drawn, first, axis=0)

    def frames(self, columns: Sequence[str]) -> Iterator[pd.DataFrame]:
        """One row per cell and sample with a draw. Values that no model takes show in every sample, drawn or not: a missing or
        infinite label leaves NaN in the sums of its cell."""
        x = np.frombuffer(b"".join(self.slots), dtype=float).reshape(-1, self.width)
        step = max(1, HANDED // self.samples)
        for at in range(0, len(x), step):
            here, times, labels = x[at:at + step], self.times[at:at + step], self.labels[at:at + step]
            cell, sample = np.nonzero((times > 0) | np.isnan(labels) | ~np.isfinite(here).all(axis=1)[:, None])
            yield pd.DataFrame(dict(zip(columns, [sample, *here[cell].T, times[cell, sample], labels[cell, sample]])))


def bootstrap_cells(df: DataFrame, features: Sequence[str], label: str, times: str, samples: int, rate: float, seed: int,
                    sample: str = "__sample") -> DataFrame:
    """Bootstrap samples, one row for each and every cell of rows with equal features: their mean label and their number (``times``).

    Every row is drawn a Poisson number of times (mean ``rate``) for every sample, independent of all other rows and samples; the rows are
    read once and only sums leave a task. A task holds ``HELD`` sums, so the cells should be few. Features are doubles in the result.
    Missing features are equal; a missing label makes the mean label of its cell null. The table is staged by ``sample``.
    """
    columns = [sample, *features, times, label]
    width = len(features)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, sums = Poisson(rate, [seed % (1 << 63), TaskContext.get().partitionId()]), Sums(width, samples)
        waiting, rows = [], 0

        def take() -> None:
            values = np.concatenate(waiting)
            sums.add(values[:, :width], values[:, width], source)

        for frame in frames:
            waiting.append(frame.to_numpy(dtype=float))
            rows += len(frame)
            if rows >= SORTED:
                take()
                waiting, rows = [], 0
                if sums.full:
                    yield from sums.frames(columns)
                    sums.clear()
        if rows:
            take()
        if sums.slots:
            yield from sums.frames(columns)

    kinds = ["int", *["double"] * (width + 2)]
    parts = df.select(*[F.col(c).cast("double").alias(c) for c in [*features, label]]).mapInPandas(
        run, ", ".join(f"`{c}` {kind}" for c, kind in zip(columns, kinds)))
    known = F.count(label) == F.count("*")  # NaN in a pandas frame comes back as null
    cells = parts.repartition(F.col(sample)).groupBy(sample, *features).agg(
        F.sum(times).alias(times), F.when(known, F.sum(label)).alias("__total"))
    return stage(cells.select(sample, *features, times, F.try_divide("__total", times).alias(label)), "bootstrap", sample)
