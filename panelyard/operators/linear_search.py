"""Draws and folds of linear models, solved and scored from moments that one scan of the rows gives."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINEAR, SCALERS = ("linear_regression", "ridge", "scaled_linear"), ("standard_scaler", "min_max_scaler")


class Moments:
    """Count, means, sums of products about the means, least and largest values of the features and the label (the last one)."""

    def __init__(self, n: int, mean: np.ndarray, product: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.n, self.mean, self.product, self.low, self.high = n, mean, product, low, high

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        return cls(len(x), mean, (x - mean).T @ (x - mean), x.min(axis=0), x.max(axis=0))

    def __add__(self, other: Moments) -> Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n),
                       self.product + other.product + np.outer(apart, apart) * (self.n * other.n / n),
                       np.minimum(self.low, other.low), np.maximum(self.high, other.high))

    def row(self) -> bytes:
        return np.concatenate([self.mean, self.low, self.high, self.product.ravel()]).tobytes()

    @classmethod
    def back(cls, n: int, raw: bytes, width: int) -> Moments:
        mean, low, high, *product = np.frombuffer(raw).reshape(-1, width)
        return cls(int(n), mean, np.array(product), low, high)


def serves(model: str, transformers: Sequence[str]) -> bool:
    return model in LINEAR and set(transformers) <= set(SCALERS)


def fold_moments(rows: DataFrame, features: Sequence[str], label: str, fold_col: str) -> dict[int, Moments]:
    """Moments by fold. A task hands on one row per fold; rows are added up in two steps, and the driver reads one per fold."""
    columns, width = [*features, label], len(features) + 1

    def added(parts) -> Moments:
        total = None
        for part in parts:
            total = part if total is None else total + part
        return total

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, Moments] = {}
        for frame in frames:
            for fold, part in frame.groupby("fold"):
                x = part[columns].to_numpy(dtype=float)
                if np.isnan(x).any():
                    raise ValueError("a search over linear models needs rows without nulls")
                mine = Moments.of(x)
                found[fold] = found[fold] + mine if fold in found else mine
        if found:
            yield pd.DataFrame({"fold": list(found), "n": [m.n for m in found.values()], "m": [m.row() for m in found.values()]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "m"])
        total = added(Moments.back(n, m, width) for n, m in zip(frame.n, frame.m))
        return pd.DataFrame({"fold": frame.fold[:1], "n": [total.n], "m": [total.row()]})

    kind = "fold int, n long, m binary"
    parts = rows.select(F.col(fold_col).cast("int").alias("fold"), *[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(scan, kind)
    halves = parts.withColumn("deal", F.pmod(F.xxhash64("m"), F.lit(64))).groupBy("fold", "deal").applyInPandas(
        lambda frame: merge(frame.drop(columns="deal")), kind)
    found = halves.groupBy("fold").applyInPandas(merge, kind).collect()
    return {r.fold: Moments.back(r.n, r.m, width) for r in sorted(found, key=lambda r: r.fold)}


def _scaled(spec, train: Moments) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): the features that the model sees are a x + b."""
    k = len(train.mean) - 1
    a, b = np.ones(k), np.zeros(k)
    std = np.sqrt(np.diag(train.product)[:k] / max(1, train.n - 1))
    for name in spec.transformers:
        p = spec.params_of(name)
        if name == "standard_scaler":
            mean, spread = a * train.mean[:k] + b, np.abs(a) * std
            to = np.divide(1.0, spread, out=np.zeros(k), where=spread > 0) if p.take("with_std", True, bool) else np.ones(k)
            shift = -mean * to if p.take("with_mean", True, bool) else np.zeros(k)
        else:
            ends = a * train.low[:k] + b, a * train.high[:k] + b
            low, high = np.minimum(*ends), np.maximum(*ends)
            to = np.divide(1.0, high - low, out=np.zeros(k), where=high > low)
            shift = np.where(high > low, -low * to, 0.5)
        p.done([])
        a, b = a * to, b * to + shift
    return a, b


def scores(folds: dict[int, Moments], spec, held: int) -> tuple[float, float]:
    """R2 on the other folds, which are fitted, and on the fold that is held out."""
    train = None
    for fold, part in folds.items():
        if fold != held:
            train = part if train is None else train + part
    k = len(train.mean) - 1
    a, b = _scaled(spec, train)
    p = spec.params_of(spec.model)
    alpha = p.take("alpha", 1.0) if spec.model == "ridge" else 0.0
    if spec.model == "scaled_linear":
        factor = p.take("custom_parameter", 1.0)
        a, b = a * factor, b * factor
    with_intercept = p.take("fit_intercept", True, bool) if spec.model != "scaled_linear" else True
    p.done([])
    zz, zy = train.product[:k, :k] * np.outer(a, a), train.product[:k, k] * a
    z, y = a * train.mean[:k] + b, train.mean[k]
    if not with_intercept:
        zz, zy = zz + train.n * np.outer(z, z), zy + train.n * z * y
    unit = np.sqrt(np.diag(zz) + alpha)
    unit[unit == 0] = 1.0
    w = np.linalg.lstsq((zz + alpha * np.eye(k)) / np.outer(unit, unit), zy / unit, rcond=1e-13)[0] / unit
    intercept = y - w @ z if with_intercept else 0.0

    def r2(part: Moments) -> float:
        left = part.product[k, k] - 2 * (w * a) @ part.product[:k, k] + (w * a) @ part.product[:k, :k] @ (w * a)
        off = part.mean[k] - w @ (a * part.mean[:k] + b) - intercept
        return 1.0 - (left / part.n + off * off) / (part.product[k, k] / part.n) if part.product[k, k] else 0.0

    return r2(train), r2(folds[held])
