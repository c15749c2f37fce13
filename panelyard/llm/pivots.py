"""Near-duplicate vectors by a pivot-permutation index.

Reference vectors (pivots) are taken from the data; a vector is described by its closest pivots, ``NEAREST`` or as many more as
``nearest_for`` finds necessary: the more pivots there are, the fewer of them are close to both vectors of a pair. Inverted lists, one
for each pivot, bring vectors together that share a pivot; a pair is retrieved if it shares ``SHARED`` of them or more, and
verified by its cosine in double precision. Pivots grow with the square root of the number of vectors, and so do the lists.

Equal vectors are one class with a multiplicity from the start. Long lists meet block by block, by the numbers of the pivots and vectors
rounded to a byte a component; whole vectors are fetched for those that may be close enough. A task hands on sums and components, never its
pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from panelyard.llm.components import components
from panelyard.plans import attach, stage

NEAREST, SHARED, PIVOTS_PER_ROOT, LEAST_PIVOTS = 8, 3, 1.5, 32
#: Pairs at the threshold that are tried on the pivots, and the share of them that must be retrieved.
TRIED, RECALL = 1000, 0.97
#: Vectors of a block of a list, and pairs that are looked at at once.
BLOCK, AT_ONCE = 8192, 1 << 21


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, size, low, high, vec): the components as bytes of their own type, their number and their 128-bit hash.

    ``vec`` is null unless all components are finite and one is not zero.
    """
    of = vectors.schema[vector_col].dataType
    single = isinstance(of, ArrayType) and isinstance(of.elementType, FloatType)
    kind = np.float32 if single else np.float64
    values = F.col(vector_col).cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), values.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, size, names = [], [], []
            for v in batch.column(1):
                raw = None
                if v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy() + kind(0)  # one zero
                    if np.isfinite(x).all() and x.any():
                        raw = x.tobytes()
                vec.append(raw)
                size.append(raw and len(x))
                names.append(raw and np.frombuffer(hashlib.blake2b(raw, digest_size=16).digest(), np.int64).tolist())
            low, high = ([n and n[i] for n in names] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
                 pa.array(vec, pa.binary())], names=["id", "size", "low", "high", "vec"])

    return rows.mapInArrow(run, "id long, size int, low long, high long, vec binary")


def matrix(column, size: int) -> np.ndarray:
    """Vectors of ``size`` components each, in doubles."""
    raw = b"".join(column)
    kind = np.float32 if len(raw) == 4 * size * len(column) else np.float64
    return np.frombuffer(raw, kind).reshape(len(column), size).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest_for(pivots: np.ndarray, cosine: float, need: int) -> int:
    """How many closest pivots describe a vector, so that ``RECALL`` of the pairs with just this cosine share ``need`` of them.

    Tried on pairs of a pivot, itself left out of the count, and a vector beside it: in any direction, and towards another pivot,
    as vectors of few directions lie beside each other.
    """
    many = len(pivots)
    if many <= need:
        return many
    rng = np.random.default_rng(0)
    worst = min(NEAREST, many)
    x = pivots[:TRIED]
    for z in rng.normal(size=x.shape), pivots[rng.integers(0, many, len(x))]:
        z = z - (z * x).sum(axis=1, keepdims=True) * x
        z = z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-12)
        y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * z
        wanted = []
        for lo in range(0, len(x), 64):
            place = np.zeros((len(x[lo:lo + 64]), many), np.int64)
            for side in x, y:
                far = -(side[lo:lo + 64] @ pivots.T)
                far[np.arange(len(far)), np.arange(lo, lo + len(far))] = np.inf
                rank = np.empty_like(place)
                np.put_along_axis(rank, np.argsort(far, axis=1, kind="stable"), np.arange(many)[None, :], axis=1)
                place = np.maximum(place, rank)
            wanted.append(np.partition(place, need - 1, axis=1)[:, need - 1] + 1)
        wanted = np.sort(np.concatenate(wanted))
        worst = max(worst, int(wanted[int(np.ceil(RECALL * len(wanted))) - 1]))
    return worst


class Rounded:
    """Unit vectors with components of one byte, and how far each is from its vector: a quarter of their size in floats."""

    def __init__(self, x: np.ndarray, far: np.ndarray):
        self.x, self.far = x, far

    @staticmethod
    def of(x: np.ndarray) -> list[bytes]:
        step = (np.abs(x).max(axis=1, keepdims=True) / 127).astype(np.float32)
        small = np.rint(x / step).astype(np.int8)
        # Rounded up, so that no bound is too low.
        far = np.nextafter(np.sqrt(((x - small * step.astype(float)) ** 2).sum(axis=1)).astype(np.float32), np.float32(np.inf))
        return [s.tobytes() + f.tobytes() + v.tobytes() for s, f, v in zip(step[:, 0], far, small)]

    @classmethod
    def back(cls, column) -> Rounded:
        raw = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
        step, far = (np.ascontiguousarray(raw[:, i:i + 4]).view(np.float32)[:, 0] for i in (0, 4))
        return cls(raw[:, 8:].view(np.int8) * step[:, None], far.astype(float))

    def may_reach(self, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
        """Pairs whose cosine may be ``cosine`` or more, for all that the rounded vectors say."""
        near = np.einsum("ij,ij->i", self.x[a], self.x[b], dtype=np.float64)
        return near >= cosine - (self.far[a] + self.far[b] + self.far[a] * self.far[b]) - 1e-5


class Pivots:
    """The pivots of the vectors of one length: ``near`` closest ones describe a vector, ``need`` are to be shared."""

    def __init__(self, points: np.ndarray, first: int, cosine: float, shared: int):
        self.points, self.first = points, first
        self.need = min(shared, NEAREST, len(points))
        self.near = nearest_for(points, cosine, self.need)


def chosen_pivots(classes: DataFrame, cosine: float, shared: int) -> dict[int, Pivots]:
    """Pivots by length of vector: of each length 1.5 times the root of its vectors, the first ones by hash."""
    sizes = classes.groupBy("size").agg(F.count("*").alias("m"))
    wanted = F.least("m", F.greatest(F.lit(LEAST_PIVOTS), F.ceil(PIVOTS_PER_ROOT * F.sqrt("m"))))
    sizes = sizes.withColumn("wanted", wanted)
    # Hashes above a bound cannot be among the smallest ones: few rows are sorted, however many there are.
    share = (F.col("wanted") + 8 * F.sqrt("wanted") + 8) / F.col("m")
    order = Window.partitionBy("size").orderBy("low", "high")
    rows = attach(classes.select("size", "low", "high", "vec"), sizes, ["size"])
    rows = rows.where(F.col("low").cast("double") <= (share - 0.5) * 2.0**64).withColumn("place", F.row_number().over(order))
    out, first = {}, 0
    kept = sorted(rows.where("place <= wanted").select("size", "low", "high", "vec").collect())
    for size, group in groupby(kept, lambda r: r.size):
        out[size] = Pivots(unit(matrix([r.vec for r in group], size)), first, cosine, shared)
        first += len(out[size].points)
    return out


def in_lists(classes: DataFrame, pivots: Broadcast) -> DataFrame:
    """(pivot, need, class, n, near, code): each class in the lists in which it can meet a partner.

    ``near`` holds the numbers of its closest pivots in ascending order, ``code`` its rounded vector. Whoever shares ``need`` pivots shares one that both do not
    have among their last need - 1, so these lists are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for size in np.unique(sizes).tolist():
                mine, p = np.flatnonzero(sizes == size), pivots.value[size]
                step = max(1, AT_ONCE // len(p.points))
                for lo in range(0, len(mine), step):
                    part = batch.take(pa.array(mine[lo:lo + step]))
                    x = unit(matrix(part.column(3).to_pylist(), size))
                    near = np.argpartition(-(x @ p.points.T), p.near - 1, axis=1)[:, :p.near]
                    near = (np.sort(near, axis=1) + p.first).astype(np.int32)
                    lists = near[:, :max(1, p.near - p.need + 1)]
                    rows = np.repeat(np.arange(len(x)), lists.shape[1])
                    raw = [pa.array(x, pa.binary()) for x in ([r.tobytes() for r in near], Rounded.of(x))]
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lists.ravel()), pa.array(np.full(len(rows), p.need, np.int32)), part.column(0).take(take),
                         part.column(1).take(take), *[x.take(take) for x in raw]], names=["pivot", "need", "class", "n", "near", "code"])

    kind = "pivot int, need int, class long, n long, near binary, code binary"
    return classes.select("class", "n", "size", "vec").mapInArrow(run, kind)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of ``n`` nodes' components."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def retrieved(near: np.ndarray, pivot: int, need: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``near`` (one of ``left``, one of ``right``) with ``need`` shared pivots, ``pivot`` the first of them.

    Rows are brought together by the pivots that they share, so the work grows with what is shared and with the pairs
    of the block, not with the number of pivots.
    """
    many, wide = len(right), near.shape[1]
    order = np.argsort(near[right].ravel(), kind="stable")
    keys, owner = near[right].ravel()[order], order // wide
    lo, hi = (np.searchsorted(keys, near[left].ravel(), side) for side in ("left", "right"))
    meets = np.add.reduceat(hi - lo, np.arange(0, len(left) * wide, wide)) if len(left) else np.zeros(0, np.int64)
    start = 0
    while start < len(left):
        stop = start + max(1, min(int(np.searchsorted(np.cumsum(meets[start:]), AT_ONCE, "right")), AT_ONCE // max(1, many)))
        part = slice(start * wide, stop * wide)
        size = (hi - lo)[part]
        ends = np.cumsum(size)
        at = np.repeat(lo[part] - ends + size, size) + np.arange(ends[-1])
        pair = np.repeat(np.repeat(np.arange(stop - start), wide), size) * many + owner[at]
        count = np.bincount(pair, minlength=(stop - start) * many)
        earlier = np.bincount(pair[keys[at] < pivot], minlength=(stop - start) * many)
        found = np.flatnonzero((count >= need) & (earlier == 0))
        a, b = left[start + found // many], right[found % many]
        yield (a[a < b], b[a < b]) if left is right else (a, b)
        start = stop


def blocks_of(rows: pd.DataFrame, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    block = rows.block.to_numpy()
    left = np.flatnonzero(block == i)
    return left, left if i == j else np.flatnonzero(block == j)


def involved(cosine: float):
    """The members of one pair of blocks of a list whose vectors are fetched: those in a retrieved pair that may be close enough."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        pivot, i, j = key
        near = np.frombuffer(b"".join(rows.near), np.int32).reshape(len(rows), -1)
        rounded = Rounded.back(rows.code.tolist())
        left, right = blocks_of(rows, i, j)
        seen = np.zeros(len(rows), bool)
        for a, b in retrieved(near, int(pivot), int(rows.need.iloc[0]), left, right):
            for lo in range(0, len(a), AT_ONCE // 16):
                p, q = a[lo:lo + AT_ONCE // 16], b[lo:lo + AT_ONCE // 16]
                may = rounded.may_reach(p, q, cosine)
                seen[p[may]] = seen[q[may]] = True
        return rows.loc[seen, ["pivot", "i", "j", "need", "block", "class", "n", "near"]]

    return run


def verified(cosine: float):
    """The links of one pair of blocks, as sums and local components."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        pivot, i, j = key
        rows = rows.sort_values("class").reset_index(drop=True)
        near = np.frombuffer(b"".join(rows.near), np.int32).reshape(len(rows), -1)
        x, n = unit(matrix(rows.vec.tolist(), int(rows["size"].iloc[0]))), rows.n.to_numpy()
        left, right = blocks_of(rows, i, j)
        label, links = np.arange(len(rows)), np.zeros(len(rows))
        for a, b in retrieved(near, int(pivot), int(rows.need.iloc[0]), left, right):
            for lo in range(0, len(a), AT_ONCE // 16):
                p, q = a[lo:lo + AT_ONCE // 16], b[lo:lo + AT_ONCE // 16]
                close = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                p, q = p[close], q[close]
                links += np.bincount(p, n[q], len(rows)) + np.bincount(q, n[p], len(rows))
                if len(p):
                    label = local_components(len(rows), label[p], label[q])[label]
        names = rows["class"].to_numpy()
        some = np.flatnonzero(links)
        return pd.DataFrame({"class": names[some], "least": names[label[some]], "links": links[some].astype(np.int64)})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9,
                    shared: int = SHARED) -> DataFrame:
    """(id, n_links, component), one row per input row: rows linked directly and the smallest id reachable by links.

    Two rows link if they are retrieved and their cosine is ``cosine`` or more; equal vectors always do. Only vectors of one
    length are compared, each length with pivots of its own. Vectors that are null or empty, all zero or hold nulls, NaN or infinite
    values link with nothing. Rows with a null id have no link and a null component. Rows that repeat an id are counted one by
    one. An empty table gives an empty result; other columns are not read.

    The pivots of a length are as numerous as 1.5 times the root of its different vectors (32 at least, or all of them), so a broadcast of them stays
    small (a thousand million vectors: 47,000 pivots). Lists carry the numbers of the closest pivots and vectors rounded
    to a byte a component, which never refuse a pair that reaches ``cosine``; whole vectors are fetched for members of the others only.
    """
    rows = stage(prepared(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    usable = rows.where("vec is not null and id is not null")
    # An id may stand for several vectors: classes are named by a row, ids come back at the end.
    classes = stage(usable.groupBy("low", "high", "size").agg(
        F.first("vec").alias("vec"), F.min("row").alias("class"), F.min("id").alias("low_id"), F.count("*").alias("n")), "classes")
    pivots = classes.sparkSession.sparkContext.broadcast(chosen_pivots(classes, cosine, shared))
    listed = stage(in_lists(classes, pivots), "lists")
    blocks = listed.groupBy("pivot").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("blocks"))
    placed = attach(listed, blocks, ["pivot"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.expr("explode(sequence(0, blocks - 1))")).select(
        "pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "need", "block", "class", "n", "near", "code")
    some = stage(dealt.groupBy("pivot", "i", "j").applyInPandas(involved(cosine), dealt.drop("code").schema), "involved")
    fetched = some.join(classes.select("class", "size", "vec"), "class")
    found = stage(fetched.groupBy("pivot", "i", "j").applyInPandas(verified(cosine), "class long, least long, links long"), "links")
    ids = classes.select("class", "low_id")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    edges = found.join(ids, "class").join(ids.toDF("least", "least_id"), "least").select(
        F.col("low_id").alias("a"), F.col("least_id").alias("b"))
    # Rows that share an id tie the classes of their vectors together.
    twice = stage(usable.groupBy("id").agg(F.count("*").alias("m")).where("m > 1").select("id"), "twice")
    name = ["low", "high"]
    ties = usable.select("id", *name).join(twice, "id", "left_semi").join(classes.select(*name, "low_id"), name)
    comps = stage(components(edges.union(ties.select(F.col("id").alias("a"), F.col("low_id").alias("b")))), "components")
    known = classes.select(*name, "class", "low_id", "n").join(links, "class", "left").join(
        comps.withColumnRenamed("node", "low_id"), "low_id", "left").select(
        *name, F.expr("coalesce(links, 0) + n - 1").alias("n_links"), F.coalesce("component", "low_id").alias("component"))
    return rows.select("id", *name).join(known, name, "left").select(
        "id", F.expr("if(id is null, 0, coalesce(n_links, 0))").alias("n_links"),
        F.expr("if(id is null, null, coalesce(component, id))").alias("component"))
