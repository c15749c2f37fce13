"""Documents drawn towards a target distribution, by importance weights over hashed word runs.

A text's features are its runs of words, hashed to buckets. A bucket's gain is the logarithm of its share in the target
over its share in the documents; a text's weight is the sum of its features' gains, looked up in one array. Gumbel
noise seeded by the document's id turns the highest scores into a draw without replacement by weight.

The scores are ranked by a distributed LSD radix sort: the composite key (score, id) is taken digit by digit from its low end,
and each pass is a stable counting sort. Rows stand in tiles; a pass counts its digit in every tile, adds the counts up in the order
(digit, tile) and so knows each row's place. After the last pass the place is the rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.common import Rows, partitions_for
from panelyard.plans import stage

BUCKETS, RUN, SEED = 10_000, 1, 2024
#: Shortest text that may be drawn, in words; share of these that is drawn, in hundredths.
LEAST_WORDS, PERCENT = 20, 10
#: Bits of a digit; rows of a tile at most.
DIGIT, TILE = 11, 1 << 18
#: Bytes of a text whose words are held at once.
PORTION = 1 << 20
#: Byte -> itself, small letters for capital ones, a blank for what no word holds.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
                   for b in range(256))


class Buckets(dict):
    """Bucket of a feature, remembered; forgets all when it holds ``limit`` of them."""

    def __init__(self, buckets: int, limit: int = 300_000):
        super().__init__()
        self.buckets, self.limit = buckets, limit

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found

    def of(self, text: str, run: int) -> Iterator[tuple[int, np.ndarray]]:
        """(words, buckets of the features that end there) of the text, portion by portion."""
        raw = text.encode().translate(WORD_BYTES)
        lo, before = 0, []
        while lo < len(raw):
            hi = raw.find(b" ", lo + PORTION)
            hi = len(raw) if hi < 0 else hi
            new = raw[lo:hi].split()
            words = before + new
            features = list(new)
            for k in range(2, run + 1):
                first = max(0, len(before) - k + 1)
                features += [b" ".join(words[i:i + k]) for i in range(first, len(words) - k + 1)]
            yield len(new), np.fromiter(map(self.__getitem__, features), np.int64, len(features))
            before = words[max(0, len(words) - run + 1):]
            lo = hi


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, run: int) -> DataFrame:
    """(bucket, n) of the features of all texts, added up in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, found = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, part in table.of(text.as_py() or "", run):
                    found += np.bincount(part, minlength=buckets)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, doc_text: str, target_text: str, buckets: int, run: int) -> np.ndarray:
    """The gain of every bucket, in thousandths; as many numbers as buckets, whatever the tables hold."""
    count = lambda df, text, name: stage(bucket_counts(df, text, buckets, run), "buckets").withColumnRenamed("n", name)
    s, t = count(docs, doc_text, "s"), count(target, target_text, "t")
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left")
    every = every.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    total = lambda df, c: F.lit(float(df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] + buckets))
    ratio = (F.col("t") + 1) * total(s, "s") / ((F.col("s") + 1) * total(t, "t"))
    rows = every.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain")).collect()
    gains = np.zeros(buckets, np.int64)
    gains[[r.bucket for r in rows]] = [r.gain for r in rows]
    return gains


def weighted(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, run: int) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, gain = Buckets(len(shared.value)), shared.value
        rows = Rows(pa.schema([(c, pa.int64()) for c in ("id", "n_words", "n_features", "weight")]))
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                n_words = n = weight = 0
                for words, part in table.of(text.as_py() or "", run):
                    n_words, n, weight = n_words + words, n + len(part), weight + int(gain[part].sum())
                rows.add(key.as_py(), n_words, n, weight)
                if rows.full():
                    yield rows.batch()
        yield rows.batch()

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(score, "id long, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """Noise of a key, in thousandths: 32 bits of its hash through the inverse of the Gumbel distribution."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def _ordered_bits(key: Column, descending: bool) -> Column:
    """A BIGINT whose unsigned order is the order of ``key``."""
    bits = key.bitwiseXOR(F.lit(-(1 << 63)))
    return F.bitwise_not(bits) if descending else bits


def radix_ranks(rows: DataFrame, keys: list[tuple[Column, bool]], name: str = "rank", digit: int = DIGIT,
                tile_rows: int = TILE) -> DataFrame:
    """``rows`` with their place, from 1 on, in the order of ``keys``: (BIGINT without nulls, descending?), the first decides.

    LSD radix sort by digits of ``digit`` bits; digits in which all rows agree are skipped. Equal keys stay in the
    order that the rows were read in. No task holds more than a tile or one partition of the input.
    """
    names = [f"__key{i}" for i in range(len(keys))]
    slots = rows.select("*", *[_ordered_bits(key, down).alias(c) for c, (key, down) in zip(names, keys)])
    number = F.monotonically_increasing_id()
    slots = stage(slots.select("*", F.shiftright(number, 33).alias("__tile"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")),
                  "slots")
    bits = slots.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}{c}") for c in names for f in (F.bit_or, F.bit_and)]).first()
    tile_rows = max(1, min(tile_rows, -(-bits.n // partitions_for(rows))))

    digits = []  # (column, lowest bit), the least significant first
    for c in reversed(names):
        differ = 0 if not bits.n else (bits[f"bit_or{c}"] ^ bits[f"bit_and{c}"]) & ((1 << 64) - 1)
        while differ:
            low = (differ & -differ).bit_length() - 1
            digits.append((c, low))
            differ &= ~(((1 << digit) - 1) << low)

    tiles = Window.partitionBy("__digit").orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__digit").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as a digit has values
    inside = Window.partitionBy("__tile", "__digit").orderBy("__at")
    zero = F.lit(0).cast("long")
    for c, low in digits or [(names[0], 64)]:
        value = F.shiftrightunsigned(c, low).bitwiseAND(F.lit((1 << digit) - 1)) if low < 64 else zero
        dealt = slots.withColumn("__digit", value)
        counted = stage(dealt.groupBy("__digit", "__tile").agg(F.count("*").alias("__n")), "digits")
        lower = stage(counted.groupBy("__digit").agg(F.sum("__n").alias("__n")).select(
            "__digit", F.coalesce(F.sum("__n").over(before), zero).alias("__lower")), "digits")
        first = counted.join(lower, "__digit").select(
            "__tile", "__digit", (F.col("__lower") + F.coalesce(F.sum("__n").over(tiles), zero)).alias("__first"))
        place = F.col("__first") + F.col("__rank") - 1
        placed = dealt.withColumn("__rank", F.row_number().over(inside)).join(stage(first, "digits"), ["__tile", "__digit"])
        slots = stage(placed.select(*rows.columns, *names, F.floor(place / tile_rows).alias("__tile"),
                                    F.pmod(place, F.lit(tile_rows)).alias("__at")), "slots")
    return slots.select(*rows.columns, (F.col("__tile") * tile_rows + F.col("__at") + 1).alias(name))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
              percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, run: int = RUN,
              seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``; rank is null for rows that are not drawn.

    Of the rows with at least ``least_words`` words, ``percent`` hundredths (rounded down) are drawn, the highest scores first, then the
    smaller ids, null ids last. Null and empty texts have no feature and the weight 0. Rows of one id share their noise; rows
    that are equal in score and id are ranked one after the other in either order. Very long texts are read whole, in
    portions. Empty documents give an empty result, an empty target counts nothing; other columns are not read.
    """
    gains = bucket_gains(docs, target, text_col, target_text, buckets, run)
    found = weighted(docs, gains, id_col, text_col, run)
    scored = stage(found.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    keys = [(F.col("score"), True), (F.col("id").isNull().cast("long"), False), (F.coalesce("id", F.lit(0)), False)]
    columns = ["id", "n_features", "weight", "score"]
    ranked = radix_ranks(able.select(*columns), keys)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.union(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long")))
