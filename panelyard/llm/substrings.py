"""Repeated passages by a compacted de Bruijn graph over words.

An edge is a run of ``k`` words (35); its nodes are the runs of k - 1 words at its ends. Edges that start more than once
anywhere are repeated, and the words they cover go.

The graph is never laid out edge by edge. Each edge has a minimizer, the least of the hashes of its shorter runs, and
consecutive edges with the same minimizer at the same place are one *link*: a chain of edges that no other path can
enter half way under that minimizer. Equal edges have equal minimizers, so:

* a link whose minimizer occurs once holds no repeated edge;
* a link that occurs twice as a whole is repeated as a whole;
* only the remaining links (equal minimizer, different words) are taken apart into edges.

Repeated links are then compacted: joined with the counts of their neighbours, a chain of links that always follow each
other is one path, the unit in which repeated passages are reported, by the coordinates of all its occurrences.

Links and edges are compared by a 64-bit hash of their words under a 64-bit minimizer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.common import (U, Prefix, Rows, WordHashes, keys_met_again, list_array, mix, partitions_for,
                                  run_hashes, signed)
from panelyard.plans import stage

#: Words of the shorter runs; edges that a slice of a text holds at most (places take 23 bits).
SEED_WORDS, SLICE = 8, 1 << 22


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return x if done == width else np.minimum(x[: len(x) - (width - done)], x[width - done:])


def links(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, edges, minimizer, hash) of each link of a text of word hashes, in order."""
    short = run_hashes(h, SEED_WORDS)
    parts = []
    for lo in range(0, len(h) - k + 1, SLICE):
        hi = min(lo + SLICE, len(h) - k + 1)  # edges lo..hi-1
        mine = short[lo: hi + k - SEED_WORDS]
        # The place breaks ties: the first of equal runs, which is the same one in equal edges.
        ranked = (mix(mine) & ~U((1 << 23) - 1)) | np.arange(len(mine), dtype=U)
        best = (least_of(ranked, k - SEED_WORDS + 1) & U((1 << 23) - 1)).astype(np.int64) + lo
        start = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
        parts.append((start + lo, np.diff(np.r_[start, len(best)]), short[best[start]]))
    start, edges, least = (np.concatenate(p) for p in zip(*parts))
    return start, edges, least, Prefix(h).runs(start, edges + k - 1)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


MARKED = ("id long, mark long, n_words long, class long, other long, digest string, least array<long>, link array<long>, "
          "start array<int>, edges array<int>")


def marked(docs: DataFrame, id_col: str, text_col: str, k: int, seed: int) -> DataFrame:
    """Each text's class (hash of its words), SHA-256 of its words, and links; links once per class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(seed), set()
        names = ["id", "mark", "n_words", "class", "other", "digest", "least", "link", "start", "edges"]
        rows = Rows(pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("n_words", pa.int64()), ("class", pa.int64()),
                               ("other", pa.int64()), ("digest", pa.string())]))
        found: list[list] = [[], [], [], []]

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            lists = [list_array(part, kind) for part, kind in zip(found, kinds)]
            for part in found:
                part.clear()
            return pa.RecordBatch.from_arrays([*rows.batch().columns, *lists], names=names)

        for batch in batches:
            for key, text, mark in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = words_of(text.as_py())
                joined = b" ".join(words)
                name = hashlib.blake2b(joined, digest_size=16, salt=seed.to_bytes(8, "little")).digest()
                low, high = np.frombuffer(name, np.int64).tolist()
                rows.add(key, mark, len(words), low, high, hashlib.sha256(joined).hexdigest(), size=160)
                if len(words) < k or low in seen:
                    for part in found:
                        part.append(None)
                else:
                    seen.add(low)
                    start, edges, least, link = links(hashes.of(words), k)
                    for part, values in zip(found, (signed(least), signed(link), start.astype(np.int32),
                                                    edges.astype(np.int32))):
                        part.append(values)
                    rows.bytes += 24 * len(start)
                if rows.full():
                    yield flush()
        yield flush()

    return _texts(docs, id_col, text_col).mapInArrow(run, MARKED)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, mark): id and mark, a hash of the text as it is, address a text, whether the id is null or repeated."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def texts_with(docs: DataFrame, id_col: str, text_col: str, ranges: DataFrame) -> DataFrame:
    """(id, text, and the columns of ``ranges``) of the rows whose id and mark have a row in ``ranges``."""
    texts, ranges = _texts(docs, id_col, text_col).alias("t"), ranges.alias("r")
    same = F.col("t.id").eqNullSafe(F.col("r.id")) & (F.col("t.mark") == F.col("r.mark"))
    return texts.join(ranges, same).select("t.id", "t.text", *[f"r.{c}" for c in ranges.columns if c not in ("id", "mark")])


def open_edges(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int, seed: int) -> DataFrame:
    """(least, edge, class, at) of every edge of the wanted links.

    ``wanted``: id, mark, class, and lists start, edges, least of the links of one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(seed)
        names = ["least", "edge", "class", "at"]
        for batch in batches:
            for text, name, start, edges, least in zip(*(batch.column(i) for i in range(1, 6))):
                words = words_of(text.as_py())
                digest = hashlib.blake2b(b" ".join(words), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
                if np.frombuffer(digest, np.int64)[0] != name.as_py():
                    continue  # another text of the same mark
                start, edges, least = (x.values.to_numpy() for x in (start, edges, least))
                at = np.repeat(start - (np.cumsum(edges) - edges), edges) + np.arange(edges.sum())
                edge = Prefix(hashes.of(words)).runs(at.astype(np.int64), k)
                for lo in range(0, len(at), 1 << 18):
                    cut = slice(lo, lo + (1 << 18))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(least, edges)[cut]), pa.array(signed(edge)[cut]),
                         pa.array(np.full(len(at[cut]), name.as_py())), pa.array(at[cut].astype(np.int32))], names=names)

    rows = texts_with(docs, id_col, text_col, wanted).select("id", "text", "class", "start", "edges", "least")
    return rows.mapInArrow(run, "least long, edge long, class long, at int")


def compacted(parts: DataFrame) -> DataFrame:
    """(class, path, start, edges): chains of repeated links that always follow each other, as one occurrence each.

    ``parts``: class, start, edges, least, link, an occurrence each. Two links are one path if every
    occurrence of the first goes on with the second and every one of the second comes from the first.
    """
    by = Window.partitionBy("class").orderBy("start")
    step = parts.select("class", "start", "edges", "link",
                        F.when(F.lag(F.col("start") + F.col("edges")).over(by) == F.col("start"),
                               F.lag("link").over(by)).alias("before"),
                        F.when(F.lead("start").over(by) == F.col("start") + F.col("edges"),
                               F.lead("link").over(by)).alias("after"))
    step = stage(step, "steps")
    known = step.groupBy("link").agg(
        (F.count("before") == F.count("*")).alias("always_in"), F.min("before").alias("in1"), F.max("before").alias("in2"),
        (F.count("after") == F.count("*")).alias("always_out"), F.min("after").alias("out1"), F.max("after").alias("out2"))
    known = known.select("link", F.expr("always_in and in1 = in2").alias("one_in"),
                         F.expr("always_out and out1 = out2").alias("one_out"))
    # A table of its own, so that the join can split the rows of a link that occurs everywhere.
    known = stage(known, "known")
    rows = step.select("class", "start", "edges", "link", "before").join(known, "link")
    joined = F.col("one_in") & F.coalesce(F.lag("one_out").over(by), F.lit(False)) & F.col("before").isNotNull()
    runs = rows.withColumn("head", F.when(joined, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("head").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("class", "run").agg(
        F.min_by("link", "start").alias("path"), F.min("start").alias("start"), F.sum("edges").cast("int").alias("edges"))


class Repeats:
    """The repeated passages of a table of texts; see ``repeated``."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int):
        self.docs, self.id_col, self.text_col, self.k = docs, id_col, text_col, k
        seed = 0
        while True:
            self.rows = stage(marked(docs, id_col, text_col, k, seed), "marked")
            self.classes = stage(self.rows.groupBy("class").agg(
                F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("low"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"),
                F.min("other").alias("o1"), F.max("other").alias("o2")), "classes")
            if self.classes.where("o1 <> o2").isEmpty():
                break
            seed += 1  # two texts share a name: draw all names again
        self.seed = seed
        self.paths = stage(self._paths(), "paths")

    def _paths(self) -> DataFrame:
        each = self.rows.where("least is not null").select(
            "class", F.explode(F.arrays_zip("least", "link", "start", "edges")).alias("x")).select(
            "x.least", "x.link", "class", "x.start", "x.edges")
        met = stage(keys_met_again(each, ["least"], ["link", "class", "start", "edges"], partitions_for(self.rows))
                    .distinct(), "links")
        # Tables of their own, here and below, so that the joins can split the rows of one key.
        links_met = stage(met.groupBy("least", "link").agg(
            F.count("*").alias("n"), F.min(F.struct("class", "start", "edges")).alias("one")), "met")
        kinds = links_met.groupBy("least").agg(F.count("*").alias("links"), F.min("n").alias("fewest")).where(
            "links > 1 and fewest = 1")
        # Links that share a minimizer with others, one of which occurs once: one occurrence of each, edge by edge.
        apart = stage(links_met.join(kinds.select("least"), "least", "left_semi").select(
            "least", "one.class", "one.start", "one.edges", (F.col("n") == 1).alias("alone")), "apart")
        wanted = apart.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("start", "edges", "least"))).alias("x"))
        wanted = wanted.join(self.classes.select("class", "low"), "class").select(
            "low.id", "low.mark", "class", F.col("x.start").alias("start"), F.col("x.edges").alias("edges"),
            F.col("x.least").alias("least"))
        # Written, as a range exchange reads its input twice.
        edges = stage(open_edges(self.docs, wanted, self.id_col, self.text_col, self.k, self.seed), "open")
        again = stage(keys_met_again(edges, ["least", "edge"], ["class", "at"], partitions_for(self.rows))
                      .distinct(), "edges")
        many = stage(again.groupBy("least", "edge").agg(F.count("*").alias("n")).where("n > 1"), "many")
        single = again.join(many.select("least", "edge"), ["least", "edge"], "left_semi")
        # Edges of links that occur as a whole more than once are there already.
        alone = apart.where("alone").select("least", "class", F.col("start").alias("s"), "edges")
        single = single.join(alone, ["least", "class"]).where("at >= s and at < s + edges").select(
            "class", F.col("at").alias("start"), F.lit(1).alias("edges"), F.col("edge").alias("link"))
        whole = met.join(links_met.where("n > 1").select("least", "link"), ["least", "link"], "left_semi").select(
            "class", "start", "edges", "link")
        return compacted(whole.unionByName(single))

    def passages(self) -> DataFrame:
        """(id, path, start, end): repeated passages of every row, in words, end exclusive.

        A row that has copies is repeated as a whole and comes as one passage named by its class.
        """
        rows = self.rows.where(f"n_words >= {self.k}").select("id", "class", "n_words")
        copies = self.classes.where("copies > 1").select("class")
        whole = rows.join(copies, "class", "left_semi").select(
            "id", F.col("class").alias("path"), F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))
        part = rows.join(self.classes.where("copies = 1").select("class"), "class", "left_semi").join(
            self.paths, "class").select("id", "path", "start", (F.col("start") + F.col("edges") + self.k - 1).alias("end"))
        return whole.union(part)

    def kept(self) -> DataFrame:
        """(id, n_words, n_removed, kept_sha256), one row per input row: what is left without its repeated words."""
        k = self.k
        spans = self.paths.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("start", "edges"))).alias("x"))
        info = self.classes.select("class", "copies").join(spans, "class", "left").select(
            "class", "copies", F.expr("x.start").alias("start"), F.expr("x.edges").alias("edges"))
        rows = self.rows.select("id", "mark", "n_words", "class", "digest").join(info, "class", "left")
        gone = f"n_words >= {k} and copies > 1"
        cut = f"n_words >= {k} and copies = 1 and start is not null"
        empty = hashlib.sha256(b"").hexdigest()
        easy = rows.where(f"not ({cut})").select(
            "id", "n_words", F.expr(f"if({gone}, n_words, 0L)").alias("n_removed"),
            F.expr(f"if({gone}, '{empty}', digest)").alias("kept_sha256"))
        seed = self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Rows(pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                                  ("kept_sha256", pa.string())]))
            for batch in batches:
                for key, text, name, start, edges in zip(*(batch.column(i) for i in range(5))):
                    words = words_of(text.as_py())
                    digest = hashlib.blake2b(b" ".join(words), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
                    if np.frombuffer(digest, np.int64)[0] != name.as_py():
                        continue  # another text of the same mark
                    left = without(words, start.values.to_numpy(), edges.values.to_numpy(), k)
                    out.add(key.as_py(), len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest(),
                            size=160)
                if out.full():
                    yield out.batch()
            yield out.batch()

        hard = texts_with(self.docs, self.id_col, self.text_col, rows.where(cut).select("id", "mark", "class", "start", "edges"))
        return easy.union(hard.select("id", "text", "class", "start", "edges").mapInArrow(
            run, "id long, n_words long, n_removed long, kept_sha256 string"))


def without(words: list[bytes], start: np.ndarray, edges: np.ndarray, k: int) -> list[bytes]:
    """The words that no edge covers."""
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + edges + k - 1, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 35) -> Repeats:
    """Runs of ``k`` words that start more than once in the table, same row included.

    ``passages()`` lists them as compacted paths with the coordinates of every occurrence; ``kept()`` gives for
    every input row what remains without the words they cover. Words are runs without ASCII white space, taken as they are.
    Null and empty texts and texts of fewer words hold no run and keep all words. Rows with a null id and rows that repeat an id
    are rows of their own, like others. An empty table gives empty results; other columns are not read.
    """
    return Repeats(docs, id_col, text_col, k)
