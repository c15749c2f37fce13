"""Ranked lexical search over an inverted index, best intervals of documents first.

``index`` cuts the documents into blocks and writes, for every term of a block, the list of its documents and counts.
A term's part of a document's score grows with the count and falls with the document's length; the score of a query is
the sum over its terms.

``search`` gives each posting list of a block a sparse table of range maxima. A query's documents of a block are first one
interval; the maxima of its terms inside an interval, added up, bound every score there. The interval of the highest bound is
taken, split at the document where the largest of these maxima stands, that document is scored, and both sides are bounded anew.
An interval whose bound is below the score that enough documents are known to reach is never opened. A short first round over all blocks finds
that score, so most blocks end at their first bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.common import partitions_for
from panelyard.plans import stage, with_row

#: A block ends with the document that brings it to so many words or documents.
BLOCK_WORDS, BLOCK_DOCS = 1 << 20, 1 << 16
#: Bytes of a text whose words are held at once.
PORTION = 1 << 20
#: Terms of the queries that go through the blocks together.
GROUP_TERMS = 200_000
#: Intervals of a query that are opened at once, and times that happens in the first round.
WIDTH, FIRST_ROUNDS = 8, 3

#: Characters of a term, for Spark and SQL; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for bytes: small letters for capital ones, a blank for what no term holds.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
                   for b in range(256))

POSTINGS = "block long, term string, docs array<int>, counts array<int>, ids array<long>"


class _Vocabulary(dict):
    """Numbers of the terms in the order they are met."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Block:
    """Collects documents and writes their posting lists."""

    def __init__(self):
        self.vocabulary, self.ids, self.sizes = _Vocabulary(), [], []
        self.terms: list[np.ndarray] = []
        self.words = 0

    def add(self, key, text: str) -> None:
        raw = text.encode().translate(TERM_BYTES)
        lo, size = 0, 0
        while lo < len(raw):
            hi = raw.find(b" ", lo + PORTION)
            hi = len(raw) if hi < 0 else hi
            terms = raw[lo:hi].split()
            self.terms.append(np.fromiter(map(self.vocabulary.__getitem__, terms), np.int32, len(terms)))
            size, lo = size + len(terms), hi
        if size:  # others are in no list
            self.ids.append(key)
            self.sizes.append(size)
            self.words += size

    def full(self) -> bool:
        return self.words >= BLOCK_WORDS or len(self.ids) >= BLOCK_DOCS

    def batches(self, block: int) -> Iterator[pa.RecordBatch]:
        """One row per term, documents numbered by id (null ids last), and a row without a term: sizes and ids."""
        n = len(self.ids)
        order = sorted(range(n), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        sizes = np.array(self.sizes, np.int64)
        key = np.concatenate(self.terms).astype(np.int64) * n + np.repeat(number, sizes)
        self.terms.clear()
        key, counts = np.unique(key, return_counts=True)
        docs, counts = (key % n).astype(np.int32), counts.astype(np.int32)
        names = [t.decode() for t in self.vocabulary]
        first = np.searchsorted(key, np.arange(len(names) + 1) * n)
        schema = pa.schema([("block", pa.int64()), ("term", pa.string()), ("docs", pa.list_(pa.int32())),
                            ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([None], pa.string()), pa.array([sizes[order].astype(np.int32)], pa.list_(pa.int32())),
             pa.array([None], pa.list_(pa.int32())), pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64()))], schema=schema)
        for lo in range(0, len(names), 1 << 14):
            hi = min(len(names), lo + (1 << 14))
            part, ends = slice(first[lo], first[hi]), pa.array((first[lo:hi + 1] - first[lo]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(hi - lo, block)), pa.array(names[lo:hi], pa.string()), pa.ListArray.from_arrays(ends, pa.array(docs[part])),
                 pa.ListArray.from_arrays(ends, pa.array(counts[part])), pa.nulls(hi - lo, pa.list_(pa.int64()))], schema=schema)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, term, docs, counts, ids): the posting lists of all documents, written to the shared folder.

    The row without a term holds a block's numbers of terms (``docs``) and ids. Null and empty texts have no term and are in no
    list. Every other row is a document of its own, with a null or a repeated id too. A long text is read whole, in portions. Other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = _Block(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                block.add(key.as_py(), text.as_py() or "")
                if block.full():
                    yield from block.batches(number)
                    block, number = _Block(), number + 1
        if block.ids:
            yield from block.batches(number)

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stage(read.mapInArrow(run, POSTINGS), "postings")


def query_terms(queries: DataFrame, text_col: str) -> DataFrame:
    """(query, term, times) of rows with a number ``query``; a row without a term has none."""
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract_all(F.translate(F.col(text_col), capital, small), F.lit(TERM), F.lit(0))
    return queries.select("query", F.explode(found).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))


class _Group:
    """The terms of some queries: ``first`` says where each query's terms start, ``weight`` has the repeats in it."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, least: dict[int, int] | None = None):
        order = np.lexsort((term, query))
        query, self.term, self.weight = query[order], term[order], weight[order]
        self.query, first = np.unique(query, return_index=True)
        self.first = np.r_[first, len(query)]
        #: A score that enough documents reach, by query.
        self.least = np.array([(least or {}).get(q, 1) for q in self.query.tolist()], np.int64)


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), then the same of first[1] and so on."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class _Maxima:
    """The posting lists of one block with their range maxima.

    ``key`` orders all postings by list and document; ``top[j][i]`` is the place of the largest impact among the 2**j
    postings from ``i`` on, the first one of equals.
    """

    def __init__(self, lists: list[tuple[int, np.ndarray, np.ndarray]], norm: np.ndarray):
        self.n = len(norm)
        self.terms = np.array([t for t, _, _ in lists], np.int64)
        size = np.array([len(d) for _, d, _ in lists], np.int64)
        docs = np.concatenate([d for _, d, _ in lists]).astype(np.int64)
        counts = np.concatenate([c for _, _, c in lists]).astype(np.int64)
        self.key = np.repeat(np.arange(len(lists)), size) * self.n + docs
        self.impact = (1_000_000_000 * counts) // (1000 * counts + 12 * norm[docs])
        self.top = [np.arange(len(docs), dtype=np.int32)]
        self.level = np.zeros(int(size.max()) + 1, np.int64)
        for j in range(1, int(size.max()).bit_length()):
            self.level[1 << j:] = j
            left, right = self.top[-1][:-(1 << j - 1)], self.top[-1][1 << j - 1:]
            self.top.append(np.where(self.impact[left] >= self.impact[right], left, right))
        self.flat = np.concatenate(self.top)
        self.start = np.cumsum([0, *[len(t) for t in self.top]])

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of the largest impact in each (not empty) range of postings."""
        j = self.level[hi - lo]
        left, right = self.flat[self.start[j] + lo], self.flat[self.start[j] + hi - (1 << j)]
        return np.where(self.impact[left] >= self.impact[right], left, right)


class _Best:
    """The best documents of one block for every query of a group."""

    def __init__(self, group: _Group, maxima: _Maxima, k: int):
        self.m, self.k = maxima, k
        order = np.argsort(maxima.terms)
        at = np.minimum(np.searchsorted(maxima.terms, group.term, sorter=order), len(order) - 1)
        slot = order[at]
        here = maxima.terms[slot] == group.term
        size = np.add.reduceat(here.astype(np.int64), group.first[:-1])
        self.slot, self.weight = slot[here], group.weight[here]
        self.size, self.first = size, np.cumsum(size) - size
        self.least = group.least.tolist()
        self.found: list[list[tuple[int, int]]] = [[] for _ in size]  # heaps of (score, -document)
        self.open: list[list[tuple[int, int, int, int]]] = [[] for _ in size]  # heaps of (-bound, from, to, split)
        queries = np.flatnonzero(size)
        self.push(queries, np.zeros(len(queries), np.int64), np.full(len(queries), maxima.n))

    def push(self, query: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Bound the intervals and open those that can hold one of the best documents."""
        query, lo, hi = (x[lo < hi] for x in (query, lo, hi))
        if not len(query):
            return
        size = self.size[query]
        at = _spans(self.first[query], size)
        base, weight = self.slot[at] * self.m.n, self.weight[at]
        of = np.repeat(np.arange(len(query)), size)
        left, right = np.searchsorted(self.m.key, base + lo[of]), np.searchsorted(self.m.key, base + hi[of])
        part, place = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        some = right > left
        place[some] = self.m.largest(left[some], right[some])
        part[some] = weight[some] * self.m.impact[place[some]]
        starts = np.cumsum(size) - size
        bound, most = np.add.reduceat(part, starts), np.maximum.reduceat(part, starts)
        which = np.minimum.reduceat(np.where(part == most[of], np.arange(len(at)), len(at)), starts)
        split = self.m.key[place[which]] % self.m.n
        for q, b, a, z, s in zip(query.tolist(), bound.tolist(), lo.tolist(), hi.tolist(), split.tolist()):
            if b > 0 and b >= self.least[q]:
                heapq.heappush(self.open[q], (-b, a, z, s))

    def score(self, query: np.ndarray, doc: np.ndarray) -> np.ndarray:
        size = self.size[query]
        at = _spans(self.first[query], size)
        key = self.slot[at] * self.m.n + np.repeat(doc, size)
        place = np.minimum(np.searchsorted(self.m.key, key), len(self.m.key) - 1)
        part = np.where(self.m.key[place] == key, self.weight[at] * self.m.impact[place], 0)
        return np.add.reduceat(part, np.cumsum(size) - size)

    def run(self, rounds: int | None) -> None:
        """Open intervals until none can hold one of the ``k`` best, or for so many rounds."""
        active = [q for q, heap in enumerate(self.open) if heap]
        while active and rounds != 0:
            taken = []
            for q in active:
                heap, found = self.open[q], self.found[q]
                last = found[0] if len(found) == self.k else (0, 1)
                for _ in range(WIDTH):
                    if not heap:
                        break
                    bound, lo, hi, split = heapq.heappop(heap)
                    # An equal bound helps if a smaller document can reach it.
                    if -bound < self.least[q] or -bound < last[0] or (-bound == last[0] and -lo < last[1]):
                        if -bound < max(self.least[q], last[0]):
                            heap.clear()
                        continue
                    taken.append((q, lo, hi, split))
            if taken:
                q, lo, hi, split = np.array(taken, np.int64).T
                for query, doc, score in zip(q.tolist(), split.tolist(), self.score(q, split).tolist()):
                    if score >= self.least[query]:
                        heap = self.found[query]
                        (heapq.heappush if len(heap) < self.k else heapq.heappushpop)(heap, (score, -doc))
                self.push(np.r_[q, q], np.r_[lo, split + 1], np.r_[split, hi])
            active = [q for q in active if self.open[q]]
            rounds = None if rounds is None else rounds - 1


def _searched(lists: DataFrame, group, k: int, rounds: int | None) -> DataFrame:
    """(query, id, score): the best ``k`` documents of every block; only some of them with ``rounds``.

    ``lists`` is partitioned and sorted by block: (block, number, docs, counts, ids, norm), numbers of terms from 0 on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, block, mine, ids, norm = group.value, None, [], None, None

        def done() -> Iterator[pa.RecordBatch]:
            if not mine:
                return
            best = _Best(terms, _Maxima(mine, norm), k)
            best.run(rounds)
            at = [(q, -doc, score) for q, found in zip(terms.query.tolist(), best.found) for score, doc in found]
            if at:
                query, doc, score = zip(*at)
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), ids.take(pa.array(doc)), pa.array(score, pa.int64())],
                                                 names=["query", "id", "score"])

        for batch in batches:
            for of, number, docs, counts, own, m in zip(*batch.columns):
                if of.as_py() != block:
                    yield from done()
                    block, mine = of.as_py(), []
                if number.is_valid:
                    mine.append((number.as_py(), docs.values.to_numpy(), counts.values.to_numpy()))
                else:
                    ids, norm = own.values, m.values.to_numpy()
        yield from done()

    return lists.mapInArrow(run, "query long, id long, score long")


def search(postings: DataFrame, queries: DataFrame, k: int = 20, text_col: str = "text") -> DataFrame:
    """The columns of ``queries`` with (rank, id, score) of the ``k`` best documents of each row, ranks from 1 on.

    Scores are whole numbers; only those above 0 count, equal ones go by ascending id, null ids last. Every row of
    ``queries`` is a query of its own, repeated or with null columns; one without a known term has no result. An empty index or an
    empty table of queries gives an empty result. Columns of ``queries`` named rank, id or score are refused.

    Queries go through the blocks in groups of about ``GROUP_TERMS`` terms (a longer query is a group of its own), which is what
    a task and the driver hold of them at a time.
    """
    if clash := {"rank", "id", "score"} & {c.lower() for c in queries.columns}:
        raise ValueError(f"queries have columns named {sorted(clash)}")
    spark = queries.sparkSession
    own = queries.columns
    numbered = stage(queries.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), F.col(f"`{text_col}`").alias("text"),
                                    F.monotonically_increasing_id().alias("query")), "queries")
    asked = stage(query_terms(numbered, "text"), "asked")
    sizes = postings.where("term is null")
    totals = sizes.agg(F.sum(F.size("docs")).alias("all_docs"), F.sum(F.aggregate("docs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("all_terms"))
    totals = stage(totals, "totals")
    wanted = stage(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("number")), "wanted")

    empty = lambda kind: F.lit(None).cast(kind)
    lists = postings.where("term is not null").join(wanted, "term").select(
        "block", "number", "docs", "counts", empty("array<long>").alias("ids"), empty("array<long>").alias("norm"))
    norms = with_row(sizes, totals).select("block", empty("long").alias("number"), empty("array<int>").alias("docs"),
                                           empty("array<int>").alias("counts"), "ids",
                                           F.expr("transform(docs, n -> 75L + (25L * n * all_docs) div all_terms)").alias("norm"))
    lists = stage(lists.union(norms), "lists")
    holding = stage(lists.where("number is not null").groupBy("number").agg(F.sum(F.size("docs")).alias("df")), "holding")
    weight = F.floor(F.log((2.0 * F.col("all_docs") + 2) / (2.0 * F.col("df") + 1)) * 1000)
    terms = with_row(asked.join(wanted, "term").join(holding, "number"), totals)
    terms = stage(terms.select("query", "number", (weight * F.col("times")).alias("weight")).where("weight > 0"), "terms")

    blocks = lists.repartition(partitions_for(postings), "block").sortWithinPartitions("block")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = F.row_number().over(by_score)
    groups = max(1, -(-terms.count() // GROUP_TERMS))
    best = []
    for g in range(groups):
        arrow = terms.where(F.pmod(F.xxhash64("query"), F.lit(groups)) == g).toArrow()
        columns = [arrow.column(i).to_numpy() for i in range(3)]
        first = spark.sparkContext.broadcast(_Group(*columns))
        some = _searched(blocks, first, k, FIRST_ROUNDS)
        least = some.withColumn("rank", ranked).where(F.col("rank") == k).select("query", "score").collect()
        group = spark.sparkContext.broadcast(_Group(*columns, least={r.query: r.score for r in least}))
        best.append(stage(_searched(blocks, group, k, None), "best"))
        first.destroy(), group.destroy()
    found = best[0]
    for more in best[1:]:
        found = found.union(more)
    found = found.withColumn("rank", ranked).where(F.col("rank") <= k)
    named = [F.col("own")[c].alias(c) for c in own]
    return found.join(numbered.select("query", "own"), "query").select(*named, "rank", "id", "score")
