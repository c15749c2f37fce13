"""Reproducible random order: rows are ordered by the md5 of their key and a seed.

A cut "the first m rows of that order" is the predicate ``hash <= cut``. The cut value is found
by counting hash prefixes (at most 16**4 counters per pass, combined map-side) and narrowing
until the prefix that holds rank m has few rows or is a whole hash. No row is shuffled or ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DIGITS, _WHOLE = 4, 32
#: Hashes that are read to the driver at once.
_SMALL = 20_000


def hash_key(key: str | Sequence[str], seed: int | str) -> Column:
    """md5 of ``key|seed`` as 32 hex digits; the key columns must identify a row.

    Different keys give different texts: separators inside a value are escaped and a null is
    marked.
    """
    cols = [key] if isinstance(key, str) else list(key)

    def text(c: str) -> Column:
        escaped = F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        return F.coalesce(escaped, F.lit("\\N"))

    return F.md5(F.concat_ws("|", *[text(c) for c in cols], F.lit(str(seed))))


def _tied(rank: int) -> ValueError:
    return ValueError(f"the keys do not identify rows: several rows share the hash at rank {rank}, "
                      "so no cut gives the exact size; add a column to the key")


def _nth(df: DataFrame, hashed: str, ranks_of: Callable[[int], Sequence[int]]) -> tuple[list[int], dict[int, str]]:
    """The wanted ranks, given the number of rows, and the hash at each positive one."""
    found: dict[int, str] = {}
    ranks: list[int] | None = None
    wanted = {0: ("", 0)}
    while wanted:
        prefixes = sorted({prefix for prefix, _ in wanted.values()})
        width = min(len(prefixes[0]) + _DIGITS, _WHOLE)
        pool = df if prefixes == [""] else df.filter(F.substring(hashed, 1, len(prefixes[0])).isin(prefixes))
        tally = sorted((r["p"], r["count"]) for r in
                       pool.groupBy(F.substring(hashed, 1, width).alias("p")).count().collect())
        if ranks is None:  # the first pass counts all rows
            ranks = list(ranks_of(sum(n for _, n in tally)))
            wanted = {rank: ("", rank) for rank in ranks if rank > 0}
        narrowed = {}
        for rank, (prefix, left) in wanted.items():
            for bucket, n in tally:
                if bucket.startswith(prefix):
                    if left <= n:
                        narrowed[rank] = (bucket, left, n)
                        break
                    left -= n
            else:
                raise ValueError(f"rank {rank} is beyond the number of rows")
        if width == _WHOLE:
            for rank, (bucket, left, n) in narrowed.items():
                if left < n:
                    raise _tied(rank)
                found[rank] = bucket
            break
        small = {r: v for r, v in narrowed.items() if v[2] <= _SMALL}
        members: dict[str, list[str]] = {}
        if small:
            buckets = sorted({v[0] for v in small.values()})
            for row in df.filter(F.substring(hashed, 1, width).isin(buckets)).select(hashed).collect():
                members.setdefault(row[0][:width], []).append(row[0])
        for rank, (bucket, left, _) in small.items():
            order = sorted(members[bucket])
            if left < len(order) and order[left - 1] == order[left]:
                raise _tied(rank)
            found[rank] = order[left - 1]
        wanted = {r: (v[0], v[1]) for r, v in narrowed.items() if r not in small}
    return ranks or [], found


def hash_cut(df: DataFrame, hashed: str, ranks: Sequence[int] | Callable[[int], Sequence[int]]) -> list[str]:
    """Cut values for the ranks, which may be a function of the number of rows (counted on the way).

    Rank 0 or less gives an empty string (nothing is below it). A cut between rows of equal hash
    cannot be exact and raises.
    """
    known, found = _nth(df.select(hashed), hashed, ranks if callable(ranks) else lambda _: ranks)
    return [found[r] if r > 0 else "" for r in known]
