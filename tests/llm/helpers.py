"""Small tables with every awkward row, and plain Python versions of the operators."""

import random
import re

from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of a user's own that are named like the operators' own ones.
CLASHING = ["id", "n", "class", "key", "score", "h", "label", "row", "spans", "base", "runs", "ids", "words", "component"]


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_texts(rng: random.Random) -> list:
    """(id, text) rows: copies, near copies, a shared passage, repeated rows, nulls, blanks, long ones."""
    base = [sentence(rng, rng.randrange(20, 120)) for _ in range(30)]
    passage = sentence(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    n = len(rows)
    for i in range(12):  # a large group of near copies
        words = base[0].split()
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((n + i, " ".join(words)))
    rows += [(100 + i, base[i % 3]) for i in range(9)]  # exact copies
    rows += [(120 + i, f"{sentence(rng, 15)} {passage}\n{sentence(rng, 15)}") for i in range(5)]
    rows += [(130, base[4].upper()), (131, "a b c"), (132, "A  B\tc"), (133, "one"), (134, "one"), (135, "same " * 200)]
    rows += [(140, ""), (141, " \t\n "), (142, None), (143, None), (None, None), (None, base[5]), (None, "only here " * 30)]
    rows += [(3, base[3]), (3, base[3]), (7, base[8]), (150, sentence(rng, 6000) + " é 日本 " + "y" * 5000)]
    rng.shuffle(rows)
    return rows


def documents(spark, rows, clashing: bool = True):
    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], COLUMNS)
    return df.withColumns({c: F.lit("own") for c in CLASHING}) if clashing else df


def words_of(text) -> list:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lowered(text) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text or "")


class Groups:
    """Components with the smallest member as name."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
