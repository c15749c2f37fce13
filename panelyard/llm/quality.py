"""Text quality by logistic regression over hashed word n-grams.

Features are runs of one and two words and runs of one to three word shapes (letters, digits and marks
by kind; a word that repeats its predecessor has a shape of its own), hashed to 2**20
places, with the share of the text's runs as value. Follow-the-regularised-leader updates fit the weights; a score is a
sparse dot product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm import training
from panelyard.llm.common import U, WordHashes, free_name, run_hashes

WIDTH = 1 << 20
#: Step, its offset, L1 and L2 strength, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.05, 3
#: A run's share of its text is counted in units of a hundredth.
UNIT = 100.0
KINDS = ((0, 1), (0, 2), (1, 1), (1, 2), (1, 3))
SAME = U(0x5A3E)
#: Byte -> its kind; letters beyond ASCII count as small ones.
SHAPE = bytes(32 if b in b" \t\n\v\f\r" else 97 if b >= 128 or chr(b).islower() else 65 if chr(b).isupper()
              else 48 if chr(b).isdigit() else b for b in range(256))


def shapes(text: bytes) -> list[bytes]:
    """Each word as its kinds of bytes, a run of one kind as one."""
    kinds = np.frombuffer(text.translate(SHAPE), np.uint8)
    return kinds[np.r_[True, kinds[1:] != kinds[:-1]]].tobytes().split() if len(kinds) else []


class Features:
    """Places of a text's runs, one array for each kind."""

    def __init__(self):
        self.words, self.shapes = WordHashes(), WordHashes(1)

    def __call__(self, text: str) -> list[np.ndarray]:
        text = text.encode()
        h, s = self.words.of(text.split()), self.shapes.of(shapes(text))
        s[1:][h[1:] == h[:-1]] = SAME
        return [(run_hashes((h, s)[of], k, seed=10 * of) & U(WIDTH - 1)).astype(np.int64) for of, k in KINDS]


def sparse(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) with each place once."""
    places = np.concatenate(parts)
    values = np.concatenate([np.full(len(p), UNIT / max(1, len(p))) for p in parts])
    at, inverse = np.unique(places, return_inverse=True)
    return at, np.bincount(inverse, values, len(at))


def learn(texts: list[str], y: np.ndarray) -> np.ndarray:
    """FTRL-proximal updates, one text after the other; the bias is the last weight and not regularised."""
    features = Features()
    rows = []
    for text in texts:
        at, x = sparse(features(text))
        rows.append((at.astype(np.int32), x.astype(np.float32)))
    z, n, w = np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH)
    bias, bias_n = 0.0, 0.0
    for _ in range(PASSES):
        for (at, x), label in zip(rows, y):
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x + bias, -500, 500)))
            g = (p - label) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] += g - sigma * wi
            n[at] += g * g
            bias_n += (p - label) ** 2
            bias -= ALPHA * (p - label) / (BETA + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return np.r_[w, bias]


def scorer():
    features = Features()

    def margin(text: str, w: np.ndarray) -> float:
        return float(sum(w[p].sum(dtype=np.float64) * (UNIT / len(p)) for p in features(text) if len(p)))

    return margin


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", learn_rows: Column | None = None, sample: int = training.SAMPLE) -> DataFrame:
    """(id, score): the probability of label 1 for every row of ``docs``, from its whole text alone.

    The fit takes at most ``sample`` different labelled (id, text) pairs, chosen by hash among those of
    ``learn_rows``. Null and empty texts have no run and score by the bias. Null, repeated and unlabelled ids are scored
    like any other row. Without rows of both labels all rows score the (smoothed) share of ones, 0.5 without
    any; an empty table gives an empty result. Other columns are not read.
    """
    rows = training.labelled_sample(docs, labels, id_col, text_col, label_col, sample, learn_rows)
    scored = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return training.score(scored, training.fit(rows, learn, WIDTH), scorer, "text").drop("text")


def good_texts(docs: DataFrame, labels: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "quality", learn_rows: Column | None = None, sample: int = training.SAMPLE) -> DataFrame:
    """The rows of ``docs``, as they are, whose quality score is ``least`` or more; else as ``quality_scores``."""
    rows = training.labelled_sample(docs, labels, id_col, text_col, label_col, sample, learn_rows)
    name = free_name(docs, "quality_score")
    scored = training.score(docs, training.fit(rows, learn, WIDTH), scorer, text_col, name)
    return scored.where(F.col(name) >= least).drop(name)
