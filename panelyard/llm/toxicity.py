"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the distinct runs of three to five characters of the lower-cased text, white space
as one blank, hashed to 2**20 places. Place j counts as r_j if it occurs: the logarithm of the ratio of its
(smoothed) shares among toxic and other texts. A logistic regression over these
values is fitted by AdaGrad steps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm import training
from panelyard.llm.common import U, run_hashes

WIDTH = 1 << 20
SIZES = (3, 4, 5)
#: Step, passes over the sample.
STEP, PASSES = 0.1, 4


class Features:
    """Distinct places of a text's runs of characters."""

    def __init__(self):
        self.last = np.zeros(WIDTH, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        text = " ".join(["", *text.lower().split(), ""])
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U)
        places = np.concatenate([run_hashes(chars, k, seed=10 * k) for k in SIZES])
        places = (places & U(WIDTH - 1)).astype(np.int32)
        order = np.arange(len(places), dtype=np.int32)
        self.last[places] = order
        return places[self.last[places] == order]  # the last of equal places stays


def learn(texts: list[str], y: np.ndarray) -> np.ndarray:
    features = Features()
    rows = [features(text) for text in texts]
    counts = np.ones((2, WIDTH))
    for at, label in zip(rows, y):
        counts[label, at] += 1
    # Shares of texts, so that long texts do not weigh more.
    ratio = np.log(counts[1] / (y.sum() + 2)) - np.log(counts[0] / (len(y) - y.sum() + 2))
    w, g2 = np.zeros(WIDTH), np.full(WIDTH, 1e-8)
    bias, bias_g2 = float(np.log(y.sum() / (len(y) - y.sum()))), 1e-8
    for _ in range(PASSES):
        for at, label in zip(rows, y):
            x = ratio[at]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x + bias, -500, 500)))
            g = (p - label) * x
            g2[at] += g * g
            w[at] -= STEP * g / np.sqrt(g2[at])
            bias_g2 += (p - label) ** 2
            bias -= STEP * (p - label) / np.sqrt(bias_g2)
    return np.r_[w * ratio, bias]


def scorer():
    features = Features()

    def margin(text: str, w: np.ndarray) -> float:
        at = features(text)
        return float(w[at].sum(dtype=np.float64))

    return margin


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", learn_rows: Column | None = None, sample: int = training.SAMPLE) -> DataFrame:
    """(id, score): the probability of label 1 for every row of ``docs``, from its whole text alone.

    The fit takes at most ``sample`` different labelled (id, text) pairs, chosen by hash among those of
    ``learn_rows``. Null and empty texts are a blank and have no run: they score by the bias. Null, repeated and unlabelled ids
    are scored like any other row. Without rows of both labels all rows score the (smoothed) share of
    ones, 0.5 without any; an empty table gives an empty result. Other columns are not read.
    """
    rows = training.labelled_sample(docs, labels, id_col, text_col, label_col, sample, learn_rows)
    scored = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return training.score(scored, training.fit(rows, learn, WIDTH), scorer, "text").drop("text")
