"""Text quality: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's tokens are its words and its runs of other marks, lower-cased; its features are their uni- and bigrams, a bigram
of a token with itself being one feature for all tokens. Each feature's value is a damped count over the text's norm. The
fit is one pass after another over a bounded sample, in one task; scoring is a sparse dot product against the weights,
which have a fixed size whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auklet.llm.common import WordHashes, mixed, stored
from auklet.llm.sample import MAX_CHARS, fold, labelled_sample

#: log2 of the number of weights.
BITS = 18
#: Most rows of each class that a fit sees.
PER_CLASS = 5000
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_SAME = np.uint64(xxhash.xxh3_64_intdigest(b"same again"))


def features(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature indexes of a text and their values; none for a text without tokens."""
    one = hashes.of(_TOKEN.findall(text.lower())) if text else np.empty(0, np.uint64)
    if not len(one):
        return np.empty(0, np.int64), np.empty(0)
    two = mixed(one[:-1] * np.uint64(3) + one[1:])
    two[one[:-1] == one[1:]] = _SAME
    at, n = np.unique((np.concatenate([mixed(one), two]) >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    value = np.log1p(n)
    return at, value / np.sqrt((value * value).sum())


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates, L1 and L2 terms; index 2^BITS is the intercept."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, value: np.ndarray, y: int) -> None:
        at, value = np.append(at, 1 << BITS), np.append(value, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
        g = (p - y) * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(texts: list[str], ys: list[int], passes: int = 4, seed: int = 5) -> np.ndarray:
    """Weights as float32; the prior alone if there is one class or none."""
    model, hashes, rng = Ftrl(), WordHashes(), np.random.default_rng(seed)
    rows = [features(t, hashes) for t in texts]
    if len(set(ys)) < 2:
        out = np.zeros((1 << BITS) + 1, np.float32)
        out[-1] = 4.0 * (2 * ys[0] - 1) if ys else 0.0
        return out
    for _ in range(passes):
        for k in rng.permutation(len(rows)):
            model.learn(*rows[k], ys[k])
    return model.weights(slice(None)).astype(np.float32)


def _fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat([*frames, pd.DataFrame({"text": [], "y": [], "h_": []})]).sort_values(["h_", "text"])
    yield pd.DataFrame({"model": [fit(rows["text"].tolist(), [int(y) for y in rows["y"]]).tobytes()]})


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, held: int = 0, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> bytes:
    """The model's bytes, fitted to a bounded sample of labelled rows whose fold isn't held out, of texts of max_chars characters at most."""
    sample = labelled_sample(documents, labels, label, parts, held, per_class, max_chars).repartition(1)
    rows = stored(sample.mapInPandas(_fitted, "model binary"), "quality-model").collect()
    return bytes(rows[0].model) if rows else fit([], []).tobytes()


def scored(documents: DataFrame, model: bytes, parts: int = 5, held: int = 0, at_least: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts have the intercept's score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, hashes = np.frombuffer(shared.value, np.float32).astype(float), WordHashes()
        for texts in batches:
            dots = [(w[at] @ value if len(at) else 0.0) for at, value in (features(t, hashes) for t in texts)]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(dots, float) + w[-1], -30, 30))))

    value = F.pandas_udf(score, "double")(F.col("text").cast("string"))
    rows = documents.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), value.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= at_least).cast("int"))


def quality(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Fits on labels and scores every row of documents; documents' and labels' other columns are ignored.

    Repeated rows are scored each. Without usable labels every score is 0.5. An empty table gives an empty result.
    """
    return scored(documents.select("doc_id", "text"), train(documents, labels, **how))
