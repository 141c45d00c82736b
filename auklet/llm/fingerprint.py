"""Document fingerprints by consistent weighted sampling: two agree in a share of places that estimates their generalised Jaccard similarity.

A text's weighted terms are its five-word runs with their counts (a shorter text is one run). For each of SAMPLES places and
each term, r and c are gamma(2, 1) draws and b a uniform one, fixed by the term and the place alone; a term of weight w has
t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r, and the place keeps the term and t of the least a.

The draws come from three exponential ones, each a hash of term and place: x, y and z give c = x + y, r = z + ln(c / x) and
b = z / r. This is the same distribution: r b and r (1 - b) are independent exponential draws, and so are the parts that
exp(-r (1 - b)), a uniform draw, splits c into. Then ln a = ln x - r t, and of weight 1, the common case, t is 0 and the least
a is the least hash: only repeated terms need logarithms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auklet.llm.common import WordHashes, lower_words, mixed, shingles

SAMPLES = 128
#: Terms of weight 1, and repeated ones, whose draws are in memory at once.
ONES, MANY = 1024, 256


def _exponential(hashes: np.ndarray) -> np.ndarray:
    """Exponential draws, ascending with the hashes."""
    return -np.log1p(-((hashes >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52)


class Sampler:
    def __init__(self, size: int = 5, seed: int = 23):
        self.size, self.hashes = size, WordHashes()
        self.place = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64))
        self.odd = (mixed(self.place + np.uint64(seed)) | np.uint64(1))[:, None]

    def _hashes(self, terms: np.ndarray) -> np.ndarray:
        """A hash of each place (rows) and term."""
        x = terms * self.odd
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x

    def _repeated(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a and t of each place (rows) and term."""
        hashes = self._hashes(terms)
        x, y, z = _exponential(hashes), _exponential(mixed(hashes + np.uint64(1))), _exponential(mixed(hashes + np.uint64(2)))
        r = z + np.log1p(y / x)
        t = np.floor(np.log(counts) / r + z / r)
        return np.log(x) - r * t, t.astype(np.uint64)

    def sample(self, text: str | None) -> np.ndarray:
        """16 bits for each place; of a text without words, those of a term that no text has."""
        terms, counts = np.unique(shingles(self.hashes.of(lower_words(text)), self.size), return_counts=True)
        if not len(terms):
            terms, counts = np.zeros(1, np.uint64), np.ones(1, int)
        places = np.arange(SAMPLES)
        best, kept, steps = np.full(SAMPLES, np.inf), np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.uint64)
        once = counts == 1
        ones, many, counts = terms[once], terms[~once], counts[~once]
        least = np.full(SAMPLES, np.iinfo(np.uint64).max)
        for lo in range(0, len(ones), ONES):  # long texts in bounded pieces
            hashes = self._hashes(ones[lo : lo + ONES])
            first = hashes.argmin(axis=1)
            value = hashes[places, first]
            better = value < least
            least[better], kept[better] = value[better], ones[first[better] + lo]
        if len(ones):
            best = np.log(_exponential(least))
        for lo in range(0, len(many), MANY):
            ln_a, t = self._repeated(many[lo : lo + MANY], counts[lo : lo + MANY])
            first = ln_a.argmin(axis=1)
            value = ln_a[places, first]
            better = value < best
            best[better], kept[better], steps[better] = value[better], many[first[better] + lo], t[places, first][better]
        return (mixed(kept ^ mixed(steps + self.place)) >> np.uint64(48)).astype(np.uint16)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float((x == y).mean())


def edited(text: str, after: str) -> str:
    """The last third of the text replaced by as many first characters of the text after it, or by all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n] if n else text


def _compared(size: int):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, before = Sampler(size), None

        def told(x: tuple, y: tuple) -> tuple:
            own = edited(x[1], y[1])
            print_ = x[2] if own == x[1] else sampler.sample(own)
            return x[0], len(x[1]), hashlib.sha256(own.encode()).hexdigest(), x[2].tobytes().hex(), print_.tobytes().hex(), likeness(x[2], print_), likeness(x[2], y[2])

        for batch in batches:
            out = []
            for doc, text, group, guest in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "group", "guest")), strict=True):
                same = before is not None and before[3] == group
                if guest and not same:
                    continue  # a further row of the guest's doc_id
                now = (doc, text, sampler.sample(text), group)
                if same:
                    out.append(told(before, now))
                before = None if guest else now
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


#: Most groups of consecutive documents; heads and cuts of that many are held by the driver.
GROUPS = 100_000


def fingerprints(documents: DataFrame, shingle: int = 5, rows_a_group: int = 250) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of documents.

    Documents follow each other by descending doc_id, rows of one doc_id by a hash of their text, null ids last; the first
    follows the last. Null texts are empty; equal texts have equal fingerprints; texts without words are like each other only.
    A lone document is its own next. Other columns are ignored. An empty table gives an empty result.

    Rows are dealt to groups of consecutive ids, cut at quantiles; a doc_id, or none, that has more rows than a few groups is
    cut further at even steps of the hash. A task streams over sorted groups, holding two texts. The first row of a group is
    also the guest at the end of the group before it, so whole texts move once.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    total = rows.count()
    each = max(rows_a_group, total // GROUPS, 1)
    groups = max(1, total // each)
    hot = rows.groupBy("key").count().where(F.col("count") > 4 * each).orderBy("key").collect() if groups > 1 else []  # a quarter of GROUPS at most
    cuts = rows.approxQuantile("key", [k / groups for k in range(1, groups)], 1 / (4 * groups)) if groups > 1 else []
    cuts = np.unique(np.array([*(min(int(c), (1 << 63) - 1) for c in cuts), *(k for h in hot for k in (h.key, max(h.key, 1 - (1 << 63)) - 1))], np.int64))  # a hot key is a group of its own
    hot_keys, hot_parts = np.array([h.key for h in hot], np.int64), np.array([-(-h["count"] // each) for h in hot], np.uint64)

    @F.pandas_udf("long")
    def group(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        k = keys.to_numpy(np.int64)
        place = (len(cuts) - np.searchsorted(cuts, k)).astype(np.int64) << 32
        if len(hot_keys):
            at = np.minimum(np.searchsorted(hot_keys, k), len(hot_keys) - 1)
            high = (hashes.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
            place += np.where(hot_keys[at] == k, (high * hot_parts[at]) >> np.uint64(32), 0).astype(np.int64)
        return pd.Series(place)

    first = F.max(F.struct("key", F.bitwise_not("hash").alias("low"))).alias("head")
    heads = rows.groupBy(group("key", "hash").alias("group")).agg(first).orderBy("group").collect()  # about GROUPS rows
    guests = [(heads[(k + 1) % len(heads)].head.key, ~heads[(k + 1) % len(heads)].head.low, h.group) for k, h in enumerate(heads)]
    guests = documents.sparkSession.createDataFrame(guests, "key long, hash long, before long")
    rows = rows.withColumn("group", group("key", "hash")).join(F.broadcast(guests), ["key", "hash"], "left")
    places = F.array(F.struct("group", F.lit(0).alias("guest")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("group"), F.lit(1).alias("guest"))))
    rows = rows.withColumn("place", F.explode(F.array_compact(places))).select("doc_id", "text", "key", "hash", "place.group", "place.guest")
    rows = rows.repartition("group").sortWithinPartitions("group", "guest", F.desc("key"), "hash", "text").select("doc_id", "text", "group", "guest")
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(_compared(shingle), kinds)
