"""What the text operators share: reading tables, durable intermediate tables, words and their hashes."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by these code points in the contracts that count words by white space.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"


#: Bytes of rows that a batch to or from Python holds: whole texts are long, and the JVM keeps several batches for each task.
BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's bound of a batch to BATCH_BYTES; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a temporary one only where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="auklet-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Tables that stored() wrote, by the scope that was open then; those of no scope come first, and cleared() deletes them.
_WRITTEN: list[list[str]] = [[]]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends there, and a lost executor costs nothing.

    The table outlives the call, because the returned frame is lazy; `tables` deletes it when its scope ends, else cleared().
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, paths: list[str]) -> int:
    n = 0
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cleared(spark: SparkSession) -> int:
    """Deletes the tables that this driver's operators have stored outside any scope; returns how many. Frames that weren't written yet can't be computed any more."""
    return _deleted(spark, _WRITTEN[0])


@contextmanager
def tables(spark: SparkSession) -> Iterator[None]:
    """A scope whose end deletes the tables that operators have stored in it: write results before. Scopes may be nested, in one thread."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        _deleted(spark, _WRITTEN.pop())


#: Rows of a few numbers that are broadcast at most (about 50 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What to do with a join's side of as many rows as df has: broadcast it where they are few. df has been stored, so counting is cheap."""
    return F.broadcast if df.count() <= BROADCAST_ROWS else lambda side: side


def text_key(text) -> F.Column:
    """128 bits that stand for a text, null apart from every text; cheap in the JVM, so rows can be told apart and joined by it."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


#: Bytes of rows after which a task over many short pieces gives memory back; a collection takes 45 ms, as long as such a task.
RELEASE_BYTES = 1 << 20


def released(run: Callable[[Iterator], Iterator], over: int = 0) -> Callable[[Iterator], Iterator]:
    """run, after which the worker gives memory that it no longer needs back: workers outlive tasks, and a stage's next to the one before.

    With `over`, of Arrow batches, only tasks that read at least so many bytes do.
    """

    def whole(batches: Iterator) -> Iterator:
        size = 0

        def read() -> Iterator:
            nonlocal size
            for batch in batches:
                size += batch.nbytes
                yield batch

        yield from run(read() if over else batches)
        if size < over:
            return
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return whole


class WordHashes(dict):
    """64-bit hash of each word, remembered; forgotten when there are too many, so memory stays bounded."""

    LIMIT = 400_000

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes] | list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased. Only ASCII letters and ASCII white space count in bytes, which is the rule asked for."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words, with repeats and in order; of the whole sequence if it is shorter (none if empty)."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    last = n - size + 1
    out = hashes[:last].copy()
    for k in range(1, size):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += hashes[k : k + last]
    out += np.uint64(size)
    return mixed(out)
