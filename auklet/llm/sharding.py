"""Shards by extendible hashing: a directory over hash-prefix bits, in which only oversized buckets split.

A row's bucket is the shortest prefix of its hash whose rows fit the byte limit together. Prefix sums are counted on cells
of a fixed number of bits that follows from the total size, so what is shuffled and kept is a row for each cell, not for
each document. Cells that are still too large are counted again with more bits, and only those. Rows that share a whole
hash can't be split by it; they go on to numbered pages of the bucket, filled in order up to the limit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auklet.llm.common import stored

#: Bits of the hash that can be told apart.
BITS = 52
#: Bits that one pass looks ahead, beyond those that an even spread needs.
AHEAD = 3


def _bits(key) -> F.Column:
    """The first BITS bits of the key's MD5 as a number."""
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def shards(documents: DataFrame, limit: int = 128 << 20, key: str = "doc_id") -> DataFrame:
    """documents' columns and bucket (the prefix, as bits), page, shard (both as one name) and row_bytes.

    Every shard's texts take at most `limit` bytes, unless a single row alone takes more; then that row is a shard.
    A null text counts 0 bytes; null keys hash as the empty string. Rows of one key, however many, are spread over pages.
    New columns replace documents' columns of the same name. An empty table gives an empty result.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1 byte")
    rows = documents.withColumn("row_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("hash_", _bits(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    sized = rows.select("hash_", "row_bytes")
    total = sized.agg(F.sum("row_bytes")).first()[0] or 0
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, total) / limit))) + AHEAD)
    cut = lambda h, n: F.shiftrightunsigned(h, BITS - n) if n else F.lit(0).cast("long")
    done, open_, depth = [], sized, 0
    while True:
        cells = stored(open_.groupBy(cut(F.col("hash_"), bits).alias("cell")).agg(F.sum("row_bytes").alias("bytes")), "cells")
        # every cell under each of its prefixes of depth..bits bits; a prefix that fits, and whose parent doesn't, is a bucket
        under = cells.withColumn("d", F.explode(F.sequence(F.lit(depth), F.lit(bits))))
        under = under.withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {bits} - d)"))
        sums = under.groupBy("d", "prefix").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit)
        fits = under.join(sums.select("d", "prefix"), ["d", "prefix"]).groupBy("cell").agg(F.min("d").alias("d"))
        placed = stored(cells.join(fits, "cell", "left").select("cell", F.coalesce("d", F.lit(bits)).alias("d"), F.col("d").isNull().alias("over")), "placed")
        done.append((bits, placed))
        full = placed.where("over").select("cell")
        if bits >= BITS or full.isEmpty():
            break
        open_ = open_.join(full, cut(F.col("hash_"), bits) == F.col("cell"), "left_semi")
        depth, bits = bits + 1, min(BITS, bits + AHEAD + 3)
    d, over = F.lit(None).cast("int"), F.lit(False)
    for n, placed in done:  # later passes are about cells that were over in the passes before
        at = placed.select(F.col("cell").alias(f"cell_{n}"), F.col("d").alias(f"d_{n}"), F.col("over").alias(f"over_{n}"))
        rows = rows.withColumn(f"cell_{n}", cut(F.col("hash_"), n)).join(at, f"cell_{n}", "left").drop(f"cell_{n}")
        d, over = F.coalesce(F.col(f"d_{n}"), d), F.coalesce(F.col(f"over_{n}"), over)
    bucket = F.substring(F.lpad(F.conv(F.col("hash_").cast("string"), 10, 2), BITS, "0"), F.lit(1), d)
    rows = rows.withColumn("bucket", bucket).withColumn("over_", over)
    names = [c for c in documents.columns if c not in ("bucket", "page", "shard", "row_bytes")]
    keep = rows.select(*[F.col(f"`{c}`") for c in names], "row_bytes", "bucket", "over_", "hash_")
    even = keep.where(~F.col("over_")).withColumn("page", F.lit(0).cast("long"))
    paged = _paged(keep.where("over_"), names, limit) if done[-1][0] >= BITS and not done[-1][1].where("over").isEmpty() else None
    out = even if paged is None else even.unionByName(paged)
    return out.select(*[F.col(f"`{c}`") for c in names], "row_bytes", "bucket", "page", F.concat("bucket", F.lit("/"), F.col("page").cast("string")).alias("shard"))


def _paged(rows: DataFrame, names: list[str], limit: int) -> DataFrame:
    """Rows of buckets that no hash bit can split, on pages: each takes rows of one chunk up to the limit.

    Rows are dealt to chunks by a hash of their content and of their number among rows that are equal, so that no chunk is
    unbounded and reruns give the same pages however rows are dealt to tasks; within a chunk, a page ends where half the limit is passed, and rows of over half the limit have a page of their own.
    """
    hashed = [F.col(f"`{c}`") for c, kind in rows.dtypes if not any(x in kind for x in ("map<", "variant"))]  # kinds that have no hash
    rows = stored(rows.withColumns({"same_": F.xxhash64(*hashed), "task_": F.spark_partition_id()}), "paged")
    counts = rows.groupBy("bucket", "same_", "task_").agg(F.count("*").alias("n_"))  # equal rows are numbered within tasks, after those of the tasks before
    before = Window.partitionBy("bucket", "same_").orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(counts.select("bucket", "same_", "task_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_")), ["bucket", "same_", "task_"])
    number = F.col("before_") + F.row_number().over(Window.partitionBy("bucket", "same_", "task_").orderBy("row_bytes"))
    rows = rows.withColumn("deal_", F.xxhash64(F.lit(11), "same_", number).bitwiseAND((1 << 52) - 1) / float(1 << 52)).drop("same_", "task_", "before_")
    sizes = rows.groupBy("bucket").agg((F.ceil(F.sum("row_bytes") / limit) + F.floor(F.count("*") / 10_000)).alias("chunks_"))
    rows = rows.join(sizes, "bucket").withColumn("chunk_", F.floor(F.col("deal_") * F.greatest("chunks_", F.lit(1))))
    big = F.col("row_bytes") * 2 > limit
    w = Window.partitionBy("bucket", "chunk_", big).orderBy("deal_")
    half = max(1, limit // 2)
    start = F.sum("row_bytes").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("step_", F.when(big, F.row_number().over(w)).otherwise(F.floor(F.coalesce(start, F.lit(0)) / half)))
    page = F.conv(F.substring(F.md5(F.concat_ws("/", F.col("chunk_"), big.cast("int"), F.col("step_"))), 1, 15), 16, 10).cast("long")
    return rows.withColumn("page", page).drop("deal_", "chunks_", "chunk_", "step_")
