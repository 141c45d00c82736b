"""Labelled rows for fitting: held-out rows by checksum, and a bounded sample of the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts longer than this many characters don't enter a fit, unless a caller asks for more; they are scored whole all the same.
MAX_CHARS = 100_000


def fold(doc_id, parts: int):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, parts: int, held: int, per_class: int, max_chars: int = MAX_CHARS) -> DataFrame:
    """(text, y, h_) of at most per_class rows of each class whose fold isn't held out: those of the smallest seeded hash.

    The bound keeps a fit's memory the same at every size of the corpus. Null labels and texts are left out; a document
    that is labelled twice counts with the larger label.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id"), parts) != held)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).withColumn("h_", F.xxhash64(F.lit(7), "doc_id"))
    picked = [known.where(F.col("y") == y).orderBy("h_", "doc_id").limit(per_class) for y in (0, 1)]
    picked = picked[0].union(picked[1])
    texts = documents.select("doc_id", "text").where(f"text is not null and length(text) <= {max_chars}")
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"), F.max("h_").alias("h_"))
