"""Mixing sources to target weights: whole passes, and a subset-sum fit of the rest by exact length.

Sizes are counted in words. What a source's whole passes leave of its target is filled by documents of that source: first
the same share of every length, then documents of remaining lengths while more than the reach of the dynamic program is
missing, then a bounded-knapsack program over the counts of each length hits the rest as nearly as it can be hit. Only
counts by (source, length) go to that step; which documents of a length are taken follows from a seeded hash of the row.

Words are counted in one pass over the texts, whose table of (source, size, hashes) serves all counts; a second pass over the
rows gives the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auklet.llm.common import SPACE_WORDS, stored

#: Words that the dynamic program spans.
REACH = 1 << 16
#: Documents of one length and source that are ranked together.
RANKED = 64


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], share: float, most: float) -> dict[str | None, float]:
    """Target of each of a few sources: its weight's part of share x all sizes, at most `most` times its size; the excess reshared by weight."""
    names = sorted((s for s, _ in sizes if s is not None)) + [None] * any(s is None for s, _ in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    size = dict(sizes)
    left, open_, out = share * sum(size.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in names if s in open_)
        full = [s for s in names if s in open_ and weight[s] * unit > most * size[s]]
        if not full:
            return out | {s: weight[s] * unit for s in names if s in open_}
        for s in full:
            out[s] = float(most * size[s])
            left -= out[s]
            open_.discard(s)
    return out


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with `number`: their places from 0 in the order of `by`, null last. Ranges are sorted apart and their offsets added, so no task orders all."""
    order = F.asc_nulls_last(by)
    sorted_ = rows.repartitionByRange(order).sortWithinPartitions(order).withColumns({"range_": F.spark_partition_id(), "id_": F.monotonically_increasing_id()})
    sorted_ = stored(sorted_, "ordered")
    sizes = sorted_.groupBy("range_").agg(F.count("*").alias("n_"), F.min("id_").alias("first_"))  # a row for each range
    offsets = sizes.select("range_", "first_", F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    return sorted_.join(F.broadcast(offsets), "range_").withColumn("number", F.col("id_") - F.col("first_") + F.col("before_")).drop("range_", "id_", "first_", "before_")


def source_targets(words: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source_, target) of sources (source, source_, words) as `targets` gives them, for any number of sources.

    A source is full once the words for a unit of weight pass most * words / weight. Each round sums what full ones take and what the others
    weigh, which gives the next, larger unit; it ends when no more source fills up. Only these sums come to the driver.
    """
    rows = numbered(words, "source").withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")))
    rows = stored(rows.select("source_", "words", "weight"), "weighted")
    whole = rows.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).first()
    if not whole.weight:
        return rows.select("source_", F.lit(0.0).alias("target"))
    left, full = share * whole.words, -1
    unit = left / whole.weight
    while True:
        over = F.col("weight") * F.lit(unit) > most * F.col("words")
        now = rows.agg(F.count_if(over).alias("full"), F.sum(F.when(over, F.col("words")).otherwise(0)).alias("taken"), F.sum(F.when(~over, F.col("weight")).otherwise(0)).alias("open")).first()
        if now.full == full or not now.open:
            break
        full, unit = now.full, (left - most * now.taken) / now.open
    target = F.least(F.col("weight") * F.lit(unit), most * F.col("words")) if now.open else most * F.col("words")
    return rows.select("source_", target.cast("double").alias("target"))


def reachable(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that the sum is as near to budget as can be without passing it: bounded knapsack.

    Sums are the bits of one number; each length is added in powers of two of its count. The item that first reaches a sum
    is remembered, and the best sum is taken apart again.
    """
    full = (1 << (budget + 1)) - 1
    seen, steps = 1, []
    for k, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        count = min(count, budget // length) if length else 0
        part = 1
        while count > 0:
            part = min(part, count)
            new = (seen << (length * part)) & full & ~seen
            if new:
                steps.append((k, part, new))
                seen |= new
            count -= part
            part *= 2
        if seen >> budget & 1:
            break
    take = [0] * len(lengths)
    at = seen.bit_length() - 1
    for k, part, new in reversed(steps):
        if new >> at & 1:
            take[k] += part
            at -= lengths[k] * part
    return take


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, reach: int = REACH) -> np.ndarray:
    """Counts to take of each length, together near budget; at most counts of each."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.floor(counts * (max(0, budget - reach // 2) / total)).astype(np.int64)
    missing = budget - int((lengths * take).sum())
    for k in np.argsort(-lengths, kind="stable"):  # what rounding down left, the longest first
        if missing <= reach:
            break
        if lengths[k] > 0:
            more = int(min(counts[k] - take[k], (missing - reach // 2) // lengths[k]))
            if more > 0:
                take[k] += more
                missing -= more * int(lengths[k])
    missing = min(missing, max(reach, int(lengths.max(initial=0))))
    spare = np.flatnonzero((counts > take) & (lengths > 0) & (lengths <= missing))
    take[spare] += np.array(reachable([int(x) for x in lengths[spare]], [int(x) for x in (counts - take)[spare]], int(missing)), dtype=take.dtype)
    return take


def _planned(pdf: pd.DataFrame, reach: int) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total, target = int((lengths * counts).sum()), float(pdf["target"].iloc[0])
    passes = int(target // total) if total else 0
    extra = fill(lengths, counts, int(round(target - passes * total)), reach) if total else np.zeros_like(counts)
    if total and passes and (extra == counts).all():
        passes, extra = passes + 1, np.zeros_like(counts)
    return pd.DataFrame({"source_": pdf["source_"], "size": lengths, "n": counts, "source_size": total, "target": target, "passes": passes, "extra": extra})


def mixture(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, reach: int = REACH) -> DataFrame:
    """documents' columns and size, source_size, target, taken (words) and copies (times the document is taken).

    Sources weigh `weights` in turn by code point, null last, and share `share` times all words; no source's target passes
    `most` times its words, and no document is taken more than ceil(most) times. A null text has size 0 and takes no words;
    such documents have the copies of their source's whole passes. Repeated rows count each. Reruns agree, however rows are
    dealt: the seeded hash is of the whole row, so rows of one doc_id, or without one, differ by their other columns, and
    where all columns are equal any row is the same choice. Of a source's budget the last `reach` words or so are fitted exactly, what is before them is
    shared by all lengths; more takes longer and changes what is chosen, not how near a target is where lengths are mixed. New columns replace documents' columns of the same name. An
    empty table gives an empty result.
    """
    new = ("size", "source_size", "target", "taken", "copies")
    names = [c for c in documents.columns if c not in new]
    size = F.coalesce(F.regexp_count("text", F.lit(SPACE_WORDS)), F.lit(0)).cast("long")
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    row = [F.col(f"`{c}`") for c, kind in documents.dtypes if not any(x in kind for x in ("map<", "variant"))]  # kinds that have no hash
    slot = (F.xxhash64(F.lit(seed), *row).bitwiseAND((1 << 52) - 1) / float(1 << 52)).alias("slot_")
    keys = [size.alias("size"), named.alias("source_"), slot, F.xxhash64(F.lit(seed + 1), *row).alias("tie_")]
    rows = documents.select(*[F.col(f"`{c}`") for c in names], *keys)
    counted = stored(documents.select("source", *keys), "counted")

    hist = stored(counted.groupBy("source_", "size").agg(F.first("source").alias("source"), F.count("*").alias("n")), "lengths")
    words = hist.groupBy("source_").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("words"))
    goal = source_targets(words, weights, share, most)
    plan_schema = "source_ string, size long, n long, source_size long, target double, passes long, extra long"
    plan = stored(hist.join(goal, "source_").select("source_", "size", "n", "target").groupBy("source_").applyInPandas(lambda pdf: _planned(pdf, reach), plan_schema), "plan")

    # documents of a length, in the order of their slots, are counted in parts of about RANKED rows; each part knows how many of its rows are still to take
    part = F.floor(F.col("slot_") * F.ceil(F.col("n") / RANKED)).alias("part_")
    parts = counted.join(plan, ["source_", "size"]).groupBy("source_", "size", part).agg(F.count("*").alias("here_"), F.first("extra").alias("extra_"))
    before = Window.partitionBy("source_", "size").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.greatest(F.lit(0), F.col("extra_") - F.coalesce(F.sum("here_").over(before), F.lit(0)))
    parts = stored(parts.select("source_", "size", "part_", quota.alias("quota_")), "parts")
    met = rows.join(plan, ["source_", "size"]).withColumn("part_", part).join(parts, ["source_", "size", "part_"])
    rank = F.row_number().over(Window.partitionBy("source_", "size", "part_").orderBy("slot_", "tie_"))
    out = met.withColumn("copies", (F.col("passes") + (rank <= F.col("quota_")).cast("int")).cast("int"))
    return out.select(*[F.col(f"`{c}`") for c in names], "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_rows(documents: DataFrame, **how) -> DataFrame:
    """documents' rows with documents' columns, each as often as the mixture takes it."""
    columns = documents.columns
    rows = documents.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]).alias("row_"))
    chosen = mixture(rows, **how).where("copies > 0").withColumn("again_", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return chosen.select(*[(F.col("text") if c == "text" else F.col(f"row_.`{c}`")).alias(c) for c in columns])
