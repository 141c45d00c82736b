"""Passages that repeat across documents: lines, cut further at sentence ends, are normalised and hashed.

Digests are grouped globally and the earliest document keeps its occurrence. A passage rarely comes alone on its line, so
a line is cut after . ! or ? before white space, and after the full stops of scripts without spaces. By default every
repeated line and sentence goes. With min_words, sentences go in runs of neighbouring repeated units of so many words
together, so one common sentence in a fresh line stays; whole repeated lines still go by themselves while `lines` holds.
Units of fewer than `few` words say nothing by themselves; inside a run or a line they go with it. A character of a script
without spaces counts as a word.

Rows of units are small, hot digests are combined before the shuffle, and the join of units with the repeated digests needs
no rows of a key together, so adaptive execution can split a hot line. What a row repeats is gathered by 128 bits of its
doc_id and text, so rows of one doc_id, or without one, are neither mixed up nor gathered in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auklet.llm.common import stored
from auklet.llm.decontaminate import bench_words

MIN_WORDS, FEW_WORDS = 1, 1
_UNIT = re.compile(r"[^\n]*?(?:[.!?]+(?=[^\S\n])|[\u3002\uff01\uff0e\uff1f\uff61\u104b\u17d4]+[\u300d\u300f\u201d\uff09]*)|[^\n]+")
_LINE = re.compile(r"[^\n]+")
#: Letters of scripts without spaces: Thai, Lao, Burmese, Khmer, kana, Han and their extensions.
_UNSPACED = re.compile(r"[\u0e01-\u0e4e\u0e81-\u0edf\u1000-\u1049\u1050-\u109f\u1780-\u17d3\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


_MARKS = re.compile(r"[\u104a-\u104f\u17d4-\u17da\u2018-\u201f\u2026\u3000-\u3004\u3008-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def _size(piece: str, words: list[bytes]) -> int:
    """Words, where each letter of a script without spaces counts as one."""
    letters = 0 if piece.isascii() else len(_UNSPACED.findall(piece))
    return letters + len(bench_words(_UNSPACED.sub(" ", _MARKS.sub(" ", piece)))) if letters else len(words)


def _unit(piece: str, at: int, few: int) -> tuple[int, int, int, bytes] | None:
    size = _size(piece, words := bench_words(piece))
    if size < few:
        return None
    return at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip()), size, xxhash.xxh3_128_digest(b" ".join(words))


def units(text: str | None, few: int = FEW_WORDS) -> list[tuple[int, int, int, bytes]]:
    """(start, stop, words, digest) of the units of `few` words or more; offsets are code points without outer white space."""
    return [u for m in _UNIT.finditer(text or "") if (u := _unit(m.group(), m.start(), few))]


#: Added to the places of whole lines of several units, which are doubled, so that no two of them are neighbours.
_LINES = 1 << 39


def placed_units(text: str | None, few: int = FEW_WORDS, lines: bool = False) -> list[tuple[int, int, int, bytes, bool, int]]:
    """units() in order, each with whether it is a whole line and its place; with `lines` also the lines of several units."""
    if not lines:
        return [(*u, False, k) for k, u in enumerate(units(text, few))]
    out, k = [], 0
    for n, line in enumerate(_LINE.finditer(text or "")):
        own, whole = [(u[0] + line.start(), u[1] + line.start(), *u[2:]) for u in units(line.group(), few)], _unit(line.group(), line.start(), few)
        same = [whole is not None and u[3] == whole[3] for u in own]  # the other pieces of this line have no words
        out += [((*whole, True, k + j) if x else (*u, False, k + j)) for j, (u, x) in enumerate(zip(own, same, strict=True))]
        if whole and not any(same):
            out.append((*whole, True, _LINES + 2 * n))
        k += len(own)
    return out


def _units(few: int, lines: bool):
    names = ["doc", "ka", "kb", "place", "start", "size", "words", "again", "whole", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, rows, again = [], [], []
                for text in part["text"].to_pylist():
                    found, seen = placed_units(text, few, lines), set()
                    for u in found:
                        again.append(u[3] in seen)
                        seen.add(u[3])
                    n.append(len(found))
                    rows += found
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                start, stop = np.array(columns[0], np.int32), np.array(columns[1], np.int32)
                of = pa.array(np.repeat(np.arange(part.num_rows), n))
                arrays = [np.array(columns[5], np.int64), start, stop - start, np.array(columns[2], np.int32), np.array(again, bool), np.array(columns[4], bool)]
                yield pa.RecordBatch.from_arrays([*(part[c].take(of) for c in ("doc", "ka", "kb")), *map(pa.array, arrays), pa.array(columns[3], pa.binary())], names=names)

    return run


def _row_key() -> dict[str, F.Column]:
    """128 bits that stand for a row (doc, text) by both; rows that agree in them repeat each other."""
    return {k: F.xxhash64(F.lit(seed), F.col("doc").isNull(), "doc", "text") for seed, k in enumerate(("ka", "kb"))}


def _keyed(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumns(_row_key())


def repeats(documents: DataFrame, min_words: int = MIN_WORDS, few: int = FEW_WORDS, lines: bool = True) -> DataFrame:
    """(ka, kb, spans): what to remove of each row that repeats something; spans are (start, stop, first_doc), in order."""
    kind = "doc long, ka long, kb long, place long, start int, size int, words int, again boolean, whole boolean, digest binary"
    found = _keyed(documents).mapInArrow(_units(few, lines), kind)
    own = F.struct(F.col("doc").isNull().alias("loose"), "doc", "ka", "kb")  # rows rank by doc_id, null last, and then by their keys
    firsts = found.groupBy("digest").agg(F.min(own).alias("first"), F.max(own).alias("last")).where("first < last")
    firsts = stored(firsts.select("digest", "first"), "firsts")
    later = F.col("again") | (F.col("first").isNotNull() & (F.col("first") != own))
    first = F.when(F.col("first").isNotNull(), F.col("first.doc")).otherwise(F.col("doc")).alias("first_doc")
    repeated = found.join(firsts, "digest", "left").where(later).select("ka", "kb", "place", "start", "size", "words", "whole", first).distinct()
    w = Window.partitionBy("ka", "kb").orderBy("place")
    repeated = repeated.withColumn("run", F.col("place") - F.row_number().over(w))
    stop = (F.col("start") + F.col("size")).alias("stop")
    span = F.struct("start", stop, "first_doc")
    runs = repeated.groupBy("ka", "kb", "run").agg(F.min("start").alias("start"), F.max(stop).alias("stop"), F.sum("words").alias("words"), F.min_by("first_doc", "place").alias("first_doc"), F.collect_list(F.when(F.col("whole"), span)).alias("lines"))
    runs = runs.select("ka", "kb", F.explode(F.when(F.col("words") >= min_words, F.array(F.struct("start", "stop", "first_doc"))).otherwise(F.col("lines"))).alias("span")).select("ka", "kb", "span.*")
    if lines:  # a line and the run of its sentences are one span
        w = Window.partitionBy("ka", "kb").orderBy("start", F.desc("stop"))
        fresh = F.coalesce(F.col("start") >= F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
        runs = runs.withColumn("fresh", fresh.cast("int")).withColumn("part", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        runs = runs.groupBy("ka", "kb", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("first_doc", F.struct("start", -F.col("stop"))).alias("first_doc"))
    return runs.groupBy("ka", "kb").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "first_doc"))).alias("spans"))


def line_report(documents: DataFrame, min_words: int = MIN_WORDS, few: int = FEW_WORDS, lines: bool = True) -> DataFrame:
    """(doc_id, n_chars, kept_chars, n_spans, spans, repeats_of) of every row of documents.

    spans are what goes, as offsets (code points) in the original, each with the document that keeps it; repeats_of are
    those documents, sorted. The earliest doc_id keeps a passage, null ids come last; within a document the first
    occurrence stays. Of rows of one doc_id, or without one, that of the smallest hash of its text keeps what they share; rows
    that agree in doc_id and text can't be told apart and keep it each. Spans are by a row's own text; first_doc is null where a row without doc_id
    keeps the passage. Null, empty and wordless texts have nothing to remove. Other columns are ignored. An empty table gives an empty result.

    By default every repeated unit goes: min_words asks for runs of so many words, which whole lines needn't make while
    `lines` holds, and few leaves out units of fewer words.
    """
    rows = _keyed(documents).select("doc", "ka", "kb", F.length("text").cast("long").alias("n_chars"))
    out = rows.join(repeats(documents, min_words, few, lines), ["ka", "kb"], "left")
    none = F.array().cast("array<struct<start:int,stop:int,first_doc:bigint>>")
    out = out.withColumn("spans", F.coalesce("spans", none))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    of = F.array_sort(F.array_compact(F.array_distinct(F.transform("spans", lambda s: s["first_doc"]))))
    return out.select(F.col("doc").alias("doc_id"), "n_chars", (F.col("n_chars") - gone).alias("kept_chars"), F.size("spans").alias("n_spans"), "spans", of.alias("repeats_of"))


def without_repeats(documents: DataFrame, min_words: int = MIN_WORDS, few: int = FEW_WORDS, lines: bool = True) -> DataFrame:
    """documents with the repeated passages taken out of text; columns and rows stay."""
    own = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("own")
    rows = documents.select(own, F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns(_row_key()).join(repeats(documents, min_words, few, lines), ["ka", "kb"], "left")
    parts = F.transform(F.col("spans"), lambda s, k: F.substring("text", F.when(k == 0, 1).otherwise(F.col("spans")[k - 1]["stop"] + 1), s["start"] - F.when(k == 0, 0).otherwise(F.col("spans")[k - 1]["stop"])))
    rest = F.substring(F.col("text"), F.element_at("spans", -1)["stop"] + 1, F.length("text"))
    text = F.when(F.col("spans").isNull(), F.col("own.text")).otherwise(F.concat(F.array_join(parts, ""), rest))
    return rows.select(*[(text if c == "text" else F.col(f"own.`{c}`")).alias(c) for c in documents.columns])
