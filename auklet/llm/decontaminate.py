"""Benchmark passages in documents, found by an Aho-Corasick automaton over the benchmark's word windows.

Each distinct word of the benchmark becomes one character, each window of words one pattern; a document becomes one
string, with a character of its own for words that no item has, and is scanned once. An automaton of MAX_WORDS benchmark words
takes about 100 MB in a task. A larger benchmark is cut into overlapping pieces of items, which are dealt to several
automata; each scans all texts in a pass of its own and gives only its hits, by a key of the text; these are united and joined
to the rows once, so texts are never written. Only one batch of pieces is held by the driver and the workers at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auklet.llm.common import released, small, stored, text_key

#: Benchmark words in one automaton.
MAX_WORDS = 150_000
#: Words of an item in one piece, besides the overlap.
PIECE_WORDS = 10_000
#: Bytes that belong to words, lower-cased; all other bytes separate. Bytes above 0x7F are parts of characters that count as word characters.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: The same words in the original text, for their offsets.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_STATE = "array<struct<start:int,stop:int>>"


def bench_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


def windows(words: list, size: int) -> list[tuple]:
    """Runs of `size` words; the whole list if it is shorter; none if it is empty."""
    return [tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []


class Matcher:
    """The automaton of some items (id, text), built once in each worker."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.code: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for item, text in items:
            for w in windows(bench_words(text), size):
                owners.setdefault("".join(map(self._char, w)), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for key, ids in owners.items():
            self.automaton.add_word(key, (len(key), tuple(ids)))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def _char(self, word: bytes) -> str:
        if (got := self.code.get(word)) is None:
            k = len(self.code) + 1
            got = self.code[word] = chr(k if k < 0xD800 else k + 0x800)  # surrogates are no characters
        return got

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges of words that are hit, and the items whose windows occur."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.any or not words:
            return ranges, items
        get = self.code.get
        for end, (n, ids) in self.automaton.iter("".join([get(w, "\0") for w in words])):
            items.update(ids)
            ranges.append((end - n + 1, end + 1))
        return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


#: Rows that are unpacked at a time.
PIECE = 512


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            yield batch.slice(at, PIECE)


def _scan(items, size: int, fields: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items.value, size)
        for batch in _pieces(batches):
            counts, ranges, found = [], [], []
            for text in batch["text_"].to_pylist():
                words = bench_words(text)
                r, i = matcher.find(words)
                counts.append(len(words))
                ranges.append([{"start": a, "stop": b} for a, b in r])
                found.append(sorted(i))
            arrays = [batch["row_"], batch["text_"], pa.array(counts, pa.int64()), pa.array(ranges, fields.field("ranges").type), pa.array(found, fields.field("items").type)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row_", "text_", "n_words", "ranges", "items"])

    return run


def _hits(items, size: int, fields: pa.Schema):
    """(key_, ranges, items) of the texts (key_, text_) in which one automaton finds something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items.value, size)
        for batch in _pieces(batches):
            got = [matcher.find(bench_words(text)) for text in batch["text_"].to_pylist()]
            hit = pa.array([k for k, (r, _) in enumerate(got) if r], pa.int64())
            ranges = [[{"start": a, "stop": b} for a, b in got[k][0]] for k in hit.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key_"].take(hit), pa.array(ranges, fields.field("ranges").type), pa.array([sorted(got[k][1]) for k in hit.to_pylist()], fields.field("items").type)], names=["key_", "ranges", "items"])

    return run


def _united(fields: pa.Schema):
    """Rows with what all automata found in their texts, as _scan gives it for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            counts = [len(bench_words(text)) for text in batch["text_"].to_pylist()]
            ranges = [merged([(x["start"], x["stop"]) for part in parts or () for x in part]) for parts in batch["ranges"].to_pylist()]
            found = [sorted({x for part in parts or () for x in part}) for parts in batch["items"].to_pylist()]
            arrays = [pa.array(counts, pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in r] for r in ranges], fields.field("ranges").type), pa.array(found, fields.field("items").type)]
            yield pa.RecordBatch.from_arrays([batch["row_"], batch["text_"], *arrays], names=["row_", "text_", "n_words", "ranges", "items"])

    return run


def _reported(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, spans, digests, counts = [], [], [], []
            for text, ranges, items in zip(batch["text_"].to_pylist(), batch["ranges"].to_pylist(), batch["items"].to_pylist(), strict=True):
                hits.append(sum(r["stop"] - r["start"] for r in ranges))
                at = [m.span() for m in _WORD.finditer(text)] if ranges else []
                spans.append([{"start": at[r["start"]][0], "stop": at[r["stop"] - 1][1]} for r in ranges])
                counts.append(len(items))
                digests.append(hashlib.sha256(",".join(items).encode()).hexdigest())
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            arrays = [batch["row_"], batch["n_words"], pa.array(hits, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), batch["items"], pa.array(spans, span)]
            names = ["row_", "n_words", "n_hit", "n_items", "items_sha256", "items", "spans"]
            yield pa.RecordBatch.from_arrays([*arrays, batch["text_"]] if with_text else arrays, names=[*names, "text_"] if with_text else names)

    return run


def _cut(size: int, each: int):
    """Items of more than `each` words in pieces that overlap by a window less one word, so every window is in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = bench_words(text)
                cut = [words[k : k + each + size - 1] for k in range(0, max(1, len(words) - size + 1), each)] if words else []
                for at in range(0, len(cut), 64):
                    own = cut[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(own)), pa.array([b" ".join(w).decode("utf-8", "surrogatepass") for w in own]), pa.array(map(len, own), pa.int64())], names=["item", "text", "words"])

    return run


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, keep_text: bool = False, max_words: int = MAX_WORDS) -> DataFrame:
    """Per row of documents: row_ (a struct of its columns but text), n_words, n_hit, n_items, items_sha256, items, spans, contaminated.

    spans are offsets (code points) of the hit runs in the original text. A null or wordless text has no words and no
    hits; an item without words matches nothing; items of one id count once, a null id as the empty string; an empty
    benchmark contaminates nothing. Repeated rows are judged each. Other columns ride along in row_, whatever their names.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = stored(items.mapInArrow(_cut(window, min(PIECE_WORDS, max_words)), "item string, text string, words long").distinct(), "items")
    total = items.agg(F.sum("words")).first()[0] or 0
    batches = max(1, -(-total // max_words))
    others = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    rows = documents.select((F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))).alias("row_"), F.col("text").cast("string").alias("text_"))
    kind = rows.schema["row_"].dataType.simpleString()
    fields = pa.schema([("ranges", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string()))])
    out = f"row_ {kind}, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, spans {_STATE}" + ", text_ string" * keep_text
    report = _reported(keep_text)

    def held(k: int):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(batches)) == k)
        return documents.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in own.toLocalIterator()])  # max_words words or so

    if batches == 1:  # one automaton scans and reports in the same worker
        scan = _scan(held(0), window, fields)
        rows = rows.mapInArrow(released(lambda found: report(scan(found))), out)
    else:
        rows = rows.withColumn("key_", text_key("text_"))
        hits = []
        for k in range(batches):
            shared = held(k)
            found = rows.select("key_", "text_").mapInArrow(released(_hits(shared, window, fields)), f"key_ struct<a:bigint,b:bigint>, ranges {_STATE}, items array<string>")
            hits.append(stored(found.groupBy("key_").agg(F.first("ranges").alias("ranges"), F.first("items").alias("items")), "hits"))  # equal texts have equal hits
            shared.unpersist()
        hits = reduce(DataFrame.union, hits).groupBy("key_").agg(F.collect_list("ranges").alias("ranges"), F.collect_list("items").alias("items"))  # an entry for each automaton
        hits = stored(hits, "hits")
        unite = _united(fields)
        met = rows.join(small(hits)(hits), "key_", "left").select("row_", "text_", "ranges", "items")
        rows = met.mapInArrow(released(lambda found: report(unite(found))), out)
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def decontaminate(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of documents that aren't contaminated, with documents' columns."""
    judged = contamination(documents, benchmark, keep_text=True, **how).where(~F.col("contaminated"))
    return judged.select(*[(F.col("text_") if c == "text" else F.col(f"row_.`{c}`")).alias(c) for c in documents.columns])
