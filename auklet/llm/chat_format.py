"""Conversations as token sequences with a loss mask that is aligned by offsets.

A conversation is rendered whole, encoded once with offsets, and the spans of the assistant's texts are met with the
sorted token spans by binary search. Every boundary of the template is a special token, at which the tokenizer always
cuts, so no token straddles a boundary. Long conversations come as parts, cut between turns where the encoding is cut
anyway: sums of characters by turn, added up in two steps, say in which part a turn stands before any text moves, so the
parts of one conversation are rendered and encoded in many tasks, each of which holds one part at a time.

The template is <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>. In roles and texts, "<", any number of backslashes and "|" gets
one more backslash, so no control string survives inside them; unescaping takes it away again.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auklet.llm.common import stored

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters of texts in a part, up to the end of its last turn.
PART_CHARS = 200_000
#: Turns whose characters are added up together.
CELL = 4096
PARTS = "conv_id long, part int, formatted string, input_ids array<int>, starts array<int>, stops array<int>, loss array<boolean>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text, and the spans of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escaped(role)}{SEP}", escaped(text)
        at += len(head)
        if role == "assistant":
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        out += (head, body, END)
    return "".join(out), spans


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The turns that a rendered text holds."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        role, _, text = piece.removeprefix(START).partition(SEP)
        turns.append((unescaped(role), unescaped(text)))
    return turns


def masked(starts: np.ndarray, stops: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens overlap a span: tokens are sorted, so each span is two binary searches."""
    loss = np.zeros(len(starts), bool)
    if spans:
        lo, hi = np.array(spans).T
        for a, b, full in zip(np.searchsorted(stops, lo, "right"), np.searchsorted(starts, hi, "left"), hi > lo, strict=True):
            if full:
                loss[a:b] = True
    return loss


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    tok = Tokenizer.from_file(path)
    tok.add_special_tokens([AddedToken(s, special=True, normalized=False) for s in (START, SEP, END)])
    return tok


def _formatted(path: str):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list[tuple[str, str]]]]:
        now, turns = None, []
        for batch in batches:
            for conv, part, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "part", "role", "text")), strict=True):
                if turns and (conv, part) != now:
                    yield *now, turns
                    turns = []
                now = conv, part
                turns.append((role, text))
        if turns:
            yield *now, turns

    def packed(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "part", "formatted", "input_ids", "starts", "stops", "loss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, rows, size = None, [], 0
        for conv, part, turns in parts(batches):
            tok = tok or _tokenizer(path)
            text, spans = rendered(turns)
            got = tok.encode(text, add_special_tokens=False)
            offsets = np.array(got.offsets, np.int32).reshape(-1, 2)
            starts, stops = np.ascontiguousarray(offsets[:, 0]), np.ascontiguousarray(offsets[:, 1])
            rows.append((conv, part, text, np.array(got.ids, np.int32), starts, stops, masked(starts, stops, spans)))
            size += len(text)
            if size >= 1_000_000:
                yield packed(rows)
                rows, size = [], 0
        if rows:
            yield packed(rows)

    return run


def _parts(rows: DataFrame, chars: int) -> DataFrame:
    """rows with the part that each turn stands in; only turns of conversations longer than `chars` are added up."""
    size = F.length("text") + F.length("role")
    same = lambda *pairs: reduce(and_, (F.col(x).eqNullSafe(F.col(y)) for x, y in pairs))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    long = rows.groupBy(F.col("conv_id").alias("conv_")).agg(F.sum(size).alias("total")).where(F.col("total") > chars).select("conv_")
    own = rows.join(long, same(("conv_id", "conv_")), "left_semi").groupBy(F.col("conv_id").alias("conv_"), F.col("turn").alias("turn_")).agg(F.sum(size).alias("size"))
    own = stored(own.withColumn("cell_", F.floor(F.col("turn_") / CELL)), "turns")
    cells = own.groupBy("conv_", "cell_").agg(F.sum("size").alias("size"))
    base = F.coalesce(F.sum("size").over(before("conv_").orderBy("cell_")), F.lit(0))
    cells = cells.select(F.col("conv_").alias("c_"), F.col("cell_").alias("e_"), base.alias("base"))
    inside = F.coalesce(F.sum("size").over(before("conv_", "cell_").orderBy("turn_")), F.lit(0))
    own = own.withColumn("inside", inside).join(cells, same(("conv_", "c_"), ("cell_", "e_")))
    own = own.select("conv_", "turn_", F.floor((F.col("base") + F.col("inside")) / chars).cast("int").alias("part"))
    return rows.join(own, same(("conv_id", "conv_"), ("turn", "turn_")), "left").select(*rows.columns, F.coalesce("part", F.lit(0)).alias("part"))


def formatted(conversations: DataFrame, tokenizer: str = TOKENIZER, part_chars: int = PART_CHARS) -> DataFrame:
    """PARTS of every conversation (rows conv_id, turn, role, text; more columns are ignored); a part is one row.

    loss marks the tokens of the assistant's texts. A null text or role is empty; rows of one turn are ordered by role and
    text, and stand in one part; null turns come first; rows with a null conv_id are one conversation. An empty table gives an
    empty result. The tokenizer's file must be at its path on every worker; without it the job fails at the first task.
    """
    blank = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("role", "text")])
    rows = _parts(rows, part_chars).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    return rows.mapInArrow(_formatted(tokenizer), PARTS)


def _unmasked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's text, and the character spans under its mask: a run of tokens there is one text, as special tokens stand between runs."""
    for batch in batches:
        spans = []
        for k in range(batch.num_rows):
            under = batch["loss"][k].values.to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], under, [False]]).astype(np.int8)))
            starts, stops = (batch[c][k].values.to_numpy(zero_copy_only=False) for c in ("starts", "stops"))
            spans.append([int(x) for a, b in edges.reshape(-1, 2) for x in (starts[a], stops[b - 1])])
        yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["part"], batch["formatted"], pa.array(spans, pa.list_(pa.int32()))], names=["conv_id", "part", "formatted", "spans"])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, begun, turns, n, loss, loss_chars, chars = None, False, hashlib.sha256(), 0, hashlib.sha256(), 0, 0
    for batch in batches:
        done = []
        for conv, text, spans in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "spans")), strict=True):
            if begun and conv != now:
                done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                turns, n, loss, loss_chars, chars = hashlib.sha256(), 0, hashlib.sha256(), 0, 0
            now, begun = conv, True
            for role, said in parsed(text):
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            chars += len(text)
            for a, b in zip(spans[::2], spans[1::2], strict=True):
                said = unescaped(text[a:b])
                loss.update(said.encode())
                loss_chars += len(said)
        yield _digests(done)
    if begun:
        yield _digests([(now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)])


def _digests(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(parts: DataFrame) -> DataFrame:
    """What the parts of each conversation hold: turns from the formatted text, the loss text from tokens and mask.

    A digest over all of a conversation can only be taken in order, so the texts of a conversation stream through one task,
    without tokens and a part at a time.
    """
    texts = parts.mapInArrow(_unmasked, "conv_id long, part int, formatted string, spans array<int>")
    return texts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_read_back, READ)
