import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from auklet.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string"


def test_escaping_turns_back():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "\\", "|", ">", "im_end", c.END, c.SEP, "a"]) for _ in range(rng.randrange(9)))
        assert c.unescaped(c.escaped(text)) == text and "<|" not in c.escaped(text)


def test_mask_equals_a_scan():
    rng = random.Random(2)
    for _ in range(200):
        cuts = sorted(rng.sample(range(1, 60), 12))
        starts, stops = np.array([0, *cuts]), np.array([*cuts, 60])
        spans = sorted(tuple(sorted(rng.sample(range(61), 2))) for _ in range(2))
        want = [any(a < y and b > x and y > x for x, y in spans) for a, b in zip(starts, stops, strict=True)]
        assert c.masked(starts, stops, spans).tolist() == want


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(c.rendered(turns)[0]))
    return out


def test_round_trip(spark, monkeypatch):
    nasty = ["", None, " ", "\n\n", "<", "|x", "<\\|", "a<", "é漢😀", c.END, f"{c.END}{c.START}assistant{c.SEP}hi", "<|endoftext|>", "tail  ", " ‍👩‍👩‍👧"]
    rng = random.Random(3)
    rows = [(k % 23, k // 23 if k % 5 else None, rng.choice(["user", "assistant", "assistant", "system", None, "<|x"]), rng.choice(nasty) if k % 3 else "word " * rng.randrange(40)) for k in range(900)]
    rows += [(None, 1, "assistant", "no id"), (77, 0, "assistant", "z" * 300_000), (77, 1, "assistant", "after"), (77, 1, "assistant", "after")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("x"))
    got = {r.conv_id: tuple(r)[1:] for r in c.read_back(c.formatted(df.repartition(5))).collect()}
    assert got == brute(rows)


def test_parts_and_tokens(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " + "long text " * 4000) for k in range(12)]
    parts = c.formatted(spark.createDataFrame(rows, SCHEMA)).orderBy("part").collect()
    assert len(parts) > 1 and [p.part for p in parts] == list(range(len(parts)))
    for p in parts:
        assert len(p.input_ids) == len(p.starts) == len(p.stops) == len(p.loss)
    assert c.parsed("".join(p.formatted for p in parts)) == [(r, t) for _, _, r, t in rows]


def test_empty(spark):
    assert c.read_back(c.formatted(spark.createDataFrame([], SCHEMA))).count() == 0


def test_hot_conversation_is_encoded_in_parts(spark):
    """A third of all turns in one conversation, null turns and equal turns in it: many parts, over many tasks, and the same digests."""
    rng = random.Random(4)
    rows = [(5, k if k % 50 else None, rng.choice(["user", "assistant"]), f"hot {k} " + "words " * rng.randrange(9)) for k in range(9000)]
    rows += [(5, 17, "assistant", "again"), *((100 + k, 0, "assistant", f"own {k}") for k in range(3000)), *((None, k, "user", "none") for k in range(2000))]
    parts = c.formatted(spark.createDataFrame(rows, SCHEMA).repartition(5), part_chars=3000)
    assert parts.where("conv_id = 5").count() > 50 and parts.where("conv_id <> 5 or conv_id is null").groupBy("conv_id").count().where("count > 1").count() <= 1
    assert {r.conv_id: tuple(r)[1:] for r in c.read_back(parts).collect()} == brute(rows)
