import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from auklet.llm import divergence as d

SCHEMA = "text string, lang string, source string"


def brute(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    low = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        have = Counter(t for r, w in zip(rows, words, strict=True) if r[1] == lang for t in set(w))
        kept = sorted(t for t, n in have.items() if n >= least)
        counts = defaultdict(Counter)
        for r, w in zip(rows, words, strict=True):
            if r[1] == lang:
                counts[r[2]].update(t for t in w if have[t] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s]
            mine = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", mine)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))):
                    if part == "pair" or k < top:
                        out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


def corpus(seed, n, sources):
    rng = random.Random(seed)
    some = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["Été", "été", "言葉", "A1b", "don't", "x_y"]
    return [(" ".join(rng.choices(some[: rng.choice((20, 100, 306))], k=rng.randrange(0, 60))), rng.choice(("en", "fr", None)), rng.choice((None, *(f"s{k}" for k in range(sources))))) for _ in range(n)]


def got(df, **how):
    return sorted(tuple(r) for r in d.divergence(df, **how).collect())


def test_equals_brute_force(spark):
    rows = corpus(1, 300, 6)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("value", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("p", F.lit(None).cast("int"))
    assert got(df, least_docs=5, top=7) == brute(rows, 5, 7)


def test_many_blocks_and_buckets_and_small_pieces(spark, monkeypatch):
    rows = corpus(2, 400, 30)
    whole = brute(rows, 2, 50)
    counts = d._counted
    monkeypatch.setattr(d, "BLOCK", 4)
    monkeypatch.setattr(d, "TERMS", 16)
    assert got(spark.createDataFrame(rows, SCHEMA), least_docs=2) == whole
    monkeypatch.setattr(d, "HELD", 10)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"text": r[0], "lang": r[1] or "", "source": r[2] or ""} for r in rows])
    parts = [r for b in counts(iter([batch])) for r in b.to_pylist()]
    assert sum(r["n"] for r in parts) == sum(len(d.terms_of(r[0])) for r in rows) and len({r["source"] for r in parts if r["term"] is None}) == 31


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [("", "en", "a"), (None, "en", "b"), ("x y", "en", "b"), ("x y", "en", "b")], [("Word " * 50_000, "en", "a"), ("word", "en", "b")]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for least in (1, 2, 30):
        assert got(df, least_docs=least) == brute(rows, least, 50)


def test_counts_beyond_64_bits_in_the_product(spark):
    share = spark.range(1).select(F.lit(9_000_000_000_000).alias("n"), F.lit("90000000000000").cast("decimal(20,0)").alias("total"), F.lit(1000).cast("long").alias("v"))
    assert share.select(d._share("n", "total", F.col("v")).alias("p")).first().p == 1 + 10**9 * (9_000_000_000_000 + 5) // (90_000_000_000_000 + 5000)
