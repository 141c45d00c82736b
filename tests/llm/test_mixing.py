import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auklet.llm.mixing import fill, mixed_rows, mixture, numbered, reachable, source_targets, targets

SCHEMA = "doc_id long, text string, source string"


def test_targets_share_the_excess():
    got = targets([("b", 100), ("a", 10), (None, 1000), ("c", 0)], (5, 2, 1), 1.5, 2.0)
    assert list(got) and got["a"] == 20 and got["c"] == 0 and got["b"] == 200 and got[None] == pytest.approx(1.5 * 1110 - 220)
    assert targets([], (1,), 1.5, 2.0) == {} and targets([("a", 0)], (1,), 1.5, 2.0) == {"a": 0}


def test_knapsack_equals_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        lengths = rng.sample(range(1, 30), 4)
        counts = [rng.randrange(4) for _ in lengths]
        budget = rng.randrange(1, 120)
        best = max(s for take in itertools.product(*(range(c + 1) for c in counts)) if (s := sum(a * b for a, b in zip(take, lengths, strict=True))) <= budget)
        take = reachable(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and sum(a * b for a, b in zip(take, lengths, strict=True)) == best


def test_fill_hits_large_budgets():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(0, 3000, 900))
    counts = rng.integers(1, 4000, len(lengths))
    total = int((lengths * counts).sum())
    for part in (0, 0.0001, 0.3, 0.77, 0.9999, 1):
        take = fill(lengths, counts, int(total * part))
        assert (take >= 0).all() and (take <= counts).all() and abs(int((take * lengths).sum()) - int(total * part)) <= 1


def docs():
    rng = random.Random(4)
    rows = [(k, " ".join("w" * rng.randrange(1, 3) for _ in range(rng.randrange(60))), rng.choice(["a", "a", "a", "b", "c", "", None])) for k in range(1500)]
    return rows + [(5000 + k, "same text here", "a") for k in range(500)] + [(9999, None, "b"), (None, "x y", "c"), (1, "x", "zero")]


def test_sources_come_near_their_targets(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    got = mixture(df.repartition(7)).collect()
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r["size"] == len((r.text or "").split()) and r.taken in (0, r["size"], 2 * r["size"])
    assert len(got) == df.count() and all(r.source_size == size[r.source] for r in got)
    assert target == pytest.approx(targets(list(size.items()), (5, 2, 1), 1.5, 2.0))
    assert all(abs(taken[s] - target[s]) <= 1 for s in target if s != "zero")
    key = lambda r: (repr(r.doc_id), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixture(df.repartition(3)).collect()))


def test_rows_repeat_and_keep_their_columns(spark):
    df = spark.createDataFrame(docs(), SCHEMA).withColumn("size", F.lit("mine")).withColumn("copies", F.lit(None).cast("int"))
    out = mixed_rows(df)
    assert out.columns == df.columns and out.first()["size"] == "mine"
    want = sum(r.copies for r in mixture(df.select("doc_id", "text", "source")).collect())
    assert out.count() == want
    assert mixture(df.limit(0).select("doc_id", "text", "source")).count() == 0 and mixed_rows(df.limit(0)).count() == 0


def test_reruns_agree_for_one_doc_id_and_for_none(spark):
    """900 rows of one doc_id and 900 without one, with different texts of few lengths: the same texts are taken however rows are dealt."""
    rng = random.Random(6)
    rows = [(d, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 5))), "ab"[k % 2], k) for k in range(900) for d in (7, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", extra int")
    runs = [sorted(map(repr, mixed_rows(x).collect())) for x in (df, df.repartition(7), df.orderBy(F.desc("extra")).repartition(3, "text"))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 900


def test_targets_of_many_sources_equal_those_at_one_place(spark):
    rng = random.Random(9)
    for n in (1, 2, 7, 400):
        sizes = [(f"s{rng.randrange(10**6)}" if k else None, rng.choice((0, 1, 5, 100, 10_000))) for k in range(n)]
        sizes = list(dict(sizes).items())
        rows = spark.createDataFrame([(s, "" if s is None else f"={s}", w) for s, w in sizes], "source string, source_ string, words long").repartition(5)
        for weights, share, most in (((5, 2, 1), 1.5, 2.0), ((1,), 2.0, 2.0), ((3, 1), 0.2, 1.0)):
            got = {r.source_: r.target for r in source_targets(rows, weights, share, most).collect()}
            want = targets(sizes, weights, share, most)
            assert got == pytest.approx({"" if s is None else f"={s}": float(t) for s, t in want.items()})
    assert source_targets(rows.limit(0), (1,), 1.5, 2.0).count() == 0


def test_numbers_follow_code_points_with_null_last(spark):
    names = ["b", "a", "É", "Z", "", None, "ab", "日"]
    got = numbered(spark.createDataFrame([(x,) for x in names], "source string").repartition(6), "source").collect()
    assert [r.source for r in sorted(got, key=lambda r: r.number)] == [*sorted(x for x in names if x is not None), None]
