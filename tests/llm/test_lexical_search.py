import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auklet.llm import lexical_search as ls

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    each = [(d, Counter(words(t))) for d, t in docs]
    n_docs, length = sum(bool(c) for _, c in each), sum(sum(c.values()) for _, c in each)
    df = Counter(t for _, c in each for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c in each:
            n = sum(c.values())
            m = 10 + (90 * n * n_docs) // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def corpus(seed, n, vocabulary=400):
    rng = random.Random(seed)
    some = [f"w{k}" for k in range(vocabulary)] + ["Été", "ÉTÉ", "言葉", "don't"]
    weights = [1 / (k + 1) for k in range(len(some))]
    docs = [(k * 7 % 10_007, " ".join(rng.choices(some, weights, k=rng.choice((0, 3, 20, 200))))) for k in range(n)]
    items = [(k, " ".join(rng.choices(some, k=rng.randrange(0, 12)))) for k in range(25)]
    return docs, items


def got(spark, docs, items, **how):
    return sorted((tuple(r) for r in ls.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **how).collect()), key=repr)


def test_equals_brute_force(spark):
    docs, items = corpus(1, 800)
    assert got(spark, docs, items) == brute(docs, items)


def test_small_blocks_and_batches_of_queries(spark):
    docs, items = corpus(2, 3000)
    assert got(spark, docs, items, k=3, batch_terms=20, block_postings=500) == brute(docs, items, 3)


def test_ties_repeats_nulls_and_empty_sides(spark):
    docs = [(5, "a b"), (3, "a b"), (3, "a b"), (9, "A B"), (None, "a b"), (1, None), (2, ""), (4, "?!"), *((100 + k, "a b") for k in range(20)), (7, "zebra")]
    items = [(1, "a"), (1, "B a a"), (2, ""), (3, None), (None, "zebra"), (4, "unheard")]
    df = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("x")).withColumn("item_id", F.lit(8)).withColumn("n", F.lit(1))
    found = ls.search(df, spark.createDataFrame(items, ITEMS).withColumn("rank", F.lit(0)).withColumn("term", F.lit("a")))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, items)
    for d, i in (([], items), (docs, []), ([], []), ([(1, None)], items)):
        assert got(spark, d, i) == []


def test_long_text(spark):
    docs = [(1, "word " * 300_000 + "rare"), (2, "rare find"), (3, "other")]
    assert got(spark, docs, [(1, "rare word")]) == brute(docs, [(1, "rare word")])


@pytest.mark.parametrize("looked_up", [0, 5, 1000])
def test_block_stops_early_and_completes(monkeypatch, looked_up):
    monkeypatch.setattr(ls, "LOOKED_UP", looked_up)
    monkeypatch.setattr(ls, "STEP", 1)
    rng = np.random.default_rng(3)
    docs, terms = 500, 40
    have = rng.random((docs, terms)) < 0.2
    impact = np.where(have, rng.integers(1, 50, (docs, terms)) * (1 + 40 * (rng.random(terms) < 0.2)), 0)
    d, t = np.nonzero(impact)
    block = ls.Block(d, t, impact[d, t], docs, terms)
    for _ in range(50):
        asked = np.sort(rng.choice(terms, rng.integers(0, 12), replace=False))
        whole = impact[:, asked].sum(axis=1)
        bar = np.sort(whole)[-10]
        for floor in (0, int(bar), 10**9):
            found, scores = block.best(asked, 10, floor)
            assert (whole[found] == scores).all()
            assert set(np.flatnonzero((whole >= max(bar, floor, 1)))) <= set(found)
