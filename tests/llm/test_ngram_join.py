import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auklet.llm import ngram_join as nj
from tests.llm.test_near_dedup import SCHEMA, brute, corpus


def got(spark, rows, **how):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_join(spark.createDataFrame(rows, SCHEMA).repartition(5), **how).collect()}


def expected(rows, size, percent):
    return {d: x[:2] for d, x in brute(rows, size, percent).items()}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (2, 80), (1, 95)])
def test_equals_brute_force(spark, size, percent):
    rows = corpus(4, 80, 9)
    assert got(spark, rows, size=size, percent=percent) == expected(rows, size, percent)


def test_linked_sets_agree_in_a_fragment_and_their_bitmaps_allow_it():
    """Over many sizes, with as many differences as a link may have: nothing that is linked is lost."""
    rng = np.random.default_rng(2)
    for percent in (70, 90):
        for n in (*range(1, 60), 100, 500, 3000, 20_000):
            for _ in range(4):
                a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
                lost = rng.integers(0, 1 + n * (100 - percent) // 100)
                kept = rng.permutation(a)[lost:]
                room = 100 * len(kept) // percent - n  # so many others leave the pair linked
                b = np.unique(np.concatenate([kept, rng.integers(0, 1 << 64, max(0, room), dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
                    continue
                if len(a) != len(b) or both != len(a):
                    assert len(np.intersect1d(nj.fragment_keys(a, percent), nj.fragment_keys(b, percent)))
                x, y = nj.folded([nj.bitmap(a, percent).tobytes(), nj.bitmap(b, percent).tobytes()])
                assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * both <= nj.differ(len(a) + len(b), percent)


def test_bands_hold_linked_sizes():
    for percent in (70, 80, 90):
        least = nj.bands(percent)
        for n in range(1, 3000):
            band, far = (int(np.searchsorted(least, m, "right")) for m in (n, 100 * n // percent))
            assert far <= band + 1


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one\x0btwo"), (8, "one\u00a0two"), (None, "one two"), (9, "É é"), (10, "é é")]
    out = nj.ngram_join(spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit(7)).withColumn("id", F.lit("x")).withColumn("key_", F.lit(1)), size=2, percent=90)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert found == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (1, 8), None: (1, None), 9: (1, 9), 10: (1, 10)}
    assert nj.ngram_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_in_many_fragments_and_repeated_ids(spark):
    long = [f"v{k}" for k in range(30_000)]
    near, far = list(long), list(long)
    for k in range(0, 30_000, 70):
        near[k] = f"n{k}"  # 3 shingles of 70 differ on either side: 0.917 in common
    for k in range(0, 30_000, 50):
        far[k] = f"f{k}"  # 0.887
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far)), (4, "short"), (4, "short"), (4, " ".join(long))]
    out = nj.ngram_join(spark.createDataFrame(rows, SCHEMA), size=3, percent=90).orderBy("doc_id", "component_id").collect()
    assert [(r.doc_id, r.component_id) for r in out] == [(1, 1), (2, 1), (3, 3), (4, 1), (4, 4), (4, 4)]


def test_large_groups_in_blocks(spark, monkeypatch):
    """Near copies of one text that are linked through it or through chains, beside outsiders and texts of one template that are all apart."""
    monkeypatch.setattr(nj, "BLOCK", 64)
    rng = random.Random(8)
    base = [f"a{k}" for k in range(120)]
    rows = []
    for k in range(500):
        edited = list(base)
        for at in rng.sample(range(120), rng.choice((1, 2, 3))):
            edited[at] = f"n{k}x{at}"
        rows.append((k + 10, " ".join(edited)))
    rows += [(2000 + k, " ".join(base[: 110 - k] + [f"z{j}" for j in range(10 + k)])) for k in range(30)]
    rows += [(3000 + k, " ".join([f"t{j}" for j in range(90)] + [f"y{k}x{j}" for j in range(9)])) for k in range(300)]
    rows += [(5, " ".join(base))]
    assert got(spark, rows, size=1, percent=90) == expected(rows, 1, 90)
    assert got(spark, rows, size=3, percent=90) == expected(rows, 3, 90)


def test_equals_brute_force_on_documents(spark):
    from auklet.llm.common import table
    from tests.oracle import DATA

    docs = table(spark, str(DATA / "sf0.01"), "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_join(docs, size=3, percent=90).collect()}
    assert found == expected(rows, 3, 90) and sum(d != x[1] for d, x in found.items()) > 50
