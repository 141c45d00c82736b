import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from auklet.llm.fingerprint import SAMPLES, Sampler, edited, fingerprints, likeness

SCHEMA = "doc_id long, text string"


def terms(text, size=5):
    w = text.lower().split()
    return Counter(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def test_collisions_estimate_generalised_jaccard():
    rng, off = random.Random(1), []
    s = Sampler(size=1)
    for _ in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 300))]
        a = [w for w in words for _ in range(rng.choice((1, 1, 2, 5)))]
        b = [w for w in words if rng.random() < 0.7 for _ in range(rng.choice((1, 1, 3)))] + [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(50))]
        x, y = Counter(a), Counter(b)
        want = sum(min(x[k], y[k]) for k in x | y) / sum(max(x[k], y[k]) for k in x | y)
        off.append(likeness(s.sample(" ".join(a)), s.sample(" ".join(b))) - want)
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 1.3 * 0.5 / SAMPLES**0.5


def test_long_texts_with_repeats_are_unbiased():
    """A tenth of the terms shared and repeated, the rest private and single: draws that terms share would favour the repeated ones."""
    for n, seeds in ((20_000, 6), (60_000, 4), (200_000, 3)):
        for count in (2, 5):
            shared = [f"s{k}" for k in range(n // 10)] * count
            a, b = (" ".join(shared + [f"{own}{k}" for k in range(n - n // 10)]) for own in "ab")
            want = len(shared) / (len(shared) + 2 * (n - n // 10))
            got = [likeness(s.sample(a), s.sample(b)) for s in (Sampler(size=1, seed=k) for k in range(seeds))]
            assert abs(np.mean(got) - want) < 3.5 * (want * (1 - want) / SAMPLES / seeds) ** 0.5, (n, count, want, got)


def test_rows_follow_each_other(spark):
    rng = random.Random(2)
    docs = [(k * 7 % 1013, "é" * rng.randrange(3) + " ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randrange(40)))) for k in range(900)]
    docs += [(5000, None), (5001, ""), (5002, "ab"), (400_000, "z " * 60_000)]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("group", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = {r.doc_id: r for r in fingerprints(df.repartition(6), rows_a_group=20).collect()}
    order, s = sorted(docs, key=lambda d: -d[0]), Sampler()
    assert len(got) == len(docs)
    for (d, t), (_, u) in zip(order, [*order[1:], order[0]], strict=True):
        t, u, r = t or "", u or "", got[d]
        own = t[: len(t) - len(t) // 3] + u[: len(t) // 3] if len(t) >= 3 else t
        assert own == edited(t, u) and r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert r.fingerprint == s.sample(t).tobytes().hex() and r.edited_fingerprint == s.sample(own).tobytes().hex()
        assert r.near_edited == likeness(s.sample(t), s.sample(own)) and r.near_next == likeness(s.sample(t), s.sample(u))
        assert (own == t) <= (r.near_edited == 1.0)


def test_lone_repeated_null_and_empty(spark):
    one = fingerprints(spark.createDataFrame([(1, "a b c d e f")], SCHEMA)).first()
    assert one.n_chars == 11 and one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c d a b").hexdigest()
    rows = [(1, "x y z"), (1, "x y z"), (1, "other words"), (None, "none"), (None, None), (2, "x y z")]
    got = fingerprints(spark.createDataFrame(rows, SCHEMA), rows_a_group=1).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((d, len(t or "")) for d, t in rows)
    assert len({r.fingerprint for r in got if r.n_chars == 5}) == 1
    assert fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_doc_ids_are_cut_by_text(spark):
    """A doc_id and the null id with a third of all rows each: every row is followed by the next one of some order by doc_id."""
    rows = [(7, f"seven {k} a b c d") for k in range(400)] + [(None, f"none {k} a b c d") for k in range(400)] + [(k, f"own {k} text") for k in range(8, 400)] + [(-5, "last")]
    out = fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(5), rows_a_group=10)
    got = out.collect()
    s = Sampler()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((d, s.sample(t).tobytes().hex()) for d, t in rows)
    shas = {(d, hashlib.sha256(edited(t, u).encode()).hexdigest()) for d, t in rows for u in (t2 for d2, t2 in rows if d2 == d or d == 8 and d2 == 7 or d == 7 and d2 == -5 or d == -5 and d2 is None or d is None and d2 == 399 or d2 is not None and d is not None and d2 == d - 1)}
    assert all((r.doc_id, r.edited_sha256) in shas for r in got) and len({r.edited_sha256 for r in got}) > 1100
