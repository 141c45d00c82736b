import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auklet.llm import quality as q
from auklet.llm import toxicity as t
from auklet.llm.sample import fold, labelled_sample

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"
RUDE = ["zorkan", "zorkish", "zorkel", "blarg"]


def corpus(n=1200, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        toxic, good = rng.random() < 0.3, rng.random() < 0.6
        lines = [[rng.choice(plain) for _ in range(rng.randrange(3, 15))] for _ in range(rng.randrange(1, 6))]
        if not good:
            lines = [[w + "%%%" for w in line] for line in lines]
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                line = rng.choice(lines)
                line.insert(rng.randrange(len(line) + 1), rng.choice(RUDE))
        docs.append((k, "\n".join(" ".join(line) for line in lines)))
        labels.append((k, int(good), int(toxic)))
    return docs, labels


def accuracy(rows, labels, column):
    y = {d: (g, x)[column] for d, g, x in labels}
    held = [(r.predicted, y[r.doc_id]) for r in rows if r.held_out]
    return sum(a == b for a, b in held) / len(held), len(held)


def test_held_out_accuracy_and_folds(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    rows = t.toxicity(d, lab).collect()
    share, n = accuracy(rows, labels, 1)
    assert share > 0.95 and 200 < n < 400 and len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    text = dict(docs)
    marked = [text[r.doc_id][s.start : s.stop] for r in rows for s in r.spans]
    assert len(marked) > 300 and sum(w in RUDE for w in marked) > 0.95 * len(marked)
    rows = q.quality(d, lab).collect()
    share, n = accuracy(rows, labels, 0)
    assert share > 0.95 and 150 < n < 350 and all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in q.quality(d, lab).orderBy("doc_id").collect()] == pytest.approx([r.score for r in sorted(rows, key=lambda r: r.doc_id)])


def test_held_out_labels_are_never_seen(spark):
    docs, labels = corpus(300)
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    other = lab.withColumn("toxic", F.when(fold(F.col("doc_id"), 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (labelled_sample(d, x, "toxic", 4, 2, 500).orderBy("doc_id").collect() for x in (lab, other))
    assert a == b and len(a) < 300


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    lengths = np.array([3, 1, 5, 2])
    e, trans, start = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2)), 0.3
    got, pairs = t.Chains(lengths).marginals(e, trans, start)
    want, counts, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        weight = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            s = start * y[0] + sum(e[at + k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1))
            weight[y] = np.exp(s)
        z = sum(weight.values())
        want += [sum(v for y, v in weight.items() if y[k]) / z for k in range(n)]
        for y, v in weight.items():
            for k in range(n - 1):
                counts[y[k], y[k + 1]] += v / z
        at += n
    assert got == pytest.approx(want) and pairs == pytest.approx(counts)


@pytest.mark.parametrize("op", [t.toxicity, q.quality])
def test_edges(spark, op):
    docs, labels = corpus(200)
    extra = [(9001, None), (9002, ""), (9003, " \n "), (9004, "zorkan " * 30_000), (9004, "zorkan " * 30_000), (None, "la la")]
    d = spark.createDataFrame(docs + extra, DOCS).withColumn("score", F.lit("x")).withColumn("y", F.lit(2))
    lab = spark.createDataFrame(labels + [(5, None, None), (None, 1, 1), (7, 1, 1)], LABELS).withColumn("text", F.lit("clash"))
    got = op(d, lab).collect()
    assert len(got) == 206 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    blank = {r.score for r in got if r.doc_id in (9001, 9002, 9003)}
    assert len(blank) == 1
    assert op(d.limit(0), lab).count() == 0
    assert len({r.score for r in op(d, lab.limit(0)).collect()}) == 1


def test_clean_rows_keep_columns(spark):
    docs, labels = corpus(400)
    d = spark.createDataFrame(docs, DOCS).withColumn("row_", F.lit("mine"))
    kept = t.clean_rows(d, spark.createDataFrame(labels, LABELS))
    assert kept.columns == d.columns
    ids, toxic = {r.doc_id for r in kept.collect()}, {d for d, _, x in labels if x}
    assert len(ids & toxic) < 0.1 * len(toxic) and len(ids - toxic) > 0.9 * (400 - len(toxic))


def test_texts_of_one_long_line():
    rng = random.Random(6)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    ys = [int(rng.random() < 0.3) for _ in range(400)]
    texts = [[rng.choice(plain) for _ in range(rng.randrange(301, 700))] for _ in ys]
    for text, y in zip(texts, ys, strict=True):
        for _ in range(3 * y):
            text.insert(rng.randrange(len(text) + 1), rng.choice(RUDE))
    texts = [" ".join(text) for text in texts]
    scores, _ = t.Tagger(t.fit(texts[:300], ys[:300])).score(texts[300:])
    assert np.mean((scores >= 0.3) == np.array(ys[300:])) > 0.95
    line, start, size = t.pieces(np.array([0, 301, 303]), np.array([301, 2, 5]), 300)
    assert line.tolist() == [0, 0, 1, 2] and start.tolist() == [0, 151, 301, 303] and size.tolist() == [151, 150, 2, 5]
    assert t.pieces(np.array([0]), np.array([5]), 2)[2].tolist() == [2, 2, 1]


def test_gradient_equals_differences():
    """The fit's gradient against the likelihood's differences, over every weight that the lines have."""
    rng = np.random.default_rng(2)
    sample = t.Sample(["ab cde ab fghij\nab", "cde cde xyzzyx ab\n\nfghij ab"])
    tags = rng.random(len(sample.ids)) < 0.4
    part = t._Part(sample, sample.start, sample.lengths, tags)
    w, trans, start = rng.normal(size=1 << t.BITS) * 0.3, rng.normal(size=(2, 2)) * 0.3, 0.2

    def loss(v):
        e, total, at = part.emission(v), 0.0, 0
        for n in sample.lengths:
            score = lambda y: start * y[0] + sum(e[at + k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1))  # noqa: B023, E731
            total += np.log(sum(np.exp(score(y)) for y in itertools.product((0, 1), repeat=int(n)))) - score(tags[at : at + n].astype(int))
            at += n
        return total

    p, _ = part.chains.marginals(part.emission(w), trans, start)
    got = part.gradient(p - part.y)
    some = sorted({t.BIAS, *sample.index, *sample.after, *sample.before})
    for k in some:
        step = np.zeros_like(w)
        step[k] = 1e-5
        assert got[k] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-5, abs=1e-5)
    assert not got[np.setdiff1d(np.arange(1 << t.BITS), some)].any()
    tagger = t.Tagger(t.packed(w, trans, start, np.zeros(4)))
    lines = [line for text in ("ab cde ab fghij\nab", "cde cde xyzzyx ab\n\nfghij ab") for line in t.lines_of(text)]
    assert tagger.marginals(lines) == pytest.approx(p, abs=1e-5)  # scoring uses 32-bit weights


def test_seeds_of_a_few_documents():
    sample = t.Sample([f"the zork{k} is {w}" for k in range(6) for w in ("bad", "worse")] + [f"the good{k} is {w}" for k in range(40) for w in ("bad", "worse")])
    ys = np.array([1] * 12 + [0] * 80)
    marked = t.seeds(sample, ys, np.ones(92, bool))
    names = list(dict.fromkeys(w for d in ([f"the zork{k} is {w}" for k in range(6) for w in ("bad", "worse")] + [f"the good{k} is {w}" for k in range(40) for w in ("bad", "worse")]) for w in d.split()))
    assert {w for w, m in zip(names, marked, strict=True) if m} == {f"zork{k}" for k in range(6)}
    assert not t.seeds(sample, ys, ys == 0).any()


def test_without_usable_labels_nothing_is_marked(spark):
    docs = spark.createDataFrame([(1, "hello big world"), (2, None), (3, ""), (4, "?!")], DOCS)
    for labels in ([], [(1, 0, 1)], [(1, 0, 0)], [(1, None, None)], [(1, 0, 1), (4, 0, 0)]):
        rows = t.toxicity(docs, spark.createDataFrame(labels, LABELS)).orderBy("doc_id").collect()
        assert [r.spans for r in rows] == [[], [], [], []] and len({r.score for r in rows[1:]}) == 1
    known = spark.createDataFrame([(1, 0, 1), (4, 0, 0)], LABELS)
    for op, label in ((t.toxicity, "toxic"), (q.quality, "quality")):
        assert len({r.score for r in op(docs, known, max_chars=10).collect()}) == 1
    d, lab = spark.createDataFrame([(k, "x" * k) for k in range(60)], DOCS), spark.createDataFrame([(k, 1, k % 2) for k in range(60)], LABELS)
    assert {len(r.text) for r in labelled_sample(d, lab, "toxic", 4, 2, 500, 20).collect()} <= set(range(21))


def test_ftrl_against_plain_python():
    """The same passes over a handful of features, one coordinate at a time, from the update rule; and one score by hand."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abc", k=rng.randrange(1, 4))) for _ in range(30)]
    ys = [int("a" in x) for x in texts]
    w = q.fit(texts, ys, passes=2, seed=5)

    hashes, order = q.WordHashes(), np.random.default_rng(5)
    rows = [q.features(x, hashes) for x in texts]
    z, n = {}, {}
    a, b, l1, l2 = 1.0, 1.0, 0.02, 0.02

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((b + n.get(i, 0.0) ** 0.5) / a + l2)

    for _ in range(2):
        for k in order.permutation(30):
            x = [*zip(rows[k][0].tolist(), rows[k][1].tolist(), strict=True), (1 << q.BITS, 1.0)]
            ws = [weight(i) for i, _ in x]
            p = 1 / (1 + np.exp(-sum(v * u for (_, v), u in zip(x, ws, strict=True))))
            for (i, v), u in zip(x, ws, strict=True):
                g = (p - ys[k]) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / a
                z[i] = z.get(i, 0.0) + g - sigma * u
                n[i] = n.get(i, 0.0) + g * g
    assert {i for i in range(len(w)) if w[i]} == {i for i in z if weight(i)}
    assert [w[i] for i in z] == pytest.approx([weight(i) for i in z], rel=1e-5, abs=1e-7)


def test_quality_score_by_hand(spark):
    """Null, empty and wordless texts have the intercept's score, others their dot product's."""
    w = np.zeros((1 << q.BITS) + 1, np.float32)
    at, value = q.features("good word", q.WordHashes())
    w[at], w[-1] = 0.5, -1.0
    rows = q.scored(spark.createDataFrame([(1, None), (2, ""), (3, " \t"), (4, "good word"), (5, "GOOD  word")], DOCS), w.tobytes()).orderBy("doc_id").collect()
    plain, own = 1 / (1 + np.exp(1.0)), 1 / (1 + np.exp(1.0 - 0.5 * value.sum()))
    assert [r.score for r in rows] == pytest.approx([plain, plain, plain, own, own]) and value.sum() == pytest.approx(3**0.5)
