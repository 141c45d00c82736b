import hashlib
import random
import re

from pyspark.sql import functions as F

from auklet.llm.decontaminate import contamination, decontaminate

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, size=13):
    runs = [(str(i), w[k : k + size]) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - size + 1))]
    out = {}
    for d, t in docs:
        w, hit, met = words(t), set(), set()
        for i, run in runs:
            for k in range(len(w) - len(run) + 1):
                if w[k : k + len(run)] == run:
                    hit.update(range(k, k + len(run)))
                    met.add(i)
        out[d] = (len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_equals_brute_force_in_one_or_many_automata(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("aA bB c dé Fg h1 2 ü-x".split()) for _ in range(n))
    items = [(k, say(rng.choice((0, 1, 3, 12, 13, 14, 30)))) for k in range(40)]
    docs = [(k, say(rng.randrange(60)) + rng.choice(("", ", " + rng.choice(items)[1].upper() + ".")) + say(5)) for k in range(120)]
    docs += [(900, None), (901, ""), (902, "!!")]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame([*items, (99, None), (3, items[3][1])], ITEMS)
    for how in ({}, {"max_words": 60}):
        got = contamination(d, b, **how).collect()
        assert {r.row_.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute(docs, items)


def test_spans_are_offsets_in_the_original(spark):
    text = "Ünï — the  QUICK, brown\nfox; end"
    d = spark.createDataFrame([(1, text)], DOCS)
    r = contamination(d, spark.createDataFrame([(7, "the quick Brown fox")], ITEMS)).first()
    assert [text[s.start : s.stop] for s in r.spans] == ["the  QUICK, brown\nfox"] and r["items"] == ["7"]


def test_edges(spark):
    d = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "x y z"), (2, None), (3, "q " * 50_000 + "x y")], DOCS).withColumn("row_", F.lit("r")).withColumn("n_hit", F.lit(5))
    items = spark.createDataFrame([(None, "x y")], ITEMS)
    got = contamination(d, items)
    assert sorted((r.row_.doc_id or 0, r.n_hit, r.contaminated) for r in got.collect()) == [(0, 2, True), (1, 2, True), (1, 2, True), (2, 0, False), (3, 2, False)]
    kept = decontaminate(d, items)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert contamination(d.limit(0), items).count() == 0
    assert contamination(d, items.limit(0)).where("contaminated").count() == 0


def test_one_huge_item(spark):
    """An item of 30,000 words is cut into overlapping pieces for several automata; windows across a cut are found."""
    rng = random.Random(9)
    item = [f"i{rng.randrange(4000)}" for _ in range(30_000)]
    at = [rng.randrange(29_000) for _ in range(60)] + [10_000 * k - 6 for k in (1, 2)] + [500 * k - 6 for k in range(1, 20)]
    docs = [(k, " ".join(["fresh", *item[a : a + rng.choice((12, 13, 14, 40))], "words"])) for k, a in enumerate(at)]
    runs = {tuple(item[k : k + 13]) for k in range(len(item) - 12)}
    want = {d: any(tuple(w[k : k + 13]) in runs for k in range(len(w) - 12)) for d, t in docs for w in [t.split()]}
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "other item")], ITEMS)
    for how in ({}, {"max_words": 8000}, {"max_words": 500}):
        got = {r.row_.doc_id: r for r in contamination(spark.createDataFrame(docs, DOCS), bench, **how).collect()}
        assert {d: r.contaminated for d, r in got.items()} == want and all(r["items"] == ["1"] * want[d] for d, r in got.items())
