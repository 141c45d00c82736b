import random

from pyspark.sql import functions as F

from auklet.llm.near_dedup import near_duplicates, one_of_each_group

SCHEMA = "doc_id long, text string"


def brute(rows, size, percent):
    def members(text):
        words = (text or "").encode().lower().split()
        if not words:
            return frozenset()
        k = min(size, len(words))
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))

    sets = {d: members(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def corpus(seed, families, members):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.randrange(1, 160))]
        for _ in range(rng.randrange(1, members)):
            edited = list(base)
            for _ in range(rng.choice((0, 1, 2, 4, 8, 12))):
                edited[rng.randrange(len(edited))] = word()
            rows.append((len(rows) * 3 % 1009, " ".join(edited)))
    return rows


def got(spark, rows, **how):
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), **how)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()}


def test_equals_brute_force(spark):
    rows = corpus(1, 60, 8)
    assert got(spark, rows, shingle=2) == brute(rows, 2, 80)
    assert got(spark, rows, shingle=5) == brute(rows, 5, 80)


def test_large_group_beside_a_member_linked_by_a_chain(spark):
    rng = random.Random(5)
    base = [f"a{k}" for k in range(100)]
    rows = []
    for k in range(400):
        edited = list(base)
        edited[rng.randrange(100)] = f"n{k}"
        rows.append((k, " ".join(edited)))
    rows += [(1000, " ".join(base[:88] + [f"z{k}" for k in range(9)])), (1001, " ".join(base[:78] + [f"z{k}" for k in range(20)])), (1002, " ".join(f"q{k}" for k in range(50)))]
    assert got(spark, rows, shingle=2) == brute(rows, 2, 80)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one\x0btwo"), (8, "one two"), (None, "one two"), (9, "É é"), (10, "é é")]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit(7)).withColumn("kept", F.lit("x")), shingle=2)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()}
    assert found == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (1, 6, True), 7: (1, 6, False), 8: (1, 8, True), None: (1, None, True), 9: (1, 9, True), 10: (1, 10, True)}
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_and_repeated_rows(spark):
    long = " ".join(f"v{k}" for k in range(40_000))
    rows = [(1, long), (2, long + " more"), (2, long + " more"), (3, "short")]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=5).orderBy("doc_id").collect()
    assert [(r.doc_id, r.component_id) for r in out] == [(1, 1), (2, 1), (2, 1), (3, 3)]


def test_one_doc_id_with_different_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(3, a), (5, a + " more"), (5, b), (5, b + " more"), (None, a)] + [(7, f"own{k} words{k} here{k}") for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(df, shingle=2).collect())
    assert found[:5] == [(0, 59, 0, True), (3, 59, 3, True), (5, 59, 5, True), (5, 60, 3, False), (5, 60, 5, True)] and set(found[5:]) == {(7, 2, 7, True)}
    left = [(r.doc_id, r.text) for r in one_of_each_group(df, shingle=2).collect()]
    assert len([x for x in left if x[0] == 5]) == 1 and {x for x in left if x[0] != 5} == {(3, a), (None, a), *rows[5:]} and len(left) == 303


def test_region_larger_than_blocks_in_several_components(spark):
    """2,300 near copies of one text beside chains and outsiders that share their regions, and 700 texts of one template that are all apart."""
    rng = random.Random(8)
    base = [f"a{k}" for k in range(80)]
    rows = []
    for k in range(2300):
        edited = list(base)
        edited[rng.randrange(80)] = f"n{k}"
        rows.append((k, " ".join(edited)))
    rows += [(5000 + k, " ".join(base[: 72 - k // 4] + [f"z{j}" for j in range(8 + k // 4)])) for k in range(40)]
    rows += [(6000 + k, " ".join(base[:56] + [f"o{k}x{j}" for j in range(24)])) for k in range(100)]
    rows += [(7000 + k, " ".join([f"t{j}" for j in range(60)] + [f"y{k}x{j}" for j in range(14)])) for k in range(700)]
    assert got(spark, rows, shingle=2) == brute(rows, 2, 80)


def test_recall_on_documents(spark):
    """Every component of the generated documents, exactly as brute force has it: a recall of 1 on this table."""
    from auklet.llm.common import table
    from tests.oracle import DATA

    docs = table(spark, str(DATA / "sf0.01"), "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, shingle=2).collect()}
    assert found == brute(rows, 2, 80) and sum(not x[2] for x in found.values()) > 50
