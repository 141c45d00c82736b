import os
from collections import Counter, defaultdict

import corpus_pipeline
from auklet.llm.common import cleared, stored, table, tables
from auklet.llm.mixing import mixture
from auklet.llm.near_dedup import one_of_each_group
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_dedup import brute as linked
from tests.oracle import DATA

SF = str(DATA / "sf0.001")


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = (before.collect(), docs.collect())
        assert name == "sharding" or docs.columns == columns
    toxic = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    known = {r.doc_id for r in table(spark, SF, "labels").collect()}
    before, after = ({r.doc_id for r in x} for x in kept["toxicity"])
    assert len(after & toxic) <= 0.2 * len(toxic) and len((before - after) & (known - toxic)) <= 0.03 * len(known)

    before, after = kept["near_dedup"]
    want = linked([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(d for d, x in want.items() if x[2])

    before, after = kept["decontamination"]
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {d for d, x in contaminated([(r.doc_id, r.text) for r in before], bench).items() if x[4]}
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if r.doc_id not in bad)

    before, after = kept["mixing"]
    words, target = defaultdict(int), {}
    for r in mixture(spark.createDataFrame(before, docs.select(*columns).schema)).collect():
        target[r.source] = r.target
    for r in after:
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - t) <= max(60, 0.1 * t) for s, t in target.items()) and max(Counter(r.doc_id for r in after).values()) <= 2

    before, after = kept["sharding"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    size = defaultdict(int)
    for r in after:
        size[r.shard] += len(r.text.encode())
    assert max(size.values()) <= corpus_pipeline.SHARD_BYTES


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A B C D E F", "y"), (None, "a b c d e f", "z"), (3, None, None), (4, "", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = one_of_each_group(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=repr) == sorted([rows[0], *rows[3:]], key=repr)
    assert one_of_each_group(df.limit(0)).count() == 0


def test_stored_tables_go(spark):
    before = cleared(spark)
    kept = stored(spark.range(5), "five")
    assert kept.count() == 5 and before >= 0 and cleared(spark) == 1 and cleared(spark) == 0


def test_scopes_delete_their_own_tables(spark):
    outer = stored(spark.range(3), "outer")
    with tables(spark):
        inner = stored(spark.range(4), "inner")
        with tables(spark):
            assert stored(spark.range(5), "deep").count() == 5
        assert inner.count() == 4
        files = [f.removeprefix("file://") for f in inner.inputFiles()]
        assert files and all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files)) and outer.count() == 3 and cleared(spark) >= 1
