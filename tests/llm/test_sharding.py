import hashlib
from collections import Counter

from pyspark.sql import functions as F

from auklet.llm.sharding import shards

SCHEMA = "doc_id long, text string"


def test_shortest_prefix_that_fits(spark):
    docs = [(k, "x" * (k % 97 + 1)) for k in range(2000)]
    got = shards(spark.createDataFrame(docs, SCHEMA), limit=3000).collect()
    bits = {d: bin(int(hashlib.md5(str(d).encode()).hexdigest()[:13], 16))[2:].zfill(52) for d, _ in docs}
    size = {d: len(t) for d, t in docs}
    for r in got:
        at = [sum(size[d] for d in bits if bits[d].startswith(bits[r.doc_id][:n])) for n in range(len(r.bucket) + 1)]
        assert r.bucket == bits[r.doc_id][: len(r.bucket)] and at[-1] <= 3000 and all(x > 3000 for x in at[:-1])
    assert len(got) == 2000 and {r.page for r in got} == {0}


def test_hot_key_large_rows_nulls_and_clashing_names(spark):
    docs = [(7, "y" * 50)] * 400 + [(8, "z" * 5000), (None, None), (9, "")] + [(100 + k, "w" * 90) for k in range(50)]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("shard", F.lit("mine")).withColumn("lang", F.lit("en"))
    got = shards(df, limit=1000).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in docs) and got[0].__fields__ == ["doc_id", "text", "lang", "row_bytes", "bucket", "page", "shard"]
    bytes_, rows = Counter(), Counter()
    for r in got:
        bytes_[r.shard] += r.row_bytes
        rows[r.shard] += 1
    assert all(b <= 1000 or rows[s] == 1 for s, b in bytes_.items())
    assert 20 <= len({r.shard for r in got if r.doc_id == 7}) <= 60


def test_empty(spark):
    assert shards(spark.createDataFrame([], SCHEMA), limit=10).count() == 0


def test_pages_dont_depend_on_how_rows_are_dealt(spark):
    docs = [(7, f"text {k % 90}") for k in range(2000)] + [(8, "short")]
    df = spark.createDataFrame(docs, SCHEMA)
    runs = [Counter((r.doc_id, r.text, r.shard) for r in shards(df.repartition(n), limit=600).collect()) for n in (3, 11)]
    assert runs[0] == runs[1] and len({s for d, _, s in runs[0] if d == 7}) > 20
