import random
import uuid

from auklet.llm import components as C
from auklet.llm.common import stored


def jobs(spark, run):
    """What run gives, and the number of Spark jobs that it took."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def found(df):
    rows = [(r.node, r.component) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_few_edges_take_few_jobs(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(900, 901), (950, 950), (None, 3)], "a long, b long")
    out, n = jobs(spark, lambda: C.components(edges))
    assert found(out) == {k: 0 for k in range(301)} | {900: 900, 901: 900, 950: 950} and n <= 4
    none = stored(edges.where("false"), "links")
    same, n = jobs(spark, lambda: C.regrouped(out, none))
    assert same is out and n <= 1


def test_rounds_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    first = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(150)], "a long, b long")
    more = stored(spark.createDataFrame([(rng.randrange(500), rng.randrange(500)) for _ in range(120)] + [(700, 700), (5, 5)], "a long, b long"), "links")
    in_one = [found(C.components(first)), found(C.regrouped(C.components(first), more)), found(C.components(first.union(more)))]
    monkeypatch.setattr(C, "FEW_EDGES", -1)
    in_rounds = [found(C.components(first)), found(C.regrouped(C.components(first), more))]
    assert in_one == [*in_rounds, in_one[1]]
