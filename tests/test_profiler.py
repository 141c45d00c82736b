import sqlite3

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auklet.operators import profiler as P
from auklet.sources.profiler_db import read_profiles


def apart_by_recursion(values, high, threshold):
    """The same rule on sets of values, written as a recursion."""

    def far(vs):
        vs = sorted(vs)
        if len(vs) < 2:
            return None
        gaps = [b - a for a, b in zip(vs, vs[1:])]
        g = max(gaps)
        k = gaps.index(g) + 1
        low, up = vs[:k], vs[k:]
        if 2 * g < vs[-1] - vs[0] or np.mean(low) == 0 or np.mean(up) / np.mean(low) < threshold:
            return None
        side = up if high else low
        return far(side) or side

    side = far(values)
    return [side is not None and side[0] <= v <= side[-1] for v in values]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=12), st.booleans(), st.sampled_from([1.3, 2.5]))
def test_widest_gap_equals_recursion(values, high, threshold):
    got = P._outlying(np.array(values, float), high, threshold).tolist()
    assert got == apart_by_recursion([float(v) for v in values], high, threshold)


def test_small_groups_and_nulls_give_nothing(spark):
    rows = spark.createDataFrame([(1, 0, 5.0, True), (2, 0, None, True), (2, 1, 9.0, True)], "g int, rank int, v double, high boolean")
    assert P.apart(rows, ["g"], "rank", "v", "high", 1.3).collect() == []
    assert P.apart(rows.limit(0), ["g"], "rank", "v", "high", 1.3).collect() == []


def test_slow_compute_takes_kernels_only_if_all_have_them(spark):
    groups = spark.createDataFrame([("tp", "a", [0, 1, 2]), ("tp", "b", [3, 4, 5])], "domain string, name string, ranks array<int>")
    rows = [(r, "ZP_Kernel", v) for r, v in enumerate([10, 10, 30, 10, 10, 0])] + [(r, "ZP_Duration", v) for r, v in enumerate([9, 9, 9, 100, 100, 10])]
    got = P.slow_compute(groups, spark.createDataFrame(rows, "rank int, metric string, value long"))
    assert {r.rank: r.score for r in got.collect()} == {2: 3.0, 5: 10.0}


def test_slow_communication_gives_whole_groups(spark):
    groups = spark.createDataFrame([("dp", n, r) for n, r in (("a", [0, 4]), ("b", [1, 5]), ("c", [2, 6]), ("d", [3, 7]))], "domain string, name string, ranks array<int>")
    took = spark.createDataFrame([(r, "dp_Duration", 90 if r % 4 == 2 else 10) for r in range(8)], "rank int, metric string, value long")
    assert [(r.domain, r.ranks, r.score) for r in P.slow_communication(groups, took).collect()] == [("dp", [2, 6], 9.0)]


def test_bubbles_have_a_limit(spark):
    rows = spark.createDataFrame([(0, "ZP_Bubble", 0), (1, "ZP_Bubble", 4999), (2, "ZP_Bubble", 5000), (3, "ZP_Bubble", None)], "rank int, metric string, value long")
    assert [r.rank for r in P.bubbles(rows).collect()] == [1]


def test_databases_are_read_by_rank(spark, tmp_path):
    for rank in (0, 3):
        sub = tmp_path / f"host{rank}"
        sub.mkdir()
        con = sqlite3.connect(sub / f"ascend_pytorch_profiler_{rank}.db")
        con.execute("create table STRING_IDS (id integer, value text)")
        con.executemany("insert into STRING_IDS values (?, ?)", [(1, "KERNEL_AICORE"), (2, f"own{rank}")])
        con.execute("create table TASK (startNs integer, endNs integer, taskType integer, connectionId integer)")
        con.execute("insert into TASK values (9007199254740993, 9007199254740999, 1, 7)")
        con.commit()
        con.close()
    (tmp_path / "other.db").write_bytes(b"no database")
    names = read_profiles(spark, f"file://{tmp_path}", "strings")
    assert sorted((r.rank, r.value) for r in names.where("id = 2").collect()) == [(0, "own0"), (3, "own3")]
    tasks = read_profiles(spark, f"file://{tmp_path}", "tasks")
    assert [(r.rank, r.start, r.stop) for r in tasks.orderBy("rank").collect()] == [(0, 9007199254740993, 9007199254740999), (3, 9007199254740993, 9007199254740999)]
    assert read_profiles(spark, f"file://{tmp_path}", "hosts").count() == 0  # no such table in either file
    kernels = P.named(tasks, "type_id", names, P.KERNEL)
    assert kernels.agg(F.count("*")).first()[0] == 2
