from auklet.operators import kpi
from auklet.plans.kpi_queries import QUERIES
from tests.oracle import DATA


def test_every_rule_of_causes_occurs(spark):
    """The cards of the view ail in every way that a rule looks for, so the comparison with SQL reaches each of them."""
    rows = QUERIES["dk4_dk5_all_causes"](spark, str(DATA / "sf0.01")).collect()
    found = {(r.cause, r.confidence) for r in rows if r.cause}
    assert found == {(cause, sure) for _, cause, sure, _ in kpi.CAUSES}
    start = lambda text: text.split("{n}")[-1][:20]
    assert all(any(start(advice) in r.suggestion for r in rows if r.suggestion) for *_, advice in kpi.CAUSES)
    assert any(r.secondary for r in rows) and any(r.category == "none" for r in rows)
    assert all(f"{n} metrics" not in kpi.CAUSES[8][3] for n in range(9))


def test_slowest_clock_of_several(spark):
    """A frequency is compared with the least of the other cards'; a tie is no finding."""
    rows = [(0, c, "aicore_freq", v) for c, v in enumerate((900.0, 850.0, 900.0))] + [(60, c, "aicore_freq", 800.0) for c in range(3)] + [(120, 0, "aicore_freq", 1.0)]
    got = kpi.space_points(spark.createDataFrame(rows, "bucket long, card int, metric string, value double"), spark, kpi.Settings()).collect()
    assert {(r.bucket, r.card) for r in got if r.score == 999} == {(0, 1)} and len(got) == 7
