from auklet.operators import faults
from auklet.plans import fleet_queries as Q
from tests.oracle import DATA


def test_subscriptions_by_broadcast_and_by_join(spark, monkeypatch):
    both = []
    for few in (1000, 0):
        monkeypatch.setattr(faults, "FEW", few)
        both.append(sorted(map(repr, Q.QUERIES["fsub_j9_subscriptions"](spark, str(DATA / "sf0.001")).collect())))
    assert both[0] == both[1] and len(both[0]) > 50
