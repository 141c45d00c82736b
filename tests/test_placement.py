import itertools
import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException

from auklet.operators import placement as E


def greedy(experts, cards, redundant):
    """(expert, phys, card) by the rule itself: own share, then the next waiting replica that the card doesn't hold."""
    slots, base, each = (experts + redundant) // cards, experts // cards, redundant // cards
    waiting = [c * base + k for c in range(cards) for k in range(each)]
    out = []
    for c in range(cards):
        held = list(range(c * base, c * base + base))
        while len(held) < slots:
            taken = next(e for e in waiting if e not in held)
            waiting.remove(taken)
            held.append(taken)
        out += [(e, c * slots + k, c) for k, e in enumerate(held)]
    return out


@pytest.mark.parametrize(("experts", "cards", "redundant"), [(128, 16, 32), (12, 4, 4), (24, 6, 12), (12, 3, 0), (8, 8, 8)])
def test_replicas_stand_on_other_cards(spark, experts, cards, redundant):
    rows = spark.createDataFrame([(layer, c) for layer in (3, 7) for c in range(cards)], "layer long, card int")
    got = E.physical_places(rows, experts, redundant).collect()
    for layer in (3, 7):
        own = sorted((r.expert, r.phys, r.card) for r in got if r.layer == layer)
        assert own == sorted(greedy(experts, cards, redundant)) and len({(e, c) for e, _, c in own}) == len(own)


def test_what_doesnt_divide_is_an_error(spark):
    rows = lambda n: spark.createDataFrame([(0, c) for c in range(n)], "layer long, card int")
    for n, experts, redundant in ((25, 130, 50), (3, 3, 3), (4, 4, 8)):
        with pytest.raises(PySparkException, match="divide"):
            E.physical_places(rows(n), experts, redundant).collect()


def loads(table, weight):
    out = Counter()
    for (card, _), e in table.items():
        out[card] += weight[e]
    return out


def test_swaps_against_all_single_swaps():
    """Small layers: the peak falls or stays, nothing is lost or doubled, and it ends only where no allowed swap with any card lowers the fullest one."""
    rng = random.Random(5)
    for _ in range(60):
        cards, slots = rng.randrange(2, 5), rng.randrange(1, 4)
        names = list(range(cards * slots)) if rng.random() < 0.5 else [k % (cards * slots - 1) if cards > 2 else k for k in range(cards * slots)]
        table = {(c, s): names[c * slots + s] for c in range(cards) for s in range(slots)}
        if max(Counter((c, e) for (c, _), e in table.items()).values()) > 1:
            continue
        weight = {e: float(rng.randrange(1, 30)) for e in names}
        after = E._swapped(table, weight, 100, 100)
        assert after.keys() == table.keys() and Counter(after.values()) == Counter(table.values())
        assert max(Counter((c, e) for (c, _), e in after.items()).values()) == 1
        before, now = loads(table, weight), loads(after, weight)
        assert max(now.values()) <= max(before.values())
        one = E._swapped(table, weight, 1, 1)
        full = max(before, key=lambda c: (before[c], -c))
        best = {}
        for (a, x), (b, y) in itertools.product(table.items(), table.items()):
            if a[0] == full and b[0] != full and x not in {e for k, e in table.items() if k[0] == b[0]} and y not in {e for k, e in table.items() if k[0] == full}:
                peak = max(before[full] - weight[x] + weight[y], before[b[0]] - weight[y] + weight[x])
                best[b[0]] = min(best.get(b[0], peak), peak)
        lower = [c for c in sorted(before, key=lambda c: (before[c], c)) if c in best and best[c] < before[full]]
        changed = {k for k in table if table[k] != one[k]}
        assert len(changed) == (2 if lower else 0)
        if lower:
            assert {k[0] for k in changed} == {full, lower[0]}
            got = loads(one, weight)
            assert max(got[full], got[lower[0]]) == best[lower[0]]


def test_bounds_of_swaps():
    table = {(0, k): k for k in range(4)} | {(1, k): 4 + k for k in range(4)}
    weight = dict(enumerate([10.0, 9.0, 8.0, 7.0, 1.0, 1.0, 1.0, 1.0]))
    once, many = (E._swapped(table, weight, 100, n) for n in (1, 9))
    assert sum(once[k] != table[k] for k in table) == 2 and sum(many[k] != table[k] for k in table) >= 4
    assert E._swapped(table, weight, 0, 9) == table


def test_repaired_layers_are_evened(spark):
    rng = random.Random(2)
    rows = [(layer, c, s, (c * 4 + s) % 24, float(rng.randrange(100))) for layer in range(3) for c in range(12) for s in range(4)]
    placed = spark.createDataFrame(rows, "layer long, card long, slot long, expert long, workload double")
    plain, even = (E.repaired(placed, [1, 7], per_node=4, swaps=n) for n in (0, 50))
    peak = lambda df: {r.layer: r["max(load)"] for r in E.card_loads(df, placed).groupBy("layer").max("load").collect()}
    was, now = peak(plain), peak(even)
    assert all(now[k] <= was[k] for k in was) and any(now[k] < was[k] for k in was)
    for r in (plain, even):
        got = r.collect()
        assert len(got) == 3 * 10 * 4 and all({x.expert for x in got if x.layer == k} == set(range(24)) for k in range(3))


def test_tables_and_domains(spark):
    ranks = spark.createDataFrame([(0, 0), (1, -1), (2, 1), (5, 2)], "rank int, dp int")
    got = {r.place: (r.rank, r.local, r.back) for r in E.elastic_tables(ranks).collect()}
    assert got == {0: (0, 0, 0), 1: (1, -1, 2), 2: (2, 1, 5), 3: (5, 2, -1)}
    moved = E.domains(ranks, spark.createDataFrame([(1,)], "dp int"))
    assert {r.rank: r.dp for r in moved.collect()} == {0: 0, 1: -1, 2: -1, 5: 1}
