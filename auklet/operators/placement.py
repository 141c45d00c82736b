"""Ranks and experts after cards are lost: exclusion, renumbering, and where each expert's replicas are placed."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def excluded_ranks(groups: DataFrame, size: int) -> DataFrame:
    """(rank): the expert ranks of data-parallel groups (dp): dp * size up to (dp + 1) * size - 1."""
    return groups.select(F.explode(F.sequence(F.col("dp") * size, (F.col("dp") + 1) * size - 1)).alias("rank")).distinct()


def renumbered(ranks: DataFrame, gone: DataFrame) -> DataFrame:
    """(rank, new_rank): the survivors from 0 without holes, in order; the lost have -1.

    Numbers are counted within ranges of ranks and those ranges' offsets added, so no task orders all of them.
    """
    rows = ranks.select("rank").distinct().join(gone.select("rank").distinct().withColumn("gone_", F.lit(True)), "rank", "left")
    rows = rows.withColumns({"part_": F.floor(F.col("rank") / 4096), "on_": F.col("gone_").isNull().cast("long")})
    sizes = rows.groupBy("part_").agg(F.sum("on_").alias("n_"))
    offsets = sizes.withColumn("off_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    place = F.sum("on_").over(Window.partitionBy("part_").orderBy("rank")) - 1
    rows = rows.withColumn("k_", place).join(offsets, "part_")
    return rows.select("rank", F.when(F.col("on_") == 1, F.col("k_") + F.col("off_")).otherwise(F.lit(-1)).alias("new_rank"))


def domains(ranks: DataFrame, excluded: DataFrame) -> DataFrame:
    """(rank, old_dp, dp): the data-parallel group of each rank after groups are excluded: renumbered, -1 for the excluded and for ranks without one."""
    known = ranks.where("dp >= 0").select(F.col("dp").alias("rank"))
    moved = renumbered(known, excluded.select(F.col("dp").alias("rank"))).select(F.col("rank").alias("dp"), F.col("new_rank").alias("new_"))
    return ranks.join(moved, "dp", "left").select("rank", F.col("dp").alias("old_dp"), F.coalesce("new_", F.lit(-1)).alias("dp"))


def elastic_tables(ranks: DataFrame) -> DataFrame:
    """(place, rank, local, back): the two tables that turn ranks (rank, dp; -1 is lost) into numbers among the survivors and back.

    local is the rank's number among the survivors, -1 for the lost; back is the survivor that has the number `place`, -1 beyond them.
    """
    place = renumbered(ranks, ranks.limit(0)).withColumnRenamed("new_rank", "place")
    local = renumbered(ranks, ranks.where("dp = -1")).withColumnRenamed("new_rank", "local")
    back = local.where("local >= 0").select(F.col("local").alias("place"), F.col("rank").alias("back_"))
    rows = place.join(local, "rank").join(back, "place", "left")
    return rows.select("place", "rank", "local", F.coalesce("back_", F.lit(-1)).alias("back"))


def even_experts(cards: DataFrame, experts: int, n_cards: int) -> DataFrame:
    """(card, expert): experts in order over cards, the first ones taking one more where they don't divide."""
    base, more = divmod(experts, n_cards)
    start = F.col("card") * base + F.least("card", F.lit(more))
    count = F.lit(base) + (F.col("card") < more).cast("int")
    return cards.where(count > 0).select("card", F.explode(F.sequence(start, start + count - 1)).alias("expert"))


def redundant_experts(cards: DataFrame, experts: int, n_cards: int, redundant: int) -> DataFrame:
    """(card, expert): the experts of which there is one replica more, each with the card whose own share it begins; the replica stands elsewhere."""
    each = redundant // n_cards
    start = F.col("card") * (experts // n_cards)
    return cards.where(F.lit(each > 0)).select("card", F.explode(F.sequence(start, start + max(each - 1, 0))).alias("expert"))


def physical_places(cards: DataFrame, experts: int, redundant: int) -> DataFrame:
    """(layer, expert, phys, card): where the replicas of each expert stand in every layer, from its cards (layer, card from 0 to n - 1).

    Cards hold even shares of the experts in order, and after them replicas: of the first redundant / n experts of each share there is one
    more. Each card takes the next ones that it doesn't hold, so cards 0 and 1 take each other's, 2 and 3, and so on. Shares that don't
    divide over the cards, an odd number of cards with replicas and more replicas than experts are errors.
    """
    n = F.count("*").over(Window.partitionBy("layer"))
    rows = cards.select("layer", F.col("card").cast("long").alias("card")).distinct().withColumn("n_", n)
    wrong = (F.lit(experts) % F.col("n_") != 0) | (F.lit(redundant) % F.col("n_") != 0) | (F.lit(redundant > 0) & (F.col("n_") % 2 != 0)) | F.lit(redundant > experts)
    said = F.concat(F.lit(f"{experts} experts and {redundant} replicas don't divide over "), F.col("n_").cast("string"), F.lit(" cards that take each other's"))
    rows = rows.withColumn("n_", F.when(wrong, F.raise_error(said).cast("long")).otherwise(F.col("n_")))
    base, each = F.floor(F.lit(experts) / F.col("n_")), F.floor(F.lit(redundant) / F.col("n_"))
    spot = lambda holder, k, place: F.struct((holder * base + k).cast("int").alias("expert"), (F.col("card") * (base + each) + place).cast("int").alias("phys"))
    places = F.transform(F.sequence(F.lit(0).cast("long"), base + each - 1), lambda k: F.when(k < base, spot(F.col("card"), k, k)).otherwise(spot(F.col("card").bitwiseXOR(F.lit(1).cast("long")), k - base, k)))
    return rows.withColumn("at_", F.explode(places)).select("layer", "at_.expert", "at_.phys", F.col("card").cast("int").alias("card"))


def replicas(placed: DataFrame) -> DataFrame:
    """(layer, expert, places): the physical places (card * slots + slot) of each expert, in order; empty slots (-1) count for none."""
    slots = placed.groupBy("layer").agg((F.max("slot") + 1).alias("slots"))
    rows = placed.where("expert >= 0").join(slots, "layer")
    return rows.groupBy("layer", "expert").agg(F.array_sort(F.collect_list(F.col("card") * F.col("slots") + F.col("slot"))).alias("places"))


def _repaired(rows: pd.DataFrame, lost: frozenset[int], per_node: int, replicate: bool) -> pd.DataFrame:
    """One layer's new placement. Slots whose expert stays somewhere else are free; lost experts go there, node after node."""
    load = rows.groupby("expert")["workload"].sum().to_dict()
    experts = sorted(e for e in rows["expert"].unique() if e >= 0)
    left = rows[~rows["card"].isin(lost)].sort_values(["card", "slot"])
    table = {(c, s): e for c, s, e in left[["card", "slot", "expert"]].itertuples(index=False)}
    holders = {e: sorted(k for k, x in table.items() if x == e) for e in experts}
    kept, busy = set(), Counter()
    for e in sorted((e for e in experts if holders[e]), key=lambda e: (len(holders[e]), e)):
        place = min(holders[e], key=lambda k: (busy[k[0]], k))
        kept.add(place)
        busy[place[0]] += 1
    free: dict[int, list] = {}
    for place in sorted(set(table) - kept, key=lambda k: (busy[k[0]], k)):
        free.setdefault(place[0] // per_node, []).append(place)
    missing = [e for e in experts if not holders[e]]
    if len(missing) > sum(map(len, free.values())):
        raise ValueError(f"layer {rows['layer'].iloc[0]}: {len(missing)} experts without a replica, {sum(map(len, free.values()))} free slots")
    nodes = sorted(free, key=lambda n: (-len(free[n]), n))
    for k, e in enumerate(missing):
        while not free[nodes[k % len(nodes)]]:
            nodes.remove(nodes[k % len(nodes)])
        place = free[nodes[k % len(nodes)]].pop(0)
        table[place] = e
        kept.add(place)
    if replicate:  # the rest of the free slots hold the experts with most load for each replica
        n = Counter(table[k] for k in kept)
        for place in sorted(set(table) - kept):
            here = {table[(c, s)] for c, s in kept if c == place[0]}
            pick = max((e for e in experts if e not in here), key=lambda e: (load.get(e, 0.0) / n[e], -e), default=table[place])
            table[place] = pick
            n[pick] += 1
            kept.add(place)
    out = left.assign(old=left["expert"], expert=[table[k] for k in zip(left["card"], left["slot"], strict=True)])
    return out[["layer", "card", "slot", "old", "expert"]]


def _swapped(table: dict[tuple[int, int], int], weight: dict[int, float], rounds: int, per_pair: int) -> dict[tuple[int, int], int]:
    """The placement (card, slot) -> expert after up to `rounds` swaps, each between the fullest card and the emptiest one with which a swap lowers the higher of their two loads.

    Of a pair's swaps the one with the lowest such load is taken. A card doesn't give away what it got in an earlier round or take what it
    holds, two cards swap per_pair times at most, and all other experts keep their slots.
    """
    table = dict(table)
    cards: dict[int, dict[int, tuple[int, int]]] = {}
    for place, e in table.items():
        cards.setdefault(place[0], {})[e] = place
    load = {c: sum(weight.get(e, 0.0) for e in own) for c, own in cards.items()}
    got: dict[int, set[int]] = {c: set() for c in cards}
    between: Counter = Counter()
    for _ in range(rounds):
        full = max(load, key=lambda c: (load[c], -c))
        for other in sorted((c for c in load if c != full and between[frozenset((c, full))] < per_pair), key=lambda c: (load[c], c)):
            gives, takes = ([e for e in own if e not in theirs and e not in got[c]] for c, own, theirs in ((full, cards[full], cards[other]), (other, cards[other], cards[full])))
            ends = [(max(load[full] - weight.get(x, 0.0) + weight.get(y, 0.0), load[other] - weight.get(y, 0.0) + weight.get(x, 0.0)), x, y) for x in gives for y in takes]
            if ends and min(ends)[0] < load[full]:
                _, x, y = min(ends)
                here, there = cards[full].pop(x), cards[other].pop(y)
                cards[full][y], cards[other][x] = here, there
                table[here], table[there] = y, x
                load[full], load[other] = load[full] - weight.get(x, 0.0) + weight.get(y, 0.0), load[other] - weight.get(y, 0.0) + weight.get(x, 0.0)
                got[full].add(y)
                got[other].add(x)
                between[frozenset((full, other))] += 1
                break
        else:
            break
    return table


def _evened(rows: pd.DataFrame, load: dict[int, float], rounds: int, per_pair: int) -> pd.DataFrame:
    """A layer's placement after swaps; an expert's load is shared evenly by its replicas."""
    table = {(c, s): e for c, s, e in rows[["card", "slot", "expert"]].itertuples(index=False)}
    copies = Counter(table.values())
    weight = {e: load.get(e, 0.0) / n for e, n in copies.items()}
    if max(Counter((c, e) for (c, _), e in table.items()).values(), default=0) < 2:  # a card that holds an expert twice has no single slot for it
        table = _swapped(table, weight, rounds, per_pair)
    return rows.assign(expert=[table[k] for k in zip(rows["card"], rows["slot"], strict=True)])


def repaired(placed: DataFrame, lost: list[int], per_node: int = 8, replicate: bool = False, swaps: int = 0, per_pair: int = 1) -> DataFrame:
    """(layer, card, slot, old, expert) after cards are lost: every expert has a place again and slots that needn't change don't.

    placed is (layer, card, slot, expert, workload). Layers are independent groups of bounded size (cards x slots). Too few
    free slots for the experts without a replica are an error. With swaps, up to so many pairs of experts change cards afterwards, so that
    the fullest card has less to do: the highest load never rises, and no expert is lost or comes to a card that holds it.
    """
    gone = frozenset(lost)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out = _repaired(rows, gone, per_node, replicate)
        return _evened(out, rows.groupby("expert")["workload"].sum().to_dict(), swaps, per_pair) if swaps else out

    return placed.groupBy("layer").applyInPandas(one, "layer long, card long, slot long, old long, expert long")


def card_loads(placement: DataFrame, placed: DataFrame) -> DataFrame:
    """(layer, card, load): what the experts of each card have to do, an expert's whole workload shared evenly by its replicas."""
    whole = placed.groupBy("layer", "expert").agg(F.sum("workload").alias("whole_"))
    copies = placement.groupBy("layer", "expert").agg(F.count("*").alias("n_"))
    return placement.join(copies, ["layer", "expert"]).join(whole, ["layer", "expert"]).groupBy("layer", "card").agg(F.sum(F.col("whole_") / F.col("n_")).alias("load"))
