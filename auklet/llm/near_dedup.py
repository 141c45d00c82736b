"""Near-duplicate documents: MinHash signatures in an LSH forest, links confirmed on full shingle sets.

Every distinct shingle set is one class with an id of its own (exact copies meet there, by an aggregate that combines before
the shuffle). A class's signature is read in several orders of its minima. In each order all classes are sorted by their
minima in that order: those that agree on the first few form a region, and in it the row before has the longest common
prefix. LEVELS gives the least depth and the number of orders: regions that stay dense and undecided at one level are
sorted again, deeper and in more orders, at the next.

At each level
1. a class meets its neighbour of longest common prefix and the head (smallest id) of each of its regions; of those whose
   sketch looks alike, the likest is confirmed on the full sets. So a group of near copies, however large, becomes one
   component by one comparison for each member, before any pair is made.
2. Regions whose members are still in several components are looked at in blocks. A region of BLOCK members at most is one
   block. In a larger one, the members outside its most common component meet each other in one block, and the members
   of that component elsewhere: a component's members are dealt once, over all orders, to blocks of BLOCK, and each outsider
   visits these blocks. If there are more outsiders than a block holds, even after that, they go one level deeper; at the
   last level they are compared in pairs of blocks, so nothing is left out because a region is large.
3. In these blocks each component's likest partner is looked up and confirmed first, which joins nearly all that belong
   together, where there are many rows; then, over what is still apart, every pair of different components with like sketches is confirmed on full
   sets inside its block. Only links leave a block.

A link at similarity s shares no region of a level of D minima in T orders with probability (1 - s^D)^T: at 0.8 this is 3e-6
at the first level and 2e-6 at the second, less above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auklet.llm.common import BROADCAST_ROWS, RELEASE_BYTES, WordHashes, lower_words, released, shingles, small, stored, text_key
from auklet.llm.components import components, regrouped

#: Minima of a signature.
MINIMA = 96
#: Least depth and number of orders of each level of the forest.
LEVELS = ((4, 24), (8, 72))
#: Minima after the least depth by which a region is sorted further, a byte of each.
FURTHER = 8
#: Sketches (a byte of each minimum) that agree less than so far below the threshold aren't confirmed on full sets: five standard deviations of the estimate.
SLACK = 0.2
#: Members of a region that one block holds.
BLOCK = 512
#: Rows in blocks whose pairs are compared at once; the likest partners come first where there are more.
FEW_ROWS = 10_000
#: Rows whose sets are held at a time while they are signed.
PIECE = 1024

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    return np.unique(shingles(hashes.of(lower_words(text)), size))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of MINIMA for each non-empty set."""
    out = np.empty((len(sets), MINIMA), np.uint32)
    at = 0
    while at < len(sets):  # some tens of thousands of hashes at a time stay in the CPU's cache
        upto, n = at, 0
        while upto < len(sets) and (n == 0 or n + len(sets[upto]) <= 32_768):
            n += len(sets[upto])
            upto += 1
        x = (np.concatenate(sets[at:upto]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[at : upto - 1])])
        h = np.empty_like(x)
        for k in range(MINIMA):
            np.bitwise_xor(x, _XOR[k], out=h)
            np.multiply(h, _MUL[k], out=h)
            np.minimum.reduceat(h, starts, out=out[at:upto, k])
        at = upto
    return out


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
            sets = [shingle_set(t, size, hashes) for t in batch["text"].to_pylist()]
            full = [k for k, s in enumerate(sets) if len(s)]
            rows = iter(minima([sets[k] for k in full])) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["key_"],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "key_", "n_shingles", "digest", "signature"],
            )

    return run


def orders(depth: int, trees: int) -> np.ndarray:
    """The minima by which each order sorts: disjoint runs where the signature is long enough for that, else seeded draws."""
    if depth * trees <= MINIMA:
        return (np.arange(trees)[:, None] * depth + np.arange(depth + FURTHER)[None, :]) % MINIMA
    rng = np.random.default_rng(depth)
    return np.stack([rng.permutation(MINIMA)[: depth + FURTHER] for _ in range(trees)])


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint32).reshape(-1, MINIMA)


def _keys(sig: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """The key of each signature's region in every order: a hash of the order and its first minima."""
    order = orders(depth, trees)
    key = np.broadcast_to(np.arange(trees, dtype=np.uint64) + np.uint64(1 + 1000 * depth), (len(sig), trees)).copy()
    for d in range(depth):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
        key += sig[:, order[:, d]].astype(np.uint64) + np.uint64(1)
    return ((key * np.uint64(0xD6E8FEB86659FD93)) ^ (key >> np.uint64(29))).view(np.int64)


def _bytes_of(sig: np.ndarray) -> np.ndarray:
    return ((sig * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)


def _planted(depth: int, trees: int):
    """Each class's place in every order: its region's key, and the next minima, by which the region is sorted."""
    order = orders(depth, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _signatures(batch)
            further = np.zeros((len(sig), trees), np.uint64)
            for d in range(FURTHER):
                further = (further << np.uint64(8)) | _bytes_of(sig[:, order[:, depth + d]])
            arrays = [pa.array(_keys(sig, depth, trees).ravel()), pa.array(further.ravel().view(np.int64)), pa.array(np.repeat(batch["id"].to_numpy(zero_copy_only=False), trees))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "further", "id"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of the forest: each with the row before it in its region, and with the region's head."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids, head = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "id", "head"))
        before = np.concatenate([ids[:1], ids[:-1]])
        same = np.concatenate([[False], key[1:] == key[:-1]])
        if last is not None and last[0] == key[0]:
            before[0], same[0] = last[1], True
        last = key[-1], ids[-1]
        x, y = np.concatenate([before[same], head]), np.concatenate([ids[same], ids])
        a, b = np.minimum(x, y), np.maximum(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(a[a < b]), pa.array(b[a < b])], names=["a", "b"])


def _sketched(depth: int, trees: int):
    """A byte of each minimum, and the keys of the class's regions in all orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = _signatures(batch)
                columns = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (_bytes_of(sig), _keys(sig, depth, trees))]
                yield pa.RecordBatch.from_arrays([batch["id"], batch["n"], *columns], names=["id", "n", "sketch", "heads"])

    return run


def _alike(floor: float):
    """(a, b, like) of the pairs whose sketches agree in `floor` of all places at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, MINIMA) for c in ("sketch_a", "sketch_b"))
                like = (x == y).mean(axis=1)
                keep = pa.array(like >= floor)
                yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep), pa.array(like).filter(keep)], names=["a", "b", "like"])

    return run


class _Block:
    """Members that are compared: those of side 0 with those of side 1, or all of side -1 with each other."""

    def __init__(self, rows: dict[str, np.ndarray], floor: float, percent: int):
        self.rows, self.floor, self.percent = rows, floor, percent
        self.same = bool((rows["side"] < 0).all())
        self.left = np.flatnonzero(rows["side"] <= 0)
        self.right = self.left if self.same else np.flatnonzero(rows["side"] > 0)
        self.tree = int(np.argmax(rows["heads"][0] == rows["key"][0]))  # 0 also where the block isn't a region's

    def pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(i, js, likes): members of other components with like sketches, if no earlier order has them in one region."""
        ids, comp, n, sketch, heads = (self.rows[c] for c in ("id", "comp", "n", "sketch", "heads"))
        for i in self.left:
            at = self.right[(comp[self.right] != comp[i]) & (100 * np.minimum(n[self.right], n[i]) >= self.percent * np.maximum(n[self.right], n[i]))]
            at = at[ids[at] > ids[i]] if self.same else at
            if len(at) and self.tree:
                at = at[~(heads[at, : self.tree] == heads[i, : self.tree]).any(axis=1)]
            if len(at):
                like = (sketch[at] == sketch[i]).mean(axis=1)
                ok = like >= self.floor
                if ok.any():
                    yield i, at[ok], like[ok]

    def likest(self) -> list[np.ndarray]:
        """Each component's likest partner in this block."""
        comp, ids = self.rows["comp"], self.rows["id"]
        best: dict[int, tuple[float, int, int]] = {}
        for i, js, likes in self.pairs():
            top = np.argsort(-likes, kind="stable")
            for c, k in [(comp[i], top[0]), *((comp[js[k]], k) for k in top)]:
                if likes[k] > best.get(c, (0.0,))[0]:
                    best[c] = (float(likes[k]), ids[i], ids[js[k]])
        likes, a, b = (np.array([x[k] for x in best.values()], kind) for k, kind in enumerate((float, np.int64, np.int64)))
        return [np.array(list(best), np.int64), a, b, likes]

    def wanted(self) -> list[np.ndarray]:
        """The members that have a pair."""
        have = np.zeros(len(self.rows["id"]), bool)
        for i, js, _ in self.pairs():
            have[i] = True
            have[js] = True
        return [v[have] for v in self.rows.values()]

    def linked(self) -> list[np.ndarray]:
        """Pairs that are linked by their full sets; one is enough for two components."""
        found, comp, ids, n, sets = [], *(self.rows[c] for c in ("comp", "id", "n", "members"))
        pairs = list(self.pairs())
        met: set[tuple[int, int]] = set()
        shared = _Shared(sets, np.unique(np.concatenate([js for _, js, _ in pairs]))) if pairs else None
        for i, js, _ in pairs:
            both = shared.with_each(sets[i])[js]
            for j in js[100 * both >= self.percent * (n[i] + n[js] - both)]:
                ends = (min(comp[i], comp[j]), max(comp[i], comp[j]))
                if ends not in met:
                    met.add(ends)
                    found.append((ids[i], ids[j]))
        return [np.array(x, np.int64) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 2


class _Shared:
    """How many elements of a set each of some sets has: by an index from elements to sets."""

    def __init__(self, sets: np.ndarray, of: np.ndarray):
        values, owners = np.concatenate([sets[k] for k in of]), np.repeat(of, [len(sets[k]) for k in of])
        order = np.argsort(values, kind="stable")
        self.values, self.owners, self.many = values[order], owners[order], len(sets)

    def with_each(self, members: np.ndarray) -> np.ndarray:
        lo, hi = (np.searchsorted(self.values, members, side) for side in ("left", "right"))
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.owners[at], minlength=self.many)


_ROW = ("key", "pair", "side", "id", "n")


def _looked(floor: float, percent: int, what: str, trees: int):
    """What every block has to say; rows come sorted by block, and a block may go on in the next batch."""
    names = {"likest": ["comp", "a", "b", "like"], "wanted": [*_ROW, "sketch", "heads", "comp"], "linked": ["a", "b"]}[what]

    def read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        rows = {c: batch[c].to_numpy(zero_copy_only=False) for c in _ROW}
        for c, kind, width in (("sketch", np.uint8, MINIMA), ("heads", np.int64, trees)):
            rows[c] = np.frombuffer(b"".join(batch[c].to_pylist()), kind).reshape(-1, width)
        rows["comp"] = batch["comp"].to_numpy(zero_copy_only=False)
        if what == "linked":
            rows["members"] = np.empty(batch.num_rows, object)
            rows["members"][:] = [np.frombuffer(x, np.uint64) for x in batch["members"].to_pylist()]
        return rows

    def said(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero((rows["key"][1:] != rows["key"][:-1]) | (rows["pair"][1:] != rows["pair"][:-1])) + 1
        found = [getattr(_Block({k: v[lo:hi] for k, v in rows.items()}, floor, percent), what)() for lo, hi in zip([0, *cuts], [*cuts, len(rows["key"])], strict=True)]
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) if x.ndim == 1 else pa.array([r.tobytes() for r in x], pa.binary()) for x in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            new = read(batch)
            rows = {k: np.concatenate([held[k], v]) for k, v in new.items()} if held else new
            last = np.flatnonzero((rows["key"] == rows["key"][-1]) & (rows["pair"] == rows["pair"][-1]))[0]
            held = {k: v[last:] for k, v in rows.items()}
            if last:
                yield from said({k: v[:last] for k, v in rows.items()})
        if held:
            yield from said(held)

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([shingle_set(t, size, hashes).tobytes() for t in batch["text"].to_pylist()], pa.binary())], names=["id", "members"])

    return run


def _is_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
            sets = ((np.frombuffer(v, np.uint64) for v in batch[c].to_pylist()) for c in ("set_a", "set_b"))
            keep = pa.array([_is_link(x, y, percent) for x, y in zip(*sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return run


class _Forest:
    """What the steps share: the corpus, its classes, and the components found so far."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, percent: int):
        self.docs, self.classes, self.size, self.percent = docs, classes, size, percent
        self.floor = percent / 100 - SLACK
        self.groups = None

    def link(self, links: DataFrame) -> None:
        """Joins the components of stored links (a, b)."""
        self.groups = components(links) if self.groups is None else regrouped(self.groups, links)

    def grouped(self, rows: DataFrame) -> DataFrame:
        """rows with the component of their id; ids without a link are their own."""
        known = self.groups.select(F.col("node").alias("id"), F.col("component").alias("comp"))
        return rows.join(small(self.groups)(known), "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def members_of(self, ids: DataFrame, most: int) -> DataFrame:
        """(id, members): the full sets of these classes, `most` at most, from one text of each; texts don't move where ids are few."""
        few = F.broadcast if most <= BROADCAST_ROWS else lambda side: side
        rows = self.classes.select("id", "rep.*").join(few(ids), "id", "left_semi")
        texts = self.docs.join(few(rows), ["doc_id", "key_"]).groupBy("id").agg(F.first("text").alias("text"))
        return stored(texts.mapInArrow(released(_sets(self.size), RELEASE_BYTES), "id long, members binary"), "sets")

    def confirm(self, pairs: DataFrame) -> None:
        """Takes those of the pairs (a, b) that are linked by their full sets."""
        pairs = stored(pairs, "pairs")
        if not (n := pairs.count()) and self.groups is not None:
            return
        sets = self.members_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), 2 * n)
        a, b = (sets.select(F.col("id").alias(c), F.col("members").alias(f"set_{c}")) for c in "ab")
        met = a.join(F.broadcast(pairs) if n <= BROADCAST_ROWS else pairs, "a").join(b, "b").select("a", "b", "set_a", "set_b")
        self.link(stored(met.mapInArrow(released(_linked(self.percent), RELEASE_BYTES), "a long, b long"), "links"))

    def level(self, active: DataFrame, depth: int, trees: int, last: bool) -> DataFrame | None:
        """One level over the classes active; returns the ids to look at one level deeper, if there are any."""
        places = active.select("id", "signature").mapInArrow(_planted(depth, trees), "key long, further long, id long")
        sketches = active.select("id", "n", "signature").mapInArrow(_sketched(depth, trees), "id long, n long, sketch binary, heads binary")
        regions = stored(places.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("head")).where("size > 1"), "regions")
        members = stored(places.join(regions, "key"), "members")

        sorted_ = members.repartitionByRange("key", "further", "id").sortWithinPartitions("key", "further", "id")
        meets = sorted_.select("key", "id", "head").mapInArrow(_neighbours, "a long, b long").distinct()
        sa, sb = (sketches.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
        near = meets.join(sa, "a").join(sb, "b").where(f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)")
        near = near.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_alike(self.floor), "a long, b long, like double")
        self.confirm(near.groupBy("b").agg(F.max_by("a", F.struct("like", -F.col("a"))).alias("a")).select("a", "b"))

        members = members.select("key", "id")
        for _ in range(2):  # crowds are looked at again after what they have to do with their common component is settled
            placed = stored(self.grouped(members), "placed")
            several = self._several(placed)
            mixed = placed.join(several, "key")
            self.compare(stored(self._blocks(mixed, last).join(sketches, "id").select("key", "pair", "side", "id", "n", "sketch", "heads"), "blocks"), trees)
            crowds = several.where((F.col("size") > BLOCK) & (F.col("outside") > BLOCK)).select("key")
            if last or crowds.isEmpty():
                return None
            members = placed.join(crowds, "key", "left_semi").select("key", "id")
        return stored(mixed.join(crowds, "key", "left_semi").where("comp <> main").select("id").distinct(), "deeper")

    def compare(self, rows: DataFrame, trees: int) -> None:
        """Finds the links between components in stored blocks: the likest of each component first where there are many rows, then all."""
        if not (n := rows.count()):
            return
        row = "key long, pair long, side int, id long, n long, sketch binary, heads binary, comp long"
        in_blocks = lambda df: df.repartition("key", "pair").sortWithinPartitions("key", "pair")
        look = lambda df, what, kind: in_blocks(df).mapInArrow(released(_looked(self.floor, self.percent, what, trees), RELEASE_BYTES), kind)
        if n > FEW_ROWS:
            likest = look(self.grouped(rows), "likest", "comp long, a long, b long, like double")
            a, b = F.least("a", "b"), F.greatest("a", "b")
            likest = likest.groupBy("comp").agg(F.max_by(F.struct(a.alias("a"), b.alias("b")), F.struct("like", -a, -b)).alias("p"))
            self.confirm(likest.select("p.a", "p.b").distinct())
        wanted = stored(look(self.grouped(rows), "wanted", row), "wanted")
        if n := wanted.count():
            few = F.broadcast if n <= FEW_ROWS else lambda side: side
            self.link(stored(look(few(wanted).join(self.members_of(wanted.select("id"), n), "id"), "linked", "a long, b long"), "links"))

    def _several(self, placed: DataFrame) -> DataFrame:
        """(key, size, main, outside) of regions in several components: the most common one, and how many members are outside it."""
        parts = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
        top = F.max(F.struct("n", (-F.col("comp")).alias("minus")))
        several = parts.groupBy("key").agg(F.sum("n").alias("size"), F.count("*").alias("comps"), top.alias("top")).where("comps > 1")
        return stored(several.select("key", "size", (-F.col("top.minus")).alias("main"), (F.col("size") - F.col("top.n")).alias("outside")), "several")

    def _blocks(self, mixed: DataFrame, last: bool) -> DataFrame:
        """(key, pair, side, id): who is compared with whom, over members (key, id, comp, size, main, outside) of undecided regions."""
        crowd, outsider = F.col("size") > BLOCK, F.col("comp") != F.col("main")
        zero = F.lit(0).cast("long")
        inside = mixed.where(~crowd | outsider).withColumn("size", F.when(crowd, F.col("outside")).otherwise(F.col("size")))
        inside = (inside if last else inside.where(F.col("size") <= BLOCK)).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("long"))
        inside = inside.withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        lo, hi = F.least("own", "other"), F.greatest("own", "other")
        side = F.when(lo == hi, F.lit(-1)).when(F.col("own") == lo, F.lit(0)).otherwise(F.lit(1))
        inside = inside.select("key", (lo * (1 << 31) + hi).alias("pair"), side.alias("side"), "id")

        # a crowd's most common component is dealt to blocks once, over all orders; every outsider visits each of its blocks
        both = mixed.where(crowd).groupBy("main", "id").agg(F.bool_and(~outsider).alias("host"))
        counts = both.where("host").groupBy("main").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        both = both.join(counts, "main").withColumn("block", F.explode(F.when(F.col("host"), F.array(F.pmod(F.xxhash64("id"), "blocks"))).otherwise(F.sequence(zero, F.col("blocks") - 1))))
        both = both.select(F.xxhash64(F.lit("hosts"), "main").alias("key"), (-1 - F.col("block")).alias("pair"), F.when(F.col("host"), 0).otherwise(1).alias("side"), "id")
        return inside.union(both)


def _judged(documents: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, key_, n_shingles, group, component_id, kept) for every row; group is the component's own id, null without words."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key_", text_key("text"))
    signed = stored(docs.mapInArrow(released(_signed(shingle), RELEASE_BYTES), "doc_id long, key_ struct<a:bigint,b:bigint>, n_shingles long, digest binary, signature binary"), "signed")
    full = signed.where("doc_id is not null and digest is not null")
    classes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "key_")).alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # written, so the ids stay

    forest, active = _Forest(docs, classes, shingle, percent), classes
    for k, (depth, trees) in enumerate(LEVELS):
        deeper = forest.level(active, depth, trees, k == len(LEVELS) - 1)
        if deeper is None:
            break
        active = classes.join(small(deeper)(deeper), "id")

    last = forest.groups.select(F.col("node").alias("id"), "component")
    groups = stored(classes.select("digest", "id", "rep.doc_id").join(last, "id", "left").select("digest", "doc_id", F.coalesce("component", "id").alias("group")), "groups")
    least = groups.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    owners = groups.select("digest", "group").join(least, "group")
    rows = signed.select("doc_id", "key_", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(owners, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "key_", "n_shingles", "group", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of documents (doc_id, text; more columns are ignored).

    Documents are linked if percent/100 of the union of their sets of `shingle`-word runs is common; component_id is the
    smallest doc_id reachable over links. Null and blank texts have an empty set and are linked with nothing. Rows that
    repeat a doc_id are judged each by its own text, and link nothing by sharing the doc_id; a null doc_id is linked with
    nothing and kept. An empty table gives an empty result.
    """
    return _judged(documents, shingle, percent).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each_group(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """documents without near duplicates: of each component one row of the smallest doc_id stays, with documents' columns.

    Rows of one doc_id with different texts are judged apart: what has no duplicate stays. Of repeated rows (same doc_id and
    text) one stays. Texts without words and null doc_ids stay. What goes is a small part of most corpora, so it is broadcast
    where it is few enough rows.
    """
    judged = _judged(documents, shingle, percent).where("doc_id is not null")
    rows = judged.groupBy("doc_id", "key_").agg(F.first("group").alias("group"), F.first("kept").alias("kept"), F.count("*").alias("n"))
    rows = stored(rows, "judged")
    stays = rows.where("kept and group is not null").groupBy("group").agg(F.min("key_").alias("least"))  # its doc_id is the group's smallest
    gone = rows.where("group is not null").join(stays, "group").where("not kept or key_ <> least").select("doc_id", "key_")
    gone = stored(gone, "gone")
    many = rows.where("n > 1").join(small(gone)(gone), ["doc_id", "key_"], "left_anti").select("doc_id", "key_")
    many = stored(many, "many")
    key = [F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text").cast("string")).alias("key_")]
    own = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("own")
    left = documents.select(own, *key).join(small(gone)(gone), ["doc_id", "key_"], "left_anti")
    if not many.isEmpty():
        once = left.join(small(many)(many), ["doc_id", "key_"], "left_semi").groupBy("doc_id", "key_").agg(F.first("own").alias("own")).select("own")
        left = left.join(small(many)(many), ["doc_id", "key_"], "left_anti").select("own").union(once)
    return left.select(*[F.col(f"own.`{c}`").alias(c) for c in documents.columns])
