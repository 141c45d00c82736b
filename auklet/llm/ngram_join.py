"""Documents with nearly the same set of n-grams, by a join over vertical fragments of the global n-gram order.

The order is that of the n-grams' 64-bit hashes, cut at the same places for all sets of like size; a set's part between two cuts
is its fragment. Two sets that are linked differ in at most h = (|a| + |b|) (100 - percent) / (100 + percent) n-grams. Sizes
form bands, so that linked sets lie in one band or in neighbours, and sets of two neighbouring bands are cut into h + 2 fragments:
so they agree in at least two whole fragments, and in one that isn't empty unless both sets have several empty ones, which count
then. Sets that agree in a fragment form a region. That is exact: no link is outside all regions.

1. Equal sets are one class (an aggregate that combines before the shuffle).
2. Each class meets the first class of each of its regions; the nearest is confirmed. So a large group of near copies becomes
   one component by one comparison for each member.
3. Regions whose members are still in several components are compared in blocks of BLOCK, never two members of one component.
   In a region of several blocks only what is outside its most common component is compared, with all the others. Each
   component's nearest partner is confirmed first, which joins most; then every pair that is left.

Pairs are met by parity bitmaps: a set flips one bit for each of its n-grams, so two bitmaps differ in no more bits than the sets
differ in n-grams; pairs that differ in more than h bits can't be linked. What remains is confirmed by counting: each
pair meets in every fragment of the order (of about FRAGMENT n-grams), partial overlaps are counted there, and summed per pair.
So a set of any length is compared in pieces of bounded size, in different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auklet.llm.common import BROADCAST_ROWS, WordHashes, lower_words, mixed, released, shingles, small, stored, text_key
from auklet.llm.components import components, regrouped

#: N-grams of a fragment in which overlaps are counted, at most on average.
FRAGMENT = 2048
#: Members of a region that one block holds, on average.
BLOCK = 2048
#: Bits of a bitmap, at least and at most.
LEAST_BITS, MOST_BITS = 256, 1 << 14
#: Rounds in which each component's nearest partner is confirmed, before all pairs that are left.
ROUNDS = 2
#: Rows whose sets are held at a time.
PIECE = 1024


@cache
def bands(percent: int) -> np.ndarray:
    """The least size of each band; a set of band k is linked with sets of bands k - 1 to k + 1 only."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(100 * least[-1] // percent + 1)
    return np.array(least)


def differ(total, percent: int):
    """How many n-grams may be in one of two linked sets only, whose sizes sum to `total`."""
    return total * (100 - percent) // (100 + percent)


@cache
def cuts(fragments: int) -> np.ndarray:
    """Where fragments of the order begin."""
    return np.array([-(-(f << 64) // fragments) for f in range(fragments)], np.uint64)


def fragment_keys(members: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the fragments of a set (sorted hashes): as the upper of two bands, and as the lower; equal keys mean equal fragments."""
    least = bands(percent)
    band = int(np.searchsorted(least, len(members), "right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(members))])
    out = []
    for upper in (band, band + 1):
        h = int(differ(2 * (int(least[upper + 1]) - 1), percent))
        if not h:
            continue  # only equal sets are linked
        at = np.append(np.searchsorted(members, cuts(h + 2)), len(members))
        key = sums[at[1:]] - sums[at[:-1]] + np.arange(1, h + 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(upper * 0xC2B2AE3D27D4EB4F % (1 << 64))
        full = at[1:] > at[:-1]
        out.append(mixed(key)[full] if h + 2 - full.sum() <= 1 else mixed(key))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def bitmap(members: np.ndarray, percent: int) -> np.ndarray:
    """Parity of the number of n-grams at each bit; the low bits of a hash give its place, so halves fold onto each other."""
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < 8 * differ(2 * len(members), percent):
        bits *= 2
    return np.packbits(np.bincount(members & np.uint64(bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little")


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all of the shortest's length."""
    width = min(map(len, maps))
    out = np.empty((len(maps), width // 8), np.uint64)
    for k, m in enumerate(maps):
        x = np.frombuffer(m, np.uint64)
        while len(x) > width // 8:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[k] = x
    return out


def ngram_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    return np.unique(shingles(hashes.of(lower_words(text)), size))


def _signed(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
            n, digest, maps, keys = [], [], [], []
            for text in batch["text"].to_pylist():
                s = ngram_set(text, size, hashes)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                maps.append(bitmap(s, percent).tobytes() if len(s) else None)
                keys.append(fragment_keys(s, percent).tobytes() if len(s) else None)
            columns = [pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, maps, keys))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key_"], *columns], names=["doc_id", "key_", "n_shingles", "digest", "map", "keys"])

    return run


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
        keys = [np.frombuffer(k, np.int64) for k in batch["keys"].to_pylist()]
        if keys:
            ids = np.repeat(batch["id"].to_numpy(zero_copy_only=False), list(map(len, keys)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids)], names=["key", "id"])


def _near(percent: int):
    """(a, b, total, apart) of the pairs whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
            apart = np.array([np.bitwise_count(np.bitwise_xor(*folded([x, y]))).sum(dtype=int) for x, y in zip(batch["map_a"].to_pylist(), batch["map_b"].to_pylist(), strict=True)], int)
            total = batch["total"].to_numpy(zero_copy_only=False)
            keep = pa.array(apart <= differ(total, percent))
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (batch["a"], batch["b"], batch["total"], pa.array(apart, pa.int64()))], names=["a", "b", "total", "apart"])

    return run


def _in_block(rows: dict[str, np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, js, apart): members of other components whose bitmaps allow a link. Side 0 meets side 1; a block of side -1 meets itself."""
    ids, comp, n = rows["id"], rows["comp"], rows["n"]
    words = folded(list(rows["map"]))
    same = rows["side"][0] < 0
    right = np.flatnonzero(rows["side"] != 0)
    for i in np.flatnonzero(rows["side"] <= 0):
        js = right[comp[right] != comp[i]]
        js = js[ids[js] > ids[i]] if same else js
        js = js[100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])]
        if len(js):
            apart = np.bitwise_count(words[js] ^ words[i]).sum(axis=1, dtype=np.int64)
            ok = apart <= differ(n[js] + n[i], percent)
            if ok.any():
                yield i, js[ok], apart[ok]


def _met(percent: int, nearest: bool):
    """(comp, a, b, total, apart) of pairs in blocks: the nearest of each component, or every pair once, under component 0.

    Rows come sorted by block, and a block may go on in the next batch.
    """

    def said(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, comp, n = rows["id"], rows["comp"], rows["n"]
        comps, of = np.unique(comp, return_inverse=True)
        best = np.full((3, len(comps)), np.iinfo(np.int64).max)  # of each component: bits apart, and the pair
        pairs: list[np.ndarray] = []
        for i, js, apart in _in_block(rows, percent):
            if nearest:
                order = np.argsort(-apart, kind="stable")  # of several partners in one component the nearest is written last
                js, apart = np.append(js[order], js[order[-1]]), np.append(apart[order], apart[order[-1]])
                c = np.append(of[js[:-1]], of[i])
                ok = apart < best[0, c]
                for row, x in enumerate((apart[ok], i, js[ok])):
                    best[row, c[ok]] = x
            else:
                pairs.append(np.stack([np.zeros(len(js), np.int64), np.full(len(js), i), js, apart]))
        known = best[0] < np.iinfo(np.int64).max
        found = np.stack([comps, best[1], best[2], best[0]])[:, known] if known.any() else np.concatenate(pairs, axis=1) if pairs else None
        if found is not None:
            c, i, j, apart = found
            columns = [c, np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), n[i] + n[j], apart]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["comp", "a", "b", "total", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch[c].to_numpy(zero_copy_only=False) for c in ("key", "pair", "side", "id", "comp", "n", "map")}
            rows = {c: np.concatenate([held[c], x]) for c, x in new.items()} if held else new
            at = np.flatnonzero((rows["key"][1:] != rows["key"][:-1]) | (rows["pair"][1:] != rows["pair"][:-1])) + 1
            ends = [0, *at.tolist()]
            for lo, hi in zip(ends, ends[1:], strict=False):
                yield from said({c: x[lo:hi] for c, x in rows.items()})
            held = {c: x[ends[-1] :] for c, x in rows.items()}
        if held:
            yield from said(held)

    return run


def _segments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
            ids, many, fragments, parts = [], [], [], []
            for k, f, text in zip(*(batch[c].to_pylist() for c in ("id", "fragments", "text")), strict=True):
                members = ngram_set(text, size, hashes)
                for at, part in enumerate(np.split(members, np.searchsorted(members, cuts(f)[1:]))):
                    if len(part):
                        ids.append(k)
                        many.append(f)
                        fragments.append(at)
                        parts.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(many, pa.int64()), pa.array(fragments, pa.int64()), pa.array(parts, pa.binary())], names=["id", "fragments", "fragment", "members"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many n-grams two sets share in a fragment."""
    for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
        sets = ((np.frombuffer(m, np.uint64) for m in batch[c].to_pylist()) for c in ("members_a", "members_b"))
        common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], batch["total"], pa.array(common, pa.int64())], names=["a", "b", "total", "common"])


class _Join:
    """What the steps share: the corpus, its classes, and the components found so far."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, percent: int):
        self.docs, self.classes, self.size, self.percent = docs, classes, size, percent
        self.groups = None

    def grouped(self, rows: DataFrame) -> DataFrame:
        known = self.groups.select(F.col("node").alias("id"), F.col("component").alias("comp"))
        return rows.join(known, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def confirm(self, pairs: DataFrame) -> None:
        """Joins the components of those pairs (a, b, total) that are linked: overlaps are counted by fragment and summed."""
        pieces = F.ceil(F.log2(F.col("total") / (2 * FRAGMENT)))
        pairs = stored(pairs.select("a", "b", "total", F.pow(F.lit(2), F.greatest(pieces, F.lit(0))).cast("long").alias("fragments")), "pairs")
        n = pairs.count()
        if not n and self.groups is not None:
            return
        wanted = pairs.select(F.col("a").alias("id"), "fragments").union(pairs.select("b", "fragments")).distinct()
        wanted = wanted.join(self.classes.select("id", "rep.*"), "id")
        texts = self.docs.join(F.broadcast(wanted) if 2 * n <= BROADCAST_ROWS else wanted, ["doc_id", "key_"])
        texts = texts.groupBy("id", "fragments").agg(F.first("text").alias("text"))
        segments = stored(texts.mapInArrow(released(_segments(self.size)), "id long, fragments long, fragment long, members binary"), "segments")
        a, b = (segments.select(F.col("id").alias(c), "fragments", "fragment", F.col("members").alias(f"members_{c}")) for c in "ab")
        met = pairs.join(a, ["a", "fragments"]).join(b, ["b", "fragments", "fragment"]).select("a", "b", "total", "members_a", "members_b")
        partial = met.mapInArrow(released(_overlaps), "a long, b long, total long, common long")
        whole = partial.groupBy("a", "b", "total").agg(F.sum("common").alias("common"))
        links = stored(whole.where((100 + self.percent) * F.col("common") >= self.percent * F.col("total")).select("a", "b"), "links")
        self.groups = components(links) if self.groups is None else regrouped(self.groups, links)

    def run(self) -> DataFrame:
        """(id, component) of classes with a link."""
        places = self.classes.select("id", "keys").mapInArrow(_planted, "key long, id long")
        regions = stored(places.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("head")).where("size > 1"), "regions")
        members = stored(places.join(small(regions)(regions), "key").select("key", "id", "head"), "members")
        maps = self.classes.select("id", "n", "map")
        a, b = (maps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("map").alias(f"map_{c}")) for c in "ab")
        meets = members.where("id > head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct().join(a, "a").join(b, "b")
        meets = meets.where(f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)").select("a", "b", F.expr("n_a + n_b").alias("total"), "map_a", "map_b")
        near = meets.mapInArrow(_near(self.percent), "a long, b long, total long, apart long")
        near = near.groupBy("b").agg(F.min_by(F.struct("a", "total"), F.struct("apart", "a")).alias("p"))
        self.confirm(near.select("p.a", "b", "p.total"))
        for _ in range(ROUNDS):
            blocks = self.blocks(members, maps)
            if blocks is None:
                return self.groups
            self.confirm(self.pairs(blocks, True))
        blocks = self.blocks(members, maps)
        if blocks is not None:
            self.confirm(self.pairs(blocks, False))
        return self.groups

    def pairs(self, blocks: DataFrame, nearest: bool) -> DataFrame:
        rows = blocks.repartition("key", "pair").sortWithinPartitions("key", "pair")
        found = rows.mapInArrow(released(_met(self.percent, nearest)), "comp long, a long, b long, total long, apart long")
        if nearest:
            found = found.groupBy("comp").agg(F.min_by(F.struct("a", "b", "total"), F.struct("apart", "a", "b")).alias("p")).select("p.*")
        return found.select("a", "b", "total").distinct()

    def blocks(self, members: DataFrame, maps: DataFrame) -> DataFrame | None:
        """Rows of blocks (key, pair, side, id, comp, n, map) of the regions that are in several components; None if none is."""
        placed = self.grouped(members.select("key", "id"))
        parts = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
        top = F.max(F.struct("n", (-F.col("comp")).alias("minus")))
        several = parts.groupBy("key").agg(F.sum("n").alias("size"), F.count("*").alias("comps"), top.alias("top")).where("comps > 1")
        several = stored(several.select("key", "size", (-F.col("top.minus")).alias("main"), F.col("top.n").alias("inside")), "several")
        if several.isEmpty():
            return None
        rows = placed.join(small(several)(several), "key")
        crowd, host, zero = F.col("size") > BLOCK, F.col("comp") == F.col("main"), F.lit(0).cast("long")
        blocks = lambda n: F.ceil(n / BLOCK).cast("long")
        outs, hosts = blocks(F.col("size") - F.col("inside")), blocks(F.col("inside"))
        rows = rows.withColumns({"outs": F.when(crowd, outs).otherwise(F.lit(1).cast("long")), "hosts": F.when(crowd, hosts).otherwise(zero), "host": crowd & host})
        rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("host"), F.col("hosts")).otherwise(F.col("outs"))))
        lone = F.transform(F.sequence(zero, F.col("outs") - 1), lambda o: F.struct((F.least("own", o) * (1 << 31) + F.greatest("own", o)).alias("pair"), F.when(F.col("own") == o, -1).when(F.col("own") < o, 0).otherwise(1).alias("side")))
        code = lambda o, h: (-1 - (o * F.col("hosts") + h)).alias("pair")
        visits = F.when(F.col("hosts") > 0, F.transform(F.sequence(zero, F.col("hosts") - 1), lambda h: F.struct(code(F.col("own"), h), F.lit(0).alias("side")))).otherwise(F.array().cast("array<struct<pair:bigint,side:int>>"))
        hosted = F.transform(F.sequence(zero, F.col("outs") - 1), lambda o: F.struct(code(o, F.col("own")), F.lit(1).alias("side")))
        rows = rows.withColumn("at", F.explode(F.when(F.col("host"), hosted).otherwise(F.concat(lone, visits))))
        return stored(rows.select("key", "at.*", "id", "comp").join(maps, "id"), "blocks")


def ngram_join(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents (doc_id, text; more columns are ignored).

    Documents are linked if percent/100 of the union of their sets of `size`-word runs is common; component_id is the
    smallest doc_id reachable over links, itself included. All links between components are found; those inside a component
    that follow from others aren't listed. Null and blank texts have an empty set and are linked with nothing. Rows that repeat
    a doc_id are judged each by its own text, and link nothing by sharing the doc_id; a null doc_id is linked with nothing. An
    empty table gives an empty result. Regions are few for thresholds of about 70 and above.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key_", text_key("text"))
    signed = stored(docs.mapInArrow(released(_signed(size, percent)), "doc_id long, key_ struct<a:bigint,b:bigint>, n_shingles long, digest binary, map binary, keys binary"), "signed")
    full = signed.where("doc_id is not null and digest is not null")
    classes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "key_")).alias("rep"), F.first("n_shingles").alias("n"), F.first("map").alias("map"), F.first("keys").alias("keys"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # written, so the ids stay

    last = _Join(docs, classes, size, percent).run().select(F.col("node").alias("id"), "component")
    groups = classes.select("digest", "id", "rep.doc_id").join(last, "id", "left").select("digest", "doc_id", F.coalesce("component", "id").alias("group"))
    groups = stored(groups, "groups")
    least = groups.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    owners = groups.join(least, "group").select("digest", "component_id")
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(owners, "digest", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
