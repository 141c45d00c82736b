"""The highest-scoring documents of each query, by an index of postings in the order of their impact.

A first scan of the texts keeps, for each document, the queries' terms that it has, and its length; numbers of the whole corpus come
from that table. A second one cuts it into blocks of documents. In a block a term's postings are grouped by impact (what
the term adds to a document's score: an integer, so equal impacts are exact), largest first. A query's groups are processed
in that order over all its terms, score at a time, into accumulators. A document whose accumulator isn't among the best yet
can gain no more than the largest impact that each term has left; as soon as that leaves it below the k-th best score that the task
knows, of this block or an earlier one, processing stops, and the scores of the documents that can still be among the best are
completed from their own postings. So only provably lower documents stay incomplete, and the result is exact.

Each task hands on k rows a query at most. A large set of queries is dealt to batches, which are searched one after
another over the first scan's table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auklet.llm.common import released, stored
from auklet.llm.decontaminate import bench_words

#: Terms of queries, repeats included, that one batch of queries holds on average.
BATCH_TERMS = 500_000
#: Postings of a block of documents.
BLOCK_POSTINGS = 400_000
#: Groups of equal impact that are processed before the first look at the bounds; twice as many before each further one.
STEP = 64
#: Documents whose scores are completed at most; while more can be among the best, processing goes on.
LOOKED_UP = 1000
#: Weights are natural logarithms in thousandths; an impact is a weight times a saturated count in millionths; B percent of length counts.
WEIGHT, COUNT, SATURATION, B = 1000, 1_000_000_000, 1000, 90
#: Parts into which a query's rows are dealt before its last ranking.
PARTS = 64


def _scanned(wanted):
    """(doc_id, n, terms, counts): each document's number of terms, and the wanted ones (all, if None) with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted.value
        for batch in batches:
            n, found = [], []
            for text in batch["text"].to_pylist():
                words = bench_words(text)
                n.append(len(words))
                found.append(Counter(words if known is None else compress(words, map(known.__contains__, words))))
            at = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            terms = pa.array([t.decode("utf-8", "surrogatepass") for f in found for t in f], pa.string())
            counts = pa.array([c for f in found for c in f.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, terms), pa.ListArray.from_arrays(at, counts)], names=["doc_id", "n", "terms", "counts"])

    return run


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All places of the ranges start to stop, one range after another."""
    size = stop - start
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Block:
    """Postings of some documents (doc ascending): of each term, groups of equal impact, largest first; and of each document, its terms."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, terms: int):
        self.docs, self.own_term, self.own_impact = docs, term, impact
        self.own = np.searchsorted(doc, np.arange(docs + 1))  # postings of document d are own[d] to own[d + 1]
        order = np.lexsort((-impact, term))
        self.doc, self.impact, self.term = doc[order], impact[order], term[order]
        new = np.ones(len(order), bool)
        new[1:] = (self.term[1:] != self.term[:-1]) | (self.impact[1:] != self.impact[:-1])
        self.start = np.flatnonzero(new)  # of each group of one term and impact
        self.stop = np.append(self.start[1:], len(order))
        self.first = np.searchsorted(self.term[self.start], np.arange(terms + 1))  # groups of term t are first[t] to first[t + 1]
        self.asked = np.zeros(terms, bool)

    def best(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): all that can be among the k best, with whole scores, if they score `floor` (and 1) at least."""
        groups = _ranges(self.first[terms], self.first[terms + 1])
        groups = groups[np.argsort(-self.impact[self.start[groups]], kind="stable")]
        own = self.term[self.start[groups]]
        acc = np.zeros(self.docs, np.int64)
        at, step, bar = 0, STEP, max(floor, 1)
        while True:
            left = self._left(groups[at:], own[at:])
            if self.docs >= k:
                bar = max(bar, int(np.partition(acc, -k)[-k]))
            if left < bar:  # a document without a posting so far can't reach the bar
                may = np.flatnonzero(acc + left >= bar)
                if len(may) <= LOOKED_UP or not left:
                    break
            now = groups[at : at + step]
            where = _ranges(self.start[now], self.stop[now])
            np.add.at(acc, self.doc[where], self.impact[where])
            at, step = at + step, 2 * step
        if left:
            acc[may] = self._completed(may, terms)
        whole = may[acc[may] >= bar]
        return whole, acc[whole]

    def _left(self, groups: np.ndarray, own: np.ndarray) -> int:
        """The most that groups which aren't processed yet can add to a document: the largest impact of each term."""
        _, head = np.unique(own, return_index=True)
        return int(self.impact[self.start[groups[head]]].sum())

    def _completed(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Whole scores of a few documents, from their own postings."""
        self.asked[terms] = True
        where = _ranges(self.own[docs], self.own[docs + 1])
        gain = np.where(self.asked[self.own_term[where]], self.own_impact[where], 0)
        self.asked[terms] = False
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, np.repeat(np.arange(len(docs)), self.own[docs + 1] - self.own[docs]), gain)
        return out


def _searched(shared, k: int, postings: int):
    """Rows (item, score, doc_id) of a task: the k best documents for each query; doc_ids in no order for equal ones only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, weight, items, n_docs, length = shared.value
        values = pa.array([c.decode("utf-8", "surrogatepass") for c in code], pa.string())
        top = [(np.empty(0, np.int64),) * 3 for _ in items]  # scores, doc_ids, nulls

        def search(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts)
            terms, counts = table["terms"].combine_chunks(), table["counts"].combine_chunks()
            each = np.diff(terms.offsets.to_numpy())
            spot = pc.index_in(terms.flatten(), values).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(table.num_rows), each)
            known = ~np.isnan(spot) if spot.dtype.kind == "f" else np.ones(len(spot), bool)
            doc, spot, tf = doc[known], spot[known].astype(np.int64), counts.flatten().to_numpy()[known]
            m = (100 - B) + (B * table["n"].to_numpy() * n_docs) // max(1, length)
            impact = weight[spot] * ((COUNT * tf) // (SATURATION * tf + 8 * m[doc]))
            some = impact > 0
            block = Block(doc[some], spot[some], impact[some], table.num_rows, len(code))
            ids = table["doc_id"].combine_chunks()
            null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy()
            for q, wanted in enumerate(items):
                had = top[q]
                found, scores = block.best(wanted, k, int(had[0][-1]) if len(had[0]) == k else 0)
                if len(found):
                    s, d, x = (np.concatenate(y) for y in zip(had, (scores, ids[found], null[found]), strict=True))
                    order = np.lexsort((d, x, -s))[:k]
                    top[q] = s[order], d[order], x[order]

        parts, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = len(part["terms"].flatten())
                if size and size + n > postings:
                    search(parts)
                    parts, size = [], 0
                parts.append(part)
                size += n
        if parts:
            search(parts)
        item = np.repeat(np.arange(len(items)), [len(x[0]) for x in top])
        score, ids, null = (np.concatenate([x[c] for x in top]) if top else np.empty(0, np.int64) for c in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(ids, mask=null.astype(bool))], names=["query_", "score", "doc_id"])

    return run


def search(documents: DataFrame, queries: DataFrame, k: int = 10, batch_terms: int = BATCH_TERMS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each query; fewer, if fewer score.

    documents (doc_id, text) and queries (item_id, text) may have more columns, which are ignored. Terms are runs of letters,
    digits and characters beyond ASCII, with A-Z lower-cased; null and empty texts have none. Equal scores rank by doc_id, null last. Every row of documents
    is one document, also if its doc_id repeats. Queries that share an item_id, null included, are one query of all their terms.
    Whole texts count. batch_terms and block_postings bound memory and change no result. An empty table on either side gives an empty result.
    """
    spark = documents.sparkSession
    asked = queries.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text"))
    terms = asked.mapInArrow(_asked(), f"item_id {asked.schema['item_id'].dataType.simpleString()}, term string").distinct()
    terms = stored(terms.withColumn("item_", F.struct("item_id")), "query-terms")
    vocabulary = terms.select("term").distinct()
    wanted = None
    if vocabulary.count() <= batch_terms:  # else the whole table of terms is kept, and the batches below look up theirs
        wanted = spark.sparkContext.broadcast({r.term.encode("utf-8", "surrogatepass") for r in vocabulary.collect()})
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = stored(rows.mapInArrow(released(_scanned(wanted)), "doc_id long, n long, terms array<string>, counts array<long>"), "scanned")
    whole = docs.agg(F.sum((F.col("n") > 0).cast("long")).alias("n"), F.sum("n").alias("length")).first()
    n_docs, length = whole.n or 0, whole.length or 0
    held = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(WEIGHT * F.log((F.lit(2 * n_docs + 2).cast("double")) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = stored(terms.join(held, "term").select("item_", "term", weight.alias("weight")), "weighted")

    batches = max(1, -(-terms.count() // batch_terms))
    found = None
    for b in range(batches):
        own = weighted.where(F.pmod(F.xxhash64("item_"), F.lit(batches)) == b).groupBy("item_").agg(F.collect_list(F.struct("term", "weight")).alias("terms")).collect()
        if not own:
            continue
        code: dict[bytes, int] = {}
        weights: list[int] = []
        items = []
        for r in own:
            for t in r.terms:
                if code.setdefault(t.term.encode("utf-8", "surrogatepass"), len(code)) == len(weights):
                    weights.append(t.weight)
            items.append(np.array(sorted(code[t.term.encode("utf-8", "surrogatepass")] for t in r.terms)))
        shared = spark.sparkContext.broadcast((list(code), np.array(weights, np.int64), items, n_docs, length))
        best = docs.where("size(terms) > 0").select("doc_id", "n", "terms", "counts").mapInArrow(released(_searched(shared, k, block_postings)), "query_ long, score long, doc_id long")
        names = spark.createDataFrame([(q, r.item_) for q, r in enumerate(own)], f"query_ long, item_ {terms.schema['item_'].dataType.simpleString()}")
        ranked = _ranked(best, k).join(F.broadcast(names), "query_").select("item_.item_id", "rank", "doc_id", "score")
        found = ranked if found is None else found.union(ranked)
    if found is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return found


def _ranked(best: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; in parts first, as every task of a large corpus hands on k."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    best = best.withColumn("part_", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_", "part_").orderBy(*order))).where(F.col("rank") <= k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_").orderBy(*order))).where(F.col("rank") <= k)


def _asked():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(bench_words(t))) for t in batch["text"].to_pylist()]
            at = np.repeat(np.arange(batch.num_rows), list(map(len, found)))
            yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(at, pa.int64())), pa.array([t.decode("utf-8", "surrogatepass") for f in found for t in f], pa.string())], names=["item_id", "term"])

    return run
