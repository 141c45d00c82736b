"""How far sources of a language are apart in their use of words, by an inverted index of corrections to a baseline.

Every source gives each kept term of its language a smoothed share p, also the terms that it doesn't have. Two sources are apart
by the sum of |p - q| over all kept terms. For terms that neither has, the difference is that of their shares of zero
counts, so each pair starts at V times that, V the number of kept terms. Postings (term, source, share) then emit
corrections only for terms that one of the two has: |p - q| less what the baseline counted for the term.

Postings are dealt by term to buckets and by source to blocks, and a bucket meets each pair of blocks that its language
has: so a task holds TERMS terms of 2 * BLOCK sources, whatever a language, a term or a source grows to, and what leaves
it is one sum for each pair of sources, not one row for each term and pair. Shares are exact integers throughout.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auklet.llm.common import released, small, stored

#: Kept terms of a bucket, on average, and sources of a block, on average.
TERMS, BLOCK = 2048, 128
#: Distinct (group, term) pairs that a task counts before it hands them on.
HELD = 300_000
#: Parts per billion, in which shares are given, and the count that every term is given on top of its own.
SCALE, PRIOR = 1_000_000_000, 5
#: Bytes of terms, lower-cased; all others separate. Bytes above 0x7F are parts of characters that belong to terms.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) summed over some rows of a task; a row with the null term for each group met."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]
            columns = [[lang] * len(terms), [source] * len(terms), [t and t.decode("utf-8", "surrogatepass") for t in terms], [0, *n.values()], [0, *map(docs.__getitem__, n)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = held[lang, source]
            words, before = terms_of(text), len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n) - before + 1
            if size >= HELD:
                yield from out()
                size = 0
    yield from out()


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a source of a language, and how many documents have it; one row
    with the null term for each group that occurs. Null text, lang and source count as ''."""
    docs = documents.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = docs.mapInArrow(released(_counted), "lang string, source string, term string, n long, docs long")
    return stored(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def _share(count, total, v) -> F.Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * v)); in decimals, as the product may pass 64 bits."""
    return F.when(v > 0, 1 + F.expr(f"((({count}) + {PRIOR}) * cast({SCALE} as decimal(12, 0))) div ({total} + {PRIOR} * v)")).otherwise(F.lit(0)).cast("long")


def _corrections(key: tuple, table: pa.Table) -> pa.Table:
    """The sum of corrections for each pair of sources of two blocks, over the terms of a bucket; the baseline comes with bucket 0.

    Rows without a term carry the share of zero counts of their source.
    """
    lang, left, right, bucket = (k.as_py() for k in key)
    zeros, posted = table.filter(pc.is_null(table["term"])), table.filter(pc.is_valid(table["term"]))
    names = {b: sorted(set(zeros.filter(pc.equal(zeros["block"], b))["source"].to_pylist())) for b in {left, right}}
    term = posted["term"].combine_chunks().dictionary_encode() if len(posted) else None
    rows, many = (term.indices.to_numpy(), len(term.dictionary)) if len(posted) else (np.empty(0, np.int64), 0)
    zero = dict(zip(zip(zeros["block"].to_pylist(), zeros["source"].to_pylist(), strict=True), zeros["p"].to_pylist(), strict=True))
    z = {b: np.array([zero[b, s] for s in names[b]], np.int64) for b in names}
    shares = {b: np.broadcast_to(z[b], (many, len(z[b]))).copy() for b in names}
    block, p = posted["block"].to_numpy(), posted["p"].to_numpy()
    sources = np.array(posted["source"].to_pylist(), object)
    for b in names:
        at = {s: k for k, s in enumerate(names[b])}
        own = np.flatnonzero(block == b)
        shares[b][rows[own], [at[s] for s in sources[own]]] = p[own]
    v = table["v"][0].as_py() if bucket == 0 else 0
    a, b, sums = [], [], []
    for k, s in enumerate(names[left]):
        others = slice(k + 1, None) if left == right else slice(None)
        base = np.abs(z[left][k] - z[right][others])
        sums.append(np.abs(shares[left][:, k : k + 1] - shares[right][:, others]).sum(axis=0) - many * base + v * base)
        a += [s] * len(base)
        b += names[right][others]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "part": pa.array(np.concatenate(sums) if sums else [], pa.int64())})


def divergence(documents: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) over documents (text, lang, source; more columns are ignored).

    Each language keeps the terms (runs of letters, A-Z lower-cased) that `least_docs` of its documents have. Every source
    that occurs in a language, also one without terms, gives each kept term the share p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)),
    N its occurrences of kept terms; so does the language as a whole. Part `pair`: item is another source of the language, value the sum
    of |p - q| over all kept terms (0 if none is kept), all ranks. Part `term`: item is a kept term that the source has and gives
    a larger share than its language does, value the difference, the `top` largest. Ranks begin at 1, value descending, equal ones by item's
    bytes. Null texts, languages and sources are ''. Repeated rows count each. An empty table gives an empty result.
    """
    counts = term_counts(documents)
    term = Window.partitionBy("lang", "term")
    known = counts.where("term is not null").withColumn("df", F.sum("docs").over(term)).withColumn("whole", F.sum("n").over(term))
    kept = stored(known.where(F.col("df") >= least_docs).select("lang", "source", "term", "n", "whole"), "kept-terms")

    langs = kept.groupBy("lang", "term").agg(F.first("whole").alias("n")).groupBy("lang")
    langs = stored(langs.agg(F.count("*").alias("v"), F.sum("n").cast("decimal(20, 0)").alias("all_")), "langs")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").cast("decimal(20, 0)").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0).cast("decimal(20, 0)")).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    groups = groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    groups = stored(groups.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).cast("int")), "groups")
    few = small(groups)

    shares = kept.join(few(groups), ["lang", "source"]).withColumn("p", _share("n", "total", F.col("v")))
    zeros = groups.withColumn("p", _share("0", "total", F.col("v"))).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    row = ["lang", "source", "term", "block", "blocks", "bucket", "p", "v"]
    placed = shares.withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets").cast("int")).select(row).union(zeros.withColumn("term", F.lit(None).cast("string")).select(row))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("lang", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "bucket", "block", "source", "term", "p", "v")
    parts = placed.groupBy("lang", "left", "right", "bucket").applyInArrow(_corrections, "lang string, a string, b string, part long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    against = shares.where("n > 0").join(few(langs.select("lang", "all_")), "lang").withColumn("q", _share("whole", "all_", F.col("v")))
    mine = against.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    mine = mine.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(out).union(mine.withColumn("part", F.lit("term")).select(out))
