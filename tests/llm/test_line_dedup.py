import random
import re
from collections import Counter

from pyspark.sql import functions as F

from auklet.llm.line_dedup import line_report, without_repeats

SCHEMA = "doc_id long, text string"


def cut(text):
    """Lines and their sentences of an ASCII text, character by character: (start, stop, words) each, in order."""
    lines, at = [], 0
    for line in (text or "").split("\n"):
        sentences, begin = [], 0
        for k in range(len(line)):
            if line[k] in ".!?" and k + 1 < len(line) and line[k + 1].isspace():
                sentences.append((begin, k + 1))
                begin = k + 1
        sentences.append((begin, len(line)))
        spans = []
        for a, b in [(0, len(line)), *sentences]:
            piece = line[a:b]
            lead, trail = len(piece) - len(piece.lstrip()), len(piece) - len(piece.rstrip())
            spans.append((at + a + lead, at + b - trail, tuple(re.findall("[a-z0-9]+", piece.lower()))))
        lines.append((spans[0], spans[1:]))
        at += len(line) + 1
    return lines


def brute(docs, min_words=1, few=1, lines=True):
    """Characters that go, by document: whole lines that were met before, and runs of such sentences."""
    first = {}
    for d, t in sorted(docs):
        for line, sentences in cut(t):
            for u in [*sentences, line]:
                if len(u[2]) >= few:
                    first.setdefault(u[2], d)
    out = {}
    for d, t in docs:
        seen, run, gone = set(), [], set()
        later = lambda u: u[2] in seen or first[u[2]] != d  # noqa: E731, B023

        def close():
            if run and sum(len(u[2]) for u in run) >= min_words:  # noqa: B023
                gone.update(range(run[0][0], run[-1][1]))  # noqa: B023
            run.clear()  # noqa: B023

        for line, sentences in cut(t):
            whole = len(line[2]) >= few and later(line)
            for u in sentences:
                if len(u[2]) >= few:
                    run.append(u) if later(u) else close()
                    seen.add(u[2])
            if whole and lines:
                gone.update(range(line[0], line[1]))
            seen.add(line[2])
        close()
        out[d] = gone
    return out


def characters(row):
    """The characters that a report takes out; its spans are in order and apart."""
    spans = [tuple(s) for s in row.spans]
    assert all(b <= c for (_, b, _), (c, _, _) in zip(spans, spans[1:]))
    return {k for a, b, _ in spans for k in range(a, b)}


def corpus(seed):
    rng = random.Random(seed)
    line = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 14))) + rng.choice((".", "!", "", "?!"))
    passages = [" ".join(line() for _ in range(8)) for _ in range(5)]
    common = line()
    return [(k, rng.choice(("", common + "\n")) + rng.choice(("\n", " ")).join(rng.choice(passages) if rng.random() < 0.15 else line() for _ in range(rng.randrange(12)))) for k in range(200)]


def test_equals_brute_force(spark):
    docs = corpus(1)
    df = spark.createDataFrame(docs, SCHEMA).withColumn("row", F.lit("x")).withColumn("spans", F.lit(3))
    for how in ({}, {"min_words": 25, "few": 3}, {"min_words": 25, "few": 3, "lines": False}, {"min_words": 8}):
        want = brute(docs, **how)
        got = {r.doc_id: r for r in line_report(df.repartition(6), **how).collect()}
        assert {d: characters(r) for d, r in got.items()} == want and sum(map(bool, want.values())) > 30, how
        cleaned, text = {r.doc_id: r for r in without_repeats(df, **how).collect()}, dict(docs)
        for d, gone in want.items():
            kept = "".join(c for k, c in enumerate(text[d]) if k not in gone)
            assert cleaned[d].text == kept and got[d].kept_chars == len(kept) and got[d].repeats_of == sorted({s[2] for s in got[d].spans})
    assert without_repeats(df).columns == df.columns


def test_rows_of_one_or_no_doc_id_keep_their_own_spans(spark):
    """Thousands of rows without an id, and of one id: each has spans by its own text, and loses nothing else."""
    passage = " ".join(f"common word{k}" for k in range(20)) + "."
    texts = [f"Own opening of row {k}.\n{passage if k % 2 else f'Nothing else in row {k}.'}\nOwn ending {k}." for k in range(3000)]
    rows = [(None if k % 3 else 9, t) for k, t in enumerate(texts)] + [(1, passage), ((1 << 63) - 1, f"Largest id.\n{passage}")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = Counter((r.doc_id, r.n_chars, tuple(s.first_doc for s in r.spans), tuple(s.stop - s.start for s in r.spans)) for r in line_report(df).collect())
    want = Counter((d, len(t), (1,) * (passage in t and d != 1), (len(passage),) * (passage in t and d != 1)) for d, t in rows)
    assert got == want
    kept = Counter((r.doc_id, r.text) for r in without_repeats(df).collect())
    assert kept == Counter((d, t if d == 1 else t.replace(passage, "")) for d, t in rows)


def test_passage_inside_other_text(spark):
    passage = "The quick brown fox jumps. " * 2 + " ".join(f"Sentence number {k} says something new about nothing at all." for k in range(8))
    docs = [(1, f"Alpha beta gamma. {passage} Delta epsilon zeta eta."), (2, f"Other words come first, {passage.upper()}\nlast line of this one."), (3, "The quick brown fox jumps. Nothing else is shared here.")]
    got = {r.doc_id: r for r in line_report(spark.createDataFrame(docs, SCHEMA), min_words=25).collect()}
    assert got[1].n_spans == 0 and got[3].n_spans == 0 and got[2].repeats_of == [1]
    assert docs[1][1][got[2].spans[0].start : got[2].spans[0].stop].endswith("NOTHING AT ALL.")


def test_edges(spark):
    long = " ".join(f"word{k}" for k in range(30))
    docs = [(5, long), (5, long), (None, long), (None, None), (6, ""), (7, " \n.\n"), (8, f"{long}\n{long}"), (9, "tiny\n" * 50_000)]
    got = sorted((r.doc_id or 0, r.n_spans) for r in line_report(spark.createDataFrame(docs, SCHEMA)).collect())
    assert got == [(0, 0), (0, 1), (5, 0), (5, 0), (6, 0), (7, 0), (8, 1), (9, 1)]
    assert line_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_of_several_short_sentences(spark):
    line = "One two three. Hi. Four five six!"
    docs = [(1, f"Fresh words here.\n{line}\nMore of them."), (2, f"Nothing else was.\n{line.upper()}\nThat is all."), (3, f"In a line {line} it stays.")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in line_report(spark.createDataFrame(docs, SCHEMA), min_words=25, few=3).collect()}
    assert got == {1: [], 2: [(18, 18 + len(line), 1)], 3: []}


def test_scripts_without_spaces(spark):
    passage = "\u8fd9\u662f\u4e00\u4e2a\u5e38\u89c1\u7684\u6bb5\u843d\u3002\u5b83\u5728\u5f88\u591a\u6587\u4ef6\u91cc\u91cd\u590d\u51fa\u73b0\uff01\u6ca1\u6709\u4eba\u77e5\u9053\u5b83\u4ece\u54ea\u91cc\u6765\u3002"
    docs = [(1, "\u65b0\u7684\u5f00\u5934\u3002" + passage), (2, "\u53e6\u4e00\u4e2a\u5f00\u5934\u3002" + passage + "\u7ed3\u5c3e\u4e0d\u540c\u3002")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in line_report(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {1: [], 2: [(6, 6 + len(passage), 1)]}


def test_rows_without_or_of_one_doc_id_rank_by_their_text(spark):
    """Of rows that share a passage one keeps it, also if none has a doc_id or all have the same; short lines go as long ones do."""
    passage = "A line that four rows without an id share with each other"
    for ids in ([None] * 4, [7] * 4):
        rows = [(d, f"own words {k}\n{passage}\nmore {k}") for k, d in enumerate(ids)]
        got = line_report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        assert sorted(r.n_spans for r in got) == [0, 1, 1, 1] and all(r.repeats_of == ([] if ids[0] is None else [7]) for r in got if r.n_spans)
        left = [r.text for r in without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()]
        assert sum(passage in t for t in left) == 1
    rows = [(k, f"fresh {k} text{k}\n{line}") for k, line in enumerate(["yes."] * 4 + ["one two."] * 4)]
    got = {r.doc_id: r.n_spans for r in line_report(spark.createDataFrame(rows, SCHEMA), min_words=25).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 1, 6: 1, 7: 1}
