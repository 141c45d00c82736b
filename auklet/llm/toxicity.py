"""Toxic spans by a linear-chain conditional random field, and toxicity scores of documents.

Labels are given by document. They become labelled tokens through the word forms (whole words and their first letters)
that stand in many contexts in toxic sample documents and practically never in clean ones: such tokens of toxic documents are toxic, all tokens
of clean documents aren't. The field has two states and log-linear features of the word, its ends, and its neighbours; it
is fitted to lines of the sample by gradient steps on the exact likelihood. Forward-backward gives each token's marginal
probability. A document's score is a logistic function of its largest marginal, the expected number of toxic tokens and its
length; tokens with a marginal of one half or more are its offending spans. That function is cross-fitted: for each third of
the sample a field is fitted to the other two thirds, so every label counts and none is judged by a field that saw it. The field
that is used is fitted to the whole sample. Each of these fits is a task of its own; it holds words and features as numbers.
"""

from __future__ import annotations

import io
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auklet.llm.common import released, stored
from auklet.llm.decontaminate import bench_words
from auklet.llm.sample import MAX_CHARS, fold, labelled_sample

#: log2 of the number of emission weights.
BITS = 18
#: Most rows of each class that a fit sees.
PER_CLASS = 2000
#: Most lines with, and without, a toxic token that the field is fitted to, and most words of such a line; longer ones are cut.
TOXIC_LINES, PLAIN_LINES, LINE_WORDS = 5000, 10_000, 300
#: Parts of the lines that take turns in the gradient steps.
BATCHES = 12
#: Parts of the sample that are left out in turn.
FOLDS = 3
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def forms(word: bytes) -> tuple[bytes, ...]:
    """The word and its first 3 to 5 characters, marked apart."""
    text = word.decode("utf-8", "ignore")
    return (b"=" + word, *(b"%d" % k + text[:k].encode() for k in (3, 4, 5) if len(text) > k))


def _index(feature: bytes) -> int:
    return xxhash.xxh3_64_intdigest(feature) >> (64 - BITS)


#: The feature that every token has.
BIAS = _index(b"bias")


def word_features(word: bytes) -> tuple[list[int], int, int]:
    """Indexes of a word's own features, and of what it says about the word after and the word before it."""
    own = [_index(f) for f in forms(word)] + [BIAS]
    return own, _index(b"<" + word[:4]), _index(b">" + word[:4])


class Chains:
    """Lines of a batch, longest first, laid out by position, so a step of the recursion takes all lines at once."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        sorted_ = lengths[order]
        self.steps = int(sorted_[0]) if len(sorted_) else 0
        self.active = np.searchsorted(-sorted_, -np.arange(self.steps), side="left")  # lines longer than t
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        total = int(self.at[-1])
        t = np.repeat(np.arange(self.steps), self.active)
        self.token = begin[np.arange(total) - self.at[t]] + t  # slot -> token in text order

    def marginals(self, emission: np.ndarray, trans: np.ndarray, start: float, counts: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Probability of state 1 of each token, and expected transition counts (2 x 2), if asked for; emission in text order."""
        a = np.exp(trans)
        e = np.exp(np.clip(emission, -30, 30))[self.token]
        fwd, back, pairs = np.empty_like(e), np.ones_like(e), np.zeros((2, 2))
        for t in range(self.steps):
            lo, hi = self.at[t], self.at[t + 1]
            if t:
                p = fwd[self.at[t - 1] : self.at[t - 1] + hi - lo]
                fwd[lo:hi] = e[lo:hi] * (a[0, 1] + a[1, 1] * p) / (a[0, 0] + a[1, 0] * p)
            else:
                fwd[lo:hi] = e[lo:hi] * np.exp(start)
        for t in range(self.steps - 2, -1, -1):
            lo, hi = self.at[t + 1], self.at[t + 2]
            n, f = e[lo:hi] * back[lo:hi], fwd[self.at[t] : self.at[t] + hi - lo]
            back[self.at[t] : self.at[t] + hi - lo] = (a[1, 0] + a[1, 1] * n) / (a[0, 0] + a[0, 1] * n)
            if not counts:
                continue
            joint = np.stack([np.full_like(n, a[0, 0]), a[0, 1] * n, f * a[1, 0], f * a[1, 1] * n])
            pairs += (joint / joint.sum(0)).sum(1).reshape(2, 2)
        out = np.empty_like(e)
        both = fwd * back
        out[self.token] = both / (1 + both)
        return out, pairs


class _Known(dict):
    """Number of each word met, and in `sums` what its features add to its own emission, to the next word's and to the one before."""

    def __init__(self, w: np.ndarray):
        super().__init__()
        self.w, self.sums = w, np.empty((4096, 3))

    def __missing__(self, word: bytes) -> int:
        own, after, before = word_features(word)
        got = self[word] = len(self)
        if got == len(self.sums):
            self.sums = np.concatenate([self.sums, np.empty_like(self.sums)])
        self.sums[got] = self.w[own].sum(), self.w[after], self.w[before]
        return got


class Tagger:
    """Marginals of texts' tokens under fitted weights; a word's weights are summed once and remembered, up to a bound."""

    LIMIT = 400_000

    def __init__(self, model: bytes):
        m = np.load(io.BytesIO(model), allow_pickle=False)
        self.w, self.trans, self.start, self.doc = m["w"], m["trans"], float(m["start"]), m["doc"]
        self.known = _Known(self.w)

    def marginals(self, lines: list[list[bytes]]) -> np.ndarray:
        """Of all tokens of the lines, one line after another."""
        if len(self.known) > self.LIMIT:
            self.known = _Known(self.w)
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(lines)), np.int64, int(lengths.sum()))
        if not len(ids):
            return np.empty(0)
        sums = self.known.sums[ids]
        emission = sums[:, 0].copy()
        first = np.zeros(len(ids), bool)
        first[np.concatenate([[0], np.cumsum(lengths)])[:-1][lengths > 0]] = True
        inner = np.flatnonzero(~first)
        emission[inner] += sums[inner - 1, 1]
        emission[inner - 1] += sums[inner, 2]
        return Chains(lengths[lengths > 0]).marginals(emission, self.trans, self.start, counts=False)[0]

    def each(self, docs: list[list[list[bytes]]]) -> list[np.ndarray]:
        """The marginals of every document's tokens; a document is its lines."""
        p = self.marginals([line for doc in docs for line in doc])
        return np.split(p, np.cumsum([sum(map(len, doc)) for doc in docs])[:-1]) if docs else []

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores of texts, and the marginals of each text's tokens."""
        each = self.each([lines_of(t) for t in texts])
        x = np.array([document_features(q) for q in each]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.doc, -30, 30))), each


def lines_of(text: str | None) -> list[list[bytes]]:
    return [w for w in map(bench_words, text.split("\n")) if w] if text else []


def packed(w: np.ndarray, trans: np.ndarray, start: float, doc: np.ndarray) -> bytes:
    """A model's arrays as bytes."""
    out = io.BytesIO()
    np.savez_compressed(out, w=w.astype(np.float32), trans=trans, start=np.float64(start), doc=doc)
    return out.getvalue()


def document_features(p: np.ndarray) -> tuple[float, float, float, float]:
    if not len(p):
        return 1.0, 0.0, 0.0, 0.0
    top = float(p.max())
    return 1.0, 4 * top, float(np.log1p(p.sum())), float(np.log1p(len(p))) / 10


class Sample:
    """Texts as numbers: words in text order, where lines begin and whose they are, and the features of each distinct word."""

    def __init__(self, texts: list[str]):
        number: dict[bytes, int] = {}
        ids, lengths, docs = array("i"), array("q"), array("q")
        for d, text in enumerate(texts):
            for line in lines_of(text):
                ids.extend([number.setdefault(w, len(number)) for w in line])
                lengths.append(len(line))
                docs.append(d)
        self.ids, self.lengths, self.docs = np.frombuffer(ids or b"", np.int32), np.frombuffer(lengths or b"", np.int64), np.frombuffer(docs or b"", np.int64)
        self.start = np.cumsum(self.lengths) - self.lengths
        self.words, self.n_docs = len(number), len(texts)
        form: dict[bytes, int] = {}
        own = [[form.setdefault(f, len(form)) for f in forms(w)] for w in number]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)  # forms of word k are form[first[k]:first[k + 1]]
        self.form = np.fromiter(chain.from_iterable(own), np.int32, int(self.first[-1]))
        self.index = np.fromiter(map(_index, form), np.int32, len(form))[self.form] if len(form) else np.empty(0, np.int32)
        self.forms = len(form)
        self.after, self.before = (np.fromiter((_index(mark + w[:4]) for w in number), np.int32, len(number)) for mark in (b"<", b">"))

    def owners(self) -> np.ndarray:
        """The word of each place of form."""
        return np.repeat(np.arange(self.words, dtype=np.int32), np.diff(self.first))

    def sums(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each word adds to its own emission, the next word's and the one before."""
        return np.bincount(self.owners(), w[self.index], self.words) + w[BIAS], w[self.after], w[self.before]


def places(start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of runs that begin at `start`, one run after another."""
    return np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _inner(lengths: np.ndarray) -> np.ndarray:
    """The tokens of lines of these lengths (none empty) that aren't a line's first."""
    first = np.zeros(int(lengths.sum()), bool)
    first[np.cumsum(lengths) - lengths] = True
    return np.flatnonzero(~first)


def seeds(sample: Sample, ys: np.ndarray, chosen: np.ndarray, odds: float = 20.0) -> np.ndarray:
    """Whether each word of the sample has a form that stands in `odds` times as many contexts of toxic documents as of clean ones, and in one
    for each hundred toxic documents, 3 to 12, at least; over the chosen documents.

    A context is a word between its neighbours, counted once however many documents have it: so the words of a toxic text
    that was copied often don't count as often.
    """
    have, n, size = [], [], sample.words + 1
    for y in (0, 1):
        lines = np.flatnonzero((chosen & (ys == y))[sample.docs])
        lengths = sample.lengths[lines]
        ids = sample.ids[places(sample.start[lines], lengths)].astype(np.int64)
        inner = _inner(lengths)
        left, right = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        left[inner], right[inner - 1] = ids[inner - 1] + 1, ids[inner] + 1
        _, first = np.unique((left * size + ids) * size + right, return_index=True)
        contexts = np.bincount(ids[first], minlength=sample.words)
        have.append(np.bincount(sample.form, contexts[sample.owners()], sample.forms))
        n.append(max(1, len(first)))
    least = min(12, max(3, int(ys[chosen].sum()) // 100))
    toxic = (have[1] >= least) & (have[1] / n[1] >= odds * (have[0] + 0.5) / n[0])
    return np.bincount(sample.owners(), toxic[sample.form], sample.words) > 0


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - y) + l2 * w)
    return w


class _Part:
    """Lines that take a gradient step together: their words' features as sparse numbers, tags and layout."""

    def __init__(self, sample: Sample, start: np.ndarray, lengths: np.ndarray, tags: np.ndarray):
        where = places(start, lengths)
        words, ids = np.unique(sample.ids[where], return_inverse=True)
        self.ids, self.y, self.inner, self.begin = ids.astype(np.int32), tags[where].astype(float), _inner(lengths), np.cumsum(lengths) - lengths
        many = sample.first[words + 1] - sample.first[words]
        self.index = sample.index[places(sample.first[words], many)]
        self.owner = np.repeat(np.arange(len(words), dtype=np.int32), many)
        self.after, self.before, self.words = sample.after[words], sample.before[words], len(words)
        self.chains = Chains(lengths)

    def emission(self, w: np.ndarray) -> np.ndarray:
        out = (np.bincount(self.owner, w[self.index], self.words) + w[BIAS])[self.ids]
        out[self.inner] += w[self.after][self.ids[self.inner - 1]]
        out[self.inner - 1] += w[self.before][self.ids[self.inner]]
        return out

    def gradient(self, rest: np.ndarray) -> np.ndarray:
        """Of the weights, from what each token's marginal is above its tag."""
        out = np.bincount(self.index, np.bincount(self.ids, rest, self.words)[self.owner], 1 << BITS)
        out += np.bincount(self.after, np.bincount(self.ids[self.inner - 1], rest[self.inner], self.words), 1 << BITS)
        out += np.bincount(self.before, np.bincount(self.ids[self.inner], rest[self.inner - 1], self.words), 1 << BITS)
        out[BIAS] += rest.sum()
        return out


def pieces(start: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, start, length) of lines cut into even pieces of `size` tokens at most."""
    many = -(-lengths // size)
    each = -(-lengths // many)
    line = np.repeat(np.arange(len(lengths)), many)
    at = places(np.zeros(len(many), np.int64), many) * each[line]
    return line, start[line] + at, np.minimum(each[line], lengths[line] - at)


def line_marginals(sample: Sample, model: tuple, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Marginals of the tokens of lines, one line after another, under (what words add, trans, start)."""
    (own, after, before), trans, begin = model
    ids, inner = sample.ids[places(start, lengths)], _inner(lengths)
    emission = own[ids]
    emission[inner] += after[ids[inner - 1]]
    emission[inner - 1] += before[ids[inner]]
    return Chains(lengths).marginals(emission, trans, begin, counts=False)[0]


def plain_model(ys: list[int]) -> bytes:
    """A field that marks nothing, and one score for all documents: high only if all labels are 1."""
    w = np.zeros(1 << BITS)
    w[BIAS] = -30.0
    return packed(w, np.zeros((2, 2)), 0.0, np.array([-4.0 + 8.0 * min(ys, default=0), 0, 0, 0]))


def field(sample: Sample, ys: np.ndarray, chosen: np.ndarray, rounds: int = 5, seed: int = 3, toxic_lines: int = TOXIC_LINES, plain_lines: int = PLAIN_LINES, line_words: int = LINE_WORDS) -> bytes:
    """A field fitted to the chosen documents of the sample and their labels; one that marks nothing, if none has a toxic form."""
    rng = np.random.default_rng(seed)
    doc = np.repeat(sample.docs, sample.lengths)  # of each token
    tags = seeds(sample, ys, chosen)[sample.ids] & ((ys > 0) & chosen)[doc]
    named = np.bincount(doc, tags, sample.n_docs) > 0
    lines = np.flatnonzero((chosen & ((ys == 0) | named))[sample.docs])  # a toxic document without a known form has no labelled token
    _, start, lengths = pieces(sample.start[lines], sample.lengths[lines], line_words)
    tagged_before = np.concatenate([[0], np.cumsum(tags)])
    any_ = tagged_before[start + lengths] > tagged_before[start]
    toxic, plain = np.flatnonzero(any_), np.flatnonzero(~any_)
    if not len(toxic):
        return plain_model([0])
    shown = np.concatenate([rng.permutation(toxic)[:toxic_lines], rng.permutation(plain)[:plain_lines]])

    w, trans, begin = np.zeros(1 << BITS), np.zeros((2, 2)), 0.0
    w[BIAS] = -3.0
    for again in range(3):
        parts = [_Part(sample, start[x], lengths[x], tags) for x in (shown[k::BATCHES] for k in range(min(BATCHES, len(shown))))]
        w, trans, begin = _steps(parts, w, trans, begin, rounds)
        del parts
        if again < 2:
            model = sample.sums(w), trans, begin
            tops = [np.maximum.reduceat(line_marginals(sample, model, start[x], lengths[x]), np.cumsum(lengths[x]) - lengths[x]) for x in (plain[k : k + 2000] for k in range(0, len(plain), 2000))]
            tops = np.concatenate(tops) if tops else np.empty(0)
            hard = np.argsort(-tops, kind="stable")[:plain_lines]
            shown = np.concatenate([shown, plain[hard[tops[hard] > 0.05]]])  # lines that look toxic and aren't are shown again
    return packed(w, trans, begin, np.zeros(4))


def judged_features(model: bytes, sample: Sample, docs: np.ndarray) -> np.ndarray:
    """The features of documents by which the document score is fitted."""
    m = np.load(io.BytesIO(model), allow_pickle=False)
    known = sample.sums(m["w"].astype(float)), m["trans"], float(m["start"])
    out = np.empty((len(docs), 4))
    first = np.searchsorted(sample.docs, np.arange(sample.n_docs + 1))  # lines of document d are first[d] to first[d + 1]
    for k in range(0, len(docs), 256):
        some = docs[k : k + 256]
        lines = places(first[some], first[some + 1] - first[some])
        sizes = np.bincount(np.repeat(np.arange(len(some)), first[some + 1] - first[some]), sample.lengths[lines], len(some)).astype(np.int64)
        p = line_marginals(sample, known, sample.start[lines], sample.lengths[lines])
        out[k : k + 256] = [document_features(x) for x in np.split(p, np.cumsum(sizes)[:-1])]
    return out


def with_documents(model: bytes, x: np.ndarray, ys: np.ndarray) -> bytes:
    """The field's model with a document score that is fitted to features x of documents."""
    m = np.load(io.BytesIO(model), allow_pickle=False)
    return packed(m["w"], m["trans"], float(m["start"]), _logistic(x, ys.astype(float)))


def left_out(sample: Sample, y: np.ndarray, leave: int, **bounds: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(model, documents, features): a field fitted without one part of the sample, and that part's documents judged by it; part FOLDS leaves out nothing."""
    of = _folds(y)
    model, out = field(sample, y, of != leave, **bounds), np.flatnonzero(of == leave)
    return model, out, judged_features(model, sample, out)


def fit(texts: list[str], ys: list[int], **bounds: int) -> bytes:
    """A whole model from texts and labels at one place."""
    if len(set(ys)) < 2:
        return plain_model(ys)
    sample, y = Sample(texts), np.array(ys)
    judged = [left_out(sample, y, k, **bounds) for k in range(FOLDS + 1)]
    out = np.concatenate([x[1] for x in judged])
    return with_documents(judged[FOLDS][0], np.concatenate([x[2] for x in judged]), y[out])


def _folds(y: np.ndarray) -> np.ndarray:
    """The part that each row is in; classes are dealt out evenly."""
    of = np.empty(len(y), int)
    for c in np.unique(y):
        at = np.flatnonzero(y == c)
        of[at] = np.arange(len(at)) % FOLDS
    return of


def _steps(parts: list[_Part], w: np.ndarray, trans: np.ndarray, start: float, rounds: int) -> tuple:
    """Weights after `rounds` passes of gradient steps on the likelihood."""
    w_sq, t_sq, s_sq = np.full(1 << BITS, 0.1), np.full((2, 2), 1.0), 1.0
    for _ in range(rounds):  # steps along the likelihood's gradient over a part of the lines, with per-weight rates
        for part in parts:
            p, pairs = part.chains.marginals(part.emission(w), trans, start)
            y = part.y.astype(int)
            seen = np.bincount(2 * y[part.inner - 1] + y[part.inner], minlength=4).reshape(2, 2)
            g = part.gradient(p - part.y) + 0.002 * w
            gt, gs = (pairs - seen) + 0.01 * trans, float((p - part.y)[part.begin].sum()) + 0.01 * start
            w_sq, t_sq, s_sq = w_sq + g * g, t_sq + gt * gt, s_sq + gs * gs
            w, trans, start = w - 0.3 * g / np.sqrt(w_sq), trans - 0.1 * gt / np.sqrt(t_sq), start - 0.1 * gs / np.sqrt(s_sq)
    return w, trans, start


def _fitted(**bounds: int):
    """For each left-out part: its documents' labels and features; for part FOLDS, the whole field's model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"leave": [], "text": [], "y": [], "h_": []}), *frames]).sort_values(["h_", "text"])
        for leave in sorted(rows["leave"].unique()):
            own = rows[rows["leave"] == leave]
            y = own["y"].to_numpy(int)
            model, out, x = left_out(Sample(own["text"].tolist()), y, int(leave), **bounds)
            if leave == FOLDS:
                yield pd.DataFrame({"model": [model], "y": [None], "x": [None]})
            elif len(out):
                yield pd.DataFrame({"model": None, "y": y[out], "x": list(x)})

    return run


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, held: int = 2, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, **bounds: int) -> bytes:
    """The model's bytes, fitted to a bounded sample of labelled rows whose fold isn't held out.

    Labelled texts of more than max_chars characters don't enter the fit; bounds are field()'s toxic_lines, plain_lines and line_words.
    Each left-out part has a task of its own, which holds the sample as numbers; four features of each of its
    documents come back for the fit of the document score.
    """
    sample = stored(labelled_sample(documents, labels, label, parts, held, per_class, max_chars), "toxicity-sample")
    classes = [r.y for r in sample.select("y").distinct().collect()]
    if len(classes) < 2:
        return plain_model(classes)
    dealt = sample.withColumn("leave", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).repartitionByRange(FOLDS + 1, "leave")
    rows = stored(dealt.select("leave", "text", "y", "h_").mapInPandas(released(_fitted(**bounds)), "model binary, y int, x array<double>"), "toxicity-model").collect()
    judged = sorted((r.y, *r.x) for r in rows if r.model is None)
    return with_documents(next(bytes(r.model) for r in rows if r.model is not None), np.array([r[1:] for r in judged]), np.array([r[0] for r in judged]))


def _tagged(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part["text_"].to_pylist()
                scores, marginals = tagger.score(texts)
                spans = []
                for text, p in zip(texts, marginals, strict=True):
                    hit = np.flatnonzero(p >= 0.5)
                    where = [m.span() for m in _WORD.finditer(text)] if len(hit) else []
                    spans.append([{"start": where[k][0], "stop": where[k][1], "marginal": float(p[k])} for k in hit])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("marginal", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part["row_"], part["text_"], pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["row_", "text_", "score", "spans"])

    return run


def tagged(documents: DataFrame, model: bytes, at_least: float = 0.3) -> DataFrame:
    """Per row: row_ (a struct of documents' columns but text), text_, score, predicted, spans (start, stop, marginal).

    spans are offsets in code points of the original text. Null, empty and wordless texts get the score of no tokens and
    no spans. Repeated rows are scored each; other columns ride along in row_, whatever their names.
    """
    others = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    rows = documents.select((F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))).alias("row_"), F.col("text").cast("string").alias("text_"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    out = f"row_ {rows.schema['row_'].dataType.simpleString()}, text_ string, score double, spans array<struct<start:int,stop:int,marginal:double>>"
    return rows.mapInArrow(released(_tagged(shared)), out).withColumn("predicted", (F.col("score") >= at_least).cast("int"))


def toxicity(documents: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, **how: int) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row, by a model fitted on labels outside the held-out fold; how: train()'s bounds.

    Without usable labels of both classes the score is the same for all rows, and there are no spans. An empty table gives an empty result.
    """
    rows = tagged(documents.select("doc_id", "text"), train(documents, labels, parts=parts, held=held, **how))
    return rows.select("row_.doc_id", (fold(F.col("row_.doc_id"), parts) == held).alias("held_out"), "score", "predicted", "spans")


def clean_rows(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of documents that aren't judged toxic, with documents' columns."""
    kept = tagged(documents, train(documents, labels, **how)).where("predicted = 0")
    return kept.select(*[(F.col("text_") if c == "text" else F.col(f"row_.`{c}`")).alias(c) for c in documents.columns])
