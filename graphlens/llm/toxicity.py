"""Toxicity from the nearest labelled examples by exact TF-IDF cosine of whole texts.

Terms are lower-cased words and their stems (the first ``STEM`` characters), so that one stem in many inflections
is a term too. A weight is (1 + ln count) * (ln((1 + documents) / (1 + document frequency)) + 1). Frequencies are
counted over all documents for every term of the examples; a term that no example holds weighs as a term of one
document: it counts in the norm of its text and can match nothing. A text's norm is taken over all its terms.
No term is left out, and none is chosen by its class.

The examples (bounded in rows and bytes, see ``examples``) are an inverted index: for each term and each block of
``BLOCK`` examples the postings and the largest weight among them. Examples are ordered so that similar ones share
blocks. A query sums the maxima to bound the cosine with any example of a block, scores its best blocks, and then
every other block whose bound reaches the k-th best cosine; blocks below it cannot hold a neighbour. Postings of
terms that many examples share are kept as dense panels, one for each block, others as lists.

The nearest ``NEIGHBOURS`` examples vote, nearer ones more: a neighbour at cosine distance d weighs
(1 - d) ** ``FALL``. A logistic curve of the log odds of these votes, fitted on leave-one-out votes of the examples
and weighted back to the class rates of all labels, makes them a probability. The nearest examples are returned as
evidence. ``STEM``, ``FALL`` and ``NEIGHBOURS`` (the largest cut to what a fold
has) had the least log loss of the settings tried in a fourfold cross-validation of training ids.

Defined results: null and empty texts share no term with any example and get the score of a vote that is the
examples' share of label 1; neighbours that tie go by id; repeated rows are scored each; an id teaches once,
however often labels or documents repeat it; if the training labels lack a class every score is the share of label
1 among them, 0 without labels. Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, received, rows_of, ship
from .examples import labelled_texts

STEM, BLOCK, EVIDENCE = 4, 64, 3
NEIGHBOURS, FALL = (15, 60, 240, 960), 2.0
#: Terms whose postings are dense panels; texts scored at a time.
PANEL, BATCH = 512, 64
_WORD = re.compile(r"[^\W_]+").findall
Vector = tuple[np.ndarray, np.ndarray]


def terms_of(text: str | None) -> tuple[Counter, Counter]:
    """Counts of a text's words and of their stems."""
    words = _WORD((text or "").lower())
    return Counter(words), Counter([w[:STEM] for w in words if len(w) >= STEM])


class Terms:
    """Words and stems, numbered: words first."""

    def __init__(self, texts: list[str]):
        self.words: dict[str, int] = {}
        stems: dict[str, int] = {}
        for text in texts:  # one text's counts at a time: those of all would take hundreds of MB
            for own, found in zip((self.words, stems), terms_of(text)):
                for t in found:
                    own.setdefault(t, len(own))
        self.stems = {t: i + len(self.words) for t, i in stems.items()}

    def __len__(self) -> int:
        return len(self.words) + len(self.stems)

    def places(self, words: Counter, stems: Counter) -> np.ndarray:
        """-1 for a term that is not among these."""
        found = chain(map(self.words.get, words, repeat(-1)), map(self.stems.get, stems, repeat(-1)))
        return np.fromiter(found, np.int64, len(words) + len(stems))


class Weights:
    """Unit vectors of texts over the terms of the examples, normed over all their terms."""

    def __init__(self, terms: Terms, frequencies: np.ndarray, documents: int):
        self.terms = terms
        idf = np.log((1 + documents) / (1 + frequencies)) + 1
        self.idf = np.append(idf, math.log((1 + documents) / 2) + 1)  # the last is that of all other terms

    def of(self, text: str | None) -> Vector:
        words, stems = terms_of(text)
        at = self.terms.places(words, stems)
        w = (1 + np.log(np.fromiter(chain(words.values(), stems.values()), float, len(at)))) * self.idf[at]
        w = w / np.sqrt((w**2).sum()) if len(w) else w
        known = at >= 0
        return at[known], w[known]


def block_order(vectors: list[Vector], terms: int) -> np.ndarray:
    """An order in which similar vectors come together: halves along the direction in which they differ most."""
    many = np.argsort(-np.bincount(np.concatenate([i for i, _ in vectors]), minlength=terms), kind="stable")[:PANEL]
    column = np.full(terms, -1)
    column[many] = np.arange(len(many))
    dense = np.zeros((len(vectors), len(many)))
    for d, (i, w) in enumerate(vectors):
        dense[d, column[i][column[i] >= 0]] = w[column[i] >= 0]

    def halve(at: np.ndarray) -> Iterator[np.ndarray]:
        if len(at) <= BLOCK:
            yield at
            return
        x = dense[at] - dense[at].mean(0)
        axis = x[np.argmax((x**2).sum(1))]
        for _ in range(8):
            axis = x.T @ (x @ axis)
            axis /= max(np.linalg.norm(axis), 1e-300)
        order = at[np.argsort((x @ axis).round(9), kind="stable")]
        half = -(-len(at) // (2 * BLOCK)) * BLOCK
        yield from halve(order[:half])
        yield from halve(order[half:])

    return np.concatenate(list(halve(np.arange(len(vectors)))))


def _gather(start: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of all these terms in lists that begin at ``start``, and how many each term has."""
    sizes = start[terms + 1] - start[terms]
    return np.arange(sizes.sum()) + np.repeat(start[terms] - np.cumsum(sizes) + sizes, sizes), sizes


class BlockMaxIndex:
    """Postings of unit vectors by term and block, with the largest weight of each term in each block."""

    def __init__(self, vectors: list[Vector], terms: int):
        self.size, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        self.example = block_order(vectors, terms)
        slot = np.empty(self.size, np.int64)
        slot[self.example] = np.arange(self.size)
        slots = np.repeat(slot, [len(i) for i, _ in vectors])
        term, weight = np.concatenate([i for i, _ in vectors]), np.concatenate([w for _, w in vectors])
        order = np.lexsort((slots, term))
        term, slots, weight = term[order], slots[order], weight[order]
        lengths = np.bincount(term, minlength=terms)
        panel = np.argsort(-lengths, kind="stable")[:PANEL]
        self.row = np.full(terms, -1)
        self.row[panel] = np.arange(len(panel))
        row = self.row[term]
        self.panel = np.zeros((len(panel), self.blocks * BLOCK))
        self.panel[row[row >= 0], slots[row >= 0]] = weight[row >= 0]
        self.most = self.panel.reshape(len(panel), self.blocks, BLOCK).max(2)
        # of the other terms: entries (slot, weight), and above them one (block, largest weight) for each block
        term, self.slot, self.weight = term[row < 0], slots[row < 0], weight[row < 0]
        self.start = np.searchsorted(term, np.arange(terms + 1))
        key = term * self.blocks + self.slot // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.block, self.top = key[first] % self.blocks, np.maximum.reduceat(self.weight, first) if len(first) else self.weight
        self.block_start = np.searchsorted(key[first] // self.blocks, np.arange(terms + 1))

    def nearest(self, queries: list[Vector], k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """For each query the examples with the k best positive cosines (to 12 digits), best first, ties to the
        smaller example, filled up with zeros; and how many blocks were scored. Query q leaves out example
        ``leave`` + q if that is given.
        """
        n = len(queries)
        query = np.repeat(np.arange(n), [len(i) for i, _ in queries])
        term, weight = np.concatenate([i for i, _ in queries]), np.concatenate([w for _, w in queries])
        row = self.row[term]
        dense = np.zeros((n, len(self.panel)))
        dense[query[row >= 0], row[row >= 0]] = weight[row >= 0]
        query, term, weight = query[row < 0], term[row < 0], weight[row < 0]
        at, sizes = _gather(self.block_start, term)
        bound = np.bincount(np.repeat(query, sizes) * self.blocks + self.block[at], np.repeat(weight, sizes) * self.top[at], n * self.blocks).reshape(n, -1)
        bound = (bound + dense @ self.most) * (1 + 1e-9) + 1e-12
        at, sizes = _gather(self.start, term)
        slot = np.repeat(query * (self.blocks * BLOCK), sizes) + self.slot[at]
        out = np.bincount(slot, np.repeat(weight, sizes) * self.weight[at], n * self.blocks * BLOCK).astype(float).reshape(n, self.blocks, BLOCK)

        def score(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)).tolist():
                q = np.flatnonzero(wanted[:, b])
                out[q, b] += dense[q] @ self.panel[:, b * BLOCK : (b + 1) * BLOCK]

        most = k
        k = min(k + (leave >= 0), self.size)
        wave = min(self.blocks, -(-k // BLOCK) + 1)
        wanted = np.zeros((n, self.blocks), bool)
        np.put_along_axis(wanted, np.argpartition(-bound, wave - 1, axis=1)[:, :wave], True, 1)
        score(wanted)
        # what is summed so far is at most the cosine, so the k-th best of it is at most the k-th best cosine
        so_far = out.reshape(n, -1)
        more = ~wanted & (bound >= np.partition(so_far, so_far.shape[1] - k, axis=1)[:, [so_far.shape[1] - k]])
        score(more)
        out[~(wanted | more)] = 0
        cosine = np.empty((n, self.size))
        cosine[:, self.example] = out.reshape(n, -1)[:, : self.size].round(12)
        if leave >= 0:
            cosine[np.arange(n), leave + np.arange(n)] = 0
        # apart by less than the last digit, so that ties go to the smaller example; there are at most 4,000
        key = np.arange(self.size) * 2.5e-16 - cosine
        best = np.argpartition(key, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(key, best, 1), axis=1), 1)[:, :most]
        return best, np.take_along_axis(cosine, best, 1), int(wanted.sum() + more.sum())


def votes(cosine: np.ndarray, label: np.ndarray, share: float) -> np.ndarray:
    """Log odds of label 1 among each query's nearest neighbours, for each number of them; without any, of ``share``."""
    w = cosine**FALL
    for_1, of_all = np.cumsum(w * label, axis=1), np.cumsum(w, axis=1)
    at = [min(k, w.shape[1]) - 1 for k in NEIGHBOURS]
    v = (for_1[:, at] + 1e-3 * share) / (of_all[:, at] + 1e-3)
    return np.log((v + 0.01) / (1.01 - v))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients, the constant last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    c = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(c)), x.T @ (weight * (p - y)) + ridge * c)
        c -= step
        if np.abs(step).max() < 1e-9:
            break
    return c


class Model:
    """What the search needs on executors; the bounds of the examples bound it."""

    def __init__(self, weights: Weights, ids: np.ndarray, label: np.ndarray, vectors: list[Vector], prior: dict[int, int]):
        self.weights, self.ids, self.label = weights, ids, label
        self.share = float(label.mean())
        self.index = BlockMaxIndex(vectors, len(weights.terms))
        x = np.concatenate([votes(c, label[near], self.share) for a in range(0, len(vectors), BATCH) for near, c, _ in [self.index.nearest(vectors[a : a + BATCH], max(NEIGHBOURS), a)]])
        rate = np.array([prior[v] / max(1, (label == v).sum()) for v in label.tolist()])
        self.curve = fit_logistic(x, label.astype(float), rate * len(label) / rate.sum())

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        """Of each text its score and the nearest examples."""
        scores, evidence = [], []
        for a in range(0, len(texts), BATCH):
            near, cosine, _ = self.index.nearest([self.weights.of(t) for t in texts[a : a + BATCH]], max(NEIGHBOURS))
            z = votes(cosine, self.label[near], self.share) @ self.curve[:-1] + self.curve[-1]
            scores.append(1 / (1 + np.exp(-np.clip(z, -700, 700))))
            for who, c in zip(near[:, :EVIDENCE].tolist(), cosine[:, :EVIDENCE].tolist()):
                evidence.append([{"doc_id": int(self.ids[i]), "toxic": int(self.label[i]), "similarity": s} for i, s in zip(who, c) if s > 0])
        return np.concatenate(scores) if scores else np.empty(0), evidence


def document_frequencies(docs: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """In how many of all documents each of the terms occurs, and the number of documents."""
    shipped = ship(docs.sparkSession, terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = received(shipped)
        df = np.zeros(len(terms) + 1, np.int64)
        rows = 0
        for b in rows_of(batches, BATCH):
            df += np.bincount(np.concatenate([terms.places(*terms_of(t)) for t in b.column("text").to_pylist()]) + 1, minlength=len(df))
            rows += b.num_rows
        df[0] = rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at - 1), pa.array(df[at])], names=["term", "n"])

    found = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[found.column("term").to_numpy() + 1] = found.column("n").to_numpy()
    return out[1:], int(out[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model | float:
    """The model, or the only score there can be."""
    rows, counts = labelled_texts(docs, labels, label)
    if len({y for _, y, _ in rows}) < 2:
        return counts.get(1, 0) / max(1, sum(counts.values()))
    texts = [raw.decode() for _, _, raw in rows]
    terms = Terms(texts)
    weights = Weights(terms, *document_frequencies(docs, terms))
    return Model(weights, np.array([i for i, _, _ in rows]), np.array([y for _, y, _ in rows]), [weights.of(x) for x in texts], counts)


def score(docs: DataFrame, model: Model | float, cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for each row of ``docs``."""
    shipped = ship(docs.sparkSession, model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received(shipped)
        for b in rows_of(batches, 1024):
            s, evidence = (np.full(b.num_rows, m), [[]] * b.num_rows) if isinstance(m, float) else m.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32)), pa.array(evidence, kind)], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    ddl = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,toxic:int,similarity:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, ddl)


def without_toxic(docs: DataFrame, model: Model | float, cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``cut``, with all their columns."""
    shipped = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received(shipped)
        for b in rows_of(batches, 1024):
            s = np.full(b.num_rows, m) if isinstance(m, float) else m.score(b.column("text").to_pylist())[0]
            yield b.filter(pa.array(s < cut))

    return docs.mapInArrow(run, docs.schema)
