"""Quality by a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes, each overlapping the next by ``CHUNK`` -
``STEP``, to the last byte. In each chunk, ``FILTERS`` learned filters of ``WIDTH`` bytes slide by ``STRIDE``;
a filter is a table of weights by place and byte, so convolution is a sum of table rows. ReLU and the
maximum over the chunk give the chunk's vector; its mean and its maximum over all chunks feed a hidden layer
and one logistic output. Chunks of a few kinds of bytes excite few filters, which is how repetition shows.

Training is by Adam on whole texts of the examples (bounded in rows and bytes, see ``examples``). Classes are
balanced in training and the output is moved to the class rates of all labels. The network is a few hundred kB
and is broadcast.

Defined results: null and empty texts are one chunk of zero bytes; long texts are read in slabs of
``SLAB`` chunks; repeated rows are scored each, but an id teaches once; if the training labels lack a class every score is the
share of label 1 among them, 1 without labels, so that nothing is rejected untaught. Extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, received, rows_of, ship
from .examples import labelled_texts

CHUNK, STEP, WIDTH, STRIDE = 512, 448, 8, 4
FILTERS, HIDDEN, SLAB = 32, 16, 64
EPOCHS, BATCH, SEED = 8, 32, 7
PLACES = (CHUNK - WIDTH) // STRIDE + 1


def chunks_of(text: bytes) -> np.ndarray:
    """One row of ``CHUNK`` bytes for each chunk, the last one padded with zeros."""
    n = 1 + max(0, -(-(len(text) - CHUNK) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {
            "filters": rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "w1": rng.normal(0, 0.2, (2 * FILTERS, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": rng.normal(0, 0.2, HIDDEN).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    def pool(self, chunks: np.ndarray, places: bool = False):
        """The chunks' vectors, and where each filter was largest."""
        p, out, where = self.p, [], []
        for a in range(0, len(chunks), SLAB):
            part = chunks[a : a + SLAB]
            act = np.take(p["filters"][0], part[:, 0 : STRIDE * PLACES : STRIDE], axis=0)
            for j in range(1, WIDTH):
                act += np.take(p["filters"][j], part[:, j : j + STRIDE * (PLACES - 1) + 1 : STRIDE], axis=0)
            if places:
                at = act.argmax(1)
                where.append(at)
                out.append(np.take_along_axis(act, at[:, None], 1)[:, 0])
            else:
                out.append(act.max(1))
        pooled = np.maximum(np.concatenate(out) + p["bias"], 0)
        return (pooled, np.concatenate(where)) if places else pooled

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Mean and maximum over each text's chunks; small texts share a slab, long ones are walked."""
        out = np.empty((len(texts), 2 * FILTERS), np.float32)
        group: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if group:
                pooled = self.pool(np.concatenate([c for _, c in group]))
                starts = np.cumsum([0, *(len(c) for _, c in group)])[:-1]
                rows = [i for i, _ in group]
                out[rows, :FILTERS] = np.add.reduceat(pooled, starts) / np.array([len(c) for _, c in group], np.float32)[:, None]
                out[rows, FILTERS:] = np.maximum.reduceat(pooled, starts)
                group.clear()

        held = 0
        for i, t in enumerate(texts):
            c = chunks_of(t)
            if len(c) > 4 * SLAB:
                total, most = np.zeros(FILTERS), np.zeros(FILTERS, np.float32)
                for a in range(0, len(c), 4 * SLAB):
                    pooled = self.pool(c[a : a + 4 * SLAB])
                    total += pooled.sum(0, dtype=float)
                    most = np.maximum(most, pooled.max(0))
                out[i] = np.concatenate([total / len(c), most])
                continue
            group.append((i, c))
            held += len(c)
            if held >= 4 * SLAB:
                flush()
                held = 0
        flush()
        return out

    def logits(self, features: np.ndarray) -> np.ndarray:
        p = self.p
        return np.maximum(features @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"][0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = np.clip(self.logits(self.features(texts)).astype(float) + self.shift, -700, 700)
        return 1 / (1 + np.exp(-z))

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss."""
        p = self.p
        chunks = [chunks_of(t) for t in texts]
        sizes = np.array([len(c) for c in chunks])
        flat, starts, owner = np.concatenate(chunks), np.cumsum([0, *sizes])[:-1], np.repeat(np.arange(len(texts)), sizes)
        pooled, where = self.pool(flat, places=True)
        most = np.maximum.reduceat(pooled, starts)
        x = np.concatenate([np.add.reduceat(pooled, starts) / sizes[:, None].astype(np.float32), most], 1)
        pre = x @ p["w1"] + p["b1"]
        h = np.maximum(pre, 0)
        dz = ((1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"][0], -30, 30))) - y) / len(y)).astype(np.float32)
        dh = dz[:, None] * p["w2"] * (pre > 0)
        dx = dh @ p["w1"].T
        dp = dx[owner, :FILTERS] / sizes[owner, None]
        top = pooled == most[owner]
        dp += dx[owner, FILTERS:] * top / np.maximum(np.add.reduceat(top.astype(np.float32), starts), 1)[owner]
        dp = (dp * (pooled > 0)).astype(np.float32)
        filters = np.zeros((WIDTH, 256 * FILTERS))
        column = np.arange(FILTERS)[None, :]
        for j in range(WIDTH):
            byte = np.take_along_axis(flat, where * STRIDE + j, 1).astype(np.int64)
            filters[j] = np.bincount((byte * FILTERS + column).ravel(), dp.ravel(), 256 * FILTERS)
        return {"filters": filters.reshape(WIDTH, 256, FILTERS).astype(np.float32), "bias": dp.sum(0), "w1": x.T @ dh, "b1": dh.sum(0), "w2": h.T @ dz, "b2": dz.sum(keepdims=True)}

    def train(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, rate: float = 4e-3) -> None:
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        steps = epochs * -(-len(texts) // BATCH)
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                pick = order[a : a + BATCH]
                t += 1
                lr = rate * (1 - t / (steps + 1))
                for k, g in self.gradients([texts[i] for i in pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network | float:
    rows, counts = labelled_texts(docs, labels, label)
    if len(counts) < 2:
        return 0.0 if counts.get(0, 0) else 1.0
    y = np.array([label for _, label, _ in rows], np.float32)
    if not 0 < y.sum() < len(y):
        return counts.get(1, 0) / sum(counts.values())
    # the smaller class is repeated until the classes are about equal
    few, many = sorted((np.flatnonzero(y == 0), np.flatnonzero(y == 1)), key=len)
    pick = np.concatenate([many, np.resize(few, len(many))]) if len(few) * 4 >= len(many) else np.concatenate([many, np.tile(few, 4)])
    net = Network()
    net.train([rows[i][2] for i in pick], y[pick])
    net.shift = math.log(counts[1] / counts[0]) - math.log(y[pick].sum() / (len(pick) - y[pick].sum()))
    return net


def score(docs: DataFrame, net: Network | float, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    shipped = ship(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received(shipped)
        for b in rows_of(batches, 512):
            s = np.full(b.num_rows, m) if isinstance(m, float) else m.score([(t.as_py() or "").encode() for t in b.column("text")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_poor(docs: DataFrame, net: Network | float, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, with all their columns."""
    shipped = ship(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received(shipped)
        for b in rows_of(batches, 512):
            s = np.full(b.num_rows, m) if isinstance(m, float) else m.score([(t.as_py() or "").encode() for t in b.column("text")])
            yield b.filter(pa.array(s >= cut))

    return docs.mapInArrow(run, docs.schema)
