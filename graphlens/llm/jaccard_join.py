"""Exact self-join of documents whose sets of word 5-grams have a Jaccard similarity of at least 0.75.

A set is kept as 64-bit hashes. Documents with the same set are one class and are worked on once.

Classes are known by a 64-bit hash of their set; sets that differ in a second one are told apart, so that only an
agreement in 128 bits could confuse two.

Meeting. In one order of all 5-grams, two sets that link share one of the first n - ceil(0.75 n) + 1 of either
(the prefix), so classes that share no prefix hash cannot link. The order puts frequent 5-grams last, by a
sketch of counters, one for about ``PER_COUNTER`` 5-grams (at most 2 ** 24), over the 5-grams of all documents, so passages that many documents
share stay out of prefixes. The order decides only what work there is, never the result. Classes meet by a shuffle of
their prefixes; frequent 5-grams, which large families of near copies have in their prefixes after all, are summed
up before it and joined, so that adaptive execution can split them.

Count vectors. The hashes of a set fall into groups by their leading bits, about four to a group; the counts are
the class's point, and what two sets share is at most the summed minima of their counts. Pairs
that cannot reach 0.75 under that bound are dropped. A second vector has two to four groups to a hash and keeps
counts modulo 2: the groups in which two sets differ are at most as many as the members that they do not
share, which bounds the overlap closely. What is left is verified on the sets themselves.

Rounds keep pairs few without losing a link. A run (classes that share a prefix hash) of up to ``FAMILY`` classes is
put into an R-tree of its points, which is joined with itself under the bounds; of the pairs that come out, each class
keeps its ``BEST`` closest, and verified links join components. A larger run, which only a large family of near copies
makes, first has all its classes paired with its smallest one; what still holds several components then goes through the
tree like the others. Last, runs of which pairs were left out and that still hold several components are joined again
and every pair of different components is verified. A pair is left unverified only if its ends are connected
already, so near copies by the thousand cost a few checks each and no link between components is lost.
Classes carry their ``FIRST`` largest open runs, so that a pair seen to share an earlier run is left to that run, and runs
all of whose pairs are left to others are not joined.

Defined results: words are split at spaces and \\t to \\r after lower-casing A-Z; fewer than five words make
one n-gram of all of them; null and wordless texts have an empty set and link with nothing, not even with
each other; repeated rows and equal ids count each, and a component's id is the smallest id in it; a
null id never names a component that has another; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of, small_table, unused
from .components import components

WORDS, NUM, DEN = 5, 3, 4
#: The sketch of frequencies has a counter for about so many 5-grams, and at least and at most 2 ** this many.
PER_COUNTER, SKETCH_BITS = 32, (14, 24)
PASS = 400_000
#: A filter of ids has so many bits for each, and at most 2 ** this many (32 MB); beyond it ids are joined.
PER_ID, BLOOM_BITS = 8, 28
LEAF = 32
#: Runs of more classes than this are joined to their smallest class before the tree.
FAMILY = 256
#: Classes of one part of a run; a task holds two parts at most.
PART_ROWS = 2048
BEST = 2
#: Pairs of a unit that are held before the closest are chosen among them.
HELD = 200_000
FIRST = 6
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``raw`` begins, and its hash: a polynomial over its bytes, mixed with its length.

    All words at once: differences of one running sum, moved to a common power.
    """
    dense = ~_SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(dense.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    powers, inverse = _powers(len(raw) + 1)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=run[1:])
    return start, mix64((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64) * _ODD[4])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least ``n`` of them."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS.clear()
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            each = np.full(size, x, np.uint64)
            each[0] = 1
            _POWERS.append(np.cumprod(each, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct 5-gram hashes of each text, ascending. Texts share passes of about ``PASS`` bytes."""
    group: list[bytes] = []

    def done() -> Iterator[np.ndarray]:
        start, w = word_hashes(b" ".join(group))
        at = np.searchsorted(start, np.cumsum([0, *(len(g) + 1 for g in group)]))
        n = max(0, len(w) - WORDS + 1)
        grams = w[:n] * _ODD[0]
        for i in range(1, WORDS):
            grams += w[i : n + i] * _ODD[i]
        grams = mix64(grams)
        for s, e in zip(at.tolist(), at[1:].tolist()):
            if e - s >= WORDS:
                own = np.sort(grams[s : e - WORDS + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif e > s:
                yield mix64((w[s:e] * np.array(_ODD[: e - s])).sum(keepdims=True) + np.uint64(e - s))
            else:
                yield np.empty(0, np.uint64)
        group.clear()

    size = 0
    for t in texts:
        group.append((t or "").encode().lower())
        size += len(group[-1])
        if size >= PASS:
            yield from done()
            size = 0
    if group:
        yield from done()


def group_counts(hashes: np.ndarray) -> bytes:
    """Counts by leading bits, one byte each, held at 255; 16 to 4096 groups, about four hashes in each."""
    bits = min(12, max(4, len(hashes).bit_length() - 2))
    return np.minimum(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def fold(counts: np.ndarray, groups: int) -> np.ndarray:
    """The counts that fewer groups would have; the last axis shrinks."""
    if counts.shape[-1] == groups:
        return counts
    return np.minimum(counts.reshape(*counts.shape[:-1], groups, -1).sum(-1, dtype=np.int64), 255).astype(np.uint8)


def group_parity(hashes: np.ndarray) -> bytes:
    """Counts modulo 2, packed, by leading bits; a power of two of groups, 2 to 4 for each hash."""
    bits = max(6, (2 * len(hashes)).bit_length())
    return np.packbits((np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).astype(np.uint8)).tobytes()


def fold_parity(packed: bytes, size: int) -> bytes:
    """The parity vector of ``size`` bytes."""
    while len(packed) > size:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).reshape(-1, 2)
        packed = np.packbits(bits[:, 0] ^ bits[:, 1]).tobytes()
    return packed


def parity_apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many groups the vectors of each pair differ."""
    out = np.zeros(len(x), np.int64)
    sizes = np.array([min(len(a), len(b)) for a, b in zip(x, y)], np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        for part in np.array_split(at, max(1, len(at) * size // 4_000_000)):
            a, b = (np.frombuffer(b"".join(fold_parity(v[i], size) for i in part.tolist()), np.uint64).reshape(len(part), -1) for v in (x, y))
            out[part] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    return out


def may_link(na, nb, apart, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold if their counts are ``apart`` in sum of absolute
    differences: the shared part is then at most (na + nb - apart) / 2, the summed minima.
    """
    return (num + den) * (na + nb - apart) >= 2 * num * (na + nb)


def links(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return den * shared >= num * (len(a) + len(b) - shared)


def sketch_bits(grams: float, per: int = PER_COUNTER) -> int:
    """Bits of a sketch that counts so many hashes, about ``per`` to a counter."""
    return min(max(int(math.log2(max(1.0, grams / per))), SKETCH_BITS[0]), SKETCH_BITS[1])


def frequency_levels(rows: DataFrame, bits: int, hashes=lambda b: shingle_sets(b.column(0).to_pylist())) -> np.ndarray:
    """A level for each of 2 ** bits counters: 0 for the usual, more for each doubling beyond what chance gives.

    ``hashes`` makes the sets of hashes of a batch of ``rows``; a hash counts by its leading bits.
    """
    size, blocks = 1 << bits, 64
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint32)
        for b in batches:
            held, n = [], 0
            for s in hashes(b):
                held.append(s)
                n += len(s)
                if n > 500_000:
                    np.add.at(counts, (np.concatenate(held) >> shift).astype(np.int64), np.uint32(1))
                    held, n = [], 0
            if held:
                np.add.at(counts, (np.concatenate(held) >> shift).astype(np.int64), np.uint32(1))
        if counts.any():
            parts = counts.reshape(blocks, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in rows_of(batches, 64):
            for k, c in zip(b.column("block").to_pylist(), b.column("counts")):
                more = np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
                total[k] = total[k] + more if k in total else more.astype(np.uint64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], names=["block", "counts"])

    sketch = rows.mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, counts binary")
    found = {r["block"]: np.frombuffer(zlib.decompress(r["counts"]), np.uint64) for r in sketch.collect()}
    if not found:
        return np.zeros(size, np.uint8)
    counts = np.concatenate([found[k] for k in range(blocks)]).astype(float)
    mean = counts.mean()
    usual = mean + 6 * math.sqrt(mean) + 8
    return np.where(counts > usual, np.minimum(15, 1 + np.floor(np.log2(np.maximum(counts, 1) / usual))), 0).clip(0, 15).astype(np.uint8)


def document_sets(docs: DataFrame, levels) -> DataFrame:
    """doc_id, n, sig, twin, prefix, usual, counts, parity for each row: of the prefix the first ``usual`` grams are
    not frequent, ``twin`` is a second signature. ``levels`` is a broadcast of ``frequency_levels``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        shift = np.uint64(65 - len(level).bit_length())
        for b in rows_of(batches, 1024):
            n, sig, twin, prefix, usual, counts, parity = [], [], [], [], [], [], []
            for h in shingle_sets(b.column("text").to_pylist()):
                n.append(len(h))
                sig.append(signature(h))
                twin.append(second_signature(h))
                if len(h):
                    of = level[(h >> shift).astype(np.int64)]
                    order = np.argsort(of, kind="stable")[: len(h) - -(-NUM * len(h) // DEN) + 1]
                    prefix.append(h[order].view(np.int64))
                    usual.append(int((of[order] == 0).sum()))
                    counts.append(group_counts(h))
                    parity.append(group_parity(h))
                else:
                    prefix.append(np.empty(0, np.int64))
                    usual.append(0)
                    counts.append(b"")
                    parity.append(b"")
            ends = np.cumsum([0, *map(len, prefix)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix) if prefix else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(twin, pa.int64()), lists, pa.array(usual, pa.int32()), pa.array(counts, pa.binary()), pa.array(parity, pa.binary())], names=["doc_id", "n", "sig", "twin", "prefix", "usual", "counts", "parity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, sig long, twin long, prefix array<long>, usual int, counts binary, parity binary")


def signature(h: np.ndarray) -> int | None:
    if not len(h):
        return None
    both = np.array([h.sum(), mix64(h + np.uint64(len(h))).sum()], np.uint64)
    return int(mix64(both[:1] * _ODD[0] + mix64(both[1:]))[0].astype(np.int64))


def second_signature(h: np.ndarray) -> int | None:
    """From sums of its own, so that two sets agree in both with a chance of one in 2 ** 128."""
    if not len(h):
        return None
    return int(mix64(np.array([mix64(h * _ODD[1] + _ODD[2]).sum(), mix64(h ^ _ODD[3]).sum()], np.uint64)).sum().astype(np.int64))


def told_apart(rows: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The rows, with another ``sig`` where different sets have the same, and for each such ``sig`` the twin that kept it.

    Of 10 ** 10 sets a few pairs are expected to share 64 bits; they are few enough to be listed.
    """
    shared = rows.filter("n > 0").groupBy("sig").agg(F.min("twin").alias("kept"), F.max("twin").alias("other")).filter("kept <> other").select("sig", "kept")
    found = {r["sig"]: r["kept"] for r in shared.collect()}
    if found:
        listed = F.broadcast(small_table(rows.sparkSession, [{"sig": s, "kept": t} for s, t in found.items()], "sig long, kept long"))
        moved = F.when(F.col("twin") != F.col("kept"), F.xxhash64("sig", "twin")).otherwise(F.col("sig"))
        rows = rows.join(listed, "sig", "left").withColumn("sig", F.when(F.col("kept").isNull(), F.col("sig")).otherwise(moved)).drop("kept")
    return rows, found


def hot_runs(entries: DataFrame) -> DataFrame:
    """As ``shared_runs`` for frequent h: smallest sig and number are summed up before the shuffle, and the join that
    gives them to the entries can be split where one h has very many.
    """
    runs = entries.groupBy("h").agg(F.min("sig").alias("pivot"), F.count("*").alias("k")).filter("k > 1").select("h", "pivot")
    return entries.join(runs.hint("merge"), "h").select("h", "sig", "pivot")


def shared_runs(entries: DataFrame) -> DataFrame:
    """From (h, sig): h, sig, pivot of all entries whose h has several; the pivot is the run's smallest sig.

    The rows of a run come one after another and are never held together. For h that are not frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # hash, sig of the last entry so far, its run's pivot, whether it is out already
        for b in batches:
            h, s = b.column("h").to_numpy(), b.column("sig").to_numpy()
            fresh = True
            if last is not None:
                h, s, fresh = np.concatenate([[last[0]], h]), np.concatenate([[last[1]], s]), not last[3]
            if not len(h):
                continue
            new = np.concatenate([[True], h[1:] != h[:-1]])
            starts = np.flatnonzero(new)
            pivot = s[starts].copy()
            if last is not None:
                pivot[0] = last[2]
            lengths = np.diff(np.append(starts, len(h)))
            pivots = np.repeat(pivot, lengths)
            out = np.repeat(lengths > 1, lengths)
            if not fresh:
                out[0] = False
            shown = bool(lengths[-1] > 1 or (len(starts) == 1 and not fresh))
            last = (h[-1], s[-1], pivots[-1], shown)
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[out]), pa.array(s[out]), pa.array(pivots[out])], names=["h", "sig", "pivot"])

    return entries.repartition("h").sortWithinPartitions("h", "sig").mapInArrow(run, "h long, sig long, pivot long")


def bounded_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that may link by their count vectors."""
    side = lambda x: classes.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("counts").alias(f"c{x}"), F.col("parity").alias(f"p{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"{DEN} * least(na, nb) >= {NUM} * greatest(na, nb)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 2048):
            ca, cb = b.column("ca").to_pylist(), b.column("cb").to_pylist()
            groups = np.array([min(len(x), len(y)) for x, y in zip(ca, cb)])
            apart = np.zeros(b.num_rows, np.int64)
            for g in np.unique(groups).tolist():
                pick = np.flatnonzero(groups == g).tolist()
                x, y = (np.stack([fold(np.frombuffer(c[i], np.uint8), g) for i in pick]) for c in (ca, cb))
                apart[pick] = np.abs(x.astype(np.int16) - y).sum(1)
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            keep = may_link(na, nb, apart)
            pick = np.flatnonzero(keep)
            pa_, pb_ = (b.column(c).take(pa.array(pick)).to_pylist() for c in ("pa", "pb"))
            keep[pick] = may_link(na[pick], nb[pick], parity_apart(pa_, pb_))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], names=["a", "b"])

    return sized.select("a", "b", "na", "nb", "ca", "cb", "pa", "pb").mapInArrow(run, "a long, b long")


class RTree:
    """Points bulk-loaded by halving the widest dimension; nodes keep the largest counts and the smallest and
    largest size below them. With ``second``, the marked points are a tree of their own and only pairs across
    the two are looked for.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, second: np.ndarray):
        self.points, self.sizes = points, sizes
        self.nodes: list[tuple] = []  # upper counts, smallest, largest size, members or children
        scaled = np.column_stack([points.astype(np.float32), (sizes / 4).astype(np.float32)])
        self.root = self._build(np.flatnonzero(~second), scaled)
        self.other = self._build(np.flatnonzero(second), scaled) if second.any() else self.root

    def _build(self, at: np.ndarray, scaled: np.ndarray) -> int:
        if len(at) <= LEAF:
            below, top, lo, hi = None, self.points[at].max(0), self.sizes[at].min(), self.sizes[at].max()
        else:
            spread = np.ptp(scaled[at], axis=0)
            order = at[np.argsort(scaled[at, spread.argmax()], kind="stable")]
            below = tuple(self._build(part, scaled) for part in (order[: len(at) // 2], order[len(at) // 2 :]))
            top = np.maximum(self.nodes[below[0]][0], self.nodes[below[1]][0])
            lo, hi = (f(self.nodes[below[0]][i], self.nodes[below[1]][i]) for f, i in ((min, 1), (max, 2)))
        self.nodes.append((top, lo, hi, at, below))
        return len(self.nodes) - 1

    def _may(self, x: tuple, y: tuple) -> bool:
        shared = int(np.minimum(x[0], y[0]).sum(dtype=np.int64)) if max(x[0].max(), y[0].max()) < 255 else min(x[2], y[2])
        return (NUM + DEN) * min(shared, x[2], y[2]) >= NUM * (x[1] + y[1]) and DEN * min(x[2], y[2]) >= NUM * max(x[1], y[1])

    def leaf_pairs(self, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Members of leaves that may hold linking pairs of different labels."""
        one = [len(np.unique(label[n[3]])) == 1 for n in self.nodes]
        stack = [(self.root, self.other)]
        while stack:
            i, j = stack.pop()
            x, y = self.nodes[i], self.nodes[j]
            if one[i] and one[j] and label[x[3][0]] == label[y[3][0]] or not self._may(x, y):
                continue
            if x[4] is None and y[4] is None:
                yield x[3], y[3]
            elif i == j:
                stack += [(x[4][0], x[4][0]), (x[4][0], x[4][1]), (x[4][1], x[4][1])]
            elif y[4] is None or (x[4] is not None and len(x[3]) >= len(y[3])):
                stack += [(c, j) for c in x[4]]
            else:
                stack += [(i, c) for c in y[4]]


_NONE = np.int64(2**63 - 1)


def tree_pairs(sig: np.ndarray, n: np.ndarray, label: np.ndarray, counts: list[bytes], parity: list[bytes], earlier: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of different labels and with no common value in ``earlier`` (places of the ends, and how far apart) that the bound lets through, each once, by an R-tree over 16 groups, then the
    finest counts that both have, then their parities. Where some rows are ``second``, only pairs of one of them
    with one of the others.
    """
    fine = [np.frombuffer(c, np.uint8) for c in counts]
    tree = RTree(np.stack([fold(c, 16) for c in fine]), n, second)
    folded: dict[tuple[int, int], np.ndarray] = {}

    def at(i: int, g: int) -> np.ndarray:
        if len(fine[i]) == g:
            return fine[i]
        if (i, g) not in folded:
            if len(folded) > 4000:
                folded.clear()
            folded[i, g] = fold(fine[i], g)
        return folded[i, g]

    for x, y in tree.leaf_pairs(label):
        same = x is y
        ok = label[x][:, None] != label[y][None, :]
        if same:
            ok &= np.tri(len(x), k=-1, dtype=bool)
        ok &= DEN * np.minimum(n[x][:, None], n[y][None, :]) >= NUM * np.maximum(n[x][:, None], n[y][None, :])
        coarse = np.abs(tree.points[x].astype(np.int16)[:, None, :] - tree.points[y].astype(np.int16)[None, :, :]).sum(2)
        i, j = np.nonzero(ok & may_link(n[x][:, None], n[y][None, :], coarse))
        i, j = x[i], y[j]
        fresh = ~((earlier[i][:, :, None] == earlier[j][:, None, :]) & (earlier[i][:, :, None] != _NONE)).any((1, 2))
        i, j = i[fresh], j[fresh]
        keep = np.zeros(len(i), bool)
        groups = np.array([min(len(fine[p]), len(fine[q])) for p, q in zip(i.tolist(), j.tolist())], np.int64)
        for g in np.unique(groups).tolist():
            pick = np.flatnonzero(groups == g)
            p, q = np.stack([at(k, g) for k in i[pick].tolist()]), np.stack([at(k, g) for k in j[pick].tolist()])
            keep[pick] = may_link(n[i[pick]], n[j[pick]], np.abs(p.astype(np.int16) - q).sum(1))
        i, j = i[keep], j[keep]
        apart = parity_apart([parity[k] for k in i.tolist()], [parity[k] for k in j.tolist()])
        keep = may_link(n[i], n[j], apart)
        if keep.any():
            i, j = i[keep], j[keep]
            yield i, j, apart[keep] / (n[i] + n[j])


def closest(i: np.ndarray, j: np.ndarray, apart: np.ndarray, best: int) -> np.ndarray:
    """Which pairs are among the ``best`` closest of either end."""
    keep = np.zeros(len(i), bool)
    for end in (i, j):
        order = np.lexsort((apart, end))
        e = end[order]
        keep[order[np.arange(len(e)) - np.searchsorted(e, e) < best]] = True
    return keep


def tree_finder(table: pa.Table, label: np.ndarray, earlier: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``tree_pairs`` of a table with sig, n, counts, parity."""
    return tree_pairs(table.column("sig").to_numpy(), table.column("n").to_numpy(), label, table.column("counts").to_pylist(), table.column("parity").to_pylist(), earlier, second)


def unresolved_pairs(runs: DataFrame, labels: DataFrame | None, classes: DataFrame, best: int | None, find=tree_finder, starred: bool = True) -> DataFrame:
    """a, b, cut: pairs of different components out of runs that hold several, as ``find`` makes them from the columns of
    ``classes``; if ``starred``, without pairs with the run's pivot, which were tried before. Without ``labels`` every class is a
    component. With ``best``, only the closest of each class, and a row with the run's hash in a and b and ``cut`` set for
    each run of which pairs were left out.

    A run of more than ``PART_ROWS`` classes is split into parts by a hash, and every pair of parts is a unit of
    its own, so a group of near copies of any size is spread over tasks that hold two parts each.
    """
    label = F.coalesce("label", "sig").alias("label")
    labelled = runs.select("h", "sig", "pivot", F.col("sig").alias("label")) if labels is None else runs.join(labels.withColumnRenamed("v", "sig"), "sig", "left").select("h", "sig", "pivot", label)
    # a run is known by its members (their number and two sums of hashes), so runs of one and the same set of classes are joined once
    sums = [F.sum(F.xxhash64(F.lit(i), "sig").cast("decimal(38,0)")).alias(f"of{i}") for i in (0, 1)]
    same = labelled.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k"), *sums).filter(f"lo < hi and k > {2 if starred else 1}")
    once = same.groupBy("of0", "of1", "k").agg(F.min("h").alias("h")).select("h", "k", F.ceil(F.col("k") / PART_ROWS).alias("parts"))
    # large runs come first: a pair is left to the first of the runs that both its ends know
    rank = F.struct((-F.col("k")).alias("nk"), "h")
    rows = materialize(labelled.join(once, "h").withColumn("rank", rank), "jaccard-open")
    low = rows.groupBy("sig").agg(F.slice(F.array_sort(F.collect_set("rank")), 1, FIRST).alias("low"))
    rows = rows.join(low, "sig")
    # a run whose classes all know one and the same earlier run has no pair of its own
    before = rows.select("h", "k", F.explode(F.filter("low", lambda x: x < F.col("rank"))).alias("known"))
    covered = before.groupBy("h", "k", "known").agg(F.count("*").alias("of")).filter("of = k").select("h").distinct()
    rows = rows.join(covered, "h", "left_anti").join(classes, "sig")
    part = F.pmod(F.xxhash64("sig"), F.col("parts")).alias("part")
    with_part = rows.select("*", part, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("with"))
    units = with_part.withColumn("x", F.least("part", "with")).withColumn("y", F.greatest("part", "with"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            sig, pivot, h, rank = table.column("sig").to_numpy(), *(table.column(c)[0].as_py() for c in ("pivot", "h", "rank"))
            earlier = np.full((len(sig), FIRST), _NONE)
            for r, low in enumerate(table.column("low").to_pylist()):
                before = [x["h"] for x in low if (x["nk"], x["h"]) < (rank["nk"], h)]
                earlier[r, : len(before)] = before
            out, size, held_back = [], 0, False
            part = table.column("part").to_numpy()
            second = (part == table.column("y")[0].as_py()) & (table.column("x")[0].as_py() < part)
            if second.all() or (table.column("x")[0].as_py() < table.column("y")[0].as_py() and not second.any()):
                return
            for i, j, apart in find(table, table.column("label").to_numpy(), earlier, second):
                new = (sig[i] != pivot) & (sig[j] != pivot) if starred else np.ones(len(i), bool)
                out.append((i[new], j[new], apart[new]))
                size += len(out[-1][0])
                if size > HELD:
                    i, j, apart = (np.concatenate(c) for c in zip(*out))
                    if best is None:
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sig[i], sig[j])), pa.array(np.maximum(sig[i], sig[j])), pa.array(np.zeros(len(i), bool))], names=["a", "b", "cut"])
                        out, size = [], 0
                    else:
                        keep = closest(i, j, apart, best)
                        held_back |= not keep.all()
                        out, size = [(i[keep], j[keep], apart[keep])], 0
            if out:
                i, j, apart = (np.concatenate(c) for c in zip(*out))
                if best is not None:
                    keep = closest(i, j, apart, best)
                    held_back |= not keep.all()
                    i, j = i[keep], j[keep]
                a, b, cut = np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j]), np.zeros(len(i), bool)
                if held_back:
                    a, b, cut = np.append(a, h), np.append(b, h), np.append(cut, True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cut)], names=["a", "b", "cut"])

        for b in batches:
            unit = np.column_stack([b.column(c).to_numpy() for c in ("h", "x", "y")])
            edges = [0, *(np.flatnonzero((unit[1:] != unit[:-1]).any(1)) + 1).tolist(), len(unit)]
            for s, e in zip(edges, edges[1:]):
                if e == s:
                    continue
                if held and any(held[0].column(c)[0].as_py() != v for c, v in zip(("h", "x", "y"), unit[s].tolist())):
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(s, e - s))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    units = units.select("h", "x", "y", "part", "pivot", "rank", "label", "low", *classes.columns)
    return units.repartition("h", "x", "y").sortWithinPartitions("h", "x", "y").mapInArrow(run, "a long, b long, cut boolean").distinct()


def _bloom(ids: DataFrame, column: str, size: int) -> np.ndarray:
    """A set of ``size`` bits, packed, that holds all ids; it only spares work and lets no id be missed."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(size // 8, np.uint8)
        for b in batches:
            at = _bits(b.column(0).to_numpy(), size)
            np.bitwise_or.at(on, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(on.tobytes(), 1)], pa.binary())], names=["on"])

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(size // 8, np.uint8)
        for b in rows_of(batches, 16):
            for x in b.column("on"):
                on |= np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(on.tobytes(), 1)], pa.binary())], names=["on"])

    parts = ids.select(column).mapInArrow(bits, "on binary").repartition(8).mapInArrow(union, "on binary").coalesce(1).mapInArrow(union, "on binary").collect()
    return np.frombuffer(zlib.decompress(parts[0]["on"]), np.uint8) if parts else np.zeros(size // 8, np.uint8)


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def holds(bloom: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _bits(ids, len(bloom) * 8)
    return (bloom[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, apart: dict[int, int], num: int = NUM, den: int = DEN) -> DataFrame:
    """The pairs whose sets reach num / den. Sets are made again, from one text of each class in a pair."""
    wanted = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted = materialize(wanted.join(classes.select("sig", "one"), "sig"), "jaccard-wanted")
    size = 1 << max(16, (PER_ID * wanted.count()).bit_length())
    small = size <= 1 << BLOOM_BITS
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(wanted, "one", size)) if small else None

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 1024):
            if small:
                b = b.take(pa.array(np.flatnonzero(holds(bloom.value, b.column("doc_id").to_numpy(zero_copy_only=False)))))
            made = list(shingle_sets(b.column("text").to_pylist()))
            sig = [signature(h) for h in made]
            twin = [apart.get(s) and second_signature(h) for s, h in zip(sig, made)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sig, pa.int64()), pa.array(twin, pa.int64()), pa.array([h.tobytes() for h in made], pa.binary())], names=["one", "sig", "twin", "members"])

    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), "text")
    if not small:
        named = named.join(wanted.select(F.col("one").alias("doc_id")).distinct(), "doc_id", "left_semi")
    made = named.mapInArrow(sets, "one long, sig long, twin long, members binary")
    if apart:
        listed = F.broadcast(small_table(docs.sparkSession, [{"sig": s, "kept": t} for s, t in apart.items()], "sig long, kept long"))
        moved = F.when(F.col("twin") != F.col("kept"), F.xxhash64("sig", "twin")).otherwise(F.col("sig"))
        made = made.join(listed, "sig", "left").withColumn("sig", F.coalesce(moved, "sig")).drop("kept")
    made = made.drop("twin")
    made = materialize(made.join(wanted, ["sig", "one"], "left_semi"), "jaccard-sets").dropDuplicates(["sig"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 256):
            keep = pa.array([links(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), num, den) for x, y in zip(b.column("ma"), b.column("mb"))], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    side = lambda x: made.select(F.col("sig").alias(x), F.col("members").alias(f"m{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb").mapInArrow(check, "a long, b long")


def points_of(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The classes that are in ``wanted`` (sig). Few of all are in large runs or in those that are worked on again, so a set of bits
    holds most of the others back from the shuffle.
    """
    wanted = materialize(wanted, "jaccard-wanted")
    size = 1 << max(16, (PER_ID * wanted.count()).bit_length())
    if size > 1 << BLOOM_BITS:
        return classes.join(wanted, "sig")
    bloom = classes.sparkSession.sparkContext.broadcast(_bloom(wanted, "sig", size))

    @F.pandas_udf("boolean")
    def may(sig: pd.Series) -> pd.Series:
        return pd.Series(holds(bloom.value, sig.to_numpy()))

    return classes.filter(may("sig")).join(wanted, "sig")


def components_of_runs(runs: DataFrame, classes: DataFrame, bounded, find, check) -> DataFrame:
    """v, label of the classes that links join. ``find`` makes pairs inside a run, ``bounded`` drops star pairs (a, b) that
    cannot link by the columns of ``classes``, ``check`` keeps those that do.
    """
    sized = materialize(runs.join(runs.groupBy("h").agg(F.count("*").alias("k")), "h"), "jaccard-sized")
    small, big = (sized.filter(of).drop("k") for of in (F.col("k") <= FAMILY, F.col("k") > FAMILY))
    stars = big.filter("sig <> pivot").select(F.col("pivot").alias("a"), F.col("sig").alias("b")).distinct()
    points = lambda of: materialize(points_of(classes, of.select("sig").distinct()), "jaccard-points")
    in_big = None if big.isEmpty() else points(big)
    found = None if in_big is None else materialize(check(materialize(bounded(stars, in_big), "jaccard-stars")), "jaccard-links")
    labels = components(found) if found is not None else None
    # runs, the labels so far, how many of each class's closest pairs are tried, whether their stars were
    todo = [(small, classes, None, BEST, False)] + [(big, in_big, labels, BEST, True)] * (found is not None)
    while todo:
        cuts = []
        pairs = None
        for of, own, known, best, starred in todo:
            rest = materialize(unresolved_pairs(of, known, own, best, find, starred), "jaccard-rest")
            cut = rest.filter("cut").select(F.col("a").alias("h"))
            if best is not None and not cut.isEmpty():
                cuts.append((materialize(of.join(cut, "h", "left_semi"), "jaccard-sized"), starred))
            new = rest.filter("not cut").select("a", "b")
            pairs = new if pairs is None else pairs.unionByName(new)
        pairs = pairs.distinct()
        if not pairs.isEmpty():
            labels = components(materialize(check(pairs), "jaccard-links"), labels)
        todo = [(of, points(of), labels, None, starred) for of, starred in cuts]
    return labels if labels is not None else runs.filter("false").select(F.col("sig").alias("v"), F.col("sig").alias("label"))


def with_components(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of all rows (doc_id, n, sig), from the smallest id of each class and the labels of the linked."""
    groups = classes.select("sig", "smallest").join(labels.withColumnRenamed("v", "sig"), "sig", "left").select("sig", "smallest", F.coalesce("label", "sig").alias("label"))
    ids = groups.groupBy("label").agg(F.min("smallest").alias("component_id"))
    found = groups.join(ids, "label").select("sig", "component_id")
    linked = rows.filter("n > 0").select("doc_id", "n", "sig").join(found, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    letters = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows, apart = told_apart(materialize(document_sets(docs, sc.broadcast(frequency_levels(docs.select("text"), sketch_bits(letters / 6)))), "jaccard-rows"))
    some = rows.filter("n > 0")
    # one row of each class: the one with the smallest id stands for it
    classes = some.groupBy("sig").agg(F.first("prefix").alias("prefix"), F.first("usual").alias("usual"))
    usual = classes.select(F.explode(F.slice("prefix", F.lit(1), F.col("usual"))).alias("h"), "sig")
    hot = classes.filter(F.size("prefix") > F.col("usual")).select(F.explode(F.slice("prefix", F.col("usual") + 1, F.size("prefix"))).alias("h"), "sig")
    runs = materialize(shared_runs(usual).unionByName(hot_runs(hot)), "jaccard-runs")
    classes = materialize(some.groupBy("sig").agg(F.min("doc_id").alias("smallest"), F.min(F.coalesce("doc_id", F.lit(0))).alias("one"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("parity").alias("parity")), "jaccard-classes")
    points = classes.select("sig", "n", "counts", "parity")
    labels = components_of_runs(runs, points, bounded_pairs, tree_finder, lambda pairs: verified(docs, classes, pairs, apart))
    return with_components(rows, classes, labels)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, of each component one: that with the smallest id, which null follows.

    Rows are joined under ids of their own, hashes of (id, text), so rows without an id or under a repeated one are
    grouped by their texts like all others, and equal rows are one.
    """
    of_text, key = unused(docs, "of_text", "key")
    keyed = docs.withColumn(of_text, F.md5(F.col("text").cast("binary"))).withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), of_text))
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("group"))
    ids = keyed.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("id"), F.col(of_text).alias("of_text")).distinct()
    order = F.struct(F.col("id").isNull(), F.coalesce("id", F.lit(0)), "of_text", "key")
    first = materialize(ids.join(found, "key").groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.key").alias(key)), "jaccard-first")
    return keyed.join(first, key, "left_semi").dropDuplicates([key]).select(docs.columns)


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
t AS (
  SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END AS s
  FROM w),
e AS (SELECT r, unnest(s) AS g FROM t),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN t x ON x.r = p.a JOIN t y ON y.r = p.b WHERE 100 * shared >= 75 * (len(x.s) + len(y.s) - shared)),
c AS (
  WITH RECURSIVE reach(v, u) AS (SELECT r, r FROM t UNION SELECT reach.v, l.b FROM reach JOIN l ON l.a = reach.u)
  SELECT v, min(t.doc_id) AS component_id FROM reach JOIN t ON t.r = reach.u GROUP BY v)
SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, c.component_id FROM t JOIN c ON c.v = t.r
"""
