"""Degree-preserving rewiring by double edge swaps.

A draw makes its swaps one after another; which edges the k-th attempt takes comes from an md5 of seed, draw and k, so a draw
depends on its number alone: a lost task gives the same draw again, and SQL can repeat it. One task row makes one draw of the
one reference; draws are spread over tasks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lost_edges(draws: DataFrame, edges: DataFrame, of: int) -> DataFrame:
    """draw, s, eff: the share of the graph's ``of`` edges that a draw lost."""
    kept = draws.join(F.broadcast(edges), ["u", "v"], "left_semi").groupBy("draw", "s").agg(F.count("*").alias("kept"))
    return kept.select("draw", "s", ((F.lit(of) - F.col("kept")) / F.lit(float(of))).alias("eff"))


def _joined(edges: set[tuple[int, int]], nodes: int) -> bool:
    """Whether the edges join all nodes."""
    root = list(range(nodes))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    parts = nodes
    for u, v in edges:
        if (x := top(u)) != (y := top(v)):
            root[x], parts = y, parts - 1
    return parts == 1


def attempt(seed: int, draw: int, k: int, edges: int) -> tuple[int, int, bool]:
    """The two edges of an attempt and whether the second is turned round: three numbers of one md5."""
    h = hashlib.md5(f"{seed}:{draw}:{k}".encode()).hexdigest()
    return int(h[:8], 16) % edges, int(h[8:16], 16) % edges, int(h[16], 16) % 2 == 1


def swap_edges(edges: list[tuple[int, int]], swaps: int, tries: int, seed: int, draw: int, nodes: int | None = None) -> set[tuple[int, int]]:
    """The graph after ``swaps`` double edge swaps, or as many as ``tries`` attempts give. With ``nodes`` a swap that
    splits the graph is taken back.
    """
    at, held, done = sorted(edges), set(edges), 0
    if len(at) < 2:
        return held
    for k in range(tries):
        if done == swaps:
            break
        i, j, turn = attempt(seed, draw, k, len(at))
        (a, b), (c, d) = at[i], at[j][::-1] if turn else at[j]
        x, y = (min(a, d), max(a, d)), (min(c, b), max(c, b))
        if len({a, b, c, d}) < 4 or x in held or y in held:
            continue
        old, new = {at[i], at[j]}, {x, y}
        held = held - old | new
        if nodes and not _joined(held, nodes):
            held = held - new | old
            continue
        at[i], at[j], done = x, y, done + 1
    return held


def swap_draws(reference: DataFrame, draws: DataFrame, tries: int, seed: int, nodes: int | None = None) -> DataFrame:
    """draw, s, code, lost for each row of ``draws`` (draw, s): the reference after s swaps within s * ``tries`` attempts,
    as edge codes, and how many of its edges are gone. With ``nodes`` the graph stays connected.
    """
    import pyarrow as pa

    from .scoring import packed

    def run(batches):
        for b in batches:
            out = []
            for draw, s, code in zip(*(b.column(c).to_pylist() for c in ("draw", "s", "code"))):
                start = [(c // 65536, c % 65536) for c in code]
                end = swap_edges(start, s, s * tries, seed, draw, nodes)
                out.append((draw, s, sorted(u * 65536 + v for u, v in end), len(set(start) - end)))
            columns = zip(*out) if out else [()] * 4
            types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["draw", "s", "code", "lost"])

    one = packed(reference.withColumn("k", F.lit(0)), "k").select("code")
    return draws.select("draw", "s").join(F.broadcast(one)).mapInArrow(run, "draw long, s int, code array<long>, lost int")


def drawn_edges(drawn: DataFrame) -> DataFrame:
    """draw, s, u, v of ``swap_draws``."""
    return drawn.select("draw", "s", F.explode("code").alias("c")).select("draw", "s", F.expr("cast(c div 65536 as int)").alias("u"), (F.col("c") % 65536).cast("int").alias("v"))
