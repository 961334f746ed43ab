r"""How far the sources of each language are apart in the terms they use, pair by pair and term by term, in whole numbers.

Terms are runs of letters A-Z and of characters above U+007F, A-Z lower-cased. A language keeps the terms of at least
``LEAST`` of its documents. A group (language, source) gives a kept term the share p = 1 + floor(10**9 (count + 5) /
(N + 5 V)), where N sums its counts of kept terms and V is their number; a term that the group lacks has the group's base share.
Two groups are as far apart as the absolute differences of their shares, summed over the kept terms.

Heavy and light. The distance of groups s and t is V |base_s - base_t| and, for each term that s or t has, by how much
its difference exceeds |base_s - base_t|. Terms that more than 1 / ``SHARE`` of a language's groups have, or more than ``MANY``,
are heavy: tiles of about ``CHUNK`` of them and two blocks of ``BLOCK`` groups are dense matrices, in which groups that
lack a term hold their base. Light terms are posting lists of at most ``MANY`` groups. What a group's light terms
add if the other group lacks them depends on the shares alone, so it comes from a histogram of shares against the
bases of each block; what two groups of one list add beyond that is a correction for their pair. Both parts are sums
of whole numbers and are added up by pair.

Tasks hold a tile, a batch of lists or a batch of documents. Counts are summed in the task before they are shuffled, by
language, source and term, so a source or language with most of the rows is many keys. The result has a row for each
ordered pair of sources of a language, which is what is asked for; nothing else is formed by pairs of groups.

Defined results: null text, language and source are ''; a group without terms has its base share for every kept term; a
language without kept terms has distances 0; ties go to the smaller item by UTF-8 bytes; repeated rows and ids count
each as documents; a source alone in its language has no pairs; an empty table gives an empty table; texts of any
length are counted in slices; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, rows_of

LEAST, PRIOR, UNIT, RANKS = 30, 5, 1_000_000_000, 50
#: A heavy term: in more than 1 / SHARE of the groups or in more than MANY.
SHARE, MANY = 2, 64
#: Groups and terms of a tile, about.
BLOCK, CHUNK = 64, 1024
#: Bytes of a text looked at together, and entries that a task sums up before it hands them on.
SLICE, ENTRIES = 1 << 20, 300_000
#: Rows that are broadcast at most.
SMALL = 10_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, slice by slice; slices end between terms."""
    raw, at = text.encode().lower(), 0
    while at < len(raw):
        gap = _GAP.search(raw, at + SLICE)
        end = gap.start() if gap else len(raw)
        yield _TERM.findall(raw, at, end)
        at = end


def tallies(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences in each group, and how many of its documents have the term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        has: dict[tuple[str, str], Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in n.items():
                names, found = list(own), has[lang, source]
                for i in range(0, len(names), 50_000):
                    part = names[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([own[x] for x in part], pa.int64()), pa.array([found[x] for x in part], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            n.clear()
            has.clear()

        for b in rows_of(batches, 64):
            for key, text in zip(zip(b.column("lang").to_pylist(), b.column("source").to_pylist()), b.column("text").to_pylist()):
                own, found, seen = n.setdefault(key, Counter()), has.setdefault(key, Counter()), set()
                for some in terms(text):
                    own.update(some)
                    seen.update(some)
                found.update(seen)
            if sum(map(len, n.values())) > ENTRIES:
                yield from flush()
        yield from flush()

    some = docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return some.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, of: Column, kept: Column) -> Column:
    """1 + floor(UNIT (n + PRIOR) / (of + PRIOR kept)), in decimals, which do not overflow."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(19,0)")
    return 1 + F.call_function("div", top, (of + PRIOR * kept).cast("decimal(19,0)"))


def hinted(side: DataFrame, rows: int) -> DataFrame:
    """Broadcast if it has few rows."""
    return F.broadcast(side) if rows <= SMALL else side


def known_groups(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n (of kept terms), v, lang_n, groups, g (its place in the language), base."""
    every = rows.select("lang", "source").distinct()
    counts = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("first").alias("v"))
    own = Window.partitionBy("lang")
    return (
        every.join(counts, ["lang", "source"], "left")
        .na.fill(0)
        .withColumn("lang_n", F.sum("n").over(own))
        .withColumn("v", F.sum("v").over(own))
        .withColumn("groups", F.count("*").over(own))
        .withColumn("g", F.row_number().over(own.orderBy("source")) - 1)
        .withColumn("base", F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(0))
    )


_TILE = "lang string, s long, t long, v long"


def tile(rows: pa.Table) -> pa.Table:
    """What one tile adds to each pair of its groups, s < t."""
    lang, a, b, chunk = (rows.column(c)[0].as_py() for c in ("lang", "a", "b", "chunk"))
    kind, x = rows.column("kind").to_numpy(), rows.column("x").to_numpy()
    gs, ps, m = rows.column("gs").to_pylist(), rows.column("ps").to_pylist(), rows.column("m").to_numpy()
    name, v = rows.column("term").to_pylist(), 0
    base = {}
    for i in np.flatnonzero(kind == 0).tolist():
        order = np.argsort(gs[i])
        base[int(x[i])] = np.array(ps[i], np.int64)[order]
        v = int(m[i])
    apart = np.abs(base[a][:, None] - base[b][None, :])
    total = v * apart if chunk == 0 else np.zeros_like(apart)
    # heavy terms: dense, with the base where a group lacks the term
    heavy = np.flatnonzero(kind == 1).tolist()
    at = {t: i for i, t in enumerate(dict.fromkeys(name[i] for i in heavy))}
    dense = {k: np.repeat(own[:, None], len(at), 1) for k, own in base.items()}
    for i in heavy:
        dense[int(x[i])][np.array(gs[i]) % BLOCK, at[name[i]]] = ps[i]
    for s, of_s in enumerate(dense[a]):
        total[s] += np.abs(dense[b] - of_s).sum(1)
    total -= len(at) * apart
    # light terms of one group alone: how often each share, against all bases of the other block
    for side, other, flat in ((a, b, apart), (b, a, apart.T)):
        rare = np.flatnonzero((kind == 2) & (x == side))
        for part in np.array_split(rare, len(rare) // 20_000 + 1):
            if len(part):
                own = np.array([gs[i][0] for i in part.tolist()]) % BLOCK
                more = m[part][:, None] * (np.abs(np.array([ps[i][0] for i in part.tolist()])[:, None] - base[other][None, :]) - flat[own])
                add = np.zeros_like(flat)
                np.add.at(add, own, more)
                total += add if side == a and flat is apart else add.T
    s, t = np.triu_indices(len(total), 1) if a == b else (i.ravel() for i in np.indices(total.shape))
    keep = slice(None) if chunk == 0 else total[s, t] != 0
    s, t = s[keep], t[keep]
    return pa.table({"lang": pa.array([lang] * len(s), pa.string()), "s": pa.array(a * BLOCK + s, pa.int64()), "t": pa.array(b * BLOCK + t, pa.int64()), "v": pa.array(total[s, t], pa.int64())})


def tiled(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, s, t, v: the parts of bases, of heavy terms and of light terms that one of the groups has."""
    block = F.expr(f"g div {BLOCK}")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("v") / CHUNK)).alias("chunks")
    blocks = F.ceil(F.col("groups") / BLOCK).alias("blocks")
    columns = ["lang", "x", "blocks", "chunk", "kind", "term", "gs", "ps", "m"]
    lists = lambda p: (F.collect_list("g").alias("gs"), F.collect_list(p).alias("ps"))
    bases = groups.groupBy("lang", block.alias("x"), blocks, chunks).agg(*lists("base"), F.first("v").alias("m"))
    bases = bases.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("kind", F.lit(0)).withColumn("term", F.lit(""))
    of_term = F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk")
    heavy = kept.filter("heavy").select("lang", block.alias("x"), blocks, chunks, "term", F.col("g"), "p")
    heavy = heavy.groupBy("lang", "x", "blocks", "term", "chunks").agg(*lists("p")).withColumn("chunk", of_term).withColumn("kind", F.lit(1)).withColumn("m", F.lit(0).cast("long"))
    light = kept.filter("not heavy").groupBy("lang", "g", block.alias("x"), blocks, chunks, "p").agg(F.count("*").alias("m"))
    light = light.withColumn("chunk", F.pmod(F.xxhash64("g", "p"), F.col("chunks"))).withColumn("kind", F.lit(2)).withColumn("term", F.lit("")).withColumn("gs", F.array(F.col("g"))).withColumn("ps", F.array("p"))
    rows = bases.select(columns).unionByName(heavy.select(columns)).unionByName(light.select(columns))
    # each block meets every block once, itself too
    met = rows.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y")).drop("y", "blocks")
    return met.groupBy("lang", "a", "b", "chunk").applyInArrow(tile, _TILE)


def corrections(kept: DataFrame) -> DataFrame:
    """lang, s, t, v: what light terms add that both groups have, beyond what each of them adds alone."""
    lists = kept.filter("not heavy").groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct(F.col("g").cast("long").alias("g"), "p", "base"))).alias("of")).filter(F.size("of") > 1).select("lang", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 1024):
            lang = np.array(b.column("lang").to_pylist(), object)
            offsets = b.column("of").offsets.to_numpy()
            flat = b.column("of").values
            g, p, base = (flat.field(c).to_numpy() for c in ("g", "p", "base"))
            long = np.diff(offsets)
            found = []
            for n in np.unique(long).tolist():
                at = np.flatnonzero(long == n)
                i, j = np.triu_indices(n, 1)
                left, right = offsets[at][:, None] + i, offsets[at][:, None] + j
                both = np.abs(p[left] - p[right]) - np.abs(p[left] - base[right]) - np.abs(p[right] - base[left]) + np.abs(base[left] - base[right])
                found.append((np.repeat(at, len(i)), g[left].ravel(), g[right].ravel(), both.ravel()))
            at, s, t, v = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 4
            for own in set(lang.tolist()):
                of = lang[at] == own
                pairs, where = np.unique(np.column_stack([s[of], t[of]]), axis=0, return_inverse=True)
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, where.ravel(), v[of])
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(pairs), pa.string()), pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64()), pa.array(total)], names=["lang", "s", "t", "v"])

    return lists.mapInArrow(run, _TILE)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: of each group all other sources of its language by distance (``pair``), and the terms
    by which its share exceeds the language's most (``term``, to rank ``RANKS``).
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    of_term = Window.partitionBy("lang", "term")
    kept = (
        tallies(rows)
        .withColumn("lang_docs", F.sum("docs").over(of_term))
        .withColumn("spread", F.count("*").over(of_term))
        .withColumn("lang_term", F.sum("n").over(of_term))
        .withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
        .filter(F.col("lang_docs") >= LEAST)
        .drop("docs", "lang_docs")
    )
    kept = materialize(kept, "audit-kept")
    groups = materialize(known_groups(rows, kept), "audit-groups")
    n_groups = groups.count()
    shares = (
        kept.join(hinted(groups.withColumnRenamed("n", "group_n"), n_groups), ["lang", "source"])
        .withColumn("p", share(F.col("n"), F.col("group_n"), F.col("v")))
        .withColumn("q", share(F.col("lang_term"), F.col("lang_n"), F.col("v")))
        .withColumn("heavy", (F.col("spread") * SHARE > F.col("groups")) | (F.col("spread") > MANY))
    )
    shares = materialize(shares.select("lang", "source", "term", "g", "groups", "v", "base", "p", "q", "heavy"), "audit-shares")
    rank = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    by_term = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by_term = by_term.withColumn("rank", rank()).filter(F.col("rank") <= RANKS)
    apart = tiled(shares, groups).unionByName(corrections(shares)).groupBy("lang", "s", "t").agg(F.sum("v").alias("value"))
    both = apart.select("lang", F.explode(F.array(F.struct(F.col("s").alias("g"), F.col("t").alias("other")), F.struct(F.col("t").alias("g"), F.col("s").alias("other")))).alias("e"), "value").select("lang", "e.g", "e.other", "value")
    names = groups.select("lang", F.col("g").cast("long").alias("g"), "source")
    pairs = both.join(hinted(names, n_groups), ["lang", "g"]).join(hinted(names.select("lang", F.col("g").alias("other"), F.col("source").alias("item")), n_groups), ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank())
    return pairs.unionByName(by_term)


ORACLE = r"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
e AS MATERIALIZED (SELECT r, lang, source, unnest(ts) AS term FROM w),
k AS MATERIALIZED (SELECT lang, term FROM e GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM e JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (
  SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::BIGINT AS n,
         (SELECT count(*) FROM k WHERE k.lang = x.lang) AS v
  FROM (SELECT DISTINCT lang, source FROM w) x),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // ((SELECT sum(n) FROM c WHERE c.lang = p.lang) + 5 * (SELECT count(*) FROM k WHERE k.lang = p.lang)) AS q
  FROM p GROUP BY lang, term),
d AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM d QUALIFY part = 'pair' OR rank <= 50
"""
