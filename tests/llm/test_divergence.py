"""The audit against brute force: many groups, heavy and light terms, blocks and tiles of all sizes, edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from graphlens.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, ranks=50):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source, found = lang or "", source or "", TERM.findall(lower(text or ""))
        groups.add((lang, source))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: Counter({t: count[lang, s][t] for t in kept}) for x, s in groups if x == lang}
        whole = Counter()
        for c in own.values():
            whole.update(c)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q = share(whole)
        for s, c in own.items():
            p = share(c)
            pair = sorted((-sum(abs(p[t] - r[t]) for t in kept), o.encode()) for o, d in own.items() if o != s for r in [share(d)])
            term = sorted((q[t] - p[t], t.encode()) for t in kept if c[t] and p[t] > q[t])[:ranks]
            for part, found in (("pair", pair), ("term", term)):
                out |= {(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)}
    return out


def rows_of(n, sources, words, seed=2):
    rng = random.Random(seed)
    own = {s: rng.sample(range(words), max(3, words // 6)) for s in range(sources)}
    rows = []
    for i in range(n):
        s = rng.randrange(sources)
        text = " ".join(rng.choice(["Common", "COMMON's", f"wörd{chr(97 + rng.randrange(26))}", f"t{''.join(chr(97 + int(c)) for c in str(rng.choice(own[s])))}"]) for _ in range(rng.randrange(0, 15)))
        rows.append((i, text, rng.choice(["en", "en", "de"]), f"s{s}" if s else None, 1))
    return [*rows, (None, None, None, None, None), (1, "", "xx", "é", 1), (1, "9 8 - 7", "xx", "z", 1), (1, "Lone lone", "yy", "s", 1), rows[0], rows[0], (n, "İ K common " * 5000, "en", "s1", 0)]


@pytest.mark.parametrize("sources, words, block, chunk, many, share", [(5, 60, 64, 1024, 64, 2), (23, 40, 4, 7, 64, 4), (23, 40, 8, 100, 3, 1), (12, 200, 5, 11, 64, 1)])
def test_audit_against_brute_force(spark, monkeypatch, sources, words, block, chunk, many, share):
    monkeypatch.setattr(divergence, "LEAST", 4)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "MANY", many)
    monkeypatch.setattr(divergence, "SHARE", share)
    monkeypatch.setattr(divergence, "SLICE", 1000)
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    rows = rows_of(700, sources, words)
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], DOCS + ", g int, term string").repartition(3)
    got = [tuple(r) for r in divergence.audit(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 4)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None, None, "a", 1), (2, "few words", "", None, 1)]
    assert {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, DOCS)).collect()} == {("", "a", "pair", "", 0, 1), ("", "", "pair", "a", 0, 1)} == brute(rows, 30)


def test_slices_do_not_cut_terms(monkeypatch):
    text = "Über-lang " + "x" * 500 + " É 12 end" * 40
    whole = [t.encode() for t in TERM.findall(lower(text))]
    for size in (1, 2, 7, 100, 10_000):
        monkeypatch.setattr(divergence, "SLICE", size)
        assert [t for some in divergence.terms(text) for t in some] == whole


def test_shares_of_counts_beyond_64_bits(spark):
    n = 9_000_000_000_000
    row = spark.range(1).select(divergence.share(divergence.F.lit(n), divergence.F.lit(2 * n), divergence.F.lit(3)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 5) // (2 * n + 15)
