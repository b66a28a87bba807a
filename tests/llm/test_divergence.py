import re
from collections import Counter, defaultdict

import numpy as np

from lucerna.llm import divergence
from lucerna.llm.common import table

ROWS = "doc_id long, text string, lang string, source string, part int, `a.b` int"


def brute(rows, documents=10, ranks=10):
    """rows: (text, lang, source)."""
    texts = [([w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")], x or "", s or "") for t, x, s in rows]
    seen, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for words, lang, source in texts:
        seen[lang].update(set(words))
        sources[lang].add(source)
        count[lang, source].update(words)
    out = []
    for lang, groups in sources.items():
        kept = [w for w, n in seen[lang].items() if n >= documents]
        v = len(kept)

        def shares(counts):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 2) // (total + 2 * v) for w in kept}

        every = Counter()
        for s in groups:
            every.update(count[lang, s])
        p, q = {s: shares(count[lang, s]) for s in groups}, shares(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(t, sum(f(p[s][w], p[t][w]) for w in kept)) for t in groups if t != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


def test_all_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = sorted(map(tuple, divergence.audit(docs).collect()))
    assert got == brute([(r.text, r.lang, r.source) for r in docs.collect()]) and len(got) > 1000


def test_odd_rows(spark, monkeypatch):
    """Nulls, empty groups, ties, repeated rows, clashing columns, languages that keep no term, tiny pieces."""
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 3)
    monkeypatch.setattr(divergence, "ROWS_AT_ONCE", 5)
    monkeypatch.setattr(divergence, "COMBINATIONS", 4)
    monkeypatch.setattr(divergence, "HELD", 200)
    say = lambda k: " ".join(f"w{chr(97 + (k * j) % 7)} Été İx {'rare' * (j % 3)}" for j in range(1 + k % 5))
    rows = [(k, say(k), "en", f"s{k % 4}", k, k) for k in range(40)] + [(None, None, None, None, 1, 1), (3, "", "en", None, 1, 1), (4, "a b", "xx", "y", 1, 1), (4, "a b", "xx", "z", 1, 1), (5, "!! 12", "en", "none", 1, 1)]
    rows += rows[:3] + [(9, "Long-" * 300 + "é漢" * 200, "en", "s1", 1, 1)]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = sorted(map(tuple, divergence.audit(df, documents=5, ranks=2).collect()))
    want = brute([(r[1], r[2], r[3]) for r in rows], 5, 2)
    assert got == want and ("xx", "y", "pair", "z", 0, 1) in got
    assert divergence.audit(df.limit(0)).count() == 0


def test_terms_in_pieces():
    text = ("Ab-cd é" * 50).encode()
    assert [t for part in divergence.terms(text, 7) for t in part] == re.findall(rb"[a-z\x80-\xff]+", text.lower())


def test_slices():
    sizes = np.array([1, 4, 2, 5])
    starts = np.cumsum(sizes) - sizes
    want = [(a, b) for s, n in zip(starts, sizes) for a in range(s, s + n) for b in range(a + 1, s + n)]
    for limit in (1, 3, 100):
        assert [tuple(x) for a, b in divergence.slices(sizes, limit) for x in zip(a.tolist(), b.tolist())] == want


def test_large_counts(spark):
    """Shares of counts that pass 64 bits when multiplied stay exact."""
    n, total, kept = 10**13 + 7, 10**15 + 3, 12345
    df = spark.createDataFrame([(n, total, kept)], "n long, t long, v long")
    assert df.select(divergence.share(df.n, df.t, df.v)).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * kept)
