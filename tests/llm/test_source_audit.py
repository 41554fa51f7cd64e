import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.llm import source_audit

from .helpers import documents, hard_texts, nothing, words


def brute(rows, min_docs, top=10):
    """rows (text, lang, source), by dictionaries."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    own, every, holding = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((t or "", g or "", s or "") for t, g, s in rows):
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))
        own[lang, source].update(terms)
        every[lang].update(terms)
        holding[lang].update(set(terms))
    out = []
    for lang in every:
        kept = sorted(t for t, n in holding[lang].items() if n >= min_docs)
        chance = lambda counts: [1 + 10**9 * (counts[t] + 2) // (sum(counts[t] for t in kept) + 2 * len(kept)) for t in kept]  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: chance(c) for (g, s), c in own.items() if g == lang}, chance(every[lang])
        for s in p:
            pairs = [(-sum(map(f, p[s], p[o])), o.encode(), o) for o in p if o != s]
            best = [(-f(a, b), t.encode(), t) for t, a, b in zip(kept, p[s], q) if own[lang, s][t] and a > b]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                out += [(lang, s, part, item, -value, rank + 1) for rank, (value, _, item) in enumerate(items)]
    return sorted(out)


def _rows():
    out = []
    for i in range(180):
        text = words(i % 60, 40) + f" own{'abcdefghijk'[i % 11]} " * (i % 4)
        out.append((text, ("en", "de", None, "")[i % 4], f"s{i % 11}" if i % 13 else None))
    out += [(t, "en", "hard") for t in hard_texts() if t is None or len(t) < 30_000] + [(None, "xx", "a"), ("", "xx", "b"), ("12 34", "yy", "alone"), ("İI ſ Kelvin K É é", "en", "é")] + [("tie tied", "tt", s) for s in "cab" for _ in range(4)]
    return out


def _found(spark, rows, **how):
    table = spark.createDataFrame([(t, g, s, 1, "x") for t, g, s in rows], "text string, lang string, source string, n int, term string")
    return sorted(map(tuple, source_audit.audit(table, **how).collect()))


def test_equals_a_plain_computation_in_one_cell(spark):
    rows = _rows()
    want = brute(rows, 10)
    assert _found(spark, rows) == want
    assert {(r[0], r[2]) for r in want} >= {("en", "pair"), ("en", "term"), ("", "pair"), ("xx", "pair"), ("tt", "pair")}


@pytest.mark.parametrize(("block", "cell", "rounds"), [(5, 2, 2), (7, 3, 64), (1 << 16, 1, 3), (3, 5, 1)])
def test_equals_it_over_blocks_and_cells(spark, block, cell, rounds):
    rows = _rows()
    assert _found(spark, rows, min_docs=4, top=3, block=block, cell=cell, rounds=rounds) == brute(rows, 4, 3)


def test_flushed_counts_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "HELD", 5)
    rows = _rows()
    table = spark.createDataFrame(rows, "text string, lang string, source string")
    got = {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in source_audit.term_counts(table).collect()}
    assert got["tt", "a", "tie"] == (4, 4) and ("xx", "a", None) in got


def test_clashing_columns_and_empty_tables(spark):
    docs = documents(spark)
    want = brute([(r["text"], r["lang"], r["source"]) for r in docs.collect()], 10)
    assert sorted(map(tuple, source_audit.audit(docs).collect())) == want
    assert source_audit.audit(nothing(spark)).collect() == []


@pytest.mark.parametrize("cells", range(1, 12))
def test_each_pair_of_cells_meets_once(cells):
    met = Counter()
    for turn in range(cells + cells % 2 - 1 if cells > 1 else 0):
        pairs = {}
        for c in range(cells):
            other = source_audit.opponent(c, cells, turn)
            if other is not None:
                pairs[c] = other
                assert other != c
                if source_audit.is_host(c, other):
                    met[min(c, other), max(c, other)] += 1
        assert all(pairs[o] == c for c, o in pairs.items())
    assert met == Counter({(a, b): 1 for a in range(cells) for b in range(a + 1, cells)})


def test_probability_is_exact_at_any_count(spark):
    counts = [(0, 0, 1), (5, 17, 3), (8_999_999_999, 9_000_000_001, 2), (9_000_000_000, 9_000_000_001, 2), (3 * 10**17, 4 * 10**17, 10**9)]
    got = spark.createDataFrame(counts, "n long, total long, terms long").select(source_audit.probability("n", "total", "terms").alias("p"))
    assert [r["p"] for r in got.collect()] == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in counts]
    p, q = np.array([10**9 + 1, 1, 7]), np.array([1, 10**9 + 1, 7])
    assert source_audit.divergence(p, q).tolist() == [(int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(p, q)]
