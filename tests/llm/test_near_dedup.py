import itertools
import random

import pytest
import xxhash

from ratingloom.llm import simhash

from .helpers import documents, hard_texts, nothing, words


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return sorted((doc, fps[i], min(x for x in groups[find(i)] if x is not None)) for i, (doc, _) in enumerate(rows) if doc is not None)


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(simhash, "BROADCAST", broadcast)
    rng, rows = random.Random(5), []
    for i in range(150):
        base = words(i // 3, 40).split()
        for _ in range(rng.randint(0, 2)):
            base[rng.randrange(len(base))] = "other"
        rows.append((i, " ".join(base)))
    rows += [(1000 + i, t) for i, t in enumerate(hard_texts()) if t is None or len(t) < 5000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == brute(rows)


def test_dense_keys_lose_no_link(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(200)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    parts = []
    for dense in (1000, 4):
        links = simhash.fingerprint_links(df, 2, dense)
        assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 2 for r in links.collect())
        parts.append({r["node"]: r["root"] for r in simhash.components(links).collect()})
    assert parts[0] == parts[1]


def test_long_chains_end_in_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 1001)], "a long, b long")
    assert {r["node"]: r["root"] for r in simhash.components(links).collect()} == {**dict.fromkeys(range(501), 0), 1000: 1000, 1001: 1000}


def test_one_of_each_keeps_columns(spark):
    docs = documents(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert 0 in ids and 1 not in ids and 2 not in ids and len(ids) == len(set(ids))
    assert kept.where("doc_id is null").count() == 1
    assert simhash.one_of_each(nothing(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert {r["root"] for r in simhash.components(links).collect()} == {0}
