import itertools
import random

import corpus_pipeline
import pytest

from ratingloom.llm import shingle_join

from .helpers import documents, hard_texts, nothing, words


def shingled(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute(rows):
    """The smallest doc_id of each row's group of links at similarity 0.8 and more."""
    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}


def planted():
    """Originals of 40 to 160 words, copies with up to 3 words replaced, at, above and below 0.8, and a passage that many share."""
    rng, texts = random.Random(9), [t for t in hard_texts() if t is None or t.isascii()]
    for i in range(40):
        base = words(100 + i, rng.choice((40, 80, 160))).split()
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [words(7, 20) + " " + words(300 + i, 60) for i in range(30)] + [" ".join(f"w{i}" for i in range(n)) for n in (36, 37, 28, 29, 45, 46)]
    return list(enumerate(texts))


@pytest.mark.parametrize("dense, block", [(32, 256), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, dense, block):
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.near_duplicates(df, dense=dense).collect()}
    want = brute(rows)
    assert got == want and len(set(want.values())) < len(rows) - 60


def test_stage_drops_planted_near_copies_and_nothing_else(spark, tmp_path):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, df, str(tmp_path)).collect()}
    assert kept == set(brute(rows).values())


def test_hard_rows(spark):
    docs = documents(spark)
    kept = shingle_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert shingle_join.one_of_each(nothing(spark)).count() == 0


def test_stage_links_by_verified_signatures(spark, monkeypatch, tmp_path):
    """Operator 2's signatures alone find near copies, and without a real similarity of 0.8 they link nothing."""
    long = words(21, 2000).split()
    copies = [" ".join([*long[:i], "changed", *long[i + 1 :]]) for i in (3, 700, 1500)]
    rows = list(enumerate([" ".join(long), words(22, 2000), *copies, words(23, 30), words(22, 2000).replace("an", "the")]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked, real = [], shingle_join.signature_pairs

    def spied(sets, similarity, distance=2):
        # every fingerprint within two bits: all sets of like sizes are proposed, and only similar ones may be linked
        asked.append({tuple(sorted(r)) for r in real(sets, similarity, distance).collect()})
        return real(sets.withColumn("mark", shingle_join.F.lit(5).cast("bigint")), similarity, distance)

    monkeypatch.setattr(shingle_join, "signature_pairs", spied)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, df, str(tmp_path)).collect()}
    assert kept == set(brute(rows).values()) and len(kept) == len(rows) - 3
    assert len(asked) == 1 and asked[0]


@pytest.mark.parametrize("distance", [2])
def test_signature_pairs_equal_brute_force(spark, distance):
    df = spark.createDataFrame(planted(), "doc_id long, text string")
    sets = shingle_join._sets(df, "doc_id", "text", 5, (4, 5)).select("fp", "mark", "n").distinct().collect()
    got = {tuple(r) for r in shingle_join.signature_pairs(spark.createDataFrame(sets, "fp long, mark long, n long"), (4, 5), distance).collect()}
    near = {tuple(sorted((a["fp"], b["fp"]))) for a, b in itertools.combinations(sets, 2) if ((a["mark"] ^ b["mark"]) & (2**64 - 1)).bit_count() <= distance and 5 * min(a["n"], b["n"]) >= 4 * max(a["n"], b["n"])}
    heads = {m: min(s["fp"] for s in sets if s["mark"] == m) for m in {s["mark"] for s in sets}}
    assert got == {p for p in near if len({s["mark"] for s in sets if s["fp"] in p}) == 2 and all(f in heads.values() for f in p) or any(f in heads.values() for f in p) and len({s["mark"] for s in sets if s["fp"] in p}) == 1}


def test_driver_plans_few_nodes_at_once(spark, tmp_path):
    """Each step of the stage is planned by itself: what the driver plans, and plans anew after every shuffle, stays small."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    df = spark.createDataFrame(planted(), "doc_id long, text string")
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    corpus_pipeline.near_dedup_stage(spark, df, str(tmp_path)).count()
    bus.waitUntilEmpty(30_000)
    new = store.executionsList(before, 10_000)
    nodes = [store.planGraph(new.apply(i).executionId()).allNodes().size() for i in range(new.size())]
    assert len(nodes) > 20 and max(nodes) <= 50, sorted(nodes)[-5:]
