"""Search over blocks of postings against the plain search, files opened, and edge cases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ratingloom.operators import search
from ratingloom.operators.block_index import BlockIndex

TITLES = "item_id long, title string"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    texts = [" ".join(draw.choices(words, weights, k=draw.randint(1, 30))) for _ in range(900)]
    # even ids, crowded ids, negative ones, and a row of each that says something again
    ids = [k * 1000 for k in range(400)] + list(range(10**12, 10**12 + 400)) + [-5 - k for k in range(100)]
    return list(zip(ids, texts)) + [(0, "w1 w1 w2"), (None, "w1 w2"), (7, None), (8, ""), (9, "the of")]


@pytest.fixture(scope="module")
def built(spark, rows, tmp_path_factory):
    titles = spark.createDataFrame(rows, TITLES)
    return search.build_index(titles, stem=False), BlockIndex.build(titles, str(tmp_path_factory.mktemp("index") / "at"), stem=False, block=8, per_file=40)


def test_blocks_hold_the_postings(built):
    index, blocks = built
    key = lambda r: (r["term"], r["kind"], r["item_id"])
    opened = blocks.blocks().select("term", "kind", F.explode("ids").alias("item_id")).collect()
    assert sorted(map(key, opened)) == sorted(key(r) for r in index.postings.where("item_id is not null").collect())
    for b in blocks.blocks().join(blocks.terms, ["term", "kind"]).collect():
        assert 0 < len(b["ids"]) <= 8 and b["ids"] == sorted(set(b["ids"])) and (b["first"], b["last"]) == (b["ids"][0], b["ids"][-1])
        assert {i >> b["shift"] for i in b["ids"]} == {b["cell"]}


@pytest.mark.parametrize("limit", [1, 5, 100, 5000])
def test_search_equals_plain_scores(spark, rows, built, limit):
    index, blocks = built
    asked = {1: "w1 w2 w3", 2: "w250 w0 w1", 3: "w0 w0 w0 w1", 4: "w17", 5: " ".join(f"w{k}" for k in range(0, 300, 7)), 6: "", 7: "unheard", 8: None, 9: "W1: w2, (w1)"}
    found = {}
    for r in blocks.search(spark.createDataFrame([*asked.items(), (None, "w1")], "query_id long, title string"), limit).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["item_id"], r["score"]))
    n = {(r["term"], r["kind"]): r["n"] for r in index.terms.collect()}
    has = {}
    for r in index.postings.where("item_id is not null").collect():
        has.setdefault((r["term"], r["kind"]), []).append(r["item_id"])
    want = {}
    for q, text in asked.items():
        words = [w.strip(":,()").lower() for w in (text or "").split()]
        terms = [(w, "token") for w in words] + [(f"{a} {b}", "bigram") for a, b in zip(words, words[1:])]
        score = {}
        for t in set(terms):
            w = round(terms.count(t) * (1.5 if t[1] == "bigram" else 1.0) / n[t] * 1e12) if t in n else 0
            for i in has.get(t, ()):
                score[i] = score.get(i, 0) + w
        best = sorted(score.items(), key=lambda x: (-x[1], -x[0]))[:limit]
        if best:
            want[q] = [(k + 1, i, pytest.approx(s / 1e12, abs=1e-15)) for k, (i, s) in enumerate(best)]
    assert {q: sorted(v) for q, v in found.items()} == want
    for q in (2, 9):
        plain = search.search(index, asked[q], limit).where("item_id is not null").collect()
        assert sorted(r["score"] for r in plain)[-3:] == pytest.approx(sorted(s for _, _, s in found[q])[-3:])


def test_search_opens_files_of_its_terms_only(spark, built):
    _, blocks = built
    size = lambda paths: sum(os.path.getsize(p.removeprefix("file://")) for p in paths)
    every = blocks.blocks().inputFiles()
    rare = blocks.blocks(spark.createDataFrame([("w290", "token")], "term string, kind string"))
    assert rare.count() > 0 and len(every) > 20 and len(rare.inputFiles()) <= 2 and size(rare.inputFiles()) < size(every) / 10
    # one cell of a common term opens less than the term
    common = blocks.blocks().where("term = 'w0' and kind = 'token'")
    whole = blocks.blocks(spark.createDataFrame([("w0", "token")], "term string, kind string"))
    one = blocks.blocks(common.select("term", "kind", "cell").orderBy("cell").limit(1))
    assert whole.where("kind = 'token'").count() == common.count() and len(one.inputFiles()) < len(whole.inputFiles())
    assert blocks.blocks(spark.createDataFrame([("zzz", "token")], "term string, kind string")).count() == 0


def test_many_keys_read_every_file(built, spark, monkeypatch):
    from ratingloom.operators import block_index

    _, blocks = built
    texts = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w250 w0")], "query_id long, title string")
    few = sorted(map(tuple, blocks.search(texts, 5).collect()))
    monkeypatch.setattr(block_index, "LOOKUPS", 1)
    assert sorted(map(tuple, blocks.search(texts, 5).collect())) == few


def test_empty_index_and_no_texts(spark, built, tmp_path):
    none = BlockIndex.build(spark.createDataFrame([], TITLES), f"{tmp_path}/none")
    asked = spark.createDataFrame([(1, "w1")], "query_id long, title string")
    assert none.search(asked).count() == 0 and built[1].search(asked.limit(0)).count() == 0
