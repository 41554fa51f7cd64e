import random

import numpy as np
import pytest

from ratingloom.llm import merge, suffix_dedup, windows

from .helpers import documents, hard_texts, nothing, words


def brute(texts, length):
    raw, seen = [(t or "").encode() for t in texts], {}
    for b in raw:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for b in raw:
        covered = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                covered[p : p + length] = True
        starts = int((np.diff(np.append(0, covered.astype(int))) == 1).sum())
        out.append((len(b), int(covered.sum()), starts, bytes(np.frombuffer(b, np.uint8)[~covered]) if len(b) else b""))
    return out


@pytest.fixture(params=[256, 3])
def fan(request, monkeypatch):
    """Runs that are merged at once: few of them make levels."""
    monkeypatch.setattr(merge, "FAN", request.param)


def check(spark, texts, length, parts=3):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    rows = sorted(suffix_dedup.repeats(df, length).collect())
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows] == brute(texts, length)


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force_on_mosaics(spark, monkeypatch, fan, seed):
    """Texts put together from shared stretches that overlap in many ways, over several slices."""
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 4000)
    rng = random.Random(seed)
    pool = "".join(rng.choice("abcd ") for _ in range(3000))
    texts = []
    for _ in range(60):
        text = ""
        for _ in range(rng.randint(0, 6)):
            a = rng.randrange(len(pool))
            text += pool[a : a + rng.randint(1, 120)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30)))
        texts.append(text)
    check(spark, texts, 40)


def test_equals_brute_force_on_hard_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 2000)
    check(spark, [t for t in hard_texts() if t is None or len(t) < 5000] + [words(9, 300), words(9, 300)[7:1000]], 200)


def test_few_letters(spark):
    rng = random.Random(8)
    check(spark, ["".join(rng.choice("ab") for _ in range(rng.randint(0, 300))) for _ in range(30)], 16)


def test_columns_stay(spark):
    docs = documents(spark)
    got = suffix_dedup.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert got.where("doc_id = 0").first()["text"] is None
    rows = {r["doc_id"]: r["text"] for r in got.collect() if r["doc_id"] != 3}
    assert rows[5] == "" and rows[7] == "tail" and rows[8] == "head"
    assert suffix_dedup.without_repeats(nothing(spark)).count() == 0


@pytest.mark.parametrize("block", [64, 1 << 19])
def test_anchors_cover_all_windows_alike(monkeypatch, block):
    monkeypatch.setattr(windows, "BLOCK", block)
    monkeypatch.setattr(windows.Hasher, "_made", {})
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(97, 100, 900), np.full(100, 97), rng.integers(97, 123, 500)]).astype(np.uint8)
    place, hashes, first, last = windows.anchors(data, 30, 12)
    assert first[0] == 0 and last[-1] == len(data) - 30 and (first[1:] == last[:-1] + 1).all()
    assert ((place >= first - 0) & (place + 12 <= first + 30) | (first == last) | (place >= last)).all()
    other, hashes2, first2, _ = windows.anchors(data[200:], 30, 12)
    inside = first >= 200
    assert (place[inside][1:] - 200 == other[-inside.sum() + 1 :]).all() and (hashes[inside][1:] == hashes2[-inside.sum() + 1 :]).all()
