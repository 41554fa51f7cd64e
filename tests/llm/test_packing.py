import zlib

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ratingloom.llm import packing

from .helpers import documents, hard_texts, nothing

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(1, 50), max_size=200))
def test_bins_hold_everything_once(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets = packing.best_two_fit(lengths, 50)
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        order = own[np.argsort(offsets[own])]
        assert offsets[order[0]] == 0 and (offsets[order][1:] == np.cumsum(lengths[order])[:-1]).all() and lengths[own].sum() <= 50


def test_two_for_one():
    """60 + 30 leaves 10; 20 + 20 in place of 30 fill the bin."""
    bins, _ = packing.best_two_fit(np.array([60, 30, 20, 20]), 100)
    assert sorted(np.bincount(bins, [60, 30, 20, 20])) == [30, 100]


def test_pieces_and_places(spark):
    docs = documents(spark)
    library, texts = Tokenizer.from_file(PATH), hard_texts()
    rows = packing.pack(packing.pieces(docs, PATH, 1, 64), 64, group_size=16).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, own in by_doc.items():
        if doc is None or doc == 3:
            continue
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 64)))
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 64 * r["piece"] and len(part) == r["length"] == min(64, len(ids) - r["start"])
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= 1.1 * total / 64 + 2


def test_empty(spark):
    assert packing.pack(packing.pieces(nothing(spark), PATH)).count() == 0
