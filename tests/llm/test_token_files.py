import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ratingloom.llm import token_files
from ratingloom.llm.elias_fano import EliasFano
from ratingloom.llm.word_tokens import WordEncoder

from .helpers import documents, hard_texts, nothing

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 10**12), max_size=600))
def test_elias_fano(values):
    values = sorted(values)
    coded = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.int64)).to_bytes())
    assert coded.run(0, len(values)).tolist() == values and [coded[i] for i in range(len(coded))] == values
    for i in range(0, len(values) + 1, 37):
        for j in (i, i + 1, i + 50, len(values)):
            assert i > j or j > len(values) or coded.run(i, j).tolist() == values[i:j]


def test_elias_fano_is_small_and_checks():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    coded = EliasFano.encode(values)
    assert len(coded.to_bytes()) < 100_000 * 2 and coded.samples.dtype.itemsize == 4
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([2, 1]))
    with pytest.raises(IndexError):
        EliasFano.encode(np.array([1]))[1]
    with pytest.raises(IndexError):
        EliasFano.encode(np.array([1])).run(0, 2)


def test_encoder_equals_the_library():
    import pyarrow as pa

    library = Tokenizer.from_file(PATH)
    texts = [t or "" for t in hard_texts()] + ["it's WE'LL x <|endoftext|> Å ı İ ǅ", "a\x1cb\x85c　d", "q" * 3000]
    ids, bounds = WordEncoder.of(PATH).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t[:40]


@pytest.mark.parametrize("change", ["case", "cut", "other"])
def test_other_settings_are_noticed(tmp_path, change):
    """Another vocabulary is encoded as the library does, not word by word as this one."""
    import json

    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    if change != "other":
        with open(PATH, encoding="utf-8") as f:
            file = json.load(f)
        if change == "case":
            file["normalizer"] = {"type": "NFC"}
        else:
            file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[a-z]+ [a-z]+|."
        path = str(tmp_path / "vocabulary.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(file, f)
    library, encoder = Tokenizer.from_file(path), WordEncoder(path)
    assert not encoder.by_words and WordEncoder.of(PATH).by_words
    texts = ["The quick  Brown\nfox", None, "", "of the year"]
    ids, bounds = encoder.encode(pa.array(texts), 7)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]


@pytest.mark.parametrize(("docs_at_once", "tokens_at_once"), [(1, 1), (3, 40), (8192, 4 << 20)])
def test_files_are_walked_by_select(spark, monkeypatch, docs_at_once, tokens_at_once):
    monkeypatch.setattr(token_files, "READ_DOCS", docs_at_once)
    monkeypatch.setattr(token_files, "READ_TOKENS", tokens_at_once)
    rows = [(None, "no id"), (None, "x"), *((i * 3, "word " * (i % 7)) for i in range(30))]
    manifest = token_files.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH)
    uri = sorted(r.name for r in __import__("pathlib").Path(manifest.removeprefix("file:").replace("//", "/", 1)).parent.glob("*.tok"))
    seen, lengths = [], []
    for name in uri:
        file = token_files.TokenFile(manifest.rsplit("/", 1)[0] + "/" + name)
        for names, bounds in file.walk():
            assert len(names) <= docs_at_once and (len(names) == 1 or bounds[-1] - bounds[0] <= tokens_at_once)
            seen += names.to_pylist()
            lengths += np.diff(bounds).tolist()
        assert [file.doc_id(i) for i in range(len(file))] == seen[-len(file) :] and [len(file[i]) for i in range(len(file))] == lengths[-len(file) :]
        file.close()
    assert seen == [d for d, _ in rows] and lengths == [3, 2] + [i % 7 + 1 for i in range(30)]


def test_round_trip(spark):
    docs = documents(spark)
    library = Tokenizer.from_file(PATH)
    manifest = token_files.write(docs, PATH, end_id=2)
    rows = token_files.read(spark, manifest).collect()
    rows.sort(key=lambda r: r["start"])
    source = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r["doc_id"] for r in rows] == [d for d, _ in source]
    at = 0
    for r, (_, text) in zip(rows, source):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_empty(spark):
    assert token_files.read(spark, token_files.write(nothing(spark), PATH)).count() == 0


def test_words_of_letters_are_not_cut(monkeypatch):
    """Letters, with or without a mark after them, are looked up without the vocabulary's regular expression, with the library's ids."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from ratingloom.llm import word_tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["The END. of; straße, Größe? ŉa ſo! ĲSSEL: x", "École ÉTÉ, naïve", "a . ;", "it's 3rd (and) a.b x,y \x7fz don't, İstanbul. ﬁne,日本語. e\u0301a, <|x|>."]
    library, encoder = Tokenizer.from_file(path), word_tokens.WordEncoder(path)
    ids, bounds = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = word_tokens.WordEncoder(path)
    monkeypatch.setattr(word_tokens, "PIECES", None)
    assert encoder.encode(pa.array(texts[:2]))[0].tolist() == ids[: bounds[2]].tolist()
