import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from ratingloom.llm import byte_bpe

from .helpers import documents, hard_texts, nothing

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_equals_the_library_and_decodes(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK_PIECES", 200)
    docs = documents(spark)
    coded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).cache()
    texts = hard_texts()
    rows = coded.collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            assert r["ids"] == LIBRARY.encode_ordinary(texts[r["doc_id"]] or ""), r["doc_id"]
    for r in byte_bpe.decode(coded, RANKS).collect():
        if r["doc_id"] is not None:
            assert bytes(r["data"]) == (texts[r["doc_id"]] or "").encode()


def test_long_pieces_equal_the_fold(spark):
    pairs = byte_bpe.pair_ranks(RANKS)
    words = ["the", "antidisestablishmentarianism", "é" * 20, "aaaaabbbbbaaaa", "x", "日本語", "thththththing"]
    df = spark.createDataFrame([(w,) for w in words], "piece string")
    got = {r[0]: r[1] for r in df.select("piece", byte_bpe.piece_ids(F.col("piece"), RANKS)).collect()}
    for w in words:
        assert got[w] == byte_bpe.long_piece_ids(w.encode(), RANKS, pairs) == LIBRARY.encode_ordinary(w)
    assert byte_bpe.long_piece_ids(b"a" * 5000, RANKS, pairs) == LIBRARY._encode_single_piece(b"a" * 5000)


def test_a_piece_that_is_a_token_is_that_token(spark):
    """Also where no merge leads to it, as in a table that wasn't trained."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257, b"xyz": 258, b"yz": 259, "éé".encode(): 260}
    library = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    assert byte_bpe.unreached(ranks, byte_bpe.pair_ranks(ranks)) == {"abcd": 257, "éé": 260} and not byte_bpe.unreached(RANKS, byte_bpe.pair_ranks(RANKS))
    words = ["abcd", "abcde", "xyz", "éé", "ééé", "ab", "a"]
    df = spark.createDataFrame([(w,) for w in words], "piece string")
    got = {r[0]: r[1] for r in df.select("piece", byte_bpe.piece_ids(F.col("piece"), ranks)).collect()}
    assert got == {w: library.encode_ordinary(w) for w in words}


def test_table_holds_every_pair():
    pairs = {(a, b): a * b % 1000 for a in range(40) for b in range(40)}
    table = byte_bpe.cuckoo_table(pairs)
    for (a, b), rank in pairs.items():
        key = a << byte_bpe._SHIFT | b
        assert key << byte_bpe._SHIFT | rank in [table[s] for s in byte_bpe._slots(key, len(table))]


def test_empty(spark):
    assert byte_bpe.digests(byte_bpe.encode(nothing(spark), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_ids_without_a_token(spark):
    df = spark.createDataFrame([(1, [0, 1]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["data"]) for r in byte_bpe.decode(df, {b"a": 1}).collect()}
    assert got == {1: b"a", 2: b"", 3: b""}
