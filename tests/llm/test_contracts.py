"""Every registered query whose result SQL can't express, over a whole folder of test tables, held against a plain computation."""

import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
import zstandard
from tokenizers import Tokenizer

from ratingloom.llm import entry, iso_media, quality

from . import test_pii

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def results(spark, sf_dir, name, *columns):
    df = entry.QUERIES[name](spark, sf_dir)
    assert set(columns) <= set(df.columns)
    rows = df.collect()
    return sorted(rows, key=lambda r: (r["doc_id"], r["piece"] if "piece" in columns else 0))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, sf_dir, texts):
    prints = {}
    for doc, text in texts.items():
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
        ones = np.zeros(64, int)
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            ones += np.array([h >> b & 1 for b in range(64)])
        prints[doc] = sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(texts), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    rows = results(spark, sf_dir, "op2_simhash_near_dedup", "doc_id", "fingerprint", "component_id")
    assert [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows] == [(d, f"{prints[d]:016x}", find(d)) for d in sorted(texts)]


def test_op3(spark, sf_dir, texts):
    library, at, want = Tokenizer.from_file(WORDS), 0, []
    for doc in sorted(texts):
        ids = library.encode(texts[doc], add_special_tokens=False).ids + [2]
        want.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    rows = results(spark, sf_dir, "op3_elias_fano_token_files", "doc_id", "start", "n_tokens", "ids_crc32")
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == want


def test_op4(spark, sf_dir, texts):
    names = ("email", "ip", "card", "phone")
    rows = results(spark, sf_dir, "op4_pii_candidates", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    assert [r["doc_id"] for r in rows] == sorted(texts)
    for r in rows:
        base = test_pii.base(texts[r["doc_id"]])
        assert [r[f"n_{n}"] for n in names] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        spans = [(int(a), names.index(k), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert spans == sorted(spans) and set(base) <= set(spans)
        for a, _, b in set(spans) - set(base):
            assert not any(x < b and a < y for x, _, y in base) and 0 <= a < b <= len(texts[r["doc_id"]])


def test_op5(spark, sf_dir, texts):
    """Scores made anew by compressing with the model's dictionaries; held-out labels teach nothing and are told apart."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    learnt = labels.where(labels["doc_id"].isin([d for d in known if not held(d)]))
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), learnt)
    good, bad = (zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False) for d in (model.good, model.bad))

    def score(text):
        data, x = text.encode(), [1.0, 0.0, 0.0, 0.0, 0.0]
        if data:
            a, b = (sum(len(c.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)) for c in (good, bad))
            sure, least = 10 * len(data) / (len(data) + 100), min(1.0, min(a, b) / len(data))
            x = [1.0, sure * (b - a) / (a + b), sure * (b - a) / len(data), 10 * least, 10 * least**2]
        return 1 / (1 + np.exp(-np.clip(np.dot(x, model.weights), -30, 30)))

    rows = results(spark, sf_dir, "op5_compression_quality", "doc_id", "held_out", "score", "predicted")
    assert [r["doc_id"] for r in rows] == sorted(texts)
    for r in rows:
        assert r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
        assert abs(r["score"] - score(texts[r["doc_id"]])) < 1e-9
    pairs = [(r["score"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    ones, zeros = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    assert ones and zeros and np.mean([[(a > b) + (a == b) / 2 for b in zeros] for a in ones]) > 0.9


def test_op6(spark, sf_dir, texts):
    from ratingloom.llm.byte_bpe import read_ranks

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rows = results(spark, sf_dir, "op6_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(d, len(ids := library.encode_ordinary(texts[d])), sha(",".join(map(str, ids)).encode()), sha(texts[d].encode())) for d in sorted(texts)]
    assert [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows] == want


def test_op7(spark, sf_dir, texts):
    rows = results(spark, sf_dir, "op7_iso_media", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert [r["doc_id"] for r in rows] == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        whole = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = iso_media.build(whole)
        place = media.index(b"mdat") + 4  # all samples lie in one run behind the head of the media box
        assert media[place:] == whole
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        codec, seconds, samples, keys = r["feature"].split(";")
        assert (codec, float(seconds), int(samples)) == ("raw ", len(whole) / 8000, len(whole) // 64)
        assert keys == ",".join(f"{place + i}-{place + i + 64}" for i in range(0, len(whole), 4096))


def test_op8(spark, sf_dir, texts):
    library, total, by_sequence = Tokenizer.from_file(WORDS), 0, {}
    rows = results(spark, sf_dir, "op8_best_two_fit_packing", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    want = []
    for doc in sorted(texts):
        ids = library.encode(texts[doc], add_special_tokens=False).ids + [1]
        total += len(ids)
        want += [(doc, i, 4096 * i, len(part := ids[4096 * i : 4096 * (i + 1)]), crc(part)) for i in range(-(-len(ids) // 4096))]
    assert [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows] == want
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 4096
    assert len(by_sequence) <= 1.01 * -(-total // 4096) + 1
