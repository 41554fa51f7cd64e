import hashlib
import struct
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ratingloom.llm import iso_media

from .helpers import documents, hard_texts, nothing


@given(st.binary(min_size=0, max_size=20_000))
def test_round_trip(data):
    whole = data + bytes(max(1, -(-len(data) // 64)) * 64 - len(data))
    media = iso_media.build(whole)
    assert iso_media.payload(media) == whole
    found = iso_media.describe(media)
    assert found["codec"] == "raw " and found["fault"] is None and found["n_samples"] == len(whole) // 64
    assert found["duration"] == len(whole) / iso_media.RATE
    for k, span in enumerate(found["keyframes"]):
        assert media[span["first"] : span["stop"]] == whole[k * 64 * iso_media.CHUNK :][:64]


def test_probe_reads_other_layouts():
    """64-bit sizes and offsets, per-sample sizes, two chunks in reverse order, a box up to the end of the file."""
    box = lambda kind, *p: struct.pack(">I4s", 8 + sum(map(len, p)), kind) + b"".join(p)
    full = lambda kind, *p: box(kind, bytes(4), *p)
    samples = [b"aaa", b"bb", b"cccc"]

    def make(at):
        stbl = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))), full(b"stts", struct.pack(">IIIII", 2, 2, 10, 1, 20)), full(b"stsc", struct.pack(">7I", 2, 1, 2, 1, 2, 1, 1)),
            full(b"stsz", struct.pack(">IIIII", 0, 3, 3, 2, 4)), full(b"co64", struct.pack(">IQQ", 2, at + 4, at)), full(b"stss", struct.pack(">II", 1, 3)),
        )
        mdhd = box(b"mdhd", bytes([0, 0, 0, 0]), struct.pack(">IIIIHH", 0, 0, 20, 40, 0, 0))
        inner = box(b"trak", box(b"mdia", mdhd, box(b"minf", stbl)))
        moov = struct.pack(">I4sQ", 1, b"moov", 16 + len(inner)) + inner
        return box(b"ftyp", b"isom", bytes(4)) + moov + struct.pack(">I4s", 0, b"mdat")

    head = make(0)
    media = make(len(head)) + samples[2] + samples[0] + samples[1]
    assert iso_media.payload(media) == b"aaabbcccc"
    found = iso_media.describe(media)
    assert found["codec"] == "avc1" and found["duration"] == 2.0 and found["keyframes"] == [{"first": len(head), "stop": len(head) + 4}]


@pytest.mark.parametrize("bad", [b"", b"\0\0", b"abcdefgh" * 9, struct.pack(">I4s", 4, b"moov"), iso_media.build(bytes(640))[:500]])
def test_faults_are_told(bad):
    assert iso_media.describe(bad)["fault"]
    assert iso_media.describe(None)["fault"] is None


def _box(kind, *parts):
    return struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)


def _film(*all_tracks, extra=b""):
    """A film of tracks (codec, timescale, ticks of a sample, samples, sync samples), one chunk each, and what its probe must find."""
    full = lambda kind, *p: _box(kind, bytes(4), *p)

    def make(at):
        out, places = b"", []
        for codec, scale, ticks, samples, syncs in all_tracks:
            starts = [at + sum(map(len, samples[:i])) for i in range(len(samples))]
            stbl = [full(b"stsd", struct.pack(">I", 1), _box(codec, bytes(28))), full(b"stts", struct.pack(">III", 1, len(samples), ticks)), full(b"stsc", struct.pack(">IIII", 1, 1, len(samples), 1))]
            stbl += [full(b"stsz", struct.pack(">II", 0, len(samples)), *(struct.pack(">I", len(x)) for x in samples)), full(b"stco", struct.pack(">II", 1, at))]
            stbl += [full(b"stss", struct.pack(">I", len(syncs)), *(struct.pack(">I", k) for k in syncs))] if syncs is not None else []
            mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, scale, ticks * len(samples), 0, 0))
            out += _box(b"trak", full(b"tkhd", bytes(80)), _box(b"edts", full(b"elst", bytes(4))), _box(b"mdia", mdhd, _box(b"minf", full(b"smhd", bytes(4)), _box(b"stbl", *stbl))))
            wanted = range(len(samples)) if syncs is None else [k - 1 for k in syncs]
            places.append({"codec": codec.decode(), "duration": ticks * len(samples) / scale, "n_samples": len(samples), "keyframes": [{"first": starts[k], "stop": starts[k] + len(samples[k])} for k in wanted]})
            at += sum(map(len, samples))
        return _box(b"ftyp", b"isom", bytes(4)) + _box(b"moov", full(b"mvhd", bytes(96)), out, extra), places

    payload = b"".join(x for t in all_tracks for x in t[3])
    head = len(make(0)[0]) + 8
    moov, places = make(head)
    return moov + _box(b"mdat", payload), places


_TRACKS = [(b"avc1", 600, 25, [b"k" * 50, b"p" * 9, b"p" * 7, b"k" * 44], [1, 4]), (b"mp4a", 44100, 1024, [b"s" * 8, b"t" * 6], None), (b"tx3g", 1000, 500, [b"u"], [1])]


@pytest.mark.parametrize("order", [(0,), (0, 1), (1, 0), (2, 1, 0), (0, 1, 2)])
def test_tracks_keep_their_own_tables(order):
    media, want = _film(*(_TRACKS[i] for i in order))
    found = iso_media.describe(media)
    assert found == {**want[0], "others": want[1:], "fault": None}


def test_fragments_and_impossible_tables_are_faults():
    assert "fragments" in iso_media.describe(_film(_TRACKS[0], extra=_box(b"mvex", bytes(8)))[0])["fault"]
    media = iso_media.build(bytes(640))
    assert "fragments" in iso_media.describe(media + _box(b"moof", bytes(8)))["fault"]
    assert "fit" in iso_media.describe(media.replace(struct.pack(">II", 64, 10), struct.pack(">II", 64, 1 << 31)))["fault"]


def test_compact_sizes():
    for bits, sizes in ((4, bytes([0x2F, 0x10])), (8, bytes([2, 15, 1])), (16, struct.pack(">HHH", 2, 15, 1))):
        track = iso_media.Track()
        data = memoryview(bytes(4) + bytes([0, 0, 0, bits]) + struct.pack(">I", 3) + sizes)
        iso_media._table(track, b"stz2", data, 0, len(data))
        assert track.sizes.tolist() == [2, 15, 1]


@pytest.mark.parametrize("names", [("codec", "media", "id"), ("media", "codec", "id"), ("id", "Codec", "media"), ("fault", "media", "keyframes")])
def test_clashing_columns_are_replaced(spark, names):
    value = {"media": bytearray(iso_media.build(bytes(64))), "id": "7"}
    df = spark.createDataFrame([tuple(value.get(n, "old") for n in names)], ", ".join(f"{n} {'binary' if n == 'media' else 'string'}" for n in names))
    found = iso_media.probe(df)
    assert found.columns == [n for n in names if n in value] + list(iso_media.PROBE.names)
    row = found.first()
    assert row["codec"] == "raw " and row["fault"] is None and row["n_samples"] == 1 and row["others"] == []
    with pytest.raises(ValueError):
        iso_media.probe(df.select(df["media"].alias("codec")), "codec")


def test_batches_are_cut_by_bytes(spark):
    import numpy as np
    import pyarrow as pa

    from ratingloom.llm.storage import cuts, slices

    assert cuts(np.array([5, 5, 5, 30, 1, 1]), 4, 10) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * n for n in (5, 5, 5, 30, 1, 0)][:5] + [None])], ["i", "t"])
    assert [b.num_rows for b in slices([batch], 4, 10)] == [2, 1, 1, 2]
    docs = spark.range(6).selectExpr("id AS doc_id", "repeat(cast(id AS string), 3000000) AS text").coalesce(1)
    for r in iso_media.digests(iso_media.probe(iso_media.store(docs))).collect():
        assert r["n_bytes"] == 3_000_000 and r["payload_sha256"] == hashlib.sha256(str(r["doc_id"]).encode() * 3_000_000).hexdigest()


def test_query_columns(spark):
    docs = documents(spark)
    rows = iso_media.digests(iso_media.probe(iso_media.store(docs))).collect()
    assert len(rows) == docs.count()
    texts = hard_texts()
    for r in rows:
        if r["doc_id"] is None:
            continue
        raw = (texts[r["doc_id"]] or "").encode()
        whole = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        media = iso_media.build(whole)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(whole), len(media))
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest() and r["media_sha256"] == hashlib.sha256(media).hexdigest() and r["tail_crc32"] == zlib.crc32(whole[-64:])
    assert iso_media.digests(iso_media.probe(iso_media.store(nothing(spark)))).count() == 0


def test_probe_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, bytearray(iso_media.build(bytes(64))), "a"), (2, None, "b"), (3, bytearray(b"zzzz"), None)], "id long, media binary, codec string")
    rows = {r["id"]: r for r in iso_media.probe(df).collect()}
    assert rows[1]["codec"] == "raw " and rows[2]["codec"] is None and rows[3]["fault"]
