import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratingloom.llm import merge, storage, warc


def brute(rows, least=1000):
    groups = {}
    for i, _, t in rows:
        raw = (t or "").encode()
        if len(raw) >= least and i is not None:
            groups[raw] = max(groups.get(raw, i), i)
    out = []
    for i, _, t in rows:
        raw = (t or "").encode()
        to = groups.get(raw) if len(raw) >= least else None
        to = None if to == i else to
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


ROWS = (
    [(i, f"http://www.Example{i % 3}.org/p/{i % 5}?q={i}", "<p>" + "x" * (400 * (i % 4)) + "</p>") for i in range(60)]
    + [(100, None, None), (101, "not a url", ""), (102, "http://[bad", "é" * 600), (103, "http://a.b/\r\nX: y", "é" * 600), (104, "http://a.b:8080/ü", "tail"), (None, "http://c.d", "z" * 2000), (105, "http://c.d", "z" * 2000)]
    + [(106, "http://e.f", "w" * 1500), (106, "http://e.f", "w" * 1500)]
)


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_round_trip_and_order(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 7)
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, file string")
    archives = warc.write(pages, broadcast_rows=broadcast_rows)
    assert archives.count() > 5
    rows = warc.index(archives).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)
    assert got == brute(ROWS)
    keys = [(r["url_key"].encode(), r["captured_at"]) for r in rows]
    assert keys == sorted(keys)
    for r in rows[:10]:
        found = [x for x in warc.records(r["file"]) if x[0] == r["offset"]]
        assert len(found) == 1 and found[0][1] == r["length"]


def test_empty(spark):
    assert warc.index(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_url_key():
    assert warc.url_key("https://www.Example.com:443/A?b=1#c") == "com,example)/A?b=1"
    assert warc.url_key(None) == "" and warc.url_key("x y") == "x y"


@given(st.lists(st.lists(st.binary(max_size=6), max_size=30), min_size=1, max_size=9))
def test_loser_tree_merges_and_knows_prefixes(runs):
    runs = [sorted(r) for r in runs]
    streams = [merge.unpack(merge.pack([(k, str(i).encode()) for k in r])) for i, r in enumerate(runs)]
    got = list(merge.LoserTree(list(streams)))
    assert [k for _, k, _, _ in got] == sorted(k for r in runs for k in r)
    before = b""
    for prefix, key, value, run in got:
        assert prefix == merge.common(before, key) and value == str(run).encode()
        before = key


def _blocks(spark, runs):
    rows = []
    for name, keys in runs.items():
        writer = merge.RunWriter(name)
        rows += [r for k in keys if (r := writer.add(k, name.encode()))]
        rows += [r for r in [writer.end()] if r]
    return storage.stored(spark.createDataFrame(rows, merge.BLOCKS_DDL), "blocks")


def _runs(n, seed=2, size=200):
    rng = random.Random(seed)
    return {f"r{i}": sorted(bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) for _ in range(size)) for i in range(n)}


@pytest.mark.parametrize(("n", "range_bytes"), [(1, 1 << 20), (5, 2000), (40, 1500)])
def test_ranges_merge_to_one_order(spark, monkeypatch, n, range_bytes):
    """Runs of many small blocks, so that blocks are opened one after the other, within and over ranges."""
    monkeypatch.setattr(merge, "BLOCK_BYTES", 400)
    runs = _runs(n)

    def consume(items):
        before = b""
        for prefix, key, value in items:
            assert prefix == merge.common(before, key) and before <= key
            yield key, value.decode()
            before = key

    out = merge.merged(_blocks(spark, runs), consume, pa.schema([("key", pa.binary()), ("value", pa.string())]), "key binary, value string", range_bytes=range_bytes)
    assert n == 1 or out.rdd.getNumPartitions() > 3
    got = [(bytes(r["key"]), r["value"]) for r in out.collect()]
    assert [k for k, _ in got] == sorted(k for keys in runs.values() for k in keys)
    assert sorted(got) == sorted((k, name) for name, keys in runs.items() for k in keys)


def test_only_one_block_of_a_run_is_open(monkeypatch):
    monkeypatch.setattr(merge, "BLOCK_BYTES", 400)
    runs = {f"r{i}": [b"%06d" % k for k in range(i, 3000, 3)] for i in range(3)}
    rows = []
    for name, keys in runs.items():
        writer = merge.RunWriter(name)
        made = [*(writer.add(k, b"") for k in keys), writer.end()]
        rows += [(bool(r[1]), r[0], r[4], r[6], r[3]) for r in made if r]
    rows.sort(key=lambda r: (r[0], r[4], r[1]))
    read, most = [0], 0
    total = len(rows)

    def stream():
        for row in rows:
            read[0] += 1
            yield row[:4]

    for at, (_, key, _, _) in enumerate(merge.LoserTree(merge._Range(stream()).runs())):
        assert key == b"%06d" % at
        most = max(most, read[0] - at * total // 3000)
    assert at == 2999 and most <= 7


def test_many_runs_are_merged_in_levels(spark, monkeypatch):
    monkeypatch.setattr(merge, "BLOCK_BYTES", 300)
    monkeypatch.setattr(merge, "FAN", 3)
    runs = _runs(20, size=60)

    def fold(items):
        before = None
        for _, key, value in items:
            yield (True, key, value) if key != before else (False, key)
            before = key

    blocks, told = merge.reduced(_blocks(spark, runs), fold, pa.schema([("twin", pa.binary())]), "twin binary", range_bytes=800)
    assert blocks.select(F.split("run", "[.]")[0]).distinct().count() <= 3
    twins = [bytes(r["twin"]) for r in told.collect()]
    keys = [bytes(r["key"]) for r in merge.merged(blocks, lambda items: ((k,) for _, k, _ in items), pa.schema([("key", pa.binary())]), "key binary", range_bytes=800).collect()]
    assert keys == sorted(keys) and sorted(twins + keys) == sorted(k for r in runs.values() for k in r)


def test_index_of_many_archives_goes_through_levels(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 3)
    monkeypatch.setattr(merge, "FAN", 4)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    rows = warc.index(warc.write(pages)).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str) == brute(ROWS)
    keys = [(r["url_key"].encode(), r["captured_at"]) for r in rows]
    assert keys == sorted(keys)
