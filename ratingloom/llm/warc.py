"""WARC archives of page captures, with an index made by an external merge.

``write`` gives each page a record: a response, or a revisit of the one capture that keeps an equal
payload. ``capture_runs`` reads archives back one by one; each gives a run of index entries sorted by
URL key and time. ``index`` merges the runs with loser trees into one ordered history of captures.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import BLOCKS, BLOCKS_DDL, RunWriter, batches, kept, merged, reduced
from .storage import new_folder, open_fs, put, saved, stored

#: An archive is closed at so many records or bytes before compression.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 16_384, 64 << 20
#: Time of the capture of page 0; page n follows n seconds later.
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
#: Fixed value of the WARC 1.1 format.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLOCK = 1 << 20


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, lower-case and without www, then path and query; the URL itself where it has no host."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text)
        host, port = parts.hostname, parts.port
    except ValueError:
        return text
    if not host:
        return text
    host = host.removeprefix("www.")
    port = f":{port}" if port not in (None, 80, 443) else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _stamp(page_id: int | None) -> datetime:
    try:
        return EPOCH + timedelta(seconds=page_id or 0)
    except OverflowError:
        return EPOCH


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _record(head: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + f"{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The record of one page; without its payload if it refers to another page's record."""
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in (url or "").strip())
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", _stamp(page_id).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    head += [("X-Page-ID", page_id)] * (page_id is not None)
    if refers_to is not None:
        head += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", _record_id(refers_to)), ("X-Refers-To-Page-ID", refers_to)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(head, http + (payload if refers_to is None else b""))


def refers(pages: DataFrame, least: int = 1000, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """(__id, __sha, __to): the rows that revisit another, by id and payload digest.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest id is kept; rows
    that repeat that id and payload are responses too. If no row of a payload has an id, none revisits.
    """
    light = pages.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("t")).where(F.octet_length("t") >= least).select("__id", F.sha1(F.col("t").cast("binary")).alias("__sha"))
    groups = light.groupBy("__sha").agg(F.max("__id").alias("__to"), F.count("*").alias("n")).where("n > 1 and __to is not null").drop("n")
    return light.join(groups, "__sha").where("__id is null or __id <> __to").select("__id", "__sha", "__to").distinct()


def write(pages: DataFrame, folder: str | None = None, least: int = 1000, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", broadcast_rows: int = 100_000) -> DataFrame:
    """Write every page as a record of gzip members; (file, records, bytes) of each archive.

    Null payloads and URLs are empty. One row is one record; other columns are left out. An archive
    appears whole or not at all, and a task that runs again replaces its own.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    twins = saved(refers(pages, least, id_col, text_col))
    rows = pages.select(F.col(id_col).cast("bigint").alias("__id"), F.col(url_col).alias("__url"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__payload"))
    n = twins.count()
    if n:
        named = rows.withColumn("__key", F.when(F.octet_length("__payload") >= least, F.sha1("__payload"))).alias("a")
        other = (F.broadcast(twins) if n <= broadcast_rows else twins).alias("b")
        rows = named.join(other, F.col("a.__id").eqNullSafe(F.col("b.__id")) & (F.col("a.__key") == F.col("b.__sha")), "left").select("a.__id", "a.__url", "a.__payload", "b.__to")
    else:
        rows = rows.withColumn("__to", F.lit(None).cast("bigint"))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        source = ((i, u, p, r) for batch in found for i, u, p, r in zip(*(c.to_pylist() for c in batch.columns)))
        number, waiting = 0, next(source, None)
        while waiting is not None:
            uri, records, size = f"{folder}/captures-{part:06d}-{number:04d}.warc.gz", 0, 0

            def members() -> Iterator[bytes]:
                nonlocal waiting, records, size
                yield _member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None)), ("WARC-Date", _stamp(0).strftime("%Y-%m-%dT%H:%M:%SZ")), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                while waiting is not None and records < ARCHIVE_RECORDS and size < ARCHIVE_BYTES:
                    raw = page_record(*waiting)
                    records, size, waiting = records + 1, size + len(raw), next(source, None)
                    yield _member(raw)

            written = put(uri, members())
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([records], pa.int64()), pa.array([written], pa.int64())], ["file", "records", "bytes"])

    return saved(rows.mapInArrow(run, "file string, records bigint, bytes bigint"))


def _member(raw: bytes) -> bytes:
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def records(uri: str) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers by lower-case name, block) of each record of an archive of gzip members."""
    files, path = open_fs(uri)
    with files.open_input_stream(path, compression=None) as source:
        waiting, at = b"", 0
        while True:
            inflate, parts, used = zlib.decompressobj(31), [], 0
            while not inflate.eof:
                if not waiting:
                    waiting = source.read(_BLOCK)
                    if not waiting:
                        if used:
                            raise ValueError(f"{uri} is cut off")
                        return
                parts.append(inflate.decompress(waiting))
                used += len(waiting) - len(inflate.unused_data)
                waiting = inflate.unused_data
            raw = b"".join(parts)
            stop = raw.index(b"\r\n\r\n")
            lines = raw[:stop].decode("utf-8", "surrogatepass").split("\r\n")
            head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            yield at, used, head, raw[stop + 4 : stop + 4 + int(head["content-length"])]
            at += used


def _entry(uri: str) -> Iterator[tuple[bytes, bytes]]:
    """(sort key, value) of each capture of an archive; payloads of responses are held against their digests."""
    for offset, length, head, block in records(uri):
        if head["warc-type"] not in ("response", "revisit"):
            continue
        http, _, body = block.partition(b"\r\n\r\n")
        digest = head["warc-payload-digest"].partition(":")[2]
        size = next(int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.lower() == b"content-length")
        revisit = head["warc-type"] == "revisit"
        if not revisit:
            if hashlib.sha1(body).hexdigest() != digest:
                raise ValueError(f"{uri}: the record at {offset} has another payload than its digest")
            size = len(body)
        page, to = head.get("x-page-id"), head.get("x-refers-to-page-id")
        stamp = head["warc-date"]
        key = url_key(head["warc-target-uri"]).encode("utf-8", "surrogatepass") + b"\0" + stamp.encode() + struct.pack(">Q", (int(page) if page else 0) + (1 << 63)) + struct.pack(">Q", offset)
        value = "\0".join([page or "", stamp, "revisit" if revisit else "response", to or "", str(size), digest, str(offset), str(length), uri])
        yield key, value.encode()


def capture_runs(archives: DataFrame, file_col: str = "file") -> DataFrame:
    """Blocks of index entries: each archive, read from start to end, gives one sorted run."""

    def rows(found: Iterator[pa.RecordBatch]) -> Iterator[tuple | None]:
        for batch in found:
            for uri in batch.column(0).to_pylist():
                run = RunWriter(uri)
                for key, value in sorted(_entry(uri)):
                    yield run.add(key, value)
                yield run.end()

    files, context = archives.select(file_col), archives.sparkSession.sparkContext
    tasks = max(4 * context.defaultParallelism, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(max(1, min(files.count(), tasks))).mapInArrow(lambda found: batches(rows(found), BLOCKS), BLOCKS_DDL)


ENTRIES = pa.schema(
    [("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    + [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
_NO_ROWS = pa.schema([("none", pa.int32())])
ENTRIES_DDL = "url_key string, captured_at string, page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, file string, offset bigint, length bigint"


def index(archives: DataFrame) -> DataFrame:
    """ENTRIES of all captures of the archives, ordered by URL key, time and page id within and over partitions."""

    def consume(items: Iterator[tuple[int, bytes, bytes]]) -> Iterator[tuple]:
        for _, key, value in items:
            page, stamp, kind, to, size, digest, offset, length, uri = value.decode().split("\0")
            url = key[: -17 - len(stamp)].decode("utf-8", "surrogatepass")
            yield url, stamp, int(page) if page else None, kind, int(to) if to else None, int(size), digest, uri, int(offset), int(length)

    runs, _ = reduced(stored(capture_runs(archives), "runs"), kept, _NO_ROWS, "none int")
    return merged(runs, consume, ENTRIES, ENTRIES_DDL)
