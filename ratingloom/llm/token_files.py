"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A file holds the documents of one range of ids in ascending order:

    ids (little-endian, 2 or 4 bytes) | boundaries | document ids | footer (JSON) | its length (4 bytes) | magic

Boundaries and document ids are Elias-Fano lists; documents without an id come first and are only
counted. The manifest lists the files in order, each with the number of tokens before it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .elias_fano import EliasFano
from .storage import new_folder, open_fs, put, slices
from .word_tokens import WordEncoder

MAGIC = b"RLTOK2\n\0"
#: Tokens that a reader holds at a time, unless one document has more, and documents.
READ_TOKENS, READ_DOCS = 4 << 20, 8192


def write(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every whole text and write files in ascending order of id; the manifest's URI.

    Null texts are empty; each document ends with end_id. Rows without an id come first; rows that
    share an id are ordered by their text. Ids must be integers. Other columns are left out. An
    empty table gives a manifest without files. The driver gets one short row for each file.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(vocabulary)
        lengths, ids, missing = [], [], 0
        part = TaskContext.get().partitionId()
        batches = slices(batches)
        first = next(batches, None)
        if first is None:
            return

        def chunks() -> Iterator[bytes]:
            nonlocal missing
            batch, at = first, 0
            while batch is not None:
                tokens, bounds = encoder.encode(batch.column(1), end_id)
                missing += batch.column(0).null_count
                ids.append(np.asarray(batch.column(0).drop_null()))
                lengths.append(np.diff(bounds))
                at += len(tokens)
                yield memoryview(np.ascontiguousarray(tokens)).cast("B")
                batch = next(batches, None)
            marks = EliasFano.encode(np.concatenate([[0], np.cumsum(np.concatenate(lengths))])).to_bytes()
            names = EliasFano.encode(np.concatenate(ids)).to_bytes()
            foot = json.dumps({"width": encoder.dtype.itemsize, "tokens": at, "nulls": missing, "boundaries": len(marks), "ids": len(names)}).encode()
            yield marks + names + foot + len(foot).to_bytes(4, "little") + MAGIC

        uri = f"{folder}/part-{part:06d}.tok"
        put(uri, chunks())
        n = np.concatenate(lengths)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array([len(n)]), pa.array([int(n.sum())])], ["part", "file", "docs", "tokens"])

    sorted_docs = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )
    files = sorted(map(tuple, sorted_docs.mapInArrow(run, "part int, file string, docs bigint, tokens bigint").collect()))
    before, listed = 0, []
    for _, file, n_docs, n_tokens in files:
        listed.append({"file": file, "docs": n_docs, "tokens": n_tokens, "before": before})
        before += n_tokens
    put(f"{folder}/manifest.json", [json.dumps({"files": listed}).encode()])
    return f"{folder}/manifest.json"


class TokenFile:
    """Random access to one file: len, document i's ids, runs of documents; boundaries and ids stay as they are stored, and are selected from."""

    def __init__(self, uri: str):
        files, path = open_fs(uri)
        self._in = files.open_input_file(path)
        size = self._in.size()
        tail = self._in.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        n = int.from_bytes(tail[:4], "little")
        foot = json.loads(self._in.read_at(n, size - 12 - n))
        self.dtype = np.dtype(f"<u{foot['width']}")
        start = foot["tokens"] * foot["width"]
        self.boundaries = EliasFano.from_bytes(self._in.read_at(foot["boundaries"], start))
        self.ids = EliasFano.from_bytes(self._in.read_at(foot["ids"], start + foot["boundaries"]))
        self.nulls = foot["nulls"]

    def __len__(self) -> int:
        return len(self.boundaries) - 1

    def tokens(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self._in.read_at((stop - start) * self.dtype.itemsize, start * self.dtype.itemsize), self.dtype)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.tokens(self.boundaries[i], self.boundaries[i + 1])

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.ids[i - self.nulls]

    def close(self) -> None:
        self._in.close()

    def walk(self) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """(document ids, their boundaries and the next one's) of runs of documents of READ_DOCS and READ_TOKENS at most, one document at least."""
        i, n = 0, len(self)
        while i < n:
            bounds = self.boundaries.run(i, min(n, i + READ_DOCS) + 1)
            j = i + max(1, int(np.searchsorted(bounds, bounds[0] + READ_TOKENS, "right")) - 1)
            without = min(j, self.nulls) - min(i, self.nulls)
            named = self.ids.run(max(i, self.nulls) - self.nulls, max(j, self.nulls) - self.nulls)
            yield pa.concat_arrays([pa.nulls(without, pa.int64()), pa.array(named, pa.int64())]), bounds[: j - i + 1]
            i = j


def read(spark: SparkSession, manifest: str, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read from the files of a manifest.

    start counts the tokens of all documents before it, in all files. ids_crc32 is over the ids as
    little-endian unsigned 32-bit integers; ids are left out with digest_only.
    """
    files, path = open_fs(manifest)
    with files.open_input_stream(path) as f:
        listed = json.loads(f.read())["files"]
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * (not digest_only)
    ddl = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * (not digest_only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(uri)
                for names, bounds in file.walk():
                    ids, at = file.tokens(int(bounds[0]), int(bounds[-1])), bounds - bounds[0]
                    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
                    cols = [names, pa.array(before + bounds[:-1]), pa.array(np.diff(at)), pa.array(sums, pa.int64())]
                    if not digest_only:
                        cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))
                file.close()

    rows = [(x["file"], x["before"]) for x in listed]
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.createDataFrame(rows, "file string, before bigint").repartition(max(1, min(len(rows), tasks))).mapInArrow(run, ddl)
