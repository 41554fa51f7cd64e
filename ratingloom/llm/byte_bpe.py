"""Byte-level BPE by a table of ranks: ids of whole texts, and texts of ids.

Texts are cut into pieces by the vocabulary's pattern, in chunks of bounded vocabulary; a chunk keeps
its documents as codes of its own distinct pieces. Each distinct piece of the corpus is then encoded
once, by Spark's higher-order functions: a fold over the piece's bytes merges, step by step, the
leftmost neighbours of least rank. Ranks are looked up in a literal table of pairs of ids. The ids of a
chunk's pieces go back to the chunk, which puts its documents together.
"""

from __future__ import annotations

import base64
import contextlib
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import new_file, new_folder, open_fs

#: Distinct pieces of a chunk; bytes of the longest piece that the fold takes (its steps grow with the square);
#: chunks that one row names.
CHUNK_PIECES, FOLD_BYTES, REFERENCES = 1 << 19, 256, 4096
_SHIFT, _MIX = 20, ((0x9E3779B1, 0x85EBCA77), (0xC2B2AE3D, 0x27D4EB2F))


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank of each line of a rank file; a token's rank is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The id that each pair of neighbouring ids merges to."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


def _slots(key: int, size: int) -> list[int]:
    a, b = key >> _SHIFT, key & (1 << _SHIFT) - 1
    return [a * m + b * n >> 16 & size - 1 for m, n in _MIX]


def cuckoo_table(pairs: dict[tuple[int, int], int]) -> list[int]:
    """Each pair in one of its two slots, as pair key << _SHIFT | merged id; -1 where a slot is free."""
    size = 1 << max(4, (2 * len(pairs)).bit_length())
    while True:
        table = [-1] * size
        for (a, b), rank in pairs.items():
            entry, place = (a << _SHIFT | b) << _SHIFT | rank, None
            for _ in range(200):
                one, two = _slots(entry >> _SHIFT, size)
                place = one if place != one else two
                entry, table[place] = table[place], entry
                if entry == -1:
                    break
            if entry != -1:
                break
        else:
            return table
        size *= 2


def _lookup(table: Column, size: int, a: Column, b: Column) -> Column:
    """The id that a and b merge to, or null."""
    a, b = a.cast("bigint"), b.cast("bigint")
    key = F.shiftleft(a, _SHIFT) + b
    first, second = (F.get(table, F.shiftright(a * F.lit(m) + b * F.lit(n), 16).bitwiseAND(F.lit(size - 1)).cast("int")) for m, n in _MIX)
    merged = lambda entry: entry.bitwiseAND(F.lit((1 << _SHIFT) - 1)).cast("int")
    return F.when(F.shiftright(first, _SHIFT) == key, merged(first)).when(F.shiftright(second, _SHIFT) == key, merged(second))


def piece_ids(piece: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of a piece (a string of 1 to FOLD_BYTES bytes), by ranked merges from its bytes up; a piece that is a token is that token."""
    merges = pair_ranks(ranks)
    pairs = cuckoo_table(merges)
    literal = F.from_json(F.lit(json.dumps(pairs, separators=(",", ":"))), "array<bigint>")  # folded into one constant
    singles = F.array(*(F.lit(ranks.get(bytes([b]), -1)) for b in range(256)))
    spelt = F.hex(piece.cast("binary"))
    start = F.transform(F.sequence(F.lit(0), F.octet_length(piece) - 1), lambda i: F.get(singles, F.conv(F.substr(spelt, 2 * i + 1, F.lit(2)), 16, 10).cast("int")))

    lookup = lambda table, a, b: _lookup(table, len(pairs), a, b)
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    edge = F.array(F.lit(-1))

    def step(state: Column, table: Column) -> Column:
        ids, ranks = state["ids"], state["ranks"]

        def merge(least: Column, at: Column) -> Column:
            """The state with the ids at places at and at + 1 as one; only its two neighbours get new ranks."""
            near = F.array(lookup(table, F.get(ids, at - 2), least), lookup(table, least, F.get(ids, at + 1)))
            return F.struct(
                F.concat(F.slice(ids, F.lit(1), at - 1), F.array(least), F.slice(ids, at + 2, F.size(ids))).alias("ids"),
                F.concat(F.slice(ranks, F.lit(1), at - 2), near, F.slice(ranks, at + 2, F.size(ids))).alias("ranks"),
            )

        return let(F.array_min(ranks), lambda least: F.when(least.isNull(), state).otherwise(let(F.array_position(ranks, least).cast("int"), lambda at: merge(least, at))))

    def fold(table: Column) -> Column:
        def run(ids: Column) -> Column:
            n = F.size(ids)
            ranks = F.zip_with(F.slice(ids, F.lit(1), n - 1), F.slice(ids, F.lit(2), n - 1), lambda a, b: lookup(table, a, b))
            begin = F.struct(ids.alias("ids"), ranks.alias("ranks"))
            return F.aggregate(F.sequence(F.lit(2), F.greatest(n - 2, F.lit(2))), begin, lambda state, _: step(state, table), lambda state: F.slice(state["ids"], F.lit(2), F.size(state["ids"]) - 2))

        return let(F.concat(edge, start, edge), run)

    folded, whole = let(literal, fold), unreached(ranks, merges)
    if not whole:
        return folded
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in whole.items() for x in pair)), piece)
    return F.when(known.isNotNull(), F.array(known)).otherwise(folded)


def unreached(ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> dict[str, int]:
    """The tokens (as texts, as far as they are such) that merging their own bytes doesn't lead to; few or none in a trained vocabulary."""
    out = {}
    for token, rank in ranks.items():
        with contextlib.suppress(UnicodeDecodeError):
            if merged_ids(token, ranks, pairs) != [rank]:
                out[token.decode()] = rank
    return out


def long_piece_ids(piece: bytes, ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """As piece_ids, in time that grows little more than the piece."""
    return [ranks[piece]] if piece in ranks else merged_ids(piece, ranks, pairs)


def merged_ids(piece: bytes, ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The ids that ranked merges make of a piece; candidates for merging wait in a heap."""
    ids = [ranks[bytes([b])] for b in piece]
    after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else -1
        if j < 0 or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
            if (r := pairs.get((rank, ids[after[i]]))) is not None:
                heapq.heappush(heap, (r, i, rank, ids[after[i]]))
        if before[i] >= 0 and (r := pairs.get((ids[before[i]], rank))) is not None:
            heapq.heappush(heap, (r, before[i], ids[before[i]], rank))
    return [x for x in ids if x >= 0]


def _packed(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(blobs: pa.Array) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs]).combine_chunks()


def _arrow_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def _coded(docs: DataFrame, pattern: str, folder: str, parts: int) -> DataFrame:
    """(part, chunk, blob): the pieces of every chunk, with their codes, cut by a hash of the piece; the documents' codes are in a file of folder.

    A chunk is named by its partition, so that a task that runs again gives the same chunk.
    """
    kind = pa.schema([("doc_id", _arrow_type(docs)), ("codes", pa.list_(pa.int32()))])
    rows = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        source = (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512))
        waiting, chunk = next(source, None), TaskContext.get().partitionId() << 24
        while waiting is not None:
            known: dict[str, int] = {}
            with new_file(f"{folder}/{chunk:016x}.parquet") as out, pq.ParquetWriter(out, kind, compression="zstd", use_dictionary=False, column_encoding={"codes.list.element": "BYTE_STREAM_SPLIT"}) as file:
                while waiting is not None and len(known) < CHUNK_PIECES:
                    codes, ends = [], [0]
                    for text in waiting.column(1).to_pylist():
                        if text:
                            codes += [known.setdefault(p, len(known)) for p in find(text)]
                        ends.append(len(codes))
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes, pa.int32()))
                    file.write_batch(pa.RecordBatch.from_arrays([waiting.column(0), lists], schema=kind))
                    waiting = next(source, None)
            pieces = pa.array(known, pa.string())
            part = np.fromiter((zlib.crc32(p.encode()) % parts for p in known), np.int32, len(known))
            order = np.argsort(part, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(part[order])) + 1), len(order)]
            for i, j in zip(cuts[:-1], cuts[1:]):  # a chunk without pieces still has one row, of none
                own = order[i:j]
                blob = _packed(pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pieces.take(pa.array(own))], ["code", "piece"]))
                yield pa.RecordBatch.from_arrays([pa.array([int(part[own[0]]) if len(own) else 0], pa.int32()), pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())], schema=rows)
            chunk += 1

    return docs.mapInArrow(run, "part int, chunk bigint, blob binary")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each value of a sorted column."""
    now, held = None, []
    for batch in batches:
        values = np.asarray(batch.column(key))
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1), len(values)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i == j:
                continue
            if values[i] != now and held:
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = int(values[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, chunks, codes): each distinct piece of a part once, or once for each REFERENCES chunks that hold it; chunks without pieces under null."""
    for _, rows in _runs(batches, "part"):
        tables = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in rows["blob"]]
        chunk = np.repeat(np.asarray(rows["chunk"]), [t.num_rows for t in tables])
        empty = np.asarray(rows["chunk"])[[t.num_rows == 0 for t in tables]]
        table = pa.concat_tables(tables).combine_chunks()
        if len(chunk):
            coded = table["piece"].combine_chunks().dictionary_encode()
            index = np.asarray(coded.indices)
            order = np.argsort(index, kind="stable")
            index, chunk, code = index[order], chunk[order], np.asarray(table["code"])[order]
            count = np.bincount(index)
            share = (np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)) // REFERENCES
            first = np.flatnonzero(np.append(True, (np.diff(index) != 0) | (np.diff(share) != 0)))
            for i in range(0, len(first), 4096):
                some = first[i : i + 4096]
                stop = first[i + 4096] if i + 4096 < len(first) else len(index)
                ends = pa.array(np.append(some, stop) - some[0], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[some[0] : stop])) for x in (chunk, code)]
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(index[some])), *lists], ["piece", "chunks", "codes"])
        if len(empty):
            lists = [pa.ListArray.from_arrays(pa.array([0, len(empty)], pa.int32()), x) for x in (pa.array(empty), pa.nulls(len(empty), pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), *lists], ["piece", "chunks", "codes"])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text, each match of pattern encoded by itself.

    One row for each row of docs; null and empty texts have no ids. Other columns are left out.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "codes")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = _arrow_type(own)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(ranks)
    coded = _coded(own, pattern, folder, parts).repartitionById(parts, "part").sortWithinPartitions("part")
    pieces = coded.mapInArrow(_gathered, "piece string, chunks array<bigint>, codes array<int>")
    short = F.octet_length("piece") <= FOLD_BYTES
    found = pieces.select(F.when(short, piece_ids(F.col("piece"), ranks)).alias("ids"), F.when(~short, F.col("piece")).alias("piece"), "chunks", "codes")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(chunk, blob): the ids of a chunk's codes."""
        pairs = None

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            chunk, code = rows["chunks"].combine_chunks().flatten(), rows["codes"].combine_chunks().flatten()
            row = np.repeat(np.arange(rows.num_rows), np.asarray(rows["chunks"].combine_chunks().value_lengths()))
            order = np.argsort(np.asarray(chunk), kind="stable")
            chunk, code = np.asarray(chunk)[order], code.take(pa.array(order))
            ids = rows["ids"].combine_chunks().take(pa.array(row[order]))
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(chunk)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i < j:
                    blob = _packed(pa.RecordBatch.from_arrays([code.slice(i, j - i), pa.concat_arrays([ids.slice(i, j - i)])], ["code", "ids"]))
                    yield pa.RecordBatch.from_arrays([pa.array([int(chunk[i])]), pa.array([blob], pa.binary())], ["chunk", "blob"])

        held, size = [], 0
        for batch in batches:
            if batch.column("piece").null_count < batch.num_rows:
                pairs = pairs or pair_ranks(sent.value)
                ids = [i if p is None else long_piece_ids(p.encode(), sent.value, pairs) for i, p in zip(batch.column("ids").to_pylist(), batch.column("piece").to_pylist())]
                batch = batch.set_column(0, "ids", pa.array(ids, pa.list_(pa.int32())))
            held.append(pa.RecordBatch.from_arrays([batch.column(c) for c in ("ids", "chunks", "codes")], ["ids", "chunks", "codes"]))
            size += len(batch.column("codes").flatten())
            if size >= 1 << 20:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _runs(batches, "chunk"):
            table = _unpacked(rows["blob"])
            table = table.filter(table["code"].is_valid())
            pieces = table["ids"].combine_chunks().take(pa.array(np.argsort(np.asarray(table["code"]), kind="stable")))
            start, flat = np.asarray(pieces.offsets).astype(np.int64), np.asarray(pieces.values)
            size = np.diff(start)
            files, path = open_fs(f"{folder}/{chunk:016x}.parquet")
            with files.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(512):
                    codes = np.asarray(batch.column(1).flatten())
                    n = size[codes]
                    ends = np.append(0, np.cumsum(n))
                    at = np.repeat(start[:-1][codes] - ends[:-1], n) + np.arange(ends[-1])
                    bounds = np.append(0, np.cumsum(np.asarray(batch.column(1).value_lengths())))
                    lists = pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(flat[at], pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), lists], ["doc_id", "ids"])

    # Chunks are numbered by the partitions that they came from, and so are dealt evenly.
    place = F.pmod(F.shiftright("chunk", 24) + F.col("chunk").bitwiseAND(F.lit((1 << 24) - 1)) * 7919, F.lit(parts)).cast("int")
    blobs = found.mapInArrow(dealt, "chunk bigint, blob binary").repartitionById(parts, place).sortWithinPartitions("chunk")
    return blobs.mapInArrow(assembled, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def token_bytes(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of each id from 0 on; nothing for ids without a token."""
    spelt = {r: t for t, r in ranks.items()}
    return pa.array([spelt.get(i, b"") for i in range(max(spelt, default=-1) + 1)], pa.large_binary())


def _joined(lists: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The bytes of each list of ids, one after the other."""
    ids = lists.flatten()
    text = pieces.take(ids)
    ends = np.frombuffer(text.buffers()[1], np.int64, len(ids) + 1, text.offset * 8) if len(ids) else np.zeros(1, np.int64)
    bounds = np.append(0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0))))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends[bounds].astype(np.int64).tobytes()), text.buffers()[2] or pa.py_buffer(b"")])


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, data): the bytes of every row's ids; ids without a token stand for nothing, null for no ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = token_bytes(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _joined(batch.column(1), pieces).cast(pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def digests(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode()'s rows; the ids are decoded as by decode()."""
    import hashlib

    sent = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = token_bytes(sent.value)
        numbers = pa.array([b"%d," % i for i in range(len(pieces))], pa.large_binary())
        sha = lambda values, cut: pa.array([hashlib.sha256(memoryview(v.as_buffer())[: v.as_buffer().size - cut] if v.as_buffer().size else b"").hexdigest() for v in values])
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                lists = batch.column(1)
                cols = [batch.column(0), lists.value_lengths().cast(pa.int64()), sha(_joined(lists, numbers), 1), sha(_joined(lists, pieces), 0)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
