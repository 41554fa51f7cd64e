"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Documents become pieces of at most ``capacity`` tokens; only lengths go through the packing. Pieces
are dealt evenly into groups of a bounded size and each group is packed alone; the sequences that it
leaves with room are taken apart and packed again in fewer groups.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved, slices
from .word_tokens import WordEncoder

#: Pieces in a packing group, about.
GROUP = 8192


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every whole text's ids with end_id, cut only where they exceed capacity.

    Null and empty texts consist of the end id. Repeated rows are documents of their own. Other
    columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(vocabulary)
        for batch in slices(batches):
            ids, bounds = encoder.encode(batch.column(1), end_id)
            n = np.diff(bounds)
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            raw, at = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), bounds[doc] + start
            sums = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at, length)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length.

    A bin takes the largest unpacked piece that fits until none does. Then its smallest piece gives
    way to the two unpacked pieces that fill its room and the rest of the bin most tightly, if they
    fill more than it did.
    """
    order = np.argsort(-lengths, kind="stable")
    waiting: dict[int, list[int]] = {}
    for i in order[::-1]:
        waiting.setdefault(int(lengths[i]), []).append(int(i))
    sizes = sorted(waiting)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(size: int) -> int:
        own = waiting[size]
        i = own.pop()
        if not own:
            del waiting[size]
            sizes.pop(bisect.bisect_left(sizes, size))
        return i

    def give(size: int, i: int) -> None:
        if size not in waiting:
            waiting[size] = []
            bisect.insort(sizes, size)
        waiting[size].append(i)

    def best_pair(room: int, least: int) -> tuple[int, int] | None:
        best, found = least, None
        i, j = 0, bisect.bisect_right(sizes, room) - 1
        while i <= j and best < room:
            if i == j and len(waiting[sizes[i]]) < 2:
                break
            total = sizes[i] + sizes[j]
            if total > room:
                j -= 1
            else:
                if total > best:
                    best, found = total, (sizes[j], sizes[i])
                i += 1
        return found

    b = 0
    while sizes:
        room, held = capacity, []
        while sizes and (k := bisect.bisect_right(sizes, room)):
            size = sizes[k - 1]
            held.append((size, take(size)))
            room -= size
        if room and sizes:
            size, i = held[-1]
            if pair := best_pair(room + size, size):
                held[-1:] = [(s, take(s)) for s in pair]
                give(size, i)
        at = 0
        for size, i in held:
            bins[i], offsets[i] = b, at
            at += size
        b += 1
    return bins, offsets


def _round(cut: DataFrame, capacity: int, group_size: int, number: int) -> DataFrame:
    """cut (with a __row number) packed in groups of about group_size; sequence_id, offset and filled are new."""
    groups = max(1, -(-cut.count() // group_size))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = cut.schema["doc_id"].dataType.simpleString()

    def one(rows: pa.Table) -> pa.RecordBatch:
        length = np.asarray(rows["length"])
        bins, offsets = best_two_fit(length, capacity)
        filled = np.bincount(bins, length).astype(np.int64)[bins]
        seq = (np.int64(number) << 56) + (np.asarray(rows["__group"]).astype(np.int64) << 32) + bins
        cols = [rows[c].combine_chunks() for c in names] + [pa.array(seq), pa.array(offsets), pa.array(filled)]
        return pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset", "__filled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.asarray(batch.column("__group"))
            ends = [*(np.flatnonzero(np.diff(group)) + 1), len(group)]
            start = 0
            if held and held[-1].column("__group")[0] != batch.column("__group")[0]:
                yield one(pa.Table.from_batches(held))
                held = []
            for k, stop in enumerate(ends):
                held.append(batch.slice(start, stop - start))
                start = stop
                if k < len(ends) - 1:
                    yield one(pa.Table.from_batches(held))
                    held = []
        if held:
            yield one(pa.Table.from_batches(held))

    ddl = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, __filled bigint"
    return (
        cut.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
        .repartitionById(min(groups, 8 * int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "__group").sortWithinPartitions("__group", F.desc("length"), "doc_id", "piece")
        .mapInArrow(run, ddl)
    )


def pack(cut: DataFrame, capacity: int = 4096, group_size: int = GROUP, full: float = 0.995) -> DataFrame:
    """cut with sequence_id and offset: places in sequences of at most capacity tokens, gapless from 0.

    Every piece is placed once; sequence ids are any distinct numbers. Sequences of the first round
    that are filled less than ``full`` are packed again. An empty table gives an empty result.
    """
    first = saved(_round(saved(cut), capacity, group_size, 0))
    loose = first.where(F.col("__filled") < full * capacity).drop("sequence_id", "offset", "__filled")
    second = _round(loose, capacity, group_size, 1)
    return first.where(F.col("__filled") >= full * capacity).unionByName(second).drop("__filled")
