"""Merging of sorted runs of byte strings over the cluster, without comparing known prefixes again.

A run is cut into blocks of front-coded keys: of each key only what follows its common prefix with the
key before it is kept, next to that prefix's length. Blocks are cut at splitters, so that every range
of keys can be merged on its own, and exchanged as compressed bytes by an ordinary shuffle. A range is
merged by a loser tree over its runs that carries, for each run's next key, the length of its common
prefix with the key given out last. Two keys with different lengths are ordered by these alone; only
keys with equal ones are compared, from that length on.

What a task holds doesn't grow with the input: at most FAN runs are merged at once (more of them are
merged in groups first, where equal keys can be folded), and of each run one block is open. A block
names the first key of the next one, so that the next one is only read when that key's turn comes; the
shuffle delivers blocks in this order. Ranges, and with them splitters, are bounded in number.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, stored

BLOCKS_DDL = "run string, block bigint, prev_key binary, first_key binary, next_key binary, bytes bigint, data binary"
BLOCKS = pa.schema([("run", pa.string()), ("block", pa.int64()), ("prev_key", pa.binary()), ("first_key", pa.binary()), ("next_key", pa.binary()), ("bytes", pa.int64()), ("data", pa.binary())])
#: Bytes of keys and values in a block, about; bytes of a range, about; runs that are merged at once.
BLOCK_BYTES, RANGE_BYTES, FAN = 256 << 10, 32 << 20, 256
#: Ranges at most, keys drawn for each of them and in all, and bytes of a drawn key: what the driver gets and sends is bounded by these.
MAX_RANGES, DRAWN, MAX_DRAWN, SPLITTER_BYTES = 1 << 14, 32, 1 << 16, 512

_U4 = struct.Struct("<I")


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, which agree in the first ``known`` bytes."""
    n = min(len(a), len(b))
    step = 64
    while known < n:
        if a[known : known + step] == b[known : known + step]:
            known = min(n, known + step)
        elif step > 1:
            step //= 4 if step > 4 else step
            step = max(step, 1)
        else:
            break
    return known


def pack(items: list[tuple[bytes, bytes]]) -> bytes:
    """Front-coded (key, value) items in ascending order of key."""
    prefix, ends, rest, values, before = [], [], [], [], b""
    for key, value in items:
        k = common(before, key)
        prefix.append(k)
        rest.append(key[k:])
        values.append(value)
        before = key
    sizes = np.array([prefix, list(map(len, rest)), list(map(len, values))], "<u4")
    return zstandard.compress(_U4.pack(len(items)) + sizes.tobytes() + b"".join(rest) + b"".join(values), 1)


def unpack(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(common prefix with the key before, key, value) of pack()'s items."""
    raw = zstandard.decompress(data)
    (n,) = _U4.unpack_from(raw)
    prefix, rest, value = (np.frombuffer(raw, "<u4", n, 4 + 4 * n * i).tolist() for i in range(3))
    at, key = 4 + 12 * n, b""
    out = at + sum(rest)
    for p, r, v in zip(prefix, rest, value):
        key = key[:p] + raw[at : at + r]
        at += r
        yield p, key, raw[out : out + v]
        out += v


class RunWriter:
    """Cuts ascending items of one run into blocks, given out as rows of BLOCKS.

    A block's row comes when the key after it is known; end() gives the last one.
    """

    def __init__(self, run: str):
        self.run, self.number, self.size, self.items, self.before = run, 0, 0, [], None

    def add(self, key: bytes, value: bytes) -> tuple | None:
        row = self._row(key) if self.size >= BLOCK_BYTES else None
        self.items.append((key, value))
        self.size += len(key) + len(value) + 12
        return row

    def _row(self, after: bytes | None) -> tuple:
        row = (self.run, self.number, self.before, self.items[0][0], after, self.size, pack(self.items))
        self.number, self.size, self.before, self.items = self.number + 1, 0, self.items[-1][0], []
        return row

    def end(self) -> tuple | None:
        return self._row(None) if self.items else None


def batches(rows: Iterable[tuple | None], schema: pa.Schema, size: int = 32) -> Iterator[pa.RecordBatch]:
    """Rows (None is left out) as record batches."""
    held = []
    for row in rows:
        if row is not None:
            held.append(row)
            if len(held) == size:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


class LoserTree:
    """Merges runs of (common prefix with the run's key before, key, value) in ascending order of key.

    A value may be a function that gives it; it's called when the key's turn comes. Iterating gives (common prefix with the key given before, key, value, number of the run). Equal keys
    come in the order of their runs.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, bytes]]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.prefix = [0] * len(runs)

    def _better(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; the loser's prefix becomes that with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        p, q = self.prefix[a], self.prefix[b]
        if p != q:
            return p > q
        u, v = x[1], y[1]
        k = common(u, v, p)
        first = u[k : k + 1] < v[k : k + 1] if k < len(u) or k < len(v) else a < b
        self.prefix[b if first else a] = k
        return first

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes, int]]:
        n = len(self.runs)
        if not n:
            return
        losers = [0] * n
        winner = [*([0] * n), *range(n)]
        for node in range(n - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], losers[node] = (a, b) if self._better(a, b) else (b, a)
        best = winner[1] if n > 1 else 0
        while self.heads[best] is not None:
            _, key, value = self.heads[best]
            yield self.prefix[best], key, value() if callable(value) else value, best
            self.heads[best] = head = next(self.runs[best], None)
            if head is not None:
                self.prefix[best] = head[0]
            node, at = (best + n) // 2, best
            while node:
                if self._better(losers[node], at):
                    losers[node], at = at, losers[node]
                node //= 2
            best = at


def _splitters(blocks: DataFrame, ranges: int, n: int) -> list[bytes]:
    """At most ranges - 1 keys that cut the keys of n blocks into about equal ranges: from a bounded draw of first keys of blocks."""
    if ranges < 2:
        return []
    share = min(1.0, min(DRAWN * ranges, MAX_DRAWN) / n)
    drawn = blocks.where(F.pmod(F.xxhash64("run", "block"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.substring("first_key", 1, SPLITTER_BYTES)).distinct()
    keys = sorted(bytes(r[0]) for r in drawn.collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)} - {keys[0]}) if keys else []


_CUT = pa.schema([("group", pa.int32()), ("range", pa.int32()), ("later", pa.bool_()), *BLOCKS])


def _cut(blocks: DataFrame, splitters: list[bytes], groups: int) -> DataFrame:
    """Blocks with the numbers of their group and range; those that hold keys of several ranges are cut.

    ``later`` is false for the block that begins a run within a range.
    """
    sent = blocks.sparkSession.sparkContext.broadcast(splitters)

    def pieces(found: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        cuts = sent.value
        for batch in found:
            for run, block, before, first, after, size, data in zip(*(batch.column(c).to_pylist() for c in BLOCKS.names)):
                group, now = zlib.crc32(run.encode()) % groups, bisect_right(cuts, first)
                later = before is not None and bisect_right(cuts, before) == now
                if after is not None and bisect_right(cuts, after) == now or now == len(cuts):
                    yield group, now, later, run, block, None, first, after, size, data
                    continue
                held, total = [], 0
                for _, key, value in unpack(data):
                    if now < len(cuts) and key >= cuts[now]:
                        if held:
                            yield group, now, later, run, block, None, held[0][0], None, total, pack(held)
                            later = False
                        held, now, total = [], bisect_right(cuts, key), 0
                    held.append((key, value))
                    total += len(key) + len(value) + 12
                after = after if after is not None and bisect_right(cuts, after) == now else None
                yield group, now, later, run, block, None, held[0][0], after, total, pack(held)

    return blocks.mapInArrow(lambda found: batches(pieces(found), _CUT), "group int, range int, later boolean, " + BLOCKS_DDL)


class _Range:
    """The runs of one range, whose blocks are read from a stream as the merge needs them."""

    def __init__(self, rows: Iterator[tuple]):
        self.rows, self.waiting, self.heads = rows, {}, []
        for row in rows:  # the blocks that begin a run come first, and are at most as many as runs
            if row[0]:
                self.waiting.setdefault(row[1], []).append(row[2:])
                break
            self.heads.append(row[1:])

    def _next(self, run: str) -> tuple:
        while not (own := self.waiting.get(run)):
            row = next(self.rows)
            self.waiting.setdefault(row[1], []).append(row[2:])
        return own.pop(0)

    def _items(self, run: str, after: bytes | None, data: bytes) -> Iterator[tuple]:
        items, key = unpack(data), b""
        while True:
            for prefix, key, value in items:  # noqa: B007
                yield prefix, key, value
            if after is None:
                return
            opened = []

            def load(run: str = run, opened: list = opened) -> bytes:
                opened.extend(self._next(run))
                opened.append(unpack(opened[1]))
                return next(opened[2])[2]

            yield common(key, after), after, load
            key, (after, _, items) = after, opened

    def runs(self) -> list[Iterator[tuple]]:
        return [self._items(*head) for head in self.heads]


def _ranges(found: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, _Range]]:
    """(group, range, its runs) from sorted blocks, to be used up in turn."""
    names = ("group", "range", "later", "run", "next_key", "data")
    rows = (row for batch in found for row in zip(*(batch.column(c).to_pylist() for c in names)))
    for (group, number), own in itertools.groupby(rows, lambda row: row[:2]):
        yield group, number, _Range(row[2:] for row in own)


def _merge(blocks: DataFrame, splitters: list[bytes], groups: int, use: Callable[[int, int, Iterator[tuple[int, bytes, bytes]]], Iterable[tuple | None]], schema: pa.Schema, ddl: str) -> DataFrame:
    """What use(group, range, items) gives for each group of runs and range of keys."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple | None]:
            for group, number, own in _ranges(found):
                yield from use(group, number, ((prefix, key, value) for prefix, key, value, _ in LoserTree(own.runs())))

        return batches(rows(), schema, 32 if "data" in schema.names else 1024)

    n = len(splitters) + 1
    cut = _cut(blocks, splitters, groups)
    if groups == 1:
        dealt = cut.repartitionById(n, "range")
    else:
        tasks = min(groups * n, 4 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = cut.repartitionById(tasks, F.pmod(F.col("group").cast("bigint") * n + F.col("range"), F.lit(tasks)).cast("int"))
    return dealt.sortWithinPartitions("group", "range", "later", "first_key", "run", "block").mapInArrow(run, ddl)


def _size(blocks: DataFrame) -> tuple[int, int, int]:
    """(bytes, blocks, runs)"""
    return blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*"), F.count(F.when(F.col("block") == 0, 1))).first()


def reduced(blocks: DataFrame, fold: Callable[[Iterator[tuple[int, bytes, bytes]]], Iterable[tuple]], schema: pa.Schema, ddl: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """(blocks of at most FAN runs, rows of ``schema`` or None): more runs are merged in groups, level by level.

    fold(items) gives, for the items of a group in ascending order of key, (True, key, value) for those
    that stay in the group's run, still ascending, and (False, *row) for rows of ``schema``. ``blocks`` is a
    stored() table; it is dropped if there is a level.
    """
    total, n, runs = _size(blocks)
    both, nothing = pa.schema([*BLOCKS, *schema]), (None,) * len(BLOCKS)
    told = None
    while runs > FAN:
        groups = -(-runs // FAN)

        def level(group: int, number: int, items: Iterator[tuple[int, bytes, bytes]]) -> Iterator[tuple | None]:
            writer = RunWriter(f"{group}.{number}")
            for stays, *row in fold(items):
                if stays:
                    if (done := writer.add(*row)) is not None:
                        yield *done, *((None,) * len(schema))
                else:
                    yield *nothing, *row
            if (done := writer.end()) is not None:
                yield *done, *((None,) * len(schema))

        splitters = _splitters(blocks, min(MAX_RANGES, max(1, total // groups // range_bytes)), n)
        out = stored(_merge(blocks, splitters, groups, level, both, f"{BLOCKS_DDL}, {ddl}"), "level")
        dropped(blocks)
        rows = out.where("run is null").select(*schema.names)
        told = rows if told is None else told.unionByName(rows)
        blocks, runs = stored(out.where("run is not null").select(*BLOCKS.names), "runs"), groups
        total, n, _ = _size(blocks)
    return blocks, told


def kept(items: Iterator[tuple[int, bytes, bytes]]) -> Iterator[tuple]:
    """A fold for reduced() that keeps every item."""
    return ((True, key, value) for _, key, value in items)


def merged(blocks: DataFrame, consume: Callable[[Iterator[tuple[int, bytes, bytes]]], Iterable[tuple | None]], schema: pa.Schema, ddl: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """What consume(items) gives, as rows of ``schema``, for each range of the blocks' keys.

    items are (common prefix with the key before in this range, key, value) in ascending order. A task
    takes one range, and the ranges of the partitions ascend; equal keys are always in one range.
    ``blocks`` should be a saved table of reduced() runs, as it is read several times.
    """
    total, n, _ = _size(blocks)
    splitters = _splitters(blocks, min(MAX_RANGES, -(-total // range_bytes)), n)
    return _merge(blocks, splitters, 1, lambda group, number, items: consume(items), schema, ddl)
