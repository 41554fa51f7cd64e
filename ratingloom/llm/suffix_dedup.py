"""Removal of long byte strings that occur more than once, by a distributed merge of sorted suffixes.

Sorting every suffix of a corpus would move two hundred times its size. What is sorted here are the
only suffixes that can matter, found in two steps that cannot miss one:

* every window of ``length`` bytes has an anchor (see windows.py); windows whose anchor's hash occurs
  once in the corpus are not repeated;
* the windows of one anchor, which are neighbours, form one suffix that stops where they do. Equal
  suffixes are found by sorting: each slice of the corpus gives a sorted, front-coded run, and the runs
  are exchanged by key range and merged by loser trees that know common prefixes (see merge.py).

A suffix that equals no other may still share some windows with others. For those, hashes of single
windows are counted, the repeated ones give shorter suffixes, which are sorted and merged in the same
way; where even such a suffix equals no other as a whole, its windows are sorted one by one. Hashes
only ever rule out: that a window is repeated is always decided by comparing its bytes.

The corpus is kept once, as compressed slices on shared storage, and doesn't move; what moves are hashes
with short references, and runs. No group is collected: of a key, a slice sends one row. Tables of
references and runs are deleted when the next step has used them; the slices stay, as the result reads them.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.feather as feather
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .merge import BLOCKS, BLOCKS_DDL, RunWriter, batches, merged, reduced
from .storage import cuts, dropped, new_file, new_folder, open_fs, stored
from .windows import Hasher, anchors

#: Bytes of text in a slice.
SLICE_BYTES = 12 << 20
_ROWS = pa.schema([("key", pa.int64()), ("slice", pa.int64()), ("ref", pa.int32()), ("weight", pa.int32()), ("wanted", pa.int32())])
_ROWS_DDL = "key bigint, slice bigint, ref int, weight int, wanted int"
_REFS = pa.schema([("slice", pa.int64()), ("ref", pa.int32())])
_REFS_DDL = "slice bigint, ref int"
#: References that mean: nothing to tell back; the slice itself.
_TOLD, _SELF = -1, -2


def _save(uri: str, table: pa.Table) -> None:
    with new_file(uri) as out:
        feather.write_feather(table, out, compression="zstd")


def _load(uri: str) -> pa.Table:
    files, path = open_fs(uri)
    with files.open_input_file(path) as source:
        return feather.read_table(source)


class _Slice:
    """A slice's texts and what earlier passes have found, in files of a folder."""

    def __init__(self, folder: str, number: int):
        self.at, self.number = f"{folder}/{number:016x}", number

    def save(self, kind: str, **arrays: np.ndarray) -> None:
        _save(f"{self.at}.{kind}", pa.table({k: pa.array(v) for k, v in arrays.items()}))

    def load(self, kind: str) -> list[np.ndarray]:
        return [c.to_numpy() for c in _load(f"{self.at}.{kind}").columns]

    def texts(self) -> tuple[list[memoryview], np.ndarray]:
        """Distinct texts, and in how many rows each is."""
        table = _load(f"{self.at}.texts").combine_chunks()
        data = table["text"].combine_chunks()
        ends, view = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8), memoryview(data.buffers()[2] or b"")
        return [view[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], table["copies"].to_numpy()


def _anchors(texts: list[memoryview], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first, last, hash) of all anchors, the hash as a signed integer."""
    found = [(i, *anchors(np.frombuffer(t, np.uint8), length, gram)[1:]) for i, t in enumerate(texts) if len(t) >= length]
    if not found:
        return (np.zeros(0, np.int32),) * 3 + (np.zeros(0, np.int64),)
    text = np.repeat(np.array([f[0] for f in found], np.int32), [len(f[1]) for f in found])
    hashes, first, last = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3))
    return text, first.astype(np.int32), last.astype(np.int32), hashes.view(np.int64)


def _rows(key: np.ndarray, number: int, ref: np.ndarray | int, weight: np.ndarray | int, wanted: np.ndarray | int) -> Iterator[pa.RecordBatch]:
    full = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int32), len(key)))
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), number)), full(ref), full(weight), full(wanted)], schema=_ROWS)
    for i in range(0, len(key), 1 << 16):
        yield batch.slice(i, 1 << 16)


def _told(key: np.ndarray, copies: np.ndarray, wanted: np.ndarray, number: int) -> tuple[np.ndarray, Iterator[pa.RecordBatch]]:
    """(which are known here to be repeated and wanted, one row for each distinct key)."""
    distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    count = np.bincount(inverse, copies, len(distinct))
    want = np.bincount(inverse, wanted, len(distinct)) > 0
    here = (count >= 2) & want
    return here[inverse], _rows(distinct, number, np.where(here, _TOLD, first), np.where(count >= 2, 2, 1), want)


def _meeting(rows: DataFrame) -> DataFrame:
    """(slice, ref) of the rows whose key weighs 2 or more over all slices and is wanted in one; of a key each slice has one row."""
    over = Window.partitionBy("key")
    met = rows.withColumn("n", F.sum("weight").over(over)).withColumn("w", F.max("wanted").over(over))
    return stored(met.where((F.col("n") >= 2) & (F.col("w") > 0) & (F.col("ref") != _TOLD)).select("slice", "ref"), "met")


def _per_slice(refs: DataFrame, slices: DataFrame, run: Callable[[int, np.ndarray], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """run(slice, its refs) for every slice."""

    def each(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in found:
            number, ref = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), len(number)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if number[i] != now and held:
                    yield from run(now, np.concatenate(held))
                    held = []
                now = int(number[i])
                held.append(ref[i:j][ref[i:j] >= 0])
        if held:
            yield from run(now, np.concatenate(held))

    parts = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Slices are numbered by the partitions that they came from, and so are dealt evenly.
    place = F.pmod(F.shiftright("slice", 24) + F.col("slice").bitwiseAND(F.lit((1 << 24) - 1)) * 7919, F.lit(parts)).cast("int")
    return refs.unionByName(slices).repartitionById(parts, place).sortWithinPartitions("slice").mapInArrow(each, ddl)


def _fold(texts: list[memoryview], text: np.ndarray, start: np.ndarray, stop: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(class of each string text[start:stop], whether each class has several members here, the classes' strings)."""
    known: dict[bytes, int] = {}
    of = np.fromiter((known.setdefault(bytes(texts[t][a:b]), len(known)) for t, a, b in zip(text.tolist(), start.tolist(), stop.tolist())), np.int32, len(text))
    return of, np.bincount(of, copies[text], len(known)) >= 2, list(known)


def _run(number: int, keys: list[bytes], many: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The slice's run of sorted, front-coded strings."""
    writer = RunWriter(f"{number}")
    order = sorted(range(len(keys)), key=keys.__getitem__)

    def rows() -> Iterator[tuple | None]:
        for i in order:
            yield writer.add(keys[i], struct.pack("<qi?", number, i, bool(many[i])))
        yield writer.end()

    yield from batches(rows(), BLOCKS)


def _equal(blocks: DataFrame) -> DataFrame:
    """(slice, ref) for each string that occurs more than once: ref is 2 * its class, and 1 more in one slice of all that have it."""

    def consume(items: Iterator[tuple[int, bytes, bytes]]) -> Iterator[tuple]:
        size, first, told = -1, None, False
        for prefix, key, value in items:
            number, of, many = struct.unpack("<qi?", value)
            if prefix == len(key) == size:
                if not told:
                    yield first[0], 2 * first[1] + 1
                    told = True
                yield number, 2 * of
            else:
                size, first, told = len(key), (number, of), many
                if many:
                    yield number, 2 * of + 1

    def fold(items: Iterator[tuple[int, bytes, bytes]]) -> Iterator[tuple]:
        """Of equal strings the first stays, as one that occurs more than once; the others are told at once."""
        held = None
        for prefix, key, value in items:
            number, of, many = struct.unpack("<qi?", value)
            if held and prefix == len(key) == len(held[0]):
                held[3] = True
                yield False, number, 2 * of
            else:
                if held:
                    yield True, held[0], struct.pack("<qi?", *held[1:])
                held = [key, number, of, many]
        if held:
            yield True, held[0], struct.pack("<qi?", *held[1:])

    runs, told = reduced(stored(blocks, "runs"), fold, _REFS, _REFS_DDL)
    found = merged(runs, consume, _REFS, _REFS_DDL)
    out = stored(found if told is None else found.unionByName(told), "equal")
    dropped(runs)
    return out


def _slices(docs: DataFrame, text_col: str, folder: str, length: int, gram: int) -> DataFrame:
    """Keep docs as slices; a row for each slice and each distinct anchor hash of it."""
    at = docs.columns.index(text_col)

    def flush(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        own = _Slice(folder, number)
        known: dict[bytes, int] = {}
        index = [known.setdefault((t or "").encode("utf-8", "surrogatepass"), len(known)) for b in held for t in b.column(at).to_pylist()]
        copies = np.bincount(index, minlength=len(known))
        _save(f"{own.at}.texts", pa.table({"text": pa.array(list(known), pa.large_binary()), "copies": pa.array(copies)}))
        others = pa.Table.from_batches(held)
        others = others.set_column(at, others.schema.names[at], others.column(at).is_null())  # of the text only whether it was null
        _save(f"{own.at}.rows", pa.table([*others.columns, pa.array(index, pa.int32())], names=[*(f"c{i}" for i in range(others.num_columns)), "index"]))
        text, _, _, key = _anchors([memoryview(t) for t in known], length, gram)
        yield from _rows(np.array([-number - 1]), number, _SELF, 2, 1)
        yield from _told(key, copies[text], np.ones(len(key)), number)[1]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        number = TaskContext.get().partitionId() << 24  # a task that runs again gives the same slices
        for batch in found:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                size += sum(len(t) for t in part.column(at).to_pylist() if t)
                held.append(part)
                if size >= SLICE_BYTES:
                    yield from flush(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield from flush(held, number)

    return docs.mapInArrow(run, _ROWS_DDL)


def _window_hashes(texts: list[memoryview], text: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, hash) of every window of every item."""
    n = (last - first + 1).astype(np.int64)
    item = np.repeat(np.arange(len(text)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    out, hasher = np.zeros(len(item), np.int64), Hasher.of(length + 2048)
    bounds = np.append(0, np.cumsum(n))
    for k in range(len(text)):  # an item is short: it spans fewer windows than one of them has bytes
        a, b = bounds[k], bounds[k + 1]
        sums = hasher.sums(np.frombuffer(texts[text[k]][first[k] : last[k] + length], np.uint8))
        places = np.arange(b - a)
        out[a:b] = hasher.spans(sums, places, places + length).view(np.int64)
    return item, start, out


def _solve(docs: DataFrame, text_col: str, length: int, gram: int, finish: Callable[[pa.Table, list[np.ndarray]], pa.RecordBatch], ddl: str) -> DataFrame:
    spark = docs.sparkSession
    folder = new_folder(spark, "slices")
    met = _meeting(_slices(docs, text_col, folder, length, gram))
    slices = met.where(F.col("ref") == _SELF)

    def whole(number: int, refs: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = _Slice(folder, number)
        texts, copies = own.texts()
        text, first, last, key = _anchors(texts, length, gram)
        open_, _ = _told(key, copies[text], np.ones(len(key)), number)
        open_[refs] = True
        text, first, last, key = text[open_], first[open_], last[open_], key[open_]
        of, many, keys = _fold(texts, text, first, last + length, copies)
        own.save("items", text=text, first=first, last=last, key=key, of=of)
        yield from _run(number, keys, many)

    equal = _equal(_per_slice(met, slices, whole, BLOCKS_DDL))

    def undecided(number: int, refs: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = _Slice(folder, number)
        text, first, last, key, of = own.load("items")
        sure, spokes = np.zeros(int(of.max(initial=-1)) + 1, bool), np.zeros(int(of.max(initial=-1)) + 1, bool)
        sure[refs >> 1], spokes[(refs >> 1)[refs & 1 == 1]] = True, True
        own.save("sure", sure=sure[of])
        _, one = np.unique(of, return_index=True)  # an item of each class
        lone, speaks = one[~sure[of[one]]], one[spokes[of[one]]]
        yield from _rows(np.concatenate([np.unique(key[lone]), key[speaks]]), number, np.concatenate([np.full(len(np.unique(key[lone])), _TOLD), speaks]), 2, np.repeat([1, 0], [len(np.unique(key[lone])), len(speaks)]))

    partners = _meeting_many(_per_slice(equal, slices, undecided, _ROWS_DDL))
    dropped(equal)

    def single(number: int, refs: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = _Slice(folder, number)
        text, first, last, _, _ = own.load("items")
        (sure,) = own.load("sure")
        items = np.concatenate([np.flatnonzero(~sure), np.unique(refs)]).astype(np.int32)
        texts, copies = own.texts()
        item, start, key = _window_hashes(texts, text[items], first[items], last[items], length)
        here, rows = _told(key, copies[text[items]][item], ~sure[items][item], number)
        own.save("open", item=items[item], start=start.astype(np.int32), key=key, here=here)
        yield from rows

    repeated = _meeting(_per_slice(partners, slices, single, _ROWS_DDL))
    dropped(partners)

    def shorter(number: int, refs: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = _Slice(folder, number)
        text, sure = own.load("items")[0], own.load("sure")[0]
        item, start, key, here = own.load("open")
        here = here.copy()
        here[refs] = True
        item, start, key = item[here], start[here], key[here]
        begins = np.append(True, (np.diff(item) != 0) | (np.diff(start) != 1))[: len(item)]
        ends = np.append(begins[1:], True)[: len(item)]
        texts, copies = own.texts()
        a, b, of_text = start[begins], start[ends], text[item[begins]]
        of, many, keys = _fold(texts, of_text, a, b + length, copies)
        own.save("pieces", text=of_text, first=a, last=b, of=of, lone=~sure[item[begins]])
        own.save("windows", key=key, piece=(np.cumsum(begins) - 1).astype(np.int32), start=start)
        yield from _run(number, keys, many)

    equal_pieces = _equal(_per_slice(repeated, slices, shorter, BLOCKS_DDL))
    dropped(repeated)

    def leftover(number: int, refs: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = _Slice(folder, number)
        text, first, last, of, lone = own.load("pieces")
        sure = np.isin(of, refs >> 1)
        key, piece, start = own.load("windows")
        left = (lone & ~sure)[piece]
        own.save("left", sure=sure, left=lone & ~sure)
        other = np.flatnonzero(~left)
        _, one = np.unique(key[other], return_index=True)
        want = np.unique(key[left])
        yield from _rows(np.concatenate([want, key[other[one]]]), number, np.concatenate([np.full(len(want), _TOLD), other[one]]), 2, np.repeat([1, 0], [len(want), len(one)]))

    needed = _meeting_many(_per_slice(equal_pieces, slices, leftover, _ROWS_DDL))
    dropped(equal_pieces)

    def one_by_one(number: int, refs: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = _Slice(folder, number)
        text = own.load("pieces")[0]
        _, left = own.load("left")
        _, piece, start = own.load("windows")
        take = np.concatenate([np.flatnonzero(left[piece]), np.unique(refs)]).astype(np.int64)
        texts, copies = own.texts()
        of, many, keys = _fold(texts, text[piece[take]], start[take], start[take] + length, copies)
        own.save("ones", text=text[piece[take]], start=start[take], of=of)
        yield from _run(number, keys, many)

    equal_ones = _equal(_per_slice(needed, slices, one_by_one, BLOCKS_DDL))
    dropped(needed)

    def result(number: int, refs: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = _Slice(folder, number)
        texts, copies = own.texts()
        text, first, last, _, _ = own.load("items")
        (sure,) = own.load("sure")
        p_text, p_first, p_last, _, _ = own.load("pieces")
        p_sure, _ = own.load("left")
        o_text, o_start, o_of = own.load("ones")
        o_sure = np.isin(o_of, refs >> 1)
        twice = np.array([i for i, t in enumerate(texts) if copies[i] > 1 and len(t) >= length], np.int64)
        all_text = np.concatenate([text[sure], p_text[p_sure], o_text[o_sure], twice])
        all_from = np.concatenate([first[sure], p_first[p_sure], o_start[o_sure], np.zeros(len(twice), np.int64)])
        all_to = np.concatenate([last[sure], p_last[p_sure], o_start[o_sure], [len(texts[i]) - length for i in twice]]).astype(np.int64) + length
        order = np.lexsort((all_from, all_text))
        all_text, all_from, all_to = all_text[order], all_from[order], all_to[order]
        cut = np.searchsorted(all_text, np.arange(len(texts) + 1))
        gone = []
        for i in range(len(texts)):
            a, b = all_from[cut[i] : cut[i + 1]], all_to[cut[i] : cut[i + 1]]
            if len(a):
                reach = np.maximum.accumulate(b)
                new = np.append(True, a[1:] > reach[:-1])
                gone.append(np.stack([a[new], np.append(reach[:-1][new[1:]], reach[-1])], axis=1))
            else:
                gone.append(_NOTHING)
        rows = _load(f"{own.at}.rows").combine_chunks()
        length_of = np.array([len(t) for t in texts], np.int64)
        for i, j in cuts(length_of[rows["index"].to_numpy()], 1024, 32 << 20):
            for batch in rows.slice(i, j - i).to_batches():
                yield finish(batch, texts, gone)

    return _per_slice(equal_ones, slices, result, ddl)


_NOTHING = np.zeros((0, 2), np.int64)


def _meeting_many(rows: DataFrame) -> DataFrame:
    """As _meeting, where a slice may have several rows of a key: those that are not wanted, of keys that are wanted in some slice.

    The wanted keys are counted and joined, so that Spark can split a key that very many rows have.
    """
    own = stored(rows, "asked")
    wanted = own.where("wanted > 0").select("key").distinct()
    out = stored(own.where("wanted = 0").join(wanted, "key", "left_semi").select("slice", "ref"), "met")
    dropped(own)
    return out


def _kept(text: memoryview, gone: np.ndarray) -> bytes:
    if not len(gone):
        return bytes(text)
    edges = [0, *gone.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeats(docs: DataFrame, length: int = 200, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each whole text as UTF-8 without the bytes of repeated strings.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in any row, the
    own one included; a text that two rows have counts as repeated. One row for each row of docs; null
    is empty; texts shorter than length stay. Other columns are left out.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def finish(batch: pa.RecordBatch, texts: list[memoryview], gone: list[np.ndarray]) -> pa.RecordBatch:
        index = batch.column("index").to_pylist()
        n = pa.array([len(texts[i]) for i in index], pa.int64())
        removed = pa.array([int((gone[i][:, 1] - gone[i][:, 0]).sum()) for i in index], pa.int64())
        spans = pa.array([len(gone[i]) for i in index], pa.int64())
        kept = pa.array([_kept(texts[i], gone[i]) for i in index], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("c0"), n, removed, spans, kept], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    ddl = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    return _solve(own, "text", length, gram or length * 3 // 5, finish, ddl)


def without_repeats(docs: DataFrame, length: int = 200, gram: int | None = None, text_col: str = "text") -> DataFrame:
    """docs with repeated strings (see repeats) cut out of its texts; rows and other columns stay, null texts stay null.

    Where a cut leaves part of a character, that part goes too.
    """
    at, schema = docs.columns.index(text_col), docs.schema

    def finish(batch: pa.RecordBatch, texts: list[memoryview], gone: list[np.ndarray]) -> pa.RecordBatch:
        index, null = batch.column("index").to_pylist(), batch.column(at).to_pylist()
        kept = pa.array([None if none else _kept(texts[i], gone[i]).decode("utf-8", "ignore") for i, none in zip(index, null)], pa.string())
        cols = list(batch.columns[:-1])
        cols[at] = kept
        return pa.RecordBatch.from_arrays(cols, schema.names)

    return _solve(docs, text_col, length, gram or length * 3 // 5, finish, schema)
