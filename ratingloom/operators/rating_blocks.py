"""Ratings cut once into blocks of users and blocks of items, for rounds that move factors only.

A block is a file on shared storage that holds all ratings of its keys as compressed rows, and for each key the
blocks of the other side that need its factors. A half round ships each factor once to each block that needs it,
those of a batch that go to one block together as one row, and a block solves its keys' least squares from what has come. A key with so many ratings that they are cut into
several blocks sends its sums of products, which are added up before they are solved.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..files import batches, erased, writer
from ..session import collected, new_folder, written
from .block_matrix import _by_key, _column
from .least_squares import added_up, fitted

#: Ratings of a block, about; ratings whose products are made at once.
BLOCK, ROWS = 1 << 17, 1 << 15
#: Blocks from which on what a half round shuffles is dropped before the next.
MANY = 8

_LONGS = pa.list_(pa.int64())
_FILE = pa.schema([("keys", _LONGS), ("starts", _LONGS), ("others", _LONGS), ("places", pa.list_(pa.int32())), ("y", pa.list_(pa.float64())), ("goes", _LONGS), ("to", _LONGS), ("whole", pa.bool_())])
_SOLVED = "id bigint, f array<double>, to array<bigint>, n bigint, sse double, s array<double>"


def _sums(full: np.ndarray, starts: np.ndarray, upper: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The upper triangle of each key's products of rows, and its number of rows; keys of one number of rows are multiplied together."""
    count = np.diff(np.append(starts, len(full)))
    out = np.empty((len(starts), len(upper[0]) + 1))
    out[:, -1] = count
    for n in np.unique(count):
        own, each = np.flatnonzero(count == n), max(1, ROWS // int(n))
        for some in (own[k : k + each] for k in range(0, len(own), each)):
            rows = full[starts[some][:, None] + np.arange(n)]
            out[some, :-1] = (rows.transpose(0, 2, 1) @ rows)[:, upper[0], upper[1]]
    return out


def _packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, ids, f): factors (id, f, to) as bytes, a batch's of each block that they go to in one row."""
    for batch in source:
        ends = np.cumsum(np.asarray(batch.column(2).value_lengths()))
        if not len(ends) or not ends[-1]:
            continue
        to = np.asarray(batch.column(2).flatten())
        order = np.argsort(to, kind="stable")
        rows, to = np.searchsorted(ends, order, side="right"), to[order]
        first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        f = np.asarray(batch.column(1).flatten()).reshape(len(ends), -1)

        def cut(values: np.ndarray) -> pa.Array:
            places = (np.append(first, len(to)) * (values.nbytes // len(to))).astype(np.int32)  # noqa: B023
            return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(values)])

        yield pa.RecordBatch.from_arrays([pa.array(to[first]), cut(np.asarray(batch.column(0))[rows]), cut(np.ascontiguousarray(f[rows]))], ["block", "ids", "f"])


def _bytes(rows: list[pa.RecordBatch], name: str, kind: type) -> np.ndarray:
    """The numbers of all rows' bytes."""
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for b in rows for x in b.column(b.schema.get_field_index(name))])


def _dealt(rows: DataFrame, key: str, size: int, block: int, out: str) -> DataFrame:
    """rows with the block of each by its key, and whether the key's block is the only one of its kind.

    Keys are dealt by hash into parts of about ``block`` ratings; the parts that a hot key makes twice as large
    are dealt again by the rating. Of those there are at most size / block, and they are counted first.
    """
    n = max(1, -(-size // block))
    part = F.pmod(F.xxhash64(key), F.lit(n))
    hot = written(rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).where(F.col("__n") > 2 * block), "hot-parts")[0]
    if hot.isEmpty():
        return rows.withColumns({out: part, f"{out}_whole": F.lit(True)})
    pieces = F.ceil(F.col("__n") / block)
    cut = rows.withColumn("__of", part).join(hot, F.col("__of") == F.col("__part"), "left")
    again = F.pmod(F.xxhash64("user_id", "item_id"), pieces) * n
    return cut.withColumns({out: F.col("__of") + F.coalesce(again, F.lit(0)), f"{out}_whole": F.col("__n").isNull()}).drop("__of", "__part", "__n")


@dataclasses.dataclass(frozen=True)
class Side:
    """The blocks of one side, about ``n`` of them: keys (id, to), the blocks of the other side that need each key, a row for each block the key is in."""

    folder: str
    keys: DataFrame
    n: int
    whole: bool

    @classmethod
    def build(cls, rows: DataFrame, key: str, other: str, own: str, to: str, n: int) -> Side:
        """From rows (user_id, item_id, y, <own>, <own>_whole, <to>)."""
        folder = new_folder(rows.sparkSession, "rating-blocks")

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (block,), of in _by_key(source, ("block",)):
                ids, others, y, going = (_column(of, c) for c in ("id", "other", "y", "to"))
                order = np.lexsort((y, others, ids))
                ids, others, y, going = ids[order], others[order], y[order], going[order]
                keys, starts = np.unique(ids, return_index=True)
                known, places = np.unique(others, return_inverse=True)
                pairs = np.unique(np.stack([np.repeat(np.arange(len(keys)), np.diff(np.append(starts, len(ids)))), going], axis=1), axis=0)
                goes, targets = np.searchsorted(pairs[:, 0], np.arange(len(keys))), np.ascontiguousarray(pairs[:, 1])
                whole = of[0].column(of[0].schema.get_field_index("whole"))[0].as_py()
                arrays = [pa.array([x], f.type) for x, f in zip((keys, starts, known, places.astype(np.int32), y, goes, targets), _FILE)]
                with writer(f"{folder}/block-{block}", _FILE) as sink:
                    sink.write_batch(pa.RecordBatch.from_arrays([*arrays, pa.array([whole])], schema=_FILE))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(np.append(goes, len(targets)).astype(np.int32), targets)], ["id", "to"])

        cut = rows.select(F.col(own).alias("block"), F.col(key).alias("id"), F.col(other).alias("other"), "y", F.col(to).alias("to"), F.col(f"{own}_whole").alias("whole"))
        dealt = cut.repartitionById(n, F.pmod("block", F.lit(n)).cast("int")).sortWithinPartitions("block")
        keys = written(dealt.mapInArrow(run, "id bigint, to array<bigint>"), "rating-keys")[0]
        side = cls(folder, keys, n, rows.where(~F.col(f"{own}_whole")).isEmpty())
        side.settle()
        return side

    def settle(self) -> None:
        """Drop what earlier jobs have shuffled; for between half rounds, each of which ships all factors."""
        if self.n > MANY:
            collected(self.keys.sparkSession)

    def solved(self, factors: DataFrame, width: int, used: int, bias: int | None = None, constant: bool = False) -> DataFrame:
        """(id, f, to, n, sse): this side's factors from the other side's (id, f, to).

        A key's f has least |y - x f|, x being the first ``used`` of the other side's factors, then 1 with
        constant; where bias is given, that one of the other side's factors is taken from y first.
        """
        folder, upper = self.folder, np.triu_indices(width + 1)

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (block,), of in _by_key(source, ("block",)):
                ids = _bytes(of, "ids", np.int64)
                given = _bytes(of, "f", np.float64).reshape(len(ids), -1)
                ids, first = np.unique(ids, return_index=True)
                given = given[first]
                file = next(batches(f"{folder}/block-{block}"))
                keys, starts, others, places, y, goes, to = (np.asarray(file.column(k)[0].values) for k in range(7))
                # every factor that the block's file names has come
                at = np.searchsorted(ids, others)[places]
                x = given[at]
                left = y - (x[:, bias] if bias is not None else 0.0)
                full = np.concatenate([x[:, :used], *([np.ones((len(y), 1))] if constant else []), left[:, None]], axis=1)
                sums = _sums(full, starts, upper)
                lists = pa.ListArray.from_arrays(np.append(goes, len(to)).astype(np.int32), to)
                if file.column(7)[0].as_py():
                    coef, n, sse = fitted(sums, width, upper)
                    f = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * width, coef.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(keys), f, lists, pa.array(n), pa.array(sse), pa.nulls(len(keys), pa.list_(pa.float64()))], ["id", "f", "to", "n", "sse", "s"])
                else:
                    s = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * sums.shape[1], sums.ravel())
                    none = pa.nulls(len(keys), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), none, lists, pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.float64()), s], ["id", "f", "to", "n", "sse", "s"])

        # as many tasks as blocks: what is shipped to a block is little beside what is computed in it
        packed = factors.select("id", "f", "to").mapInArrow(_packed, "block bigint, ids binary, f binary")
        shipped = packed.repartitionById(self.n, F.pmod("block", F.lit(self.n)).cast("int")).sortWithinPartitions("block")
        out = shipped.mapInArrow(run, _SOLVED)
        if self.whole:
            return out.drop("s")
        out = written(out, "rating-sums")[0]
        pieces = out.where("s is not null")
        routes = pieces.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to"))
        hot = added_up(pieces.select(F.col("id").alias("key"), "s"), width).select(F.col("key").alias("id"), F.col("coef").alias("f"), "n", "sse")
        return out.where("s is null").drop("s").unionByName(hot.join(routes, "id").select("id", "f", "to", "n", "sse"))


def cut(ratings: DataFrame, block: int = BLOCK) -> tuple[Side, Side]:
    """The blocks of users and of items of ratings (user_id, item_id, y), none of them null, ids integers."""
    rows, first = written(ratings.select(F.col("user_id").cast("bigint").alias("user_id"), F.col("item_id").cast("bigint").alias("item_id"), F.col("y").cast("double").alias("y")), "ratings")
    size = rows.count()
    both = _dealt(_dealt(rows, "user_id", size, block, "u"), "item_id", size, block, "i")
    (both, second), n = written(both, "ratings"), max(1, -(-size // block))
    erased(ratings.sparkSession, first)
    sides = Side.build(both, "user_id", "item_id", "u", "i", n), Side.build(both, "item_id", "user_id", "i", "u", n)
    erased(ratings.sparkSession, second)
    return sides


def drawn(side: Side, draw: Column) -> DataFrame:
    """(id, f, to): first factors of a side's keys; draw is an expression on id."""
    return side.keys.select("id", draw.alias("f"), "to")
