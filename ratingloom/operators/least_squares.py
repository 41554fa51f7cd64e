"""Least squares for very many keys at once.

Rows are shuffled by key as they are; only where a batch has so many rows of one key that their sum of
products is smaller, the sum is sent in their place, so that what moves is never more than the rows and a
key with very many of them sends one sum a batch. Each task adds up the products of its keys, in key order,
and solves each key's small system.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose products are made at once; keys that are solved at once.
ROWS, SOLVED = 2048, 1024
#: Up to this size of its inverse a system is solved by it.
SOUND = 1e4


def _firsts(keys: np.ndarray) -> np.ndarray:
    """The place of the first of each run of equal keys."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _products(full: np.ndarray, upper: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The upper triangle of each row's outer product with itself, then 1: what is added up for a key."""
    return np.concatenate([full[:, upper[0]] * full[:, upper[1]], np.ones((len(full), 1))], axis=1)


def _sent(keys: np.ndarray, full: np.ndarray, upper: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(keys, values): rows (x, y) of a batch, or their sum in place of rows that hold more numbers than it."""
    order = np.argsort(keys, kind="stable")
    keys, full = keys[order], full[order]
    first = _firsts(keys)
    count = np.diff(np.append(first, len(keys)))
    many = count * full.shape[1] > len(upper[0]) + 1
    alone = ~np.repeat(many, count)
    sums = [_products(full[a : a + n], upper).sum(axis=0) for a, n in zip(first[many], count[many])]
    return np.concatenate([keys[alone], keys[first[many]]]), [*full[alone], *sums]


def solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The shortest b with least |y - x b| for each x'x and x'y.

    Columns are brought to one size first, so that rank is told apart from size: directions whose eigenvalue
    is then below 1e-10 count as absent, and b is made orthogonal to them as they are in x. Columns of zeros
    have coefficient 0.
    """
    size = np.sqrt(np.einsum("kii->ki", gram))
    empty = size == 0
    size = np.where(empty, 1.0, size)
    scaled = gram / size[:, :, None] / size[:, None, :]
    scaled[:, np.arange(gram.shape[1]), np.arange(gram.shape[1])] = 1.0
    with np.errstate(all="ignore"):
        try:
            inverse = np.linalg.inv(scaled)
        except np.linalg.LinAlgError:  # one of them has none
            inverse = np.full_like(scaled, np.nan)
        # an eigenvalue is at least one over the inverse's size: these have no direction that counts as absent
        sound = np.sqrt(np.einsum("kij,kij->k", inverse, inverse)) < SOUND
    out = np.zeros_like(right, float)
    out[sound] = np.einsum("kij,kj->ki", inverse[sound], (right / size)[sound]) / size[sound]
    if not sound.all():
        out[~sound] = _shortest(scaled[~sound], right[~sound], size[~sound])
    out[empty] = 0.0
    return out


def _shortest(scaled: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """As solve(), from columns of one size, by eigenvalues."""
    values, vectors = np.linalg.eigh(scaled)
    absent = values < 1e-10
    along = np.einsum("kij,ki->kj", vectors, right / size)
    out = np.einsum("kij,kj->ki", vectors, np.where(absent, 0.0, along / np.where(absent, 1.0, values))) / size
    lacking = absent.any(axis=1)
    if lacking.any():
        free = np.where(absent[lacking][:, None, :], vectors[lacking] / size[lacking][:, :, None], 0.0)
        length = np.linalg.norm(free, axis=1, keepdims=True)
        free = free / np.where(length == 0, 1.0, length)
        own = out[lacking][:, :, None]
        out[lacking] = (own - free @ (np.linalg.pinv(free) @ own))[:, :, 0]
    return out


def fitted(sums: np.ndarray, width: int, upper: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coef, n, sse) of each row of sums of products."""
    m = np.empty((len(sums), width + 1, width + 1))
    m[:, upper[0], upper[1]] = m[:, upper[1], upper[0]] = sums[:, :-1]
    gram, right, n = m[:, :width, :width], m[:, :width, width], sums[:, -1].round().astype(np.int64)
    coef = solve(gram, right)
    sse = m[:, width, width] - 2 * np.einsum("ki,ki->k", coef, right) + np.einsum("ki,kij,kj->k", coef, gram, coef)
    return coef, n, np.maximum(sse, 0.0)


def added_up(rows: DataFrame, width: int, min_rows: int = 1) -> DataFrame:
    """(key, coef, n, sse) of rows (key, s), s being a row (x, y) or a sum of products: a key's are added up in one task, then solved."""
    upper = np.triu_indices(width + 1)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, sums) of consecutive rows of one key, a key's last sum still open."""
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                keys, lengths = np.asarray(batch.column(0)), np.asarray(batch.column(1).value_lengths())
                flat, starts = np.asarray(batch.column(1).flatten(), float), np.cumsum(lengths) - lengths
                values = np.empty((len(keys), len(upper[0]) + 1))
                plain = lengths == width + 1
                values[plain] = _products(flat[starts[plain][:, None] + np.arange(width + 1)], upper)
                values[~plain] = flat[starts[~plain][:, None] + np.arange(len(upper[0]) + 1)]
                first = _firsts(keys)
                yield keys[first], np.add.reduceat(values, first, axis=0)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            coef, n, sse = fitted(sums, width, upper)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * width), pa.array(coef.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(keys), lists, pa.array(n), pa.array(sse)], ["key", "coef", "n", "sse"]).filter(pa.array(n >= min_rows))

        keys, sums = np.zeros(0, np.int64), np.zeros((0, len(upper[0]) + 1))
        for more, values in added(batches):
            if len(keys) and more[0] == keys[-1]:
                sums[-1] += values[0]
                more, values = more[1:], values[1:]
            keys, sums = np.concatenate([keys, more]), np.concatenate([sums, values])
            if len(keys) > SOLVED:
                yield result(keys[:-1], sums[:-1])
                keys, sums = keys[-1:], sums[-1:]
        if len(keys):
            yield result(keys, sums)

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(solved, "key bigint, coef array<double>, n bigint, sse double")


def least_squares(design: DataFrame, key: str, width: int, min_rows: int = 1) -> DataFrame:
    """(key, coef array<double>, n bigint, sse double): for each key, the shortest b with least |y - x b|.

    design holds the key (an integer column), x (an array of ``width`` doubles) and y. Rows with a null
    are left out; keys with fewer than min_rows rows have no result. sse comes from the sums, so it is
    exact to about 1e-16 of y'y only, and 0 where rounding would make it negative.
    """
    upper = np.triu_indices(width + 1)
    rows = design.where(F.col(key).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col(key).cast("bigint").alias("key"), "x", F.col("y").cast("double").alias("y"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, width)
                keys, values = _sent(np.asarray(batch.column(0)), np.concatenate([x, np.asarray(batch.column(2), float)[:, None]], axis=1), upper)
                ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))], ["key", "s"])

    sent = rows.mapInArrow(partial, "key bigint, s array<double>")
    return added_up(sent, width, min_rows).withColumnRenamed("key", key)
