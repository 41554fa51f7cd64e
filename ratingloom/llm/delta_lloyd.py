"""Lloyd's clustering of integer vectors by what changes from round to round.

Vectors are cut into files once and stay there. Beside each file of vectors a file of assignments holds every
vector's cluster and squared distance. A round reads both, in blocks: a vector whose own centroid stayed where
it was keeps its distance and is compared with the centroids that moved only; a vector whose centroid moved is
compared with all. What a vector that changes its cluster takes from one sum and brings to another is added up
in the task, and these signed integers are all that leaves it: k rows of a vector's length and a count. The
driver adds them to the global sums, from which the next centroids follow exactly.

A task that runs again reads the same files and writes the same file, whole or not at all; the assignments of
a round are deleted when the next round's are complete.
"""

from __future__ import annotations

import dataclasses
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import erased, new_file, new_folder, open_fs, stored

#: Vectors that are compared at once.
BLOCK = 8192
#: Doubles hold integers below this exactly; components below ROOM keep all that is computed within 64 bits.
_EXACT, ROOM = float(1 << 53), 1 << 26
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_OWNED = pa.schema([("cluster", pa.int32()), ("distance", pa.int64())])


@dataclasses.dataclass
class Clustering:
    """rows (id, cluster, distance), one for each vector that took part; the final centroids and how often they were moved."""

    rows: DataFrame
    centroids: list[tuple[int, ...]]
    rounds: int


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of integers, exact: doubles or 64 bits where they have room, Python's integers elsewhere."""
    most = max(float(np.abs(vectors.astype(float)).max(initial=0)), float(np.abs(centroids.astype(float)).max(initial=0)))
    if 4.0 * most * most * vectors.shape[1] < _EXACT:
        kind = np.float64
    else:
        kind = np.int64 if most < ROOM and vectors.shape[1] <= 1024 else object
    v, c = vectors.astype(kind), centroids.astype(kind)
    out = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]
    return out.astype(np.int64) if kind is np.float64 else out


def owners(vectors: np.ndarray, centroids: np.ndarray, changed: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) of each vector; a cluster of -1 has never been assigned. Of equally near centroids the smaller number owns."""
    cluster, distance = cluster.copy(), distance.copy()
    huge = float(np.abs(vectors.astype(float)).max(initial=0)) >= ROOM  # kept distances may have been cut to 64 bits
    anew = (cluster < 0) | changed[cluster] | huge
    if anew.any():
        d = distances(vectors[anew], centroids)
        best = d.argmin(1)
        cluster[anew], distance[anew] = best, np.clip(d[np.arange(len(d)), best], _LEAST, _MOST).astype(np.int64)
    if changed.any() and not anew.all():
        rest, moved = np.flatnonzero(~anew), np.flatnonzero(changed)
        d = distances(vectors[rest], centroids[moved])
        best = d.argmin(1)
        near, who = np.clip(d[np.arange(len(d)), best], _LEAST, _MOST).astype(np.int64), moved[best]
        taken = (near < distance[rest]) | ((near == distance[rest]) & (who < cluster[rest]))
        cluster[rest[taken]], distance[rest[taken]] = who[taken], near[taken]
    return cluster, distance


def _transfers(vectors: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> np.ndarray:
    """k rows (count, components...) of Python integers: what each cluster gains."""
    out = np.zeros((k, vectors.shape[1] + 1), object)
    went = before != after
    v = vectors[went]
    if float(np.abs(v.astype(float)).max(initial=0)) >= (1 << 48):
        v = v.astype(object)
    for sign, of in ((1, after[went]), (-1, before[went])):
        for c in np.unique(of[of >= 0]):
            own = of == c
            out[c, 0] += sign * int(own.sum())
            out[c, 1:] += sign * v[own].sum(0).astype(object)
    return out


def _write(vectors: DataFrame, dim: int, folder: str) -> DataFrame:
    """(file, n): vectors (id, vector) in files of blocks, a file for each task that has rows."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.int64(), dim))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name, n = f"part-{TaskContext.get().partitionId():06d}", 0
        with new_file(f"{folder}/vectors/{name}") as out, pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as sink:
            for batch in itertools.chain([first], batches):
                for i in range(0, batch.num_rows, BLOCK):
                    own = batch.slice(i, BLOCK)
                    sink.write_batch(pa.RecordBatch.from_arrays([own.column(0), pa.FixedSizeListArray.from_arrays(own.column(1).flatten(), dim)], schema=schema))
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "n"])

    return vectors.mapInArrow(run, "file string, n long")


def _blocks(uri: str) -> Iterator[pa.RecordBatch]:
    files, path = open_fs(uri)
    with files.open_input_stream(path) as source:
        yield from pa.ipc.open_stream(source)


def _owned(folder: str, turn: int, name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(vectors, cluster, distance) of each block after a turn; before the first one nothing is owned."""
    vectors = _blocks(f"{folder}/vectors/{name}")
    if turn < 0:
        for block in vectors:
            yield block, np.full(block.num_rows, -1, np.int32), np.zeros(block.num_rows, np.int64)
        return
    for block, owned in zip(vectors, _blocks(f"{folder}/owned-{turn:04d}/{name}")):
        yield block, np.asarray(owned.column(0)), np.asarray(owned.column(1))


def _turn(files: DataFrame, folder: str, turn: int, centroids: list[tuple[int, ...]], changed: list[bool]) -> dict[tuple[int, int], int]:
    """Assign every vector once more; what each sum gains, by (cluster, place), place 0 being the count."""
    k, dim = len(centroids), len(centroids[0])
    kind = np.int64 if all(_LEAST <= x <= _MOST for c in centroids for x in c) else object
    own, moved = np.array(centroids, kind), np.array(changed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gained = np.zeros((k, dim + 1), object)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with new_file(f"{folder}/owned-{turn:04d}/{name}") as out, pa.ipc.new_stream(out, _OWNED, options=pa.ipc.IpcWriteOptions(compression="lz4")) as sink:
                    for block, before, distance in _owned(folder, turn - 1, name):
                        vectors = np.asarray(block.column(1).flatten()).reshape(block.num_rows, dim)
                        cluster, distance = owners(vectors, own, moved, before, distance)
                        gained += _transfers(vectors, before, cluster, k)
                        sink.write_batch(pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(distance)], schema=_OWNED))
        at = np.argwhere(gained != 0)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array([str(gained[c, p]) for c, p in at], pa.string())], ["cluster", "place", "amount"])

    sums = files.select("file").mapInArrow(run, "cluster int, place int, amount string").groupBy("cluster", "place").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))
    return {(r["cluster"], r["place"]): int(r["amount"]) for r in sums.collect()}


def cluster(vectors: DataFrame, k: int, rounds: int, first: Column, dim: int, id_col: str = "vec_id", vector_col: str = "vector") -> Clustering:
    """Clusters of integer vectors (array<bigint>, ``dim`` components) after ``rounds`` moves of the centroids and a last assignment.

    The k vectors with the smallest ``first`` are the first centroids, ties by vector, nulls last. A vector
    goes to the nearest centroid, ties to the smaller number; a centroid moves to the floor of its vectors'
    mean, and stays where it has none. Rounds end early where no centroid moves, as nothing can change then.

    Null vectors, those of another length and those with null components take no part. Repeated rows count as
    often as they are there; rows without an id take part like others. Fewer than k vectors make fewer
    clusters, none an empty result. Distances beyond 64 bits are given as the largest long, though compared
    exactly.
    """
    spark = vectors.sparkSession
    rows = vectors.where((F.size(vector_col) == dim) & ~F.exists(vector_col, lambda x: x.isNull())).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<bigint>").alias("v"), first.alias("first"))
    centroids = [tuple(r["v"]) for r in rows.orderBy(F.col("first").asc_nulls_last(), "v").limit(k).collect()]
    if not centroids:
        return Clustering(spark.createDataFrame([], "id bigint, cluster int, distance bigint"), [], 0)
    folder = new_folder(spark, "lloyd")
    files = stored(_write(rows.select("id", "v"), dim, folder), "lloyd-files")
    # a file is a task: names are dealt evenly, whatever the manifest's own files are
    files = files.repartition(max(1, files.count()))
    sums = [[0] * (dim + 1) for _ in centroids]
    changed, turn = [True] * len(centroids), 0
    while True:
        for (c, place), amount in _turn(files, folder, turn, centroids, changed).items():
            sums[c][place] += amount
        if turn:
            erased(spark, f"{folder}/owned-{turn - 1:04d}")
        if turn == rounds or not any(changed):
            break
        moved = [tuple(x // s[0] for x in s[1:]) if s[0] else c for c, s in zip(centroids, sums)]
        changed, centroids, turn = [a != b for a, b in zip(moved, centroids)], moved, turn + 1
    last = turn

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for block, cluster, distance in _owned(folder, last, name):
                    yield pa.RecordBatch.from_arrays([block.column(0), pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    return Clustering(files.select("file").mapInArrow(read, "id bigint, cluster int, distance bigint"), centroids, last)


def described(found: Clustering, id_col: str = "vec_id") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256): rows with the distances summed up over the cluster and over all.

    Sums beyond 64 bits are given as the largest long. The k sums are one aggregate over the assignments.
    """
    spark = found.rows.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()} if found.centroids else {}
    total = sum(sums.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    of = [(c, min(s, _MOST), min(total, _MOST), digest(found.centroids[c])) for c, s in sums.items()]
    table = spark.createDataFrame(of, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.rows.join(F.broadcast(table), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
