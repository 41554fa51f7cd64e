"""Exact top-k search by inner product over vector-approximation files.

A file holds up to FILE_ROWS distinct vectors: for each component the cell of a grid that the file's
own values fill evenly (4 bits), the exact integers, and the ids of the rows that hold the vector. A
search scans the cells first: they bound each inner product from below and from above. Exact vectors
are then read in the order of their best possible score, until the k-th score found is beyond what any
unread vector can reach. Blocks of queries are scanned together, so that both bounds are matrix products.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import new_folder, open_fs, put, saved

#: Vectors in a file; queries in a block; vectors whose bounds are held at once; files searched by one task at most.
FILE_ROWS, BLOCK_ROWS, SCAN_ROWS, TASK_FILES = 1 << 15, 1024, 4096, 16
#: Candidates of a block that are held before exact vectors are read; queries that a task takes of a block, at least; ids of one vector in a row.
HELD, LEAST_QUERIES, ROW_IDS = 1 << 21, 64, 4096
#: Candidates of a query that a round reads at most.
ROUND = 1024
CELLS = 16
_EXACT = float(1 << 53)


def scaled(vector: Column, factor: int = 64) -> Column:
    """floor(factor * component) of each component; null for vectors that are null or hold null or non-finite components."""
    unfit = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(unfit, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


def folded(vectors: DataFrame, keep: int, id_col: str, vector_col: str) -> DataFrame:
    """(vector, ids): distinct integer vectors, each with the ``keep`` smallest of its ids.

    No result needs more: of equal vectors, a larger id never comes before a smaller one.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")).where("id is not null and vector is not null").distinct()
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= keep)
    return first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), dim)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """(dimension, vectors, lists of ids), up to ``size`` rows of one dimension at a time."""
    held: dict[int, list[tuple[pa.Array, pa.Array]]] = {}
    for batch in batches:
        sizes = np.asarray(batch.column(0).value_lengths())
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            for i in range(0, len(rows), size):
                part = batch.take(pa.array(rows[i : i + size]))
                own = held.setdefault(int(dim), [])
                if sum(len(v) for v, _ in own) + part.num_rows > size:
                    yield int(dim), pa.concat_arrays([v for v, _ in own]), pa.concat_arrays([x for _, x in own])
                    own.clear()
                own.append((part.column(0), part.column(1)))
    for dim, own in held.items():
        if own:
            yield dim, pa.concat_arrays([v for v, _ in own]), pa.concat_arrays([x for _, x in own])


def _sections(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def encode_file(dim: int, vectors: pa.Array, ids: pa.Array) -> list[bytes]:
    """An approximation file: length of its header, header, marks, packed cells, exact vectors, id offsets, ids."""
    exact = _matrix(vectors, dim)
    n = len(exact)
    wide = n and dim and max(-int(exact.min()), int(exact.max())) >= 1 << 31
    marks = np.zeros((dim, CELLS + 1), np.int64)
    cells = np.zeros((n, dim), np.uint8)
    for j in range(dim):
        values = np.sort(exact[:, j])
        marks[j, :CELLS] = values[np.arange(CELLS) * n // CELLS]
        marks[j, CELLS] = values[-1]
        cells[:, j] = np.clip(np.searchsorted(marks[j, :CELLS], exact[:, j], side="right") - 1, 0, CELLS - 1)
    padded = np.pad(cells, ((0, 0), (0, dim % 2)))
    lengths = np.asarray(ids.value_lengths()).astype("<i8")
    parts = _sections(marks.astype("<i8"), padded[:, ::2] | padded[:, 1::2] << 4, exact.astype("<i8" if wide else "<i4"), np.append(0, np.cumsum(lengths)).astype("<i8"), np.asarray(ids.flatten()).astype("<i8"))
    head = json.dumps({"rows": n, "dim": dim, "wide": bool(wide), "sizes": list(map(len, parts))}).encode()
    return [len(head).to_bytes(4, "little"), head, *parts]


class ApproximationFile:
    """Reads marks, cells and, by row, exact vectors and ids."""

    def __init__(self, uri: str):
        files, path = open_fs(uri)
        self._in = files.open_input_file(path)
        n = int.from_bytes(self._in.read_at(4, 0), "little")
        head = json.loads(self._in.read_at(n, 4))
        self.rows, self.dim, self._kind = head["rows"], head["dim"], np.dtype("<i8" if head["wide"] else "<i4")
        self._at = np.concatenate([[4 + n], 4 + n + np.cumsum(head["sizes"])]).astype(int)
        self.marks = self._section(0, "<i8").reshape(self.dim, CELLS + 1)

    def _section(self, i: int, kind: str) -> np.ndarray:
        return np.frombuffer(self._in.read_at(int(self._at[i + 1] - self._at[i]), int(self._at[i])), kind)

    def cells(self, start: int, stop: int) -> np.ndarray:
        wide = (self.dim + 1) // 2
        raw = np.frombuffer(self._in.read_at((stop - start) * wide, int(self._at[1]) + start * wide), np.uint8).reshape(stop - start, wide)
        return np.stack([raw & 15, raw >> 4], axis=2).reshape(stop - start, 2 * wide)[:, : self.dim]

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """The exact vectors of ascending rows; neighbours are read together."""
        size = self.dim * self._kind.itemsize
        out = np.empty((len(rows), self.dim), np.int64)
        cuts = np.flatnonzero(np.diff(rows) > 8) + 1
        for part in np.split(np.arange(len(rows)), cuts):
            first, last = int(rows[part[0]]), int(rows[part[-1]])
            raw = np.frombuffer(self._in.read_at((last + 1 - first) * size, int(self._at[2]) + first * size), self._kind)
            out[part] = raw.reshape(last + 1 - first, self.dim)[rows[part] - first]
        return out

    def everything(self) -> np.ndarray:
        return self._section(2, self._kind).astype(np.int64).reshape(self.rows, self.dim)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        return self._section(3, "<i8"), self._section(4, "<i8")

    def close(self) -> None:
        self._in.close()


def write(vectors: DataFrame, folder: str, rows: int) -> list[str]:
    """The URIs of files that hold the rows (vector, ids), each of one dimension; their names are all the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, (dim, own, ids) in enumerate(_chunks(batches, rows)):
            uri = f"{folder}/part-{part:06d}-{number:04d}.va"
            put(uri, encode_file(dim, own, ids))
            yield pa.RecordBatch.from_arrays([pa.array([uri])], ["file"])

    return sorted(r[0] for r in vectors.mapInArrow(run, "file string").collect())


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact; beyond 64 bits it stops at the largest or smallest long."""
    most = float(np.abs(a.astype(float)).sum(1).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if most < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    big = a.astype(object) @ b.T.astype(object)
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) inner product of each query with each box; widened where doubles would round."""
    up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    low, high = low.astype(float), high.astype(float)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    size = float(np.abs(queries.astype(float)).sum(1).max(initial=0)) * max(float(np.abs(low).max(initial=0)), float(np.abs(high).max(initial=0)))
    slack = 0.0 if size < _EXACT else size * 1e-12
    return least - slack, most + slack


class _Best:
    """The k best (score, smallest id) vectors of each query so far, over all files."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.owners: list[list[np.ndarray]] = [[] for _ in range(n)]

    def threshold(self, i: int) -> float:
        return float(self.scores[i][-1]) if len(self.scores[i]) >= self.k else -np.inf

    def offer(self, i: int, scores: np.ndarray, owners: list[np.ndarray]) -> None:
        score = np.concatenate([self.scores[i], scores])
        who = self.owners[i] + owners
        order = np.lexsort(([int(w[0]) for w in who], -score.astype(object) if len(score) and score.min() == -(1 << 63) else -score))[: self.k]
        self.scores[i], self.owners[i] = score[order], [who[j] for j in order]


def _search_file(file: ApproximationFile, queries: np.ndarray, best: _Best, batch: int = 32) -> None:
    """Offer to ``best`` every vector of the file that can be among the k best of a query.

    Candidates that the bounds can't separate are not held without end: where HELD of them wait, their exact
    vectors are read, which raises the floor for the rest of the file.
    """
    n, k = len(queries), best.k
    floor = np.array([best.threshold(i) for i in range(n)])
    least_k = np.full((n, 0), -np.inf)
    held: list[tuple[np.ndarray, ...]] = []
    size, dims = 0, np.arange(file.dim)

    def above() -> list[tuple[np.ndarray, ...]]:
        """What still reaches the floor."""
        q, row, most = (np.concatenate(x) for x in zip(*held))
        stay = most >= floor[q]
        return [(q[stay], row[stay], most[stay])]

    for start in range(0, file.rows, SCAN_ROWS):
        stop = min(file.rows, start + SCAN_ROWS)
        cells = file.cells(start, stop)
        least, most = _bounds(queries, file.marks[dims, cells], file.marks[dims, cells + 1])
        both = np.concatenate([least_k, least], axis=1)
        least_k = np.partition(both, both.shape[1] - k, axis=1)[:, -k:] if both.shape[1] > k else both
        if least_k.shape[1] >= k:
            floor = np.maximum(floor, least_k.min(axis=1))
        q, row = np.nonzero(most >= floor[:, None])
        held.append((q, row + start, most[q, row]))
        size += len(q)
        if size > HELD:
            held = above()
            size = len(held[0][0])
            if size > HELD // 2:
                _read_best_first(file, queries, best, *held[0], batch)
                floor = np.maximum(floor, [best.threshold(i) for i in range(n)])
                held, size = [], 0
    if held:
        _read_best_first(file, queries, best, *above()[0], batch)


def _read_best_first(file: ApproximationFile, queries: np.ndarray, best: _Best, q: np.ndarray, row: np.ndarray, most: np.ndarray, batch: int) -> None:
    """Read exact vectors of candidates (query, row, upper bound) in the order of their bounds, until each query's k-th score is certain.

    Each round takes twice as many of a query as the one before: few rounds, and at most about twice what is needed.
    """
    n = len(queries)
    # stable: of a query's equal bounds, rows come as they were scanned
    order = np.lexsort((-most, q))
    q, row, most = q[order], row[order], most[order]
    at, ends = np.searchsorted(q, np.arange(n)), np.searchsorted(q, np.arange(n), side="right")
    offsets, ids = file.ids()
    active = np.flatnonzero(at < ends)
    while len(active):
        takes = [np.arange(at[i], min(ends[i], at[i] + batch)) for i in active]
        wanted = np.unique(row[np.concatenate(takes)])
        exact = file.exact(wanted)
        for i, take in zip(active, takes):
            rows = row[take]
            scores = _product(queries[i : i + 1], exact[np.searchsorted(wanted, rows)])[0]
            keep = scores >= best.threshold(i)
            best.offer(i, scores[keep], [ids[offsets[r] : offsets[r + 1]] for r in rows[keep]])
            at[i] = take[-1] + 1
        batch = min(2 * batch, ROUND)
        # the k-th score is certain once no unread vector can reach it; equal ones may have smaller ids
        active = np.array([i for i in active if at[i] < ends[i] and most[at[i]] >= best.threshold(i)], int)


def dealt(files: int, blocks: int, cores: int) -> tuple[int, int]:
    """(files of a task, shares that a block of queries is cut into): about four tasks a core, where there is enough to deal."""
    wanted = 4 * cores
    own = max(1, min(TASK_FILES, files * blocks // wanted))
    tasks = max(1, blocks) * max(1, -(-files // own))
    return own, max(1, min(-(-wanted // tasks), BLOCK_ROWS // LEAST_QUERIES))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector", folder: str | None = None) -> DataFrame:
    """(query_id, rank, id, score): for each row that is_query names, the k rows of largest inner product, ties to the smaller id.

    vector_col holds arrays of longs (see scaled). A query meets every row but those with its own id;
    with fewer it gets all. Rows without an id or vector take no part; vectors of different lengths do
    not meet; rows that repeat both id and vector count once. An id with several vectors is a candidate
    with each, and as a query gets the best of all its vectors' results. Sums beyond a long stop at its
    limits.
    """
    spark = vectors.sparkSession
    folder = folder or new_folder(spark, "va")
    usable = saved(vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias(id_col), vector_col, is_query.alias("__query")))
    files = write(folded(usable, k + 1, id_col, vector_col), f"{folder}/all", FILE_ROWS)
    # queries: all ids of a vector, not only the smallest, in rows of about ROW_IDS of them
    asked = usable.where("__query").select(F.col(vector_col).alias("vector"), F.col(id_col).alias("id")).distinct()
    shared = asked.groupBy("vector").agg(F.count("*").alias("n")).where(F.col("n") > ROW_IDS)
    salted = asked.join(shared, "vector", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce(F.ceil(F.col("n") / ROW_IDS), F.lit(1))))
    parts = salted.groupBy("vector", "salt").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    blocks = write(parts.select("vector", "ids"), f"{folder}/queries", BLOCK_ROWS)
    groups, shares = dealt(len(files), len(blocks), spark.sparkContext.defaultParallelism)
    groups = [files[i : i + groups] for i in range(0, len(files), groups)]
    sent = spark.sparkContext.broadcast((blocks, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_blocks, all_groups = sent.value
        for task in (t for batch in batches for t in batch.column(0).to_pylist()):
            task, share = divmod(task, shares)
            block = ApproximationFile(all_blocks[task // len(all_groups)])
            queries, (offsets, ids) = block.everything(), block.ids()
            block.close()
            first, stop = len(queries) * share // shares, len(queries) * (share + 1) // shares
            queries, offsets = queries[first:stop], offsets[first : stop + 1]
            best = _Best(len(queries), k + 1)
            for uri in all_groups[task % len(all_groups)]:
                file = ApproximationFile(uri)
                if file.dim == queries.shape[1] and len(queries):
                    _search_file(file, queries, best)
                file.close()
            for i in range(len(queries)):
                who = best.owners[i]
                own = np.concatenate(who) if who else np.zeros(0, np.int64)
                score = np.repeat(best.scores[i], list(map(len, who)))
                order = np.lexsort((own, -score.astype(object) if len(score) and score.min() == -(1 << 63) else -score))
                own, score = own[order], score[order]
                asking = ids[offsets[i] : offsets[i + 1]]
                for some in np.array_split(asking, max(1, len(asking) // 256)):
                    found = [(own[(keep := np.flatnonzero(own != a)[:k])], score[keep]) for a in some]
                    cols = [np.repeat(some, [len(x) for x, _ in found]), np.concatenate([x for x, _ in found]), np.concatenate([s for _, s in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["query_id", "id", "score"])

    n = len(blocks) * len(groups) * shares
    found = spark.range(0, n, 1, max(1, n)).mapInArrow(run, "query_id bigint, id bigint, score bigint")
    if n > 0:
        found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
