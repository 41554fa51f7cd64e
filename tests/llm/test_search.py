import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ratingloom.llm import va_file


def brute(rows, k):
    out = {}
    usable = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None})
    for i, v in usable:
        if i % 20 == 0:
            found = sorted((-int(np.dot(np.array(v, object), np.array(w, object))), j) for j, w in usable if j != i and len(w) == len(v))
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return out


def found(df, k):
    out = {}
    for r in va_file.top_k(df, F.col("vec_id") % 20 == 0, k=k).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_equals_brute_force_with_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(va_file, "FILE_ROWS", 64)
    rng = np.random.default_rng(3)
    rows = [(int(i), [int(x) for x in rng.integers(-3, 4, 7)]) for i in range(400)] + [(i, [5] * 7) for i in range(1000, 1100)]
    df = spark.createDataFrame([*rows, *rows[:5], (None, [1] * 7), (7777, None)], "vec_id long, vector array<long>")
    assert found(df, 20) == {q: v for q, v in brute(rows, 20).items() if v}


@pytest.mark.parametrize("held", [0, 50])
def test_held_candidates_are_bounded(spark, monkeypatch, held):
    """Vectors that no bounds separate, many equal scores, and queries that share a vector."""
    monkeypatch.setattr(va_file, "HELD", held)
    monkeypatch.setattr(va_file, "SCAN_ROWS", 16)
    monkeypatch.setattr(va_file, "ROW_IDS", 2)
    monkeypatch.setattr(va_file, "LEAST_QUERIES", 1)
    rng = np.random.default_rng(4)
    rows = [(int(i), [int(x) for x in rng.integers(0, 2, 5)]) for i in range(300)] + [(i, [int(x) for x in rng.integers(-900, 900, 5)]) for i in range(300, 500)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    assert found(df, 7) == brute(rows, 7)


def test_tasks_are_at_least_as_many_as_cores():
    assert va_file.dealt(2, 3, 6) == (1, 4) and va_file.dealt(10_000, 5_000, 4000) == (16, 1)
    for files, blocks in ((1, 1), (0, 0), (3, 200), (200, 3)):
        own, shares = va_file.dealt(files, blocks, 6)
        assert 1 <= own <= va_file.TASK_FILES and 1 <= shares <= va_file.BLOCK_ROWS // va_file.LEAST_QUERIES


def test_few_rows_other_lengths_and_large_values(spark):
    rows = [(0, [2**40, 1]), (1, [2**20, -5]), (2, [-(2**40), 3]), (20, [1, 2, 3]), (21, [1, 1, 1]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    assert found(df, 5) == {0: [(1, 1, 2**60 - 5), (2, 2, -(2**63))], 20: [(1, 21, 6)]}


def test_scaled_leaves_out_unfit_vectors(spark):
    rows = [(1, [0.5, -0.01]), (2, None), (3, [0.1, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r[0]: r[1] for r in df.select("vec_id", va_file.scaled(F.col("embedding"))).collect()}
    assert got == {1: [32, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_empty(spark):
    assert found(spark.createDataFrame([], "vec_id long, vector array<long>"), 3) == {}


@pytest.mark.parametrize("dim", [1, 5, 64])
def test_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    exact, queries = rng.integers(-40, 40, (300, dim)), rng.integers(-40, 40, (9, dim))
    import pyarrow as pa

    lists = pa.array(exact.tolist(), pa.list_(pa.int64()))
    parts = va_file.encode_file(dim, lists, pa.array([[i] for i in range(300)], pa.list_(pa.int64())))
    assert int.from_bytes(parts[0], "little") == len(parts[1])
    marks = np.frombuffer(parts[2], "<i8").reshape(dim, va_file.CELLS + 1)
    packed = np.frombuffer(parts[3], np.uint8).reshape(300, (dim + 1) // 2)
    cells = np.stack([packed & 15, packed >> 4], axis=2).reshape(300, -1)[:, :dim]
    least, most = va_file._bounds(queries, marks[np.arange(dim), cells], marks[np.arange(dim), cells + 1])
    scores = queries @ exact.T
    assert (least <= scores).all() and (scores <= most).all()


def test_rounds_grow(monkeypatch, tmp_path):
    """Candidates that no bound separates are read in few rounds, with the scores of brute force."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-40, 40, (2000, 2))
    uri = str(tmp_path / "one.va")
    va_file.put(uri, va_file.encode_file(2, pa.array(list(vectors)), pa.array([[i] for i in range(2000)], pa.list_(pa.int64()))))
    file, reads, real = va_file.ApproximationFile(uri), [], va_file.ApproximationFile.exact
    monkeypatch.setattr(va_file.ApproximationFile, "exact", lambda self, rows: reads.append(len(rows)) or real(self, rows))
    queries, best = np.array([[0, 0], [3, -7]]), va_file._Best(2, 5)
    va_file._search_file(file, queries, best)
    for i, q in enumerate(queries):
        order = np.lexsort((np.arange(2000), -(vectors @ q)))[:5]
        assert best.scores[i].tolist() == (vectors @ q)[order].tolist() and [int(w[0]) for w in best.owners[i]] == order.tolist()
    assert len(reads) <= 8
