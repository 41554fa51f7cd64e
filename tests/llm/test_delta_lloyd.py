import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.llm import delta_lloyd, va_file


def brute(rows, k, rounds, dim, factor=1024, salt="3:"):
    """Plain Lloyd with Python's integers; rows (id, components)."""
    kept = [(i, tuple(int(np.floor(factor * float(x))) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = assigned()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, own) if c == n]
            if mine:
                centroids[n] = tuple(sum(x) // len(mine) for x in zip(*mine))
    own = assigned()
    inertia = [sum(d for d, c in own if c == n) for n in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    most = (1 << 63) - 1
    return sorted(((i, c, min(d, most), min(inertia[c], most), min(sum(inertia), most), digest[c]) for (i, _), (d, c) in zip(kept, own)), key=str)


def found(spark, rows, k, rounds, dim):
    table = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance long, id string")
    vectors = table.select("vec_id", "cluster", "distance", "id", va_file.scaled(F.col("embedding"), 1024).alias("vector"))
    first = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    out = delta_lloyd.described(delta_lloyd.cluster(vectors, k, rounds, first, dim))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def float32(values):
    return [None if x is None else float(np.float32(x)) for x in values]


def test_nulls_lengths_ties_copies_and_clashing_columns(spark):
    rng = random.Random(1)
    rows = [(i, float32(rng.gauss(0, 1) for _ in range(4))) for i in range(80)]
    rows += [(None, [0.5, 0.25, 0.0, -1.0]), (5, None), (6, [1.0, 2.0]), (7, [1.0, None, 0.0, 0.0]), (8, [float("nan")] * 4), (9, [float("inf"), 0.0, 0.0, 0.0]), (10, [])]
    rows += [(100, [1.0, 1.0, 0.0, 0.0])] * 3 + [(101, [0.0] * 4), (101, [0.0] * 4), (102, [-0.0] * 4)]
    for k, rounds in ((8, 10), (3, 0), (1, 2), (5, 1)):
        assert found(spark, rows, k, rounds, 4) == brute(rows, k, rounds, 4)


def test_fewer_vectors_than_centroids_equal_ones_and_none(spark):
    assert found(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])], 8, 10, 2) == brute([(1, [1.0, 2.0]), (2, [3.0, 4.0])], 8, 10, 2)
    same = [(i, [0.5, 0.5]) for i in range(20)]
    assert found(spark, same, 4, 10, 2) == brute(same, 4, 10, 2)
    assert found(spark, [], 8, 10, 2) == []
    assert found(spark, [(1, None)], 8, 10, 2) == []


def test_components_beyond_doubles_and_beyond_64_bits(spark):
    rows = [(i, float32([1e12 * (i % 5), -1e9 * i, 3.0, i])) for i in range(30)] + [(99, [float(np.float32(1e14)), 0.0, 0.0, 0.0])]
    assert found(spark, rows, 4, 5, 4) == brute(rows, 4, 5, 4)


def test_only_what_changed_is_compared(monkeypatch):
    rng = np.random.default_rng(2)
    v, c = rng.integers(-50, 50, (400, 6)), rng.integers(-50, 50, (5, 6))
    own, near = delta_lloyd.owners(v, c, np.ones(5, bool), np.full(400, -1, np.int32), np.zeros(400, np.int64))
    moved = c.copy()
    moved[3] += 7
    pairs = []
    plain = delta_lloyd.distances
    monkeypatch.setattr(delta_lloyd, "distances", lambda a, b: pairs.append(len(a) * len(b)) or plain(a, b))
    after, distance = delta_lloyd.owners(v, moved, np.arange(5) == 3, own, near)
    d = plain(v, moved)
    assert (after == d.argmin(1)).all() and (distance == d.min(1)).all()
    assert sum(pairs) == 5 * (own == 3).sum() + (own != 3).sum()
    assert delta_lloyd._transfers(v, own, after, 5).sum() == 0


@pytest.mark.parametrize("size", [10, 1 << 23, 1 << 25, 1 << 40])
def test_distances_are_exact(size):
    rng = np.random.default_rng(3)
    v, c = rng.integers(-size, size, (20, 64)), rng.integers(-size, size, (3, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]
    assert delta_lloyd.distances(v, c).tolist() == want
