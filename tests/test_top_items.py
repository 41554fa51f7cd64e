import os

import numpy as np
import pytest

from ratingloom.operators import top_items
from ratingloom.plans.queries import QUERIES

USERS, ITEMS, RATED = "user_id long, u array<double>, b double", "item_id long, v array<double>, offset double", "user_id long, item_id long"


def brute(users, items, rated, limit):
    rated, out = set(rated), []
    for user, u, b in users:
        scored = sorted(((-(float(np.dot(u, v)) + offset + b), -i) for i, v, offset in items if (user, i) not in rated))[:limit]
        out += [(user, rank + 1, -i, -s) for rank, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("limit", "rows", "block"), [(5, 7, 4), (400, 1000, 512), (1, 3, 1)])
def test_equals_brute_force_with_ties(spark, limit, rows, block):
    rng = np.random.default_rng(limit)
    users = [(u, rng.integers(-3, 4, 3).astype(float).tolist(), float(rng.integers(0, 3))) for u in range(23)] + [(99, [0.0, 0.0, 0.0], 1.0)]
    items = [(100 + i, (rng.integers(-3, 4, 3) * (1 + i % 4)).astype(float).tolist(), float(rng.integers(-2, 3)) / 2) for i in range(60)]
    rated = [(int(u), 100 + int(i)) for u, i in zip(rng.integers(0, 23, 300), rng.integers(0, 60, 300))]
    tables = (spark.createDataFrame([*users, (None, [1.0, 0.0, 0.0], 0.0), (98, None, 0.0)], USERS), spark.createDataFrame([*items, (None, [9.0, 9.0, 9.0], 0.0), (7, None, 0.0), (8, [9.0, 9.0, 9.0], None)], ITEMS))
    found = top_items.best_items(*tables, spark.createDataFrame([*rated, (None, 100), (1, None)], RATED), limit, rows, block)
    assert sorted(map(tuple, found.collect())) == brute(users, items, rated, limit)


def test_empty_tables(spark):
    users, items, rated = (spark.createDataFrame([], s) for s in (USERS, ITEMS, RATED))
    one = spark.createDataFrame([(1, [1.0], 0.0)], USERS)
    assert top_items.best_items(users, items, rated).count() == 0 and top_items.best_items(one, items, rated).count() == 0


def test_items_that_cannot_be_among_the_best_are_not_read(spark, monkeypatch):
    folders = []
    plain = top_items.new_folder
    monkeypatch.setattr(top_items, "new_folder", lambda s, kind: folders.append(plain(s, kind)) or folders[-1])
    items = [(i, [10.0 + i, 0.0], 0.0) for i in range(10)] + [(100 + i, [0.001 * i, 0.0], 0.0) for i in range(200)]
    users = spark.createDataFrame([(1, [1.0, 0.0], 0.0), (2, [2.0, 1.0], 0.5)], USERS)
    found = top_items.best_items(users, spark.createDataFrame(items, ITEMS).repartition(1), spark.createDataFrame([(1, 9)], RATED), 5, rows=5)
    folder = folders[0].removeprefix("file://")
    from ratingloom.files import batches

    for name in os.listdir(folder):
        if max(next(batches(f"{folder}/{name}")).column(0)[0].as_py()) >= 100 and min(next(batches(f"{folder}/{name}")).column(0)[0].as_py()) >= 100:
            os.remove(f"{folder}/{name}")  # so that reading it would fail
    got = {u: [r["item_id"] for r in sorted(found.collect(), key=lambda r: r["rank"]) if r["user_id"] == u] for u in (1, 2)}
    assert got == {1: [8, 7, 6, 5, 4], 2: [9, 8, 7, 6, 5]}


def test_recommendations_for_all_equal_the_models_predictions(spark, sf_dir):
    from ratingloom.operators import models
    from ratingloom.sources import testdata

    ratings = testdata.ratings(spark, sf_dir)
    model = models.ALS.fit(ratings, 3)
    u, v, c = ({r[0]: r[1] for r in t.collect()} for t in (model.users, model.items, model.centers.select("item_id", "center")))
    users, items = [(k, x[:3], x[3]) for k, x in u.items()], [(k, x, c[k]) for k, x in v.items()]
    want = brute(users, items, [(r["user_id"], r["item_id"]) for r in ratings.collect()], 400)
    got = sorted(map(tuple, QUERIES["recommend_all_als3"](spark, sf_dir).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-6)
    assert sum(a[2] == b[2] for a, b in zip(got, want)) > 0.999 * len(want)  # rounding may swap equal ones


def test_large_items_that_point_elsewhere_are_not_read(spark, monkeypatch):
    """A norm doesn't tell where an item points: what is large the other way, or has a large offset only, is passed over."""
    folders = []
    plain = top_items.new_folder
    monkeypatch.setattr(top_items, "new_folder", lambda s, kind: folders.append(plain(s, kind)) or folders[-1])
    near = [(i, [5.0 + i % 8, 0.0], 0.0) for i in range(64)]
    away = [(100 + i, [-50.0 - i % 8, 0.0], 2.0) for i in range(64)] + [(200 + i, [0.0, 70.0 + i % 8], 0.0) for i in range(64)]
    users = spark.createDataFrame([(u, [1.0 + u, 0.0], 0.5) for u in range(3)], USERS)
    found = top_items.best_items(users, spark.createDataFrame(near + away, ITEMS), spark.createDataFrame([(1, 63)], RATED), 3, rows=8)
    from ratingloom.files import batches

    folder = folders[0].removeprefix("file://")
    gone = [name for name in os.listdir(folder) if min(next(batches(f"{folder}/{name}")).column(0)[0].as_py()) >= 100]
    assert len(gone) >= 8
    for name in gone:
        os.remove(f"{folder}/{name}")  # so that reading it would fail
    got = {u: [r["item_id"] for r in sorted(found.collect(), key=lambda r: r["rank"]) if r["user_id"] == u] for u in range(3)}
    assert got == {0: [63, 55, 47], 1: [55, 47, 39], 2: [63, 55, 47]}


def test_lists_are_counted_across_batches(spark):
    from ratingloom.operators import prep

    rows = [(k % 7 if k % 7 != 3 else None, [k % 5, 4] if k % 4 else None) for k in range(300)] + [(9, None)]
    plan = spark.createDataFrame(rows, "key long, ids array<int>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r["key"]: r["counts"] for r in prep.counted_lists(plan, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {k: [0.0] * 5 for k, _ in rows if k is not None}
    for k, ids in rows:
        for i in (ids or []) if k is not None else []:
            want[k][i] += 1
    assert got == want
