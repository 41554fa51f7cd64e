import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.operators import models, prep, rating_blocks
from ratingloom.operators.least_squares import least_squares

RATINGS = "user_id long, item_id long, rating double"


def ratings(spark, seed=0, users=30, items=25, hot=0):
    rng = np.random.default_rng(seed)
    rows = [(u, 1000 - i, float(rng.integers(1, 11)) / 2) for u in range(users) for i in range(items) if rng.random() < 0.5]
    rows += [(777, 5000 + i, float(rng.integers(1, 11)) / 2) for i in range(hot)]
    return spark.createDataFrame(rows, RATINGS)


def factors(df, key, name):
    return {r[key]: np.array(r[name]) for r in df.collect()}


def by_joins(rows, items, k, rounds):
    """The same rounds with every factor joined to every rating."""
    for _ in range(rounds):
        by_user = rows.join(items, "item_id").select("user_id", F.concat("v", F.array(F.lit(1.0))).alias("x"), "y")
        users = least_squares(by_user, "user_id", k + 1).select("user_id", F.col("coef").alias("u"))
        by_item = rows.join(users, "user_id").select("item_id", F.slice("u", 1, k).alias("x"), (F.col("y") - F.get("u", F.lit(k))).alias("y"))
        items = least_squares(by_item, "item_id", k).select("item_id", F.col("coef").alias("v"))
    return users, items


@pytest.mark.parametrize(("block", "hot"), [(1 << 16, 0), (60, 0), (40, 300)])
def test_half_rounds_equal_joins(spark, block, hot):
    rows = ratings(spark, hot=hot).withColumnRenamed("rating", "y")
    k = 2
    of_users, of_items = rating_blocks.cut(rows, block)
    assert of_users.whole or block < 1 << 16
    draw = F.array(*(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0 for i in range(k)))
    first = rating_blocks.drawn(of_items, draw)
    # a key of several blocks is listed once for each, with the same factors
    want_users, want_items = by_joins(rows, first.select(F.col("id").alias("item_id"), F.col("f").alias("v")).distinct(), k, 2)
    items = first
    for _ in range(2):
        users = of_users.solved(items, k + 1, k, constant=True)
        items = of_items.solved(users, k, k, bias=k)
    for got, want, key, name in ((users, want_users, "user_id", "u"), (items, want_items, "item_id", "v")):
        got, want = factors(got, "id", "f"), factors(want, key, name)
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-6) for i in want)


def test_a_round_moves_factors_only(spark):
    of_users, of_items = rating_blocks.cut(ratings(spark).withColumnRenamed("rating", "y"), 100)
    plan = of_users.solved(rating_blocks.drawn(of_items, F.array(F.lit(1.0), F.lit(0.5))), 3, 2, constant=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "y#" not in plan and "Join" not in plan


def brute_core(rows, k):
    while True:
        users, items = {}, {}
        for u, i, _ in rows:
            users[u], items[i] = users.get(u, 0) + 1, items.get(i, 0) + 1
        left = [r for r in rows if users[r[0]] >= k + 1 and items[r[1]] >= k]
        if len(left) == len(rows):
            return rows
        rows = left


@pytest.mark.parametrize("limit", [200_000, 0])
def test_one_peel_gives_all_cores(spark, monkeypatch, limit):
    monkeypatch.setattr(prep, "BROADCAST", limit)
    rng = np.random.default_rng(3)
    rows = [(u, i, 1.0 + (u + i) % 5) for u in range(40) for i in range(30) if rng.random() < 0.05 + 0.9 * (u / 40) * (i / 30)]
    rows += [(100 + j, 200 + j // 2, 2.0) for j in range(12)] + [(1, 1, 3.0)] * 2  # a chain of leaves, repeated rows
    df = spark.createDataFrame([*rows, (None, 1, 1.0), (1, None, 1.0)], RATINGS)
    ks = (2, 5, 12, 40)
    key = lambda r: tuple(map(str, r))
    want = {k: sorted(map(key, brute_core(rows, k))) for k in ks}
    found = prep.cores(df, ks).collect()
    assert len(found) == len(rows) + 2
    for k in ks:
        assert sorted(key(r[:3]) for r in found if r["k"] >= k) == want[k]
    assert want[2] and not want[40]
    assert prep.cores(df.limit(0), ks).count() == 0


def test_als_over_blocks_and_a_given_core(spark):
    df = ratings(spark, 5)
    core = prep.kcore(df, 3)
    centers = prep.item_stats(df).select("item_id", "center")
    one, many = models.ALS.fit(df, 3), models.ALS.fit(core, 3, centers, core=False, block=50)
    a, b = factors(one.items, "item_id", "v"), factors(many.items, "item_id", "v")
    assert one.rounds == many.rounds and a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-6) for i in a)
    assert models.ALS.fit(df, 40).items.count() == 0


def test_factors_are_shipped_by_the_batch(spark):
    """What goes to a block from a batch is one row, however many factors it holds."""
    df = spark.createDataFrame([(i, [float(i), -float(i)], [b for b in range(4) if (i + b) % 3]) for i in range(500)], "id long, f array<double>, to array<long>").repartition(2)
    rows = df.mapInArrow(rating_blocks._packed, "block bigint, ids binary, f binary").collect()
    assert len(rows) <= 2 * 4
    for block in range(4):
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows if r["block"] == block])
        f = np.concatenate([np.frombuffer(r["f"], float).reshape(-1, 2) for r in rows if r["block"] == block])
        assert sorted(ids) == [i for i in range(500) if (i + block) % 3] and (f == np.stack([ids, -ids], axis=1)).all()


def test_systems_solved_by_inverse_equal_those_by_eigenvalues(monkeypatch):
    from ratingloom.operators import least_squares as ls

    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6, 4)) * rng.choice([1e-3, 1.0, 1e3], size=(40, 1, 4))
    x[::4, :, 1] = x[::4, :, 0] + 1e-9 * x[::4, :, 1]  # some all but lack a rank
    x[1::5, :, 2] = 0.0
    y = rng.normal(size=(40, 6))
    gram, right = np.einsum("kni,knj->kij", x, x), np.einsum("kni,kn->ki", x, y)
    got = ls.solve(gram, right)
    monkeypatch.setattr(ls, "SOUND", 0.0)
    want = ls.solve(gram, right)
    assert np.allclose(got, want, rtol=1e-6, atol=0) and (got[1::5, 2] == 0).all()
    assert not (got[2::4] == want[2::4]).all()  # the others took the other way


def test_what_is_cut_leaves_blocks_only(spark, monkeypatch):
    """Ratings that were written on the way to the blocks are deleted, and the jobs' shuffles are dropped."""
    import os

    folders, dropped, plain = [], [], rating_blocks.written
    monkeypatch.setattr(rating_blocks, "written", lambda df, kind: folders.append((kind, (found := plain(df, kind))[1])) or found)
    monkeypatch.setattr(rating_blocks, "collected", dropped.append)
    sides = rating_blocks.cut(ratings(spark).withColumnRenamed("rating", "y"), 20)
    of = [folder.removeprefix("file://").removeprefix("file:") for kind, folder in folders if kind == "ratings"]
    assert len(of) == 2 and not any(map(os.path.exists, of)) and len(dropped) == 2
    assert all(side.keys.count() for side in sides)
