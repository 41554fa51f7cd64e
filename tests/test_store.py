import datetime
import os

import pytest

from ratingloom.operators import serving
from ratingloom.sources.store import Conflict, Store

SCHEMA = "user_id long, attrib string, value string"


def rows(df):
    return sorted((r["user_id"], r["attrib"], r["value"]) for r in df.collect())


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_put_get_delete(spark, tmp_path):
    path = f"file://{tmp_path}/kv"
    store = Store.create(spark, path, SCHEMA, ("user_id", "attrib"), buckets=8)
    assert store.read().count() == 0 and store.get(1, "a").count() == 0
    df = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    store.put(df((1, "a", "x"), (1, "b", "y"), (2, "a", None), (None, "a", "n")))
    store.put(df((1, "a", "z"), (3, "c", "w")))
    store.delete(df((1, "b", None), (9, "q", None)))
    want = [(1, "a", "z"), (2, "a", None), (3, "c", "w"), (None, "a", "n")]
    assert rows(store.read().where("user_id is not null")) == want[:3] and rows(store.get(None, "a")) == want[3:]
    assert rows(store.get(1, "a")) == want[:1] and rows(store.get(1, "b")) == []
    store.put(df((1, "b", "back")))
    again = Store.open(spark, path)
    assert rows(again.get(1, "b")) == [(1, "b", "back")] and again.keys == ("user_id", "attrib")
    assert rows(store.read(1).where("user_id = 1")) == [(1, "a", "x"), (1, "b", "y")]  # an earlier version
    with pytest.raises(Exception):
        Store.create(spark, path, SCHEMA, ("user_id",))


def test_a_batch_costs_what_it_holds_and_a_read_opens_one_bucket(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/kv", SCHEMA, ("user_id", "attrib"), buckets=16)
    store.put(spark.range(20_000).selectExpr("id AS user_id", "'a' AS attrib", "sha2(cast(id AS string), 256) AS value"))
    before = size(tmp_path)
    store.put(spark.createDataFrame([(7, "a", "new")], SCHEMA))
    assert size(tmp_path) - before < before / 50
    assert rows(store.get(7, "a")) == [(7, "a", "new")]
    opened = store.files(7, "a")
    assert len(opened) == 2 and len({f.rsplit("=", 1)[1] for f in opened}) == 1
    read = [f.replace("file:///", "/") for f in store.get(7, "a").inputFiles()]
    folders = [f.removeprefix("file://") for f in opened]
    assert read and all(any(f.startswith(folder + "/") for folder in folders) for f in read)
    assert sum(map(size, folders)) < before / 8


def test_compaction_rewrites_the_buckets_that_need_it(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/kv", SCHEMA, ("user_id", "attrib"), buckets=4)
    base = spark.range(100).selectExpr("id AS user_id", "'a' AS attrib", "'old' AS value")
    store.put(base)
    store.put(spark.createDataFrame([(5, "a", "new")], SCHEMA))
    store.delete(spark.createDataFrame([(5, "a", None), (6, "a", None)], SCHEMA))
    want, untouched = rows(store.read()), [b for b in range(100) if len(store.files(b, "a")) == 1][0]
    file = store.files(untouched, "a")
    store.compact()
    assert rows(store.read()) == want and len(want) == 98
    assert store.files(untouched, "a") == file and len(store.files(5, "a")) <= 1
    version = store.compact()
    assert store.compact() == version  # nothing to do


def test_many_small_batches_are_compacted_on_the_way(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("ratingloom.sources.store.DELTAS", 2)
    store = Store.create(spark, f"file://{tmp_path}/kv", SCHEMA, ("user_id", "attrib"), buckets=2)
    for k in range(5):
        store.put(spark.createDataFrame([(1, "a", str(k)), (k, "b", "x")], SCHEMA))
    assert rows(store.get(1, "a")) == [(1, "a", "4")] and store.read().count() == 6 and len(store.files(1, "a")) <= 3


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store.create(spark, f"file://{tmp_path}/kv", SCHEMA, ("user_id", "attrib"), buckets=2)
    store.put(spark.createDataFrame([(1, "a", "x")], SCHEMA))
    plain = Store._swap

    def crash(self, manifest):
        raise RuntimeError("crash")

    monkeypatch.setattr(Store, "_swap", crash)
    for change in (lambda: store.put(spark.createDataFrame([(1, "a", "y")], SCHEMA)), lambda: store.delete(spark.createDataFrame([(1, "a", None)], SCHEMA)), lambda: store.compact(0)):
        with pytest.raises(RuntimeError):
            change()
        assert rows(Store.open(spark, store.path).read()) == [(1, "a", "x")]
    monkeypatch.setattr(Store, "_swap", plain)
    store.put(spark.createDataFrame([(1, "a", "z")], SCHEMA))
    assert rows(store.read()) == [(1, "a", "z")]
    with pytest.raises(Conflict):  # of two writers of one version the second is told
        store._swap({"version": 2, "parts": {}})


def test_recommendations_are_kept_refreshed_and_rotate(spark, tmp_path):
    t, calls = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s), []

    def compute(users, algorithm):
        asked = sorted(r["user_id"] for r in users.collect())
        calls.append((algorithm, asked))
        return spark.createDataFrame([(u, 100 + i, i, 1.0 / i) for u in asked if u != 13 for i in range(1, 11)], "user_id long, item_id long, rank int, score double")

    path = f"file://{tmp_path}/recs"
    kept = serving.Recommendations.create(spark, path, compute, buckets=4)
    get = lambda changed, now: sorted(r["rank"] for r in kept.get(7, "als3", changed, now).collect())
    assert [get(t(1), t(2)) for _ in range(3)] == [[1, 5, 9], [2, 6, 10], [3, 7]] and len(calls) == 1
    kept = serving.Recommendations.open(spark, path, compute)  # a restart doesn't lose the turn
    assert [get(t(1), t(2)) for _ in range(2)] == [[4, 8], [1, 5, 9]] and len(calls) == 1
    assert get(t(2), t(3)) == [1, 5, 9] and len(calls) == 2  # a change at the same time makes it stale
    assert get(None, t(4)) == [2, 6, 10] and len(calls) == 2
    calls.clear()
    changed = spark.createDataFrame([(7, t(3)), (8, t(1)), (9, t(1)), (13, t(1))], "user_id long, changed timestamp")
    kept.refresh(changed, ("als3", "tag_ls"), t(5))
    assert calls == [("als3", [7, 8, 9, 13]), ("tag_ls", [7, 8, 9, 13])]
    calls.clear()
    kept.refresh(changed.where("user_id <> 8").unionByName(spark.createDataFrame([(8, t(6))], changed.schema)), ("als3", "tag_ls"), t(7))
    assert calls == [("als3", [8, 13]), ("tag_ls", [8, 13])]  # 13 never got any
    assert kept.get(13, "als3", None, t(8)).count() == 0
