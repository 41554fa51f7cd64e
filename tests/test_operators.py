import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.functions import numeric
from ratingloom.operators import agreement, linalg, models, prep, serving, similar
from ratingloom.operators import least_squares as least_squares_module
from ratingloom.operators.least_squares import least_squares
from ratingloom.sources import readers

RATINGS = "user_id long, item_id long, rating double"


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def test_medians(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (2, 1, 4.0), (1, 2, 1.0), (2, 2, 5.0), (3, 2, 5.0)], RATINGS)
    assert {r["item_id"]: (r["center"], r["n"]) for r in prep.item_stats(df).collect()} == {1: (3.5, 2), 2: (5.0, 3)}
    assert prep.item_stats(df, "mean").where("item_id = 2").first()["center"] == pytest.approx(11 / 3)


def test_weights_and_numbers_of_factors(spark):
    assert [round(one(spark, numeric.tag_weight(F.lit(n))), 6) for n in (1, 2, 6)] == [1.0, 1.693147, 2.791759]
    assert [one(spark, numeric.num_factors(F.lit(n))) for n in (1, 3, 10, 11, 14, 30, 31, 70, 150, 310, 1000)] == [0, 1, 5, 5, 6, 10, 10, 15, 20, 25, 25]


def test_boost_and_overlap(spark):
    got = [round(one(spark, numeric.common_boost(F.lit(1.0), F.lit(n), 162, 0.216)) - 1, 6) for n in (3, 10, 83, 162, 500)]
    assert got == [0, 0.010559, 0.114497, 0.216, 0.216]
    sets = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert [one(spark, numeric.genre_overlap(sets(*a), sets(*b))) for a, b in (("ab", "bcd"), ("a", "b"), ("", "a"))] == [True, False, False]
    assert one(spark, numeric.genre_overlap(F.lit(None).cast("array<string>"), sets("a"))) is False


def test_cosine_of_common_raters(spark):
    rows = [(u, i, r) for u, (a, b) in enumerate(((5.0, 3.0), (4.0, 4.0), (3.0, 5.0))) for i, r in ((1, a), (2, b))] + [(9, 1, 2.0), (9, 3, 2.0)]
    found = similar.co_rated(spark.createDataFrame(rows, RATINGS)).collect()
    assert [(r["a"], r["b"], r["n_common"], round(r["cos"], 6)) for r in found] == [(1, 2, 3, 0.92)]


@pytest.mark.parametrize("tile", [1, 7, 4096])
def test_pairs_by_tiles_equal_a_plain_count(spark, tile):
    draw = random.Random(3)
    rows = [(u, i, float(draw.randint(1, 5))) for u, n in ((1, 60), (2, 25), (3, 8), (4, 1), (5, 40)) for i in draw.sample(range(-20, 60), n)]
    rows += [(2, 3, 4.0), (2, 3, 4.0), (None, 3, 1.0), (None, 4, 1.0), (6, None, 2.0), (6, 5, 2.0)]
    genres = [(i, g) for i in range(-20, 60) for g in draw.sample("abcdef", draw.randint(1, 4))]
    sets = {i: {g for j, g in genres if j == i} for i, _ in genres}
    for with_genres in (False, True):
        sums = {}
        for (u, a, ra), (v, b, rb) in itertools.product(rows, rows):
            if None not in (u, v, a, b) and u == v and a < b and (not with_genres or 2 * len(sets[a] & sets[b]) >= min(len(sets[a]), len(sets[b]))):
                n, ab, aa, bb = sums.get((a, b), (0, 0, 0, 0))
                sums[a, b] = (n + 1, ab + ra * rb, aa + ra * ra, bb + rb * rb)
        want = {k: (n, pytest.approx(ab / (aa * bb) ** 0.5)) for k, (n, ab, aa, bb) in sums.items() if n >= 2}
        found = similar.co_rated(spark.createDataFrame(rows, RATINGS), 2, spark.createDataFrame(genres, "item_id bigint, genre string") if with_genres else None, tile).collect()
        assert len(found) == len(want) and {(r["a"], r["b"]): (r["n_common"], r["cos"]) for r in found} == want
    assert similar.co_rated(spark.createDataFrame([], RATINGS), tile=tile).count() == 0


def test_split_of_users_with_many_ratings(spark):
    rows = [(u, i, float((u * i) % 5), i) for u, n in ((1, 300), (2, 20), (3, 40), (4, 6)) for i in range(n)] + [(None, i, float(i % 5), i) for i in range(60)]
    rows += [(5, i, 3.0, i) for i in range(50)] + [(6, i, 4.0 if i == 7 else 3.0, i) for i in range(45)] + [(1, 3, 2.0, 0)] * 2
    ratings = spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double, at bigint")
    for varied in (True, False):
        whole, blocks = (prep.split(ratings, varied=varied, block=b) for b in (1_000_000, 16))
        assert blocks.columns == whole.columns
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(key, blocks.drop("at").collect())) == sorted(map(key, whole.drop("at").collect()))
    assert prep.split(ratings.limit(0), block=16).count() == 0


def test_split(spark):
    rows = [(1, i, 1.0 + i % 5) for i in range(11)] + [(2, i, 1.0 + i % 5) for i in range(12)] + [(3, i, 3.0) for i in range(30)]
    got = prep.split(spark.createDataFrame(rows, RATINGS)).groupBy("user_id", "split").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(2, "train"): 9, (2, "test"): 3}


def test_kcore(spark):
    rows = [(1, i, 1.0) for i in "123"] + [(2, i, 1.0) for i in "123"] + [(3, i, 1.0) for i in "124"]
    df = spark.createDataFrame([(u, int(i), r) for u, i, r in rows], RATINGS)
    assert sorted((r["user_id"], r["item_id"]) for r in prep.kcore(df, 2).collect()) == [(u, i) for u in (1, 2) for i in (1, 2, 3)]
    assert prep.kcore(df, 5).count() == 0 and prep.kcore(df.limit(0), 2).count() == 0


def test_rank_agreement(spark):
    schema = "user_id long, item_id long, rating double, prediction double"
    rows = [(1, 1, 5.0, 4.0), (1, 2, 3.0, 4.0), (1, 3, 3.0, 2.0), (1, 4, 1.0, 3.0), (2, 1, 4.0, 1.0), (2, 2, 4.0, 2.0), (3, 1, 5.0, None), (3, 2, 1.0, 1.0)]
    got = agreement.rank_agreement(spark.createDataFrame(rows, schema)).collect()
    assert [(r["user_id"], r["agreement"], r["pairs"]) for r in got] == [(1, 0.6, 5)]
    assert agreement.summarize(spark.createDataFrame([], "user_id long, agreement double")).first()["users"] == 0


def test_least_squares_equals_numpy(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for key, n in ((1, 50), (2, 4), (3, 1), (4, 30)):
        x, y = rng.normal(size=(n, 3)), rng.normal(size=n)
        if key == 4:
            x[:, 2] = x[:, 0]  # not of full rank: the shortest solution counts
        rows += [(key, r.tolist(), float(v)) for r, v in zip(x, y)]
        want[key] = np.linalg.lstsq(x, y, rcond=None)[0]
    got = least_squares(spark.createDataFrame([*rows, (None, [1.0] * 3, 1.0)], "k long, x array<double>, y double").repartition(5), "k", 3)
    for r in got.collect():
        assert np.allclose(r["coef"], want.pop(r["k"]), atol=1e-6)
    assert not want


def test_least_squares_of_odd_designs(spark):
    """A key with most of the rows, columns of very different size, collinear and empty columns: as numpy has it."""
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for key, n in ((1, 30_000), (2, 40), (3, 40), (4, 12), (5, 3)):
        x = rng.normal(size=(n, 6))
        x[:, 1] *= 1e-7 if key < 3 else 1e-4
        x[:, 5] = 0
        if key == 3:  # collinear columns besides
            x[:, 2] = 2 * x[:, 0]
        if key == 4:
            x[:, 1] = x[:, 3] * (rng.random() + 0.5)
        y = x @ rng.normal(size=6) + rng.normal(size=n)
        rows += [(key, r.tolist(), float(v)) for r, v in zip(x, y)]
        want[key] = (np.linalg.lstsq(x, y, rcond=None)[0], n, x, y)
    got = least_squares(spark.createDataFrame(rows, "k long, x array<double>, y double").repartition(3), "k", 6).collect()
    assert len(got) == 5
    for r in got:
        coef, n, x, y = want[r["k"]]
        assert r["n"] == n
        if r["k"] != 5:  # fewer rows than columns and very different sizes: only the fit is told apart
            assert np.allclose(r["coef"], coef, rtol=1e-4, atol=1e-6), r["k"]
        assert np.isclose(((y - x @ np.array(r["coef"])) ** 2).sum(), ((y - x @ coef) ** 2).sum(), rtol=1e-6, atol=1e-6)
        assert np.isclose(r["sse"], ((y - x @ coef) ** 2).sum(), rtol=1e-6, atol=1e-6)


def test_sums_are_sent_only_in_place_of_more_numbers():
    upper = np.triu_indices(4)
    keys, values = least_squares_module._sent(np.array([5, 1, 5, 5, 2, 5]), np.arange(24.0).reshape(6, 4), upper)
    assert keys.tolist() == [1, 2, 5] and [len(v) for v in values] == [4, 4, 11] and values[-1][-1] == 4


def test_als_recovers_what_made_the_ratings(spark):
    """With noise of 0.1, held-out ratings are told to 0.15 on the average, also by users that are folded in."""
    rng = np.random.default_rng(0)
    users, items = rng.uniform(-2, 2, (80, 3)), rng.uniform(-2, 2, (90, 3))
    rows = [(u, i, float(users[u] @ items[i] + rng.normal(0, 0.1))) for u in range(80) for i in range(90)]
    held = {(u, i) for u, i, _ in rows if rng.random() < 0.2}
    train = spark.createDataFrame([r for r in rows if r[:2] not in held], RATINGS)
    test = spark.createDataFrame([r for r in rows if r[:2] in held], RATINGS)
    zero = train.select("item_id").distinct().withColumn("center", F.lit(0.0))
    model = models.ALS.fit(train, 3, centers=zero, core=False, max_rounds=12, gain=0.001)
    assert agreement.mean_error(model.transform(test)).first()["mae"] < 0.15
    folded = model.fold_in(train.where("user_id < 5"), center=True)
    assert agreement.mean_error(folded.transform(test.where("user_id < 5"))).first()["mae"] < 0.15


def test_tag_models_fall_back_to_the_median(spark):
    ratings = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 1, 5.0)], RATINGS)
    tags = spark.createDataFrame([], "item_id long, tag string, weight double, n long")
    genres = spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, genre string")
    pairs = spark.createDataFrame([(1, 1), (3, 1), (1, 99)], "user_id long, item_id long")
    for kind in (models.TagCount, models.TagLS):
        got = {(r["user_id"], r["item_id"]): r["prediction"] for r in kind.fit(ratings, tags, genres).transform(pairs).collect()}
        assert got[1, 1] is not None and got[1, 99] is None
    assert models.TagCount.fit(ratings, tags, genres).transform(pairs).where("user_id = 3").first()["prediction"] == 4.5


def test_conjugate_gradients(spark):
    rng = np.random.default_rng(4)
    a, x = rng.normal(size=(30, 5)), rng.normal(size=5)
    matrix = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(30) for j in range(5)], "i long, j long, v double")
    b = spark.createDataFrame([(i, float(v)) for i, v in enumerate(a @ x)], "i long, v double")
    got, rounds, rr = linalg.cg_least_squares(matrix, b)
    assert rounds <= 10 and rr < 1e-4
    assert np.allclose([r["v"] for r in got.orderBy("i").collect()], x, atol=1e-3)


def test_vectors(spark):
    x = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, v double")
    assert linalg.dot(x, x) == 5.0 and linalg.dot(x, x.limit(0)) == 0.0
    assert linalg.scale(3, x).where("i = 1").first()["v"] == 6.0
    for kind in ("uniform", "normal"):
        assert linalg.filled(spark, 50, kind, -1.0, 1.0).count() == 50


def test_live_ratings_and_staleness(spark):
    t = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, t(1), 7, 1, 4.0), (2, t(2), 7, 1, 2.0), (3, t(3), 7, 1, None), (4, t(1), 7, 2, 5.0), (5, t(1), 7, 2, 3.0)]
    events = spark.createDataFrame(rows, "event_id long, event_time timestamp, user_id long, item_id long, rating double")
    assert [(r["item_id"], r["rating"]) for r in serving.live_ratings(events).collect()] == [(2, 3.0)]
    computed = spark.createDataFrame([(7, "als3", t(3)), (7, "tag_ls", t(4))], "user_id long, algorithm string, computed timestamp")
    assert [r["algorithm"] for r in serving.stale(computed, serving.ratings_changed(events)).collect()] == ["als3"]


def test_rotation_and_rated_order(spark):
    ranked = spark.createDataFrame([(i, i) for i in range(1, 9)], "item_id long, rank int")
    assert [[r["item_id"] for r in serving.rotation(ranked, t).collect()] for t in (0, 1, 4)] == [[1, 5], [2, 6], [1, 5]]
    titles = spark.createDataFrame([(1, "B"), (2, "A"), (3, "C")], "item_id long, title string")
    own = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 3, 3.0)], RATINGS)
    assert [r["title"] for r in serving.rated(own, titles, 1).collect()] == ["A", "B", "C"]


def test_recommend_checks_its_requests(spark):
    own = spark.createDataFrame([(1, 1, 5.0)], RATINGS)
    engine = serving.Engine(own, own, own, own, own, own)
    for user, algorithm in ((2, "tag_ls"), (1, "als3"), (1, "nonsense")):
        with pytest.raises(ValueError):
            engine.recommend(user, algorithm)


def test_readers(spark, tmp_path):
    (tmp_path / "items.csv").write_text('id,title,genres\n1,"Odd, ""quoted"" one (1990)",Drama|Comedy\n2,Plain,(no genres listed)\n', encoding="utf-8")
    (tmp_path / "ratings.csv").write_text("u,i,r,t\n1,2,4.5,99\n1,2,4.0,100\n1,2,3.0,100\n1,3,2.0,\n1,2,5.0,\n")
    (tmp_path / "tags.csv").write_text("u,i,tag,t\n1,2,Sad Film,9\n")
    (tmp_path / "links.csv").write_text("i,imdb,tmdb\n1,0114709,862\n2,,\n")
    items = readers.read_items(spark, str(tmp_path / "items.csv"))
    assert items.where("item_id = 1").first()["title"] == 'Odd, "quoted" one (1990)'
    assert sorted(tuple(r) for r in readers.item_genres(items).collect()) == [(1, "comedy"), (1, "drama")]
    assert readers.read_ratings(spark, str(tmp_path / "ratings.csv")).count() == 5
    assert sorted(tuple(r) for r in readers.read_ratings(spark, str(tmp_path / "ratings.csv"), last_only=True).collect()) == [(1, 2, 4.0), (1, 3, 2.0)]
    assert readers.read_tags(spark, str(tmp_path / "tags.csv")).first()["tag"] == "sad film"
    assert [tuple(r) for r in readers.read_links(spark, str(tmp_path / "links.csv")).orderBy("item_id").collect()] == [(1, "0114709", "862"), (2, None, None)]


def test_kept_tables_are_computed_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for overwrite in (False, False, True):
        assert readers.kept(spark, f"{tmp_path}/t", compute, overwrite).count() == 3
    assert len(calls) == 2


def test_kept_tables_know_what_they_were_made_of(spark, tmp_path):
    calls, source = [], f"{tmp_path}/in"

    def get(**parameters):
        def compute():
            calls.append(parameters)
            return spark.read.parquet(source)

        return readers.kept(spark, f"{tmp_path}/t", compute, inputs=(source,), parameters=parameters).count()

    spark.range(3).write.parquet(source)
    assert [get(k=1), get(k=1)] == [3, 3] and len(calls) == 1
    assert get(k=2) == 3 and len(calls) == 2  # another parameter
    spark.range(2).write.mode("append").parquet(source)
    assert [get(k=2), get(k=2)] == [5, 5] and len(calls) == 3  # another file
    (tmp_path / "t" / "_inputs.json").unlink()
    assert get(k=2) == 5 and len(calls) == 4  # stopped before the note was written


def test_numbers_follow_first_appearance(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "tag string, at long")
    assert {r["tag"]: r["id"] for r in prep.numbered(df, "tag", "at").collect()} == {"b": 0, "a": 1}
    many = spark.range(5000).selectExpr("id % 1000 AS v", "id % 7 AS at").repartition(6)
    order = sorted(range(1000), key=lambda v: (min((v + 1000 * k) % 7 for k in range(5)), v))
    assert {r["v"]: r["id"] for r in prep.numbered(many, "v", "at").collect()} == {v: i for i, v in enumerate(order)}
    assert prep.numbered(many.limit(0), "v", "at").count() == 0


@pytest.mark.parametrize(("seed", "id2", "top_n"), [(2, 3, 1), (2, 5, 2), (3, 1, 1), (4, 4, 5)])
def test_tune_equals_brute_force(spark, seed, id2, top_n):
    rng = np.random.default_rng(seed)
    rows = [(u, i, float(rng.integers(1, 6))) for u in range(40) for i in range(6) if rng.random() < 0.4 + 0.1 * i]
    rating, expected = {(u, i): r for u, i, r in rows}, 2
    pairs = {}
    for i in range(1, 6):
        both = [(rating[u, 0], rating[u, i]) for u in range(40) if (u, 0) in rating and (u, i) in rating]
        a, b = np.array(both).T
        pairs[i] = (len(both), a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    point, limit = pairs[id2][0], 0.0
    boosted = lambda i: pairs[i][1] * (1 + min(max(math.log(3 + (3 * math.exp(limit) - 3) * (pairs[i][0] - 3) / (point - 3)) - math.log(3), 0), limit))
    while limit < 2:
        best = sorted((-boosted(i), -pairs[i][0], i) for i in pairs)[: 2 * expected]
        if id2 in [i for _, _, i in best[:top_n]]:
            break
        limit = limit * -best[0][0] / (pairs[id2][1] * (1 + limit)) + 0.01
    genres = spark.createDataFrame([(i, "g") for i in range(6)], "item_id long, genre string")
    found = similar.tune(spark.createDataFrame(rows, RATINGS), genres, 0, id2, top_n, expected)
    assert found[0] == point and found[1] == pytest.approx(limit, abs=1e-9)
    with pytest.raises(ValueError):
        similar.tune(spark.createDataFrame(rows, RATINGS), genres, 0, 77, 1)


@pytest.mark.parametrize("block", [1_000_000, 20, 3])
def test_rank_agreement_equals_all_pairs(spark, block):
    """Users of more than block different counts are cut into ranges of predictions, with the same result."""
    rng = np.random.default_rng(3)
    predicted = lambda u: float(rng.integers(0, 8)) if u % 2 else float(rng.normal())
    rows = [(u, i, float(rng.integers(1, 11)) / 2, None if rng.random() < 0.1 else predicted(u)) for u in range(12) for i in range(rng.integers(0, 60))]
    want = {}
    for u, _, ra, pa in rows:
        for v, _, rb, pb in rows:
            if u == v and pa is not None and pb is not None and ra > rb:
                want.setdefault(u, []).append(pa > pb)
    got = agreement.rank_agreement(spark.createDataFrame(rows, "user_id long, item_id long, rating double, prediction double"), block=block).collect()
    assert {r["user_id"]: (r["pairs"], round(r["agreement"], 9)) for r in got} == {u: (len(v), round(sum(v) / len(v), 9)) for u, v in want.items()}


def test_research_variants(spark):
    schema = "user_id long, item_id long, rating double, prediction double"
    level = spark.createDataFrame([(1, 1, 4.0, 1.0), (1, 2, 4.0, 2.0), (2, 1, 4.0, 2.0)], schema)
    assert [tuple(r) for r in agreement.rank_agreement(level, single_level=True).collect()] == [(1, 1.0, 0)]
    flat = spark.createDataFrame([(3, i, 3.0) for i in range(30)], RATINGS)
    assert prep.split(flat, attempts=1, varied=False).where("split = 'test'").count() == 6
    ratings = spark.createDataFrame([(1, i, 1.0 + i % 5) for i in range(10)], RATINGS)
    genres = spark.createDataFrame([(i, f"g{i % 3}") for i in range(10)], "item_id long, genre string")
    tags = spark.createDataFrame([(i, f"t{i % 2}", 1.0, 5) for i in range(10)], "item_id long, tag string, weight double, n long")
    assert models.factor_profile(ratings, tags, genres, less=1).count() == models.factor_profile(ratings, tags, genres).count() - (5 == models.factor_profile(ratings, tags, genres).count())
    research = models.TagCount.fit(ratings, tags, genres, variant="research").factors.first()
    assert research["x1"] is not None


def test_levels_and_mismatches(spark):
    ratings = spark.createDataFrame([(1, 1, 4.0), (1, 2, 4.0), (1, 3, 2.0)], RATINGS)
    assert sorted((r["item_id"], r["rating"], r["level"]) for r in prep.rating_levels(ratings).collect()) == [(1, 4.0, 1), (2, 4.0, 1), (3, 2.0, 2)]
    assert {r["item_id"]: r["ratings"] for r in prep.item_ratings(ratings.where("item_id < 3")).collect()} == {1: {1: 4.0}, 2: {1: 4.0}}
    assert tuple(agreement.spread(ratings, "rating").first()) == (2.0, 4.0, 10 / 3, 3)
    titles = spark.createDataFrame([(1, "A"), (2, "B")], "item_id long, title string")
    expected = spark.createDataFrame([(1, "A"), (2, "X"), (3, "C")], "item_id long, title string")
    assert sorted(r["item_id"] for r in prep.mismatches(titles, expected).collect()) == [2, 3]


def test_synthetic_ratings_and_json(spark):
    rows = readers.synthetic_ratings(spark, 30, 20, noise=0.0)
    assert rows.count() == 600
    matrix = np.zeros((30, 20))
    for r in rows.collect():
        matrix[r["user_id"], r["item_id"]] = r["rating"]
    assert np.linalg.matrix_rank(matrix, tol=1e-6) == 3
    df = spark.createDataFrame([(1, None)], "movie_id long, title string")
    assert serving.as_json(df).first()["value"] == '{"movie_id":1,"title":null}'


def test_ratings_are_given_and_taken_back(spark):
    t = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, 0, s)
    live = spark.createDataFrame([(7, 1, 4.0, t(1)), (8, 1, 3.0, t(1))], "user_id long, item_id long, rating double, event_time timestamp")
    rows = lambda df: sorted((r["user_id"], r["item_id"], r["rating"]) for r in df.collect())
    assert rows(serving.rate(live, 7, 1, 2, t(2))) == [(7, 1, 2.0), (8, 1, 3.0)]
    assert rows(serving.rate(live, 7, 2, 5, t(2))) == [(7, 1, 4.0), (7, 2, 5.0), (8, 1, 3.0)]
    assert rows(serving.rate(live, 7, 1, None, t(2))) == [(8, 1, 3.0)] and rows(serving.rate(live, 9, 9, None, t(2))) == rows(live)


def test_pairs_made_in_passes_are_the_same(spark, monkeypatch):
    """More pairs than are made at once: those of some first items at a time."""
    rng = np.random.default_rng(8)
    rows = [(u, i, float(rng.integers(1, 11)) / 2) for u in range(25) for i in range(18) if rng.random() < 0.6] + [(None, 1, 1.0), (1, None, 1.0)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    want = sorted(map(tuple, similar.co_rated(df, tile=12).collect()))
    passes, plain = [], similar.written
    monkeypatch.setattr(similar, "written", lambda df, kind: passes.append(kind) or plain(df, kind))
    monkeypatch.setattr(similar, "PAIRS", 300)
    got = sorted(map(tuple, similar.co_rated(df, tile=12).collect()))
    assert passes.count("pairs") > 2 and got == want and len(want) > 100
