"""Predictions of the tag models and stemmed terms, held against plain computations over a whole folder."""

from collections import defaultdict

import numpy as np
import pytest

from ratingloom.functions import porter, text
from ratingloom.operators import models
from ratingloom.plans.oracles import _sql
from ratingloom.plans.queries import QUERIES
from ratingloom.sources import testdata

from .helpers import duck


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duck(sf_dir)
    get = lambda select, *needs: con.execute(_sql(select, *needs)).fetchall()
    tags, genres = defaultdict(dict), defaultdict(set)
    for item, tag, weight, n in get("SELECT item_id, tag, weight, n FROM item_tags", "item_tags"):
        tags[item][tag] = (weight, n)
    for item, genre in get("SELECT item_id, genre FROM item_genres", "item_genres"):
        genres[item].add(genre)
    train, test = (get(f"SELECT user_id, item_id, rating FROM {side}", side) for side in ("train", "test"))
    return train, test, dict(get("SELECT item_id, center FROM train_centers", "train_centers")), tags, genres


def by_user(rows):
    out = defaultdict(list)
    for u, i, r in rows:
        out[u].append((i, r))
    return out


def compared(found, want):
    got = {(r["user_id"], r["item_id"]): r["prediction"] for r in found.collect()}
    assert got.keys() == want.keys() and got
    for key, value in want.items():
        assert (got[key] is None) == (value is None), key
        assert value is None or np.isclose(got[key], value, atol=1e-6), key


def test_tag_count(spark, sf_dir, tables):
    train, test, centers, tags, genres = tables
    items_of = defaultdict(int)
    for own in genres.values():
        for g in own:
            items_of[g] += 1
    asked, want = by_user(test), {}
    for user, rated in by_user(train).items():
        liked_tags, liked_genres = defaultdict(float), defaultdict(float)
        for i, r in rated:
            if r != 3:
                for t, (w, n) in tags[i].items():
                    liked_tags[t] += (r - 3) * w / n
                for g in genres[i]:
                    liked_genres[g] += (r - 3) / items_of[g]
        dots = lambda i: (sum(liked_tags[t] * w for t, (w, _) in tags[i].items()), sum(liked_genres[g] for g in genres[i]))  # noqa: B023, E731
        rows = np.array([(*dots(i), 1.0) for i, _ in rated])
        y = np.array([r - centers[i] for i, r in rated])
        some = rows[:, 0] > 0.1
        first = np.linalg.lstsq(rows[some], y[some], rcond=None)[0] if some.sum() >= 3 else None
        second = np.linalg.lstsq(rows[:, 1:], y, rcond=None)[0] if len(rows) >= 2 else None
        for i, _ in asked[user]:
            x = np.array([*dots(i), 1.0])
            offset = x @ first if x[0] >= 1e-6 and first is not None else x[1:] @ second if second is not None else 0.0
            want[user, i] = centers[i] + offset if i in centers else None
    compared(QUERIES["tag_count_predict"](spark, sf_dir), want)


def test_tag_factors(spark, sf_dir, tables):
    train, test, centers, tags, genres = tables
    steps, asked, want = ((5, 10), (5, 20), (5, 40), (5, 80), (5, 160)), by_user(test), {}
    for user, rated in by_user(train).items():
        count = defaultdict(int)
        for i, _ in rated:
            for name in [("genre", g) for g in genres[i]] + [("tag", t) for t in tags[i]]:
                count[name] += 1
        left, k = len(rated), 0
        for factors, size in steps:  # two ratings pay for each of the first factors, then 4, 8 and so on
            k += min(left, size) // (size // factors)
            left = max(0, left - size)
        order = sorted(count, key=lambda f: (count[f], f[0] == "tag", f[1]), reverse=True)[:k]
        value = lambda i: [(tags[i].get(n, (0.0, 1))[0] / tags[i].get(n, (0.0, 1))[1] if kind == "tag" else float(n in genres[i])) for kind, n in order] + [1.0]  # noqa: B023, E731
        x, y = np.array([value(i) for i, _ in rated]), np.array([r - centers[i] for i, r in rated])
        coef = np.linalg.lstsq(x, y, rcond=1e-9)[0]
        for i, _ in asked[user]:
            want[user, i] = centers[i] + np.array(value(i)) @ coef if i in centers else None
    compared(QUERIES["tag_ls_predict"](spark, sf_dir), want)


def _stems(pairs):
    """Terms from a text's words (lower case, cleaned): stemmed, then kept unless empty or a stop word that cleaning made."""
    stop = lambda w: w in text.STOP_WORDS or (len(w) == 6 and w[0] + w[5] == "()" and w[1:5].isascii() and w[1:5].isdigit() and 1900 <= int(w[1:5]) <= 2300)
    stems = [(r, porter.stem(t)) for r, t in pairs]
    return [t for r, t in stems if t and not (len(t) < len(r) and stop(t))]


@pytest.fixture(scope="module")
def stemmed(spark, sf_dir):
    rows = testdata.titles(spark, sf_dir).select("item_id", text._paired(testdata.F.col("title")).alias("p")).collect()
    return {r["item_id"]: _stems([(x["r"], x["t"]) for x in r["p"]]) for r in rows}


def test_stemmed_terms(spark, sf_dir, stemmed):
    got = defaultdict(list)
    for r in QUERIES["title_tokens_stemmed"](spark, sf_dir).orderBy("item_id", "pos").collect():
        got[r["item_id"]].append(r["token"])
    assert got == {k: v for k, v in stemmed.items() if v}


def test_stemmed_search(spark, sf_dir, stemmed):
    n, where = defaultdict(int), defaultdict(set)
    for item, own in stemmed.items():
        for kind, terms in (("token", own), ("bigram", [f"{a} {b}" for a, b in zip(own, own[1:])])):
            for t in terms:
                n[kind, t] += 1
                where[kind, t].add(item)
    asked = [porter.stem(w) for w in ("inghe", "onth", "inghe")]
    score = defaultdict(float)
    for kind, terms, weight in (("token", asked, 1.0), ("bigram", [f"{a} {b}" for a, b in zip(asked, asked[1:])], 1.5)):
        for t in terms:
            for item in where[kind, t]:
                score[item] += weight / n[kind, t]
    want = sorted(((round(s, 9), i) for i, s in score.items()), reverse=True)[:100]
    got = [(round(r["score"], 9), r["item_id"]) for r in QUERIES["search_stemmed"](spark, sf_dir).collect()]
    assert sorted(s for s, _ in got) == sorted(s for s, _ in want) and len(set(got) & set(want)) >= len(want) - 2


def test_wide_rows_are_shuffled_by_no_other_key(spark, monkeypatch):
    """A rating's x holds 26 numbers: centers are joined before it is made."""
    seen, plain = [], models.least_squares
    monkeypatch.setattr(models, "least_squares", lambda design, *a: seen.append(design._jdf.queryExecution().executedPlan().toString()) or plain(design, *a))
    rows = spark.createDataFrame([(u, i, float(1 + (u * i) % 5)) for u in range(4) for i in range(6)], "user_id long, item_id long, rating double")
    tags = spark.createDataFrame([(1, "a", 1.0, 7)], "item_id long, tag string, weight double, n long")
    genres = spark.createDataFrame([(i, f"g{i % 2}") for i in range(6)], "item_id long, genre string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        models.TagLS.fit(rows, tags, genres)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert seen[0].index("AS x#") < seen[0].index("Exchange")
