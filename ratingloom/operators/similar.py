"""Items that the same users rate alike."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import common_boost, cosine, genre_overlap
from ..session import collected, saved, written


#: Items of a user that meet each other under one key; the square of it bounds the pairs of a key.
TILE = 4096
#: Pairs of a user's items that are made and summed up at once; more of them are made in several passes.
PAIRS = 1 << 28


def _met(rows: DataFrame, tile: int) -> DataFrame:
    """(a, b, ra, rb, and ga, gb if rows have g): each two rows of a user with different items, once, a < b.

    Users of up to ``tile`` items meet by a plain join. The items of others, who are looked for first, are dealt by
    hash into tiles of about that size; a tile meets itself and the later ones, each meeting under a key of its
    own, so that a user of very many items becomes many keys of bounded work.
    """
    values = [c for c in rows.columns if c not in ("user_id", "item_id")]
    short = {"rating": "r"}

    def side(of: DataFrame, s: str, *keys: Column) -> DataFrame:
        return of.select("user_id", *keys, F.col("item_id").alias(s), *(F.col(c).alias(short.get(c, c) + s) for c in values))

    sizes = rows.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    hot = saved(sizes.select("user_id", F.ceil(F.col("n") / tile).cast("int").alias("parts")))
    if hot.isEmpty():
        return side(rows, "a").join(side(rows, "b"), "user_id").where("a < b").drop("user_id")
    others = rows.join(hot, "user_id", "left_anti")
    part = F.pmod(F.xxhash64("item_id"), F.col("parts").cast("bigint")).cast("int")
    dealt = rows.join(hot, "user_id").withColumn("part", part)
    first = side(dealt, "a", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"))
    second = side(dealt, "b", F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"))
    met = first.join(second, ["user_id", "i", "j"]).where("i < j or a < b")
    names = ["", *(short.get(c, c) for c in values)]
    turned = [F.when(F.col("a") < F.col("b"), F.col(n + s)).otherwise(F.col(n + t)).alias(n + s) for n in names for s, t in ("ab", "ba")]
    plain = side(others, "a").join(side(others, "b"), "user_id").where("a < b").drop("user_id")
    return plain.unionByName(met.select(*turned))


def co_rated(ratings: DataFrame, min_common: int = 3, item_genres: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """(a, b, n_common, cos), a < b: items with at least min_common raters in common and the cosine of those ratings.

    With item_genres (item_id, genre), only items that share half of the smaller set of genres meet, and
    the test is made before pairs are counted. The items of a user of more than ``tile`` are cut into tiles, which
    meet each other once; pairs are summed up before they are shuffled. Rows with null users or items meet none.
    Pairs are counted first: of more than PAIRS, those of some first items at a time are made and summed up, and
    what a pass shuffles is dropped before the next.
    """
    rows = ratings.select("user_id", "item_id", "rating").where("user_id is not null and item_id is not null")
    if item_genres is not None:
        sets = item_genres.groupBy("item_id").agg(F.sort_array(F.collect_set("genre")).alias("g"))
        rows = rows.join(sets, "item_id")
    rows = written(rows, "co-rated")[0]
    n = F.count("*").cast("double")
    made = rows.groupBy("user_id").agg((n * (n - 1) / 2).alias("n")).agg(F.sum("n")).first()[0] or 0.0
    passes, pairs = max(1, math.ceil(made / PAIRS)), _met(rows, tile)
    if item_genres is not None:
        pairs = pairs.where(genre_overlap(F.col("ga"), F.col("gb")))

    def summed(pairs: DataFrame) -> DataFrame:
        sums = pairs.groupBy("a", "b").agg(F.count("*").alias("n_common"), F.sum(F.col("ra") * F.col("rb")).alias("ab"), F.sum(F.col("ra") * F.col("ra")).alias("aa"), F.sum(F.col("rb") * F.col("rb")).alias("bb"))
        return sums.where(F.col("n_common") >= min_common).select("a", "b", "n_common", cosine(F.col("ab"), F.col("aa"), F.col("bb")).alias("cos"))

    if passes == 1:
        return summed(pairs)
    found = []
    for k in range(passes):
        found.append(written(summed(pairs.where(F.pmod(F.xxhash64("a"), F.lit(passes)) == k)), "pairs")[0])
        collected(rows.sparkSession)
    return reduce(DataFrame.unionByName, found)


def similar(ratings: DataFrame, item_genres: DataFrame, top: int = 20, pool: int = 20, limit: float = 0.05, point: float = 100, min_common: int = 3, threshold: float = 0.3) -> DataFrame:
    """(item_id, rank, similar_id, score, n_common): up to ``top`` items most similar to each, by boosted cosine above threshold.

    Of each item's matches the top * pool with most common raters are scored; ties go to more common
    raters, then to the smaller id. Items without matches have no rows.
    """
    pairs = co_rated(ratings, min_common, item_genres).withColumn("score", common_boost(F.col("cos"), F.col("n_common"), point, limit)).where(F.col("score") > threshold)
    return ranked(pairs, top, pool)


def ranked(pairs: DataFrame, top: int = 20, pool: int = 20) -> DataFrame:
    """Both directions of scored pairs, cut to each item's best."""
    both = pairs.select(F.col("a").alias("item_id"), F.col("b").alias("similar_id"), "score", "n_common").unionByName(pairs.select(F.col("b").alias("item_id"), F.col("a").alias("similar_id"), "score", "n_common"))
    of = Window.partitionBy("item_id")
    many = both.withColumn("__m", F.row_number().over(of.orderBy(F.desc("n_common"), "similar_id"))).where(F.col("__m") <= top * pool)
    best = many.withColumn("rank", F.row_number().over(of.orderBy(F.desc("score"), F.desc("n_common"), "similar_id"))).where(F.col("rank") <= top)
    return best.select("item_id", "rank", "similar_id", "score", "n_common")


def matches(ratings: DataFrame, item_genres: DataFrame, item_id: int, min_common: int = 3) -> DataFrame:
    """co_rated's pairs of one item: its ratings meet only those of its own raters."""
    own = ratings.where(F.col("item_id") == item_id).select("user_id", F.col("rating").alias("ra"))
    sets = item_genres.groupBy("item_id").agg(F.sort_array(F.collect_set("genre")).alias("g"))
    mine = sets.where(F.col("item_id") == item_id).select(F.col("g").alias("mine"))
    others = ratings.where(F.col("item_id") != item_id).join(own, "user_id").groupBy("item_id")
    sums = others.agg(F.count("*").alias("n_common"), F.sum(F.col("ra") * F.col("rating")).alias("ab"), F.sum(F.col("ra") * F.col("ra")).alias("aa"), F.sum(F.col("rating") * F.col("rating")).alias("bb"))
    near = sums.where(F.col("n_common") >= min_common).join(sets, "item_id").join(F.broadcast(mine), genre_overlap(F.col("g"), F.col("mine")))
    return near.select(F.lit(item_id).cast("bigint").alias("a"), F.col("item_id").alias("b"), "n_common", cosine(F.col("ab"), F.col("aa"), F.col("bb")).alias("cos"))


def tune(ratings: DataFrame, item_genres: DataFrame, id1: int, id2: int, top_n: int, expected: int = 20, threshold: float = 0.3) -> tuple[int, float]:
    """(point, limit): a boost that brings id2 among the top_n of id1, with their number of common raters as point.

    The limit begins at 0 and is raised by what the best match is ahead, and 0.01, until id2 is in or the
    limit is 2. ``expected`` is the usual number of matches asked for; twice as many are ranked, from the
    20 times as many with most common raters. The driver gets these in each round.
    """
    own = matches(ratings, item_genres, id1).persist()
    try:
        both = own.where(F.col("b") == id2).first()
        if both is None:
            raise ValueError(f"{id1} and {id2} have fewer than 3 raters or too few genres in common")
        point, limit = both["n_common"], 0.0
        while limit < 2:
            scored = own.withColumn("score", common_boost(F.col("cos"), F.col("n_common"), point, limit)).where(F.col("score") > threshold)
            best = ranked(scored, 2 * expected).where(F.col("item_id") == id1).orderBy("rank").collect()
            if not best or any(r["similar_id"] == id2 for r in best[:top_n]):
                break
            limit = limit * best[0]["score"] / (both["cos"] * (1 + limit)) + 0.01
        return point, limit
    finally:
        own.unpersist()
