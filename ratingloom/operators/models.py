"""Rating predictors: median, tag and genre profiles, tag factors, alternating least squares.

A predictor is fitted for all users at once. ``fit`` takes ratings (user_id, item_id, rating) and the
tables that describe items; ``transform`` takes pairs with user_id and item_id and adds ``prediction``,
null where there can be none; ``params`` gives (user_id, section, pos, name, value).
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..files import erased
from ..functions.numeric import dot, num_factors
from ..session import saved, written
from . import rating_blocks
from .least_squares import least_squares
from .prep import genre_counts, item_stats, kcore

NEUTRAL = 3


def _listed(rows: DataFrame, section: str, name: str, value: str, order: tuple[Column, ...], limit: int | None = None) -> DataFrame:
    """Parameters of a section, numbered from 1 for each user."""
    out = rows.select("user_id", F.lit(section).alias("section"), F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).alias("pos"), F.col(name).alias("name"), F.col(value).alias("value"))
    return out if limit is None else out.where(F.col("pos") <= limit)


@dataclasses.dataclass
class Median:
    """Predicts the median of an item's ratings."""

    centers: DataFrame

    @classmethod
    def fit(cls, ratings: DataFrame, center: str = "median") -> Median:
        return cls(item_stats(ratings, center).select("item_id", "center"))

    def transform(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.centers.withColumnRenamed("center", "prediction"), "item_id", "left")


def tag_profile(ratings: DataFrame, tags: DataFrame) -> DataFrame:
    """(user_id, tag, score): the user's liking of each tag: offsets from neutral times weights, over the tag's uses."""
    liked = ratings.withColumn("offset", F.col("rating") - NEUTRAL).where("offset <> 0").join(tags, "item_id")
    return liked.groupBy("user_id", "tag").agg((F.sum(F.col("offset") * F.col("weight")) / F.first("n")).alias("score"))


def genre_profile(ratings: DataFrame, genres: DataFrame) -> DataFrame:
    """(user_id, genre, score): the user's liking of each genre: offsets from neutral, over the genre's items."""
    liked = ratings.withColumn("offset", F.col("rating") - NEUTRAL).where("offset <> 0").join(genres, "item_id").join(genre_counts(genres), "genre")
    return liked.groupBy("user_id", "genre").agg((F.sum("offset") / F.first("n")).alias("score"))


def _table(rows: DataFrame, key: str, name: str, value: Column, out: str) -> DataFrame:
    """(key, out): what one user or item has, as a map from names to values."""
    return rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(name), value))).alias(out))


def _met(own: str, table: str) -> Column:
    """The sum of the products of values whose names an item's map and a user's map share; 0 where nothing meets."""
    entries = F.map_entries(own)
    return F.coalesce(F.aggregate(entries, F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(table, x["key"]) * x["value"], F.lit(0.0))), F.lit(0.0))


def profile_dots(pairs: DataFrame, tags: DataFrame, genres: DataFrame, of_tags: DataFrame, of_genres: DataFrame) -> DataFrame:
    """pairs with tag_dot and genre_dot: how far the user's profiles and the item's tags and genres go together; 0 where nothing meets.

    An item's tags and genres, and then a user's profiles, come to a pair as maps, each joined by one key; no
    row is made for a pair's tag. What a map holds is bounded by the vocabulary.
    """
    items = _table(tags, "item_id", "tag", F.col("weight"), "__it").join(_table(genres, "item_id", "genre", F.lit(1.0), "__ig"), "item_id", "full")
    users = _table(of_tags, "user_id", "tag", F.col("score"), "__ut").join(_table(of_genres, "user_id", "genre", F.col("score"), "__ug"), "user_id", "full")
    both = pairs.join(items, "item_id", "left").join(users, "user_id", "left")
    return both.select(*pairs.columns, _met("__it", "__ut").alias("tag_dot"), _met("__ig", "__ug").alias("genre_dot"))


@dataclasses.dataclass
class TagCount:
    """Predicts from how an item's tags and genres go with the user's profiles.

    Model 0 fits the offset from the median to (tag_dot, genre_dot, 1) on ratings with tag_dot > 0.1, of
    which there must be 3; model 1 to (genre_dot, 1) on all, at least 2. Where the tags say nothing or
    there is no model 0, model 1 predicts; where there is neither, the median. The variant "research" fits
    model 1 to the ratings that model 0 leaves, and either to a single one.
    """

    tags: DataFrame
    genres: DataFrame
    centers: DataFrame
    of_tags: DataFrame
    of_genres: DataFrame
    factors: DataFrame

    @classmethod
    def fit(cls, ratings: DataFrame, tags: DataFrame, genres: DataFrame, centers: DataFrame | None = None, variant: str = "full") -> TagCount:
        research = variant == "research"
        centers = item_stats(ratings).select("item_id", "center") if centers is None else centers
        of_tags, of_genres = saved(tag_profile(ratings, tags)), saved(genre_profile(ratings, genres))
        rows = saved(profile_dots(ratings, tags, genres, of_tags, of_genres).join(centers, "item_id").withColumn("y", F.col("rating") - F.col("center")))
        first = least_squares(rows.where("tag_dot > 0.1").select("user_id", F.array("tag_dot", "genre_dot", F.lit(1.0)).alias("x"), "y"), "user_id", 3, 1 if research else 3)
        rest = rows.where("tag_dot <= 0.1") if research else rows
        second = least_squares(rest.select("user_id", F.array("genre_dot", F.lit(1.0)).alias("x"), "y"), "user_id", 2, 1 if research else 2)
        both = second.select("user_id", F.col("coef").alias("x1")).join(first.select("user_id", F.col("coef").alias("x0")), "user_id", "full")
        return cls(tags, genres, centers, of_tags, of_genres, saved(both))

    def transform(self, pairs: DataFrame) -> DataFrame:
        rows = profile_dots(pairs, self.tags, self.genres, self.of_tags, self.of_genres).join(self.centers, "item_id", "left").join(self.factors, "user_id", "left")
        with_tags = dot(F.col("x0"), F.array("tag_dot", "genre_dot", F.lit(1.0)))
        without = dot(F.col("x1"), F.array("genre_dot", F.lit(1.0)))
        offset = F.when((F.col("tag_dot") >= 1e-6) & F.col("x0").isNotNull(), with_tags).when(F.col("x1").isNotNull(), without).otherwise(F.lit(0.0))
        return rows.withColumn("prediction", offset + F.col("center")).select(*pairs.columns, "prediction")

    def params(self) -> DataFrame:
        best = lambda name: (F.desc("score"), F.asc(name))
        out = _listed(self.of_tags, "Tag Profile (Top 100)", "tag", "score", best("tag"), 100).unionByName(_listed(self.of_genres, "Genre Profile", "genre", "score", best("genre")))
        for section, column, names in (("For Movies with Tags", "x0", ("tag importance", "genre importance", "user bias")), ("For Movies without Tags", "x1", ("genre importance", "user bias"))):
            rows = self.factors.where(F.col(column).isNotNull()).select("user_id", F.posexplode(column).alias("p", "value"))
            named = rows.select("user_id", F.lit(section).alias("section"), (F.col("p") + 1).alias("pos"), F.get(F.array(*map(F.lit, names)), F.col("p")).alias("name"), "value")
            out = out.unionByName(named)
        return out


def factor_counts(ratings: DataFrame, tags: DataFrame, genres: DataFrame) -> DataFrame:
    """(user_id, kind, name, n): how many of the user's items have each genre and tag."""
    by_genre = ratings.join(genres, "item_id").groupBy("user_id", F.col("genre").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("genre"))
    by_tag = ratings.join(tags, "item_id").groupBy("user_id", F.col("tag").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("tag"))
    return by_genre.unionByName(by_tag).select("user_id", "kind", "name", "n")


def factor_profile(ratings: DataFrame, tags: DataFrame, genres: DataFrame, less: int = 0) -> DataFrame:
    """(user_id, slot, kind, name): the user's most frequent genres and tags, as many as the number of ratings pays for, or ``less`` fewer; ties: tags first, then the larger name."""
    rated = ratings.groupBy("user_id").agg(num_factors(F.count("*")).alias("k"))
    order = Window.partitionBy("user_id").orderBy(F.desc("n"), F.desc(F.col("kind") == "tag"), F.desc("name"))
    ranked = factor_counts(ratings, tags, genres).withColumn("slot", F.row_number().over(order) - 1)
    return ranked.join(rated, "user_id").where(F.col("slot") < F.col("k") - less).select("user_id", "slot", "kind", "name")


@dataclasses.dataclass
class TagLS:
    """Predicts from the user's most frequent genres and tags, each with a factor of its own, and a bias."""

    WIDTH = 26

    tags: DataFrame
    genres: DataFrame
    centers: DataFrame
    profile: DataFrame
    factors: DataFrame

    @staticmethod
    def _rows(pairs: DataFrame, profile: DataFrame, tags: DataFrame, genres: DataFrame) -> DataFrame:
        """pairs (with user_id and item_id) with x: the item's values in the user's slots, then 1 for the bias."""
        named = lambda kind, name: F.concat(F.lit(kind + ":"), F.col(name))
        values = genres.select("item_id", named("genre", "genre").alias("name"), F.lit(1.0).alias("value")).unionByName(tags.select("item_id", named("tag", "tag").alias("name"), (F.col("weight") / F.col("n")).alias("value")))
        of_items = values.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("__values"))
        slots = profile.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.concat_ws(":", "kind", "name").alias("name")))).alias("__slots"))
        value = lambda i: F.coalesce(F.try_element_at("__values", F.try_element_at("__slots", i)), F.lit(0.0))
        x = F.concat(F.transform(F.sequence(F.lit(0), F.lit(TagLS.WIDTH - 2)), value), F.array(F.lit(1.0)))
        return pairs.join(of_items, "item_id", "left").join(slots, "user_id", "left").withColumn("x", x).select(*pairs.columns, "x")

    @classmethod
    def fit(cls, ratings: DataFrame, tags: DataFrame, genres: DataFrame, centers: DataFrame | None = None, less: int = 0) -> TagLS:
        centers = item_stats(ratings).select("item_id", "center") if centers is None else centers
        profile = saved(factor_profile(ratings, tags, genres, less))
        # x is wide: nothing is joined by another key once it is made
        offsets = ratings.join(centers, "item_id").select("user_id", "item_id", (F.col("rating") - F.col("center")).alias("y"))
        design = cls._rows(offsets, profile, tags, genres).select("user_id", "x", "y")
        return cls(tags, genres, centers, profile, saved(least_squares(design, "user_id", cls.WIDTH).select("user_id", "coef")))

    def transform(self, pairs: DataFrame) -> DataFrame:
        rows = self._rows(pairs, self.profile, self.tags, self.genres).join(self.centers, "item_id", "left").join(self.factors, "user_id", "left")
        return rows.withColumn("prediction", dot(F.col("x"), F.col("coef")) + F.col("center")).select(*pairs.columns, "prediction")

    def params(self) -> DataFrame:
        each = self.factors.select("user_id", F.posexplode("coef").alias("slot", "value")).withColumn("bias", F.col("slot") == self.WIDTH - 1)
        named = each.join(self.profile, ["user_id", "slot"], "left").where("bias or name is not null").select("user_id", "value", F.when(F.col("bias"), "bias").otherwise(F.col("kind")).alias("kind"), F.when(F.col("bias"), "user bias").otherwise(F.col("name")).alias("name"))
        return _listed(named, "Factors", "name", "value", (F.asc(F.col("kind") == "bias"), F.desc("value"), F.asc("name")))


@dataclasses.dataclass
class ALS:
    """Factors of users and items with a user bias, by alternating least squares on offsets from the median.

    Each half of a round solves every user's, or every item's, own small system (the shortest solution).
    Fitting ends after ``min_rounds`` rounds, when one lowers the sum of squares by less than ``gain``.
    """

    k: int
    centers: DataFrame
    users: DataFrame
    items: DataFrame
    rounds: int
    sse: float

    @classmethod
    def fit(cls, ratings: DataFrame, k: int = 3, centers: DataFrame | None = None, core: bool = True, seed: int = 42, min_rounds: int = 4, max_rounds: int = 200, gain: float = 0.01, block: int = rating_blocks.BLOCK) -> ALS:
        """Fitted on the k-core of ratings, unless core is False, which also takes ratings that are a core already.

        Ratings are cut into blocks once; a round ships factors to the blocks that need them and reads nothing else.
        """
        centers = saved(item_stats(ratings).select("item_id", "center")) if centers is None else centers
        used = kcore(ratings, k) if core else ratings
        rows = used.join(centers, "item_id").select("user_id", "item_id", (F.col("rating") - F.col("center")).alias("y")).where("user_id is not null and y is not null")
        of_users, of_items = rating_blocks.cut(rows, block)
        # The first factors are drawn by hash, so that they don't depend on the partitions.
        draw = lambda i: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(2_000_001)) / 1_000_000.0 - 1.0
        items, folders = rating_blocks.drawn(of_items, F.array(*(draw(i) for i in range(k)))), []
        users, sse, n = None, None, 0
        for n in range(1, max_rounds + 1):
            users, of_round = written(of_users.solved(items, k + 1, k, constant=True), "als-users")
            of_users.settle()
            items, of_half = written(of_items.solved(users, k, k, bias=k), "als-items")
            now = items.agg(F.coalesce(F.sum("sse"), F.lit(0.0))).first()[0]
            of_items.settle()
            for folder in folders:
                erased(ratings.sparkSession, folder)
            folders = [of_round, of_half]
            if n >= min_rounds and (sse is None or now > (1 - gain) * sse):
                sse = now
                break
            sse = now
        return cls(k, centers, users.select(F.col("id").alias("user_id"), F.col("f").alias("u")), items.select(F.col("id").alias("item_id"), F.col("f").alias("v")), n, sse or 0.0)

    def transform(self, pairs: DataFrame) -> DataFrame:
        rows = pairs.join(self.items, "item_id", "left").join(self.users, "user_id", "left").join(self.centers, "item_id", "left")
        value = dot(F.col("v"), F.slice("u", 1, self.k)) + F.get("u", F.lit(self.k)) + F.col("center")
        return rows.withColumn("prediction", value).select(*pairs.columns, "prediction")

    def fold_in(self, ratings: DataFrame, center: bool = False) -> ALS:
        """This model for the users of ratings: their factors from the items' as they are.

        Users need k + 1 ratings of items that have factors. As the serving layer has always done it, raw
        ratings are fitted; with center, their offsets from the median.
        """
        y = F.col("rating") - F.col("center") if center else F.col("rating")
        rows = ratings.join(self.items, "item_id").join(self.centers, "item_id", "left").select("user_id", F.concat("v", F.array(F.lit(1.0))).alias("x"), y.alias("y"))
        users = least_squares(rows, "user_id", self.k + 1, self.k + 1).select("user_id", F.col("coef").alias("u"))
        return dataclasses.replace(self, users=saved(users))

    def params(self) -> DataFrame:
        each = self.users.select("user_id", F.posexplode("u").alias("p", "value"))
        name = F.when(F.col("p") == self.k, "user bias").otherwise(F.concat(F.lit("factor "), F.col("p").cast("string")))
        return each.select("user_id", F.lit("Factors").alias("section"), (F.col("p") + 1).alias("pos"), name.alias("name"), "value")
