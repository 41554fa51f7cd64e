"""What a rating site asks for: recommendations, search, similar items, ratings given and taken back."""

from __future__ import annotations

import dataclasses
import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from ..sources.store import Store
from .models import ALS, TagCount, TagLS
from .block_index import BlockIndex
from .search import Index, search

ALGORITHMS = ("tag_count", "tag_ls", "als3", "als5", "als7", "als9", "als11")
#: Recommendations kept for a user, of which every ROTATIONS-th is shown at a time.
KEPT, ROTATIONS = 400, 4


def live_ratings(events: DataFrame) -> DataFrame:
    """(user_id, item_id, rating, event_time): the last event of each user and item; a null rating takes it back.

    Events are (event_id, event_time, user_id, item_id, rating); of equal times the larger event_id counts.
    """
    last = events.groupBy("user_id", "item_id").agg(F.max_by(F.struct("rating", "event_time"), F.struct("event_time", "event_id")).alias("e"))
    return last.where("e.rating is not null").select("user_id", "item_id", F.col("e.rating").alias("rating"), F.col("e.event_time").alias("event_time"))


def ratings_changed(events: DataFrame) -> DataFrame:
    """(user_id, changed): when each user's ratings last changed."""
    return events.groupBy("user_id").agg(F.max("event_time").alias("changed"))


def stale(computed: DataFrame, changed: DataFrame) -> DataFrame:
    """(user_id, algorithm): recommendations computed no later than the ratings' last change."""
    return computed.join(changed, "user_id").where(F.col("computed") <= F.col("changed")).select("user_id", "algorithm")


def rotation(ranked: DataFrame, turn: int) -> DataFrame:
    """Every ROTATIONS-th row by rank (from 1), beginning with the turn-th from 0."""
    return ranked.where((F.col("rank") - 1) % ROTATIONS == turn % ROTATIONS)


def cards(items: DataFrame, titles: DataFrame, extra: DataFrame, rated: DataFrame | None = None) -> DataFrame:
    """items with title, tmdb_id, poster_url and rating: "None" and 0 where there is none."""
    out = items.join(titles.select("item_id", "title"), "item_id", "left").join(extra.select("item_id", "tmdb_id", F.col("poster").alias("poster_url")), "item_id", "left")
    out = out.withColumn("rating", F.lit(None).cast("double")) if rated is None else out.join(rated.select("item_id", "rating"), "item_id", "left")
    return out.fillna("None", ["title", "tmdb_id", "poster_url"]).fillna(0.0, ["rating"])


def as_json(rows: DataFrame) -> DataFrame:
    """(value): each row as a JSON object, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def rated(ratings: DataFrame, titles: DataFrame, user_id: int) -> DataFrame:
    """(item_id, title, rating) of a user's ratings: best first, then by title."""
    own = ratings.where(F.col("user_id") == user_id).join(titles.select("item_id", "title"), "item_id", "left")
    return own.select("item_id", "title", "rating").orderBy(F.desc("rating"), "title", "item_id")


def rated_by_all(ratings: DataFrame, titles: DataFrame) -> DataFrame:
    """(user_id, rank, item_id, title, rating): rated() for every user, with the place as rank."""
    order = Window.partitionBy("user_id").orderBy(F.desc("rating"), "title", "item_id")
    named = ratings.join(titles.select("item_id", "title"), "item_id", "left")
    return named.select("user_id", F.row_number().over(order).alias("rank"), "item_id", "title", "rating")


def rate(live: DataFrame, user_id: int, item_id: int, rating: float | None, at: datetime.datetime) -> DataFrame:
    """live_ratings() after one more request: a rating put in place of an older one, or taken back with None."""
    rest = live.where(~(F.col("user_id").eqNullSafe(F.lit(user_id)) & F.col("item_id").eqNullSafe(F.lit(item_id))))
    if rating is None:
        return rest
    return rest.unionByName(live.sparkSession.createDataFrame([(user_id, item_id, float(rating), at)], live.schema))


#: What is kept of a user's recommendations by an algorithm: at most KEPT items, and whose turn it is.
KEPT_ROW = "user_id bigint, algorithm string, computed timestamp, turn int, items array<struct<item_id: bigint, rank: int, score: double>>"


@dataclasses.dataclass
class Recommendations:
    """Recommendations kept in a keyed store, a row for each user and algorithm.

    compute takes users (user_id) and an algorithm, and gives (user_id, item_id, rank, score) for all of them in
    one job. A request gets every ROTATIONS-th of what is kept, each time the next ones; whose turn it is stays in
    the row, and so outlives a restart.
    """

    store: Store
    compute: Callable[[DataFrame, str], DataFrame]

    @classmethod
    def create(cls, spark: SparkSession, path: str, compute: Callable[[DataFrame, str], DataFrame], buckets: int = 64) -> Recommendations:
        return cls(Store.create(spark, path, KEPT_ROW, ("user_id", "algorithm"), buckets), compute)

    @classmethod
    def open(cls, spark: SparkSession, path: str, compute: Callable[[DataFrame, str], DataFrame]) -> Recommendations:
        return cls(Store.open(spark, path), compute)

    def stale(self, changed: DataFrame, algorithms: tuple[str, ...]) -> DataFrame:
        """(user_id, algorithm) of users (user_id, changed): those without a row, or with one computed no later than the ratings' last change."""
        wanted = changed.select("user_id", "changed", F.explode(F.array(*map(F.lit, algorithms))).alias("algorithm"))
        kept = self.store.read().select("user_id", "algorithm", "computed")
        return wanted.join(kept, ["user_id", "algorithm"], "left").where("computed is null or computed <= changed").select("user_id", "algorithm")

    def refresh(self, changed: DataFrame, algorithms: tuple[str, ...], now: datetime.datetime) -> int:
        """Compute what is stale, and only that, and put it in one batch, first turn first; the store's version. Users for whom nothing is computed get no row."""
        due, _ = written(self.stale(changed, algorithms), "stale")
        rows = None
        for algorithm in algorithms:
            found = self.compute(due.where(F.col("algorithm") == algorithm).select("user_id"), algorithm)
            items = F.sort_array(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "item_id", "score")))
            own = found.where(F.col("rank") <= KEPT).groupBy("user_id").agg(F.transform(items, lambda x: F.struct(x["item_id"].alias("item_id"), x["rank"].alias("rank"), x["score"].alias("score"))).alias("items"))
            own = own.select("user_id", F.lit(algorithm).alias("algorithm"), F.lit(now).alias("computed"), F.lit(0).alias("turn"), "items")
            rows = own if rows is None else rows.unionByName(own)
        return self.store.put(rows)

    def get(self, user_id: int, algorithm: str, changed: datetime.datetime | None, now: datetime.datetime) -> DataFrame:
        """(item_id, rank, score) of this turn, computed anew if stale. ``changed`` is when the user's ratings last changed, None if never."""
        spark, row = self.store.spark, self.store.get(user_id, algorithm).first()
        if row is None or (changed is not None and row["computed"] <= changed):
            self.refresh(spark.createDataFrame([(user_id, changed or now)], "user_id bigint, changed timestamp"), (algorithm,), now)
            row = self.store.get(user_id, algorithm).first()
        if row is None:
            return spark.createDataFrame([], "item_id bigint, rank int, score double")
        self.store.put(spark.createDataFrame([(*row[:3], (row["turn"] + 1) % ROTATIONS, row["items"])], KEPT_ROW))
        return rotation(spark.createDataFrame(row["items"], "item_id bigint, rank int, score double"), row["turn"])


@dataclasses.dataclass
class Engine:
    """The tables that requests are answered from."""

    ratings: DataFrame
    titles: DataFrame
    tags: DataFrame
    genres: DataFrame
    centers: DataFrame
    extra: DataFrame
    similar_items: DataFrame | None = None
    index: Index | BlockIndex | None = None
    als: dict[int, ALS] = dataclasses.field(default_factory=dict)

    def _model(self, own: DataFrame, algorithm: str):
        if algorithm == "tag_count":
            return TagCount.fit(own, self.tags, self.genres, self.centers)
        if algorithm == "tag_ls":
            return TagLS.fit(own, self.tags, self.genres, self.centers)
        if algorithm in ALGORITHMS and (k := int(algorithm[3:])) in self.als:
            return self.als[k].fold_in(own)
        raise ValueError(f"unknown algorithm: {algorithm}")

    def recommend(self, user_id: int, algorithm: str = "tag_count", limit: int = KEPT) -> tuple[DataFrame, DataFrame]:
        """((item_id, rank, score), params): the items with the best predictions that the user hasn't rated; ties to the larger id.

        tag_count and tag_ls need a rating, the others 3.
        """
        own = self.ratings.where(F.col("user_id") == user_id).select("user_id", "item_id", "rating")
        least = 1 if algorithm in ("tag_count", "tag_ls") else 3
        if own.limit(least).count() < least:
            raise ValueError(f"user {user_id} has fewer than {least} ratings")
        model = self._model(own, algorithm)
        pairs = self.centers.select(F.lit(user_id).cast("long").alias("user_id"), "item_id")
        scored = model.transform(pairs).where("prediction is not null").join(own.select("item_id"), "item_id", "left_anti")
        best = scored.orderBy(F.desc("prediction"), F.desc("item_id")).limit(limit)
        # at most ``limit`` rows are numbered
        listed = best.agg(F.sort_array(F.collect_list(F.struct(F.col("prediction").alias("score"), "item_id")), asc=False).alias("r")).select(F.posexplode("r").alias("p", "r"))
        return listed.select("r.item_id", (F.col("p") + 1).alias("rank"), "r.score"), model.params()

    def search(self, text: str, user_id: int, limit: int = 100) -> DataFrame:
        """Cards of the titles that match; an empty text matches none."""
        if isinstance(self.index, BlockIndex):
            asked = self.titles.sparkSession.createDataFrame([(0, text)], "query_id long, title string")
            return cards(self.index.search(asked, limit).select("item_id", "score"), self.titles, self.extra, self.ratings.where(F.col("user_id") == user_id))
        return cards(search(self.index, text, limit), self.titles, self.extra, self.ratings.where(F.col("user_id") == user_id))

    def similar(self, item_id: int, user_id: int) -> DataFrame:
        """Cards of the items most similar to one; none for an unknown item."""
        found = self.similar_items.where(F.col("item_id") == item_id).select(F.col("similar_id").alias("item_id"), "rank", "score")
        return cards(found, self.titles, self.extra, self.ratings.where(F.col("user_id") == user_id))

    def rated(self, user_id: int) -> DataFrame:
        return rated(self.ratings, self.titles, user_id)
