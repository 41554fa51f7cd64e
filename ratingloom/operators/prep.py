"""Statistics, dictionaries, weights, splits and cores of rating tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..files import erased
from ..functions.numeric import tag_weight
from ..session import saved, written


#: Users, items or counts of so many rows are sent to all tasks; more of them are joined by a shuffle.
BROADCAST = 200_000
#: Lists that are counted at once.
COUNTED = 4096


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST else rows


def item_stats(ratings: DataFrame, center: str = "median") -> DataFrame:
    """(item_id, center, n): the exact median (or mean) of each item's ratings, and their number."""
    value = F.median("rating") if center == "median" else F.avg("rating")
    return ratings.groupBy("item_id").agg(value.alias("center"), F.count("*").alias("n"))


def degrees(ratings: DataFrame, key: str) -> DataFrame:
    """(key, n): ratings of each user or item."""
    return ratings.groupBy(key).agg(F.count("*").alias("n"))


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """(bin, n): how many values fall in each of ``bins`` equal ranges from low to high, the upper end included; others are left out."""
    inside = values.where(F.col(column).between(low, high))
    place = F.least(F.floor((F.col(column) - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    return inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def counted_lists(rows: DataFrame, width: int) -> DataFrame:
    """(key, counts array<double>): how often each of the numbers below width is in a key's lists (key, ids); a null list is empty.

    A key's lists come to a task as they are, not number by number, and are counted as they come.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_ = None, np.zeros(width)
        for batch in source:
            for k in range(0, batch.num_rows, COUNTED):
                part = batch.slice(k, COUNTED)
                keys, lists = np.asarray(part.column(0)), part.column(1)
                first = np.append(True, keys[1:] != keys[:-1])
                at = np.repeat(np.cumsum(first) - 1, np.asarray(lists.value_lengths().fill_null(0)))
                keys = keys[first]
                counts = np.bincount(at * width + np.asarray(lists.flatten()), minlength=len(keys) * width).reshape(-1, width).astype(float)
                if last is not None and last != keys[0]:
                    yield made(np.array([last]), open_[None])
                elif last is not None:
                    counts[0] += open_
                if len(keys) > 1:
                    yield made(keys[:-1], counts[:-1])
                last, open_ = keys[-1], counts[-1].copy()
        if last is not None:
            yield made(np.array([last]), open_[None])

    def made(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * width, counts.ravel())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], ["key", "counts"])

    given = rows.where("key is not null").select(F.col("key").cast("bigint").alias("key"), F.col("ids").cast("array<int>").alias("ids"))
    return given.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, counts array<double>")


def genre_counts(item_genres: DataFrame) -> DataFrame:
    """(genre, n): items of each genre."""
    return item_genres.groupBy("genre").agg(F.count("*").alias("n"))


def numbered(values: DataFrame, column: str, first_seen: str) -> DataFrame:
    """(column, id): values numbered from 0 in the order in which they were first seen, ties by value.

    The distinct values are dealt by range and counted by partition; a partition's numbers follow those of
    the partitions before it.
    """
    first = values.groupBy(column).agg(F.min(first_seen).alias("__at")).repartitionByRange(F.col("__at").asc_nulls_first(), F.col(column).asc_nulls_first()).sortWithinPartitions("__at", column)
    # the lower 33 bits of this id number the rows of a partition
    placed = saved(first.select(column, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__k")))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each partition
    return placed.join(F.broadcast(before), "__part").select(column, (F.col("__before") + F.col("__k")).cast("int").alias("id"))


def tag_uses(tags: DataFrame, min_count: int = 6) -> DataFrame:
    """(tag, n): uses of each tag that has at least min_count."""
    return tags.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def item_tags(tags: DataFrame, min_count: int = 6) -> DataFrame:
    """(item_id, tag, weight, n): ln(uses by item) + 1 and all uses of each frequent tag of an item."""
    uses = tag_uses(tags, min_count)
    own = tags.groupBy("item_id", "tag").agg(F.count("*").alias("own"))
    return own.join(uses, "tag").select("item_id", "tag", tag_weight(F.col("own")).alias("weight"), "n")


def _draw(seed: int, attempt: int) -> Column:
    return F.md5(F.concat_ws(":", F.col("user_id").cast("string"), F.col("item_id").cast("string"), F.lit(str(seed)), F.lit(str(attempt))))


def _split_by_blocks(rows: DataFrame, ratio: float, seed: int, attempts: int, varied: bool, block: int) -> DataFrame:
    """rows (with __n) with __test, as split, for users of many ratings.

    A user's draws are dealt into ranges of about ``block`` ratings; a rating's rank is its rank in its range
    after all ratings of the ranges before, which an aggregate counts. No user's ratings meet in one task.
    """
    out = None
    for attempt in range(attempts if varied else 1):
        share = F.conv(F.substring("__draw", 1, 8), 16, 10).cast("double") / float(1 << 32)
        dealt = rows.withColumn("__draw", _draw(seed, attempt)).withColumn("__range", F.floor(share * F.ceil(F.col("__n") / block)))
        ranges = dealt.groupBy("__u", "__range").agg(F.count("*").alias("__size"))
        earlier = Window.partitionBy("__u").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        before = ranges.select(F.col("__u").alias("__bu"), F.col("__range").alias("__br"), F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
        placed = dealt.join(before, F.col("__u").eqNullSafe(F.col("__bu")) & (F.col("__range") == F.col("__br")))
        rank = F.row_number().over(Window.partitionBy("__u", "__range").orderBy("__draw", "item_id")) + F.col("__before")
        tested = saved(placed.withColumn("__test", rank > F.floor(F.col("__n") * ratio)).select(*rows.columns, "__test"))
        if not varied:
            return tested
        spread = F.min(F.when(F.col("__test"), F.col("rating"))) < F.max(F.when(F.col("__test"), F.col("rating")))
        good = saved(tested.groupBy("__u").agg(spread.alias("__good")).where("__good").select(F.col("__u").alias("__gu")))
        good, same = _small(good, good.count()), F.col("__u").eqNullSafe(F.col("__gu"))
        found = tested.join(good, same, "left_semi")
        out = found if out is None else out.unionByName(found)
        rows = tested.join(good, same, "left_anti").drop("__test")
        if rows.isEmpty():
            break
    return out


def split(ratings: DataFrame, ratio: float = 0.8, seed: int = 42, attempts: int = 5, varied: bool = True, block: int = 1_000_000) -> DataFrame:
    """ratings with ``split``: 'train' for floor(n * ratio) of each user's ratings, drawn by hash, and 'test' for the rest.

    Users with ceil(2 / (1 - ratio)) ratings or fewer are dropped, and so are those whose test ratings
    are all equal in each of ``attempts`` draws; the first draw that isn't so counts. Without varied the
    first draw counts for all. Only the users whose first draw failed are ranked for the others, over the
    same partitioning. Users of more than ``block`` ratings, of whom there are at most ratings / block, are
    ranked by ranges of draws, with the same result.
    """
    import math

    whole = Window.partitionBy("user_id")
    ratings, _ = written(ratings, "split")  # they are passed over twice: to find hot users, and to rank
    hot = saved(ratings.groupBy(F.col("user_id").alias("__u")).agg(F.count("*").alias("__n")).where(F.col("__n") > max(block, math.ceil(2 / (1 - ratio)))))
    of_hot = F.col("user_id").eqNullSafe(F.col("__u"))
    columns, every, n_hot = ratings.columns, ratings, hot.count()
    if n_hot:
        ratings = ratings.join(_small(hot, n_hot), of_hot, "left_anti")

    def drawn(rows: DataFrame, of: range) -> DataFrame:
        """rows with __test: the first of these attempts whose test ratings differ; null if there is none."""
        chosen = F.lit(None).cast("boolean")
        for attempt in of:
            rows = rows.withColumn(f"__t{attempt}", F.row_number().over(whole.orderBy(_draw(seed, attempt), "item_id")) > F.floor(F.col("__n") * ratio))
        for attempt in reversed(of):
            tested = F.when(F.col(f"__t{attempt}"), F.col("rating"))
            good = F.min(tested).over(whole) < F.max(tested).over(whole) if varied else F.lit(True)
            chosen = F.when(good, F.col(f"__t{attempt}")).otherwise(chosen)
        return rows.withColumn("__test", chosen)

    rows = ratings.withColumn("__n", F.count("*").over(whole)).where(F.col("__n") > math.ceil(2 / (1 - ratio)))
    first = drawn(rows, range(1))
    out = first.where("__test is not null").select(*ratings.columns, "__test")
    if attempts > 1 and varied:
        again = drawn(first.where("__test is null").select(*ratings.columns, "__n"), range(1, attempts))
        out = out.unionByName(again.where("__test is not null").select(*ratings.columns, "__test"))
    if n_hot:
        blocks = _split_by_blocks(every.join(_small(hot, n_hot), of_hot), ratio, seed, attempts, varied, block)
        out = out.unionByName(blocks.select(*columns, "__test"))
    return out.withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


def varied_users(ratings: DataFrame) -> DataFrame:
    """(user_id): users with two different ratings at least."""
    return ratings.groupBy("user_id").agg(F.min("rating").alias("a"), F.max("rating").alias("b")).where("a < b").select("user_id")


def rating_levels(ratings: DataFrame) -> DataFrame:
    """(user_id, item_id, rating, level): each rating with its place among the user's different ratings, 1 for the best.

    A user's levels are few and come from an aggregate, so no user's ratings are gathered.
    """
    levels = ratings.where("rating is not null").groupBy("user_id", "rating").agg(F.count("*").alias("__n"))
    places = levels.select("user_id", "rating", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("rating"))).alias("level"))
    return ratings.join(places, ["user_id", "rating"]).select("user_id", "item_id", "rating", "level")


def item_ratings(ratings: DataFrame, shares: int = 1) -> DataFrame:
    """(item_id, share, ratings map<user_id, rating>): each item's ratings by user, a hot item's in as many maps as ``shares`` says; of several ratings by a user the largest counts."""
    one = ratings.where("user_id is not null").groupBy("item_id", "user_id").agg(F.max("rating").alias("rating"))
    share = F.pmod(F.xxhash64("user_id"), F.lit(shares)).cast("int").alias("share")
    return one.groupBy("item_id", share).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("user_id", "rating")))).alias("ratings"))


def mismatches(items: DataFrame, expected: DataFrame) -> DataFrame:
    """(item_id, title, expected): expected titles (item_id, title) that items lack or have otherwise; none if the data are as expected."""
    named = expected.select("item_id", F.col("title").alias("expected")).join(items.select("item_id", "title"), "item_id", "left")
    return named.where(~F.col("title").eqNullSafe(F.col("expected"))).select("item_id", "title", "expected")


class _Degrees:
    """How many of the rows that are left each user, or each item, has; lowered by what a round drops."""

    def __init__(self, rows: DataFrame, key: str):
        self.key = key
        self.left, self.folder = written(rows.groupBy(key).agg(F.count("*").alias("n")), "degrees")

    def below(self, least: int) -> tuple[DataFrame, int]:
        """(key), and their number: those with too few rows."""
        found = self.left.where(F.col("n") < least).select(self.key)
        return found, found.count()

    def lower(self, gone: DataFrame, n_gone: int, least: int) -> None:
        """Take the rows that are gone from the degrees; those that had too few leave."""
        lost = gone.groupBy(self.key).agg(F.count("*").alias("__lost"))
        now = self.left.where(F.col("n") >= least).join(_small(lost, n_gone), self.key, "left").select(self.key, (F.col("n") - F.coalesce("__lost", F.lit(0))).alias("n"))
        last = self.folder
        self.left, self.folder = written(now, "degrees")
        erased(gone.sparkSession, last)


def cores(train: DataFrame, ks: tuple[int, ...] = (3, 5, 7, 9, 11)) -> DataFrame:
    """train with ``k``: the largest of ks in whose core the row is, 0 if in none.

    The core of k is the largest part of train in which each user has k + 1 ratings and each item k, at least.
    Cores lie in each other, so one peel from the smallest k finds all. Degrees are counted once; a round looks
    for the few users and items that fall short, finds their rows, and lowers the degrees that these rows
    counted for: only what is dropped is shuffled. Rows are read again each round, and written anew where half
    of them are gone. Rows without a user or an item are in no core.
    """
    known = train.where("user_id is not null and item_id is not null")
    rows, _ = written(known, "core-rows")
    size, n_gone_of_base = rows.count(), 0
    users, items = _Degrees(rows, "user_id"), _Degrees(rows, "item_id")
    out, last, dropped = [train.where("user_id is null or item_id is null").withColumn("k", F.lit(0))], 0, []
    for k in sorted(ks):
        while True:
            (few_users, n_users), (few_items, n_items) = users.below(k + 1), items.below(k)
            if not n_users and not n_items:
                break
            # a row is reached by its user or its item; what went earlier is told apart by the degrees' own rows
            reached = rows.join(_small(few_users.withColumn("__u", F.lit(True)), n_users), "user_id", "left").join(_small(few_items.withColumn("__i", F.lit(True)), n_items), "item_id", "left").where("__u or __i")
            for keys, name, n in dropped:
                reached = reached.join(_small(keys, n), name, "left_anti")
            gone, _ = written(reached.select(*train.columns), "core-dropped")
            n_gone = gone.count()
            out.append(gone.withColumn("k", F.lit(last)))
            kept_users, kept_items = written(few_users, "core-few")[0], written(few_items, "core-few")[0]
            users.lower(gone, n_gone, k + 1)
            items.lower(gone, n_gone, k)
            dropped += [(kept_users, "user_id", n_users), (kept_items, "item_id", n_items)]
            n_gone_of_base += n_gone
            if 2 * n_gone_of_base > size or len(dropped) >= 16:
                for keys, name, n in dropped:
                    rows = rows.join(_small(keys, n), name, "left_anti")
                rows, _ = written(rows.select(*train.columns), "core-rows")
                size, n_gone_of_base, dropped = rows.count(), 0, []
        last = k
    for keys, name, n in dropped:
        rows = rows.join(_small(keys, n), name, "left_anti")
    return reduce(DataFrame.unionByName, [*out, rows.select(*train.columns).withColumn("k", F.lit(last))])


def kcore(train: DataFrame, k: int) -> DataFrame:
    """The largest part of train in which each user has k + 1 ratings and each item k, at least."""
    return cores(train, (k,)).where(F.col("k") == k).select(*train.columns)
