"""Typed readers of the CSV inputs, and tables that are computed once and kept."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import note

#: Fixed value: what an item without genres has in the genres column.
NO_GENRES = "(no genres listed)"


def _csv(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, encoding="UTF-8", quote='"', escape='"', multiLine=True, mode=mode, enforceSchema=True)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, title, genres): genres as one string joined by bars."""
    return _csv(spark, path, "item_id long, title string, genres string")


def read_ratings(spark: SparkSession, path: str, last_only: bool = False) -> DataFrame:
    """(user_id, item_id, rating); columns after the fourth are not read.

    With last_only, of a user's ratings of an item the last one counts: that of the largest time in the fourth
    column, and of equal times the largest rating; ratings without a time come before those with one.
    """
    rows = _csv(spark, path, "user_id long, item_id long, rating double, ts long", "PERMISSIVE")
    return latest(rows, "ts") if last_only else rows.select("user_id", "item_id", "rating")


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, item_id, tag): tags in lower case."""
    return _csv(spark, path, "user_id long, item_id long, tag string, ts string", "PERMISSIVE").select("user_id", "item_id", F.lower("tag").alias("tag"))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, imdb_id, tmdb_id): outer ids as strings; short rows and empty values give nulls."""
    raw = _csv(spark, path, "item_id long, imdb_id string, tmdb_id string", "PERMISSIVE")
    return raw.select("item_id", *(F.when(F.length(c) > 0, F.col(c)).alias(c) for c in ("imdb_id", "tmdb_id")))


def latest(ratings: DataFrame, order: str) -> DataFrame:
    """One rating for each (user_id, item_id): that of the largest ``order``, ties to the larger rating, nulls last; an aggregate, so hot users don't gather."""
    return ratings.groupBy("user_id", "item_id").agg(F.max(F.struct(F.col(order), F.col("rating"))).alias("__last")).select("user_id", "item_id", F.col("__last.rating").alias("rating"))


def synthetic_ratings(spark: SparkSession, users: int, items: int, k: int = 3, noise: float = 0.1, low: float = -2.0, high: float = 2.0, seed: int = 42) -> DataFrame:
    """(user_id, item_id, rating): every user's rating of every item, from k factors of each that are drawn by hash between low and high, and normal noise."""
    rows = spark.range(users * items).select(F.floor(F.col("id") / items).alias("user_id"), (F.col("id") % items).alias("item_id"))
    draw = lambda key, side, i: F.pmod(F.xxhash64(key, F.lit(seed), F.lit(side), F.lit(i)), F.lit(1_000_001)) / 1_000_000.0 * (high - low) + low
    value = F.randn(seed) * noise
    for i in range(k):
        value = value + draw("user_id", 0, i) * draw("item_id", 1, i)
    return rows.withColumn("rating", value)


def item_genres(items: DataFrame) -> DataFrame:
    """(item_id, genre): one row for each genre of an item, in lower case, without the sentinel."""
    each = items.select("item_id", F.explode(F.split(F.lower("genres"), r"\|")).alias("genre"))
    return each.where((F.col("genre") != NO_GENRES) & (F.col("genre") != "")).distinct()


def _told(spark: SparkSession, inputs: tuple[str, ...], parameters: dict) -> str:
    """The files below the inputs, with their sizes and times, and the parameters: what a kept table was made of."""
    files = []
    for name in inputs:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        every = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while every.hasNext():
            f = every.next()
            files.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return json.dumps({"files": sorted(files), "parameters": parameters}, sort_keys=True, default=str)


def kept(spark: SparkSession, path: str, compute: Callable[[], DataFrame], overwrite: bool = False, inputs: tuple[str, ...] = (), parameters: dict | None = None) -> DataFrame:
    """The table at path; computed and written there first if it is missing or to be replaced, or was made of other inputs.

    inputs are the files or folders that compute reads, parameters what else its result depends on. Both are
    noted beside the table, in a file that is written last: a table without it, or with another one, is made
    anew. Without inputs and parameters the path alone tells.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    made_of, wanted = hadoop.Path(path, "_inputs.json"), _told(spark, inputs, parameters or {})
    fresh = files.exists(hadoop.Path(path, "_SUCCESS"))
    if fresh and (inputs or parameters):
        fresh = files.exists(made_of) and note(spark, f"{path}/_inputs.json") == wanted
    if overwrite or not fresh:
        compute().write.mode("overwrite").parquet(path)
        out = files.create(made_of, True)
        out.write(bytearray(wanted.encode()))
        out.close()
    return spark.read.parquet(path)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of changes in place of those with equal keys."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def missing(wanted: DataFrame, have: DataFrame, bad: DataFrame, key: str = "item_id") -> DataFrame:
    """The wanted keys that an enrichment neither has nor is known to lack."""
    return wanted.join(have.select(key), key, "left_anti").join(bad.select(key), key, "left_anti")
