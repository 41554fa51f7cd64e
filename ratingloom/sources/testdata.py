"""The logical tables, bound to the test tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating): the best rating of each customer for each part, by halves from 0.5 to 5."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"), (F.ceil(F.col("l_quantity") / 5) / 2.0).cast("double").alias("rating"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("user_id", "item_id").agg(F.max("rating").alias("rating"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, title, genres): genres from type, brand and size."""
    genres = F.concat_ws("|", "p_type", "p_brand", F.concat(F.lit("size"), F.floor(F.col("p_size") / 10).cast("string")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), genres.alias("genres"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, tag): what users did to items 0 to 99."""
    return table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), F.lower("event_type").alias("tag")).where("item_id is not null")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, title): the whole text of each document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("title"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, tmdb_id, poster): an enrichment that lacks many items."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), F.col("page_id").cast("string").alias("tmdb_id"), F.col("url").alias("poster"))


def rating_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, event_time, user_id, item_id, rating): a log of ratings 1 to 5; null takes a rating back."""
    rating = F.when(F.col("event_type") != "error", F.pmod(F.col("event_id"), F.lit(5)).cast("double") + 1)
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("event_time"), "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), rating.alias("rating")).where("item_id is not null")
