"""Search in titles by weighted terms and pairs of terms."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import neighbours, term_lists
from ..session import saved

#: A pair of terms counts so much more than a term.
PAIR = 1.5


@dataclasses.dataclass(frozen=True)
class Index:
    """postings (term, kind, item_id), distinct, and terms (term, kind, n) with repeats counted; kind is token or bigram."""

    postings: DataFrame
    terms: DataFrame
    stem: bool = True

    def save(self, path: str) -> None:
        self.postings.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/terms")

    @classmethod
    def load(cls, spark, path: str, stem: bool = True) -> Index:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), stem)


def _all_terms(lists: DataFrame) -> DataFrame:
    """(item_id, term, kind): tokens and pairs of term_lists()'s rows, which are read once."""
    words = F.transform("tokens", lambda w: F.struct(w.alias("term"), F.lit("token").alias("kind")))
    pairs = F.transform(neighbours(F.col("tokens")), lambda w: F.struct(w.alias("term"), F.lit("bigram").alias("kind")))
    return lists.select("item_id", F.explode(F.concat(words, pairs)).alias("t")).select("item_id", "t.term", "t.kind")


def build_index(titles: DataFrame, stem: bool = True) -> Index:
    """The index of titles (item_id, title), whose terms are found once and kept."""
    every = _all_terms(saved(term_lists(titles, stem)))
    return Index(every.select("term", "kind", "item_id").distinct(), every.groupBy("term", "kind").agg(F.count("*").alias("n")), stem)


def search(index: Index, text: str, limit: int = 100) -> DataFrame:
    """(item_id, score): the best matches of a text; a term counts 1/n, a pair 1.5/n, each as often as the text has it.

    Ties go to the larger id. The text's few terms are broadcast to the index; without terms there is no row.
    """
    spark = index.postings.sparkSession
    asked = _all_terms(term_lists(spark.createDataFrame([(0, text)], "item_id long, title string"), index.stem))
    wanted = asked.groupBy("term", "kind").agg(F.count("*").alias("times"))
    known = index.terms.join(F.broadcast(wanted), ["term", "kind"])
    weight = F.col("times") * F.when(F.col("kind") == "bigram", PAIR).otherwise(1.0) / F.col("n")
    found = index.postings.join(F.broadcast(known.select("term", "kind", weight.alias("w"))), ["term", "kind"])
    return found.groupBy("item_id").agg(F.sum("w").alias("score")).orderBy(F.desc("score"), F.desc("item_id")).limit(limit)


def frequent_terms(index: Index, kind: str = "token", limit: int = 100) -> DataFrame:
    """(term, n): the most frequent terms, ties to the larger term."""
    return index.terms.where(F.col("kind") == kind).orderBy(F.desc("n"), F.desc("term")).limit(limit).select("term", "n")


def odd_terms(index: Index) -> DataFrame:
    """(term, n): tokens with other than letters and digits."""
    return index.terms.where((F.col("kind") == "token") & ~F.col("term").rlike(r"^[\p{L}\p{N}]+$")).select("term", "n")


def terms_ending(index: Index, ending: str) -> DataFrame:
    """(term, n): tokens with an ending."""
    return index.terms.where((F.col("kind") == "token") & F.endswith(F.col("term"), F.lit(ending))).select("term", "n")
