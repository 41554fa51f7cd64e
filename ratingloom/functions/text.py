"""Titles as terms: words cut, cleaned, mapped and stemmed, and pairs of neighbours."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import porter

#: Words that are no terms, besides the years (1900) to (2300); punctuation that is stripped, in order;
#: words that stand for others.
STOP_WORDS = ("the", "of", "a", "and", "in", "to", "on", "&", "for", "la", "a.k.a")
STARTS = ("(", "*", ".", "'")
ENDS = (")", ",", ":", "?!", "!?", "!", "?", ".", "+", "'", "*")
STEMS = {
    "m*a*s*h": "mash", "u.s.a": "usa", "m.d": "md", "l.a": "la", "d.a": "da", "s.w.a.t": "swat", "r.i.p.d": "ripd", "i.q": "iq", "a.i": "ai", "s.h.i.e.l.d": "shield", "a.d": "ad", "kissing": "kiss",
    "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10", "u.f.o": "ufo", "s*p*y*": "spy", "9/11": "911",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text: cut at white space and hyphens, and at a single slash in words of six letters and more."""
    hyphens = lambda w: F.filter(F.split(w, "-"), lambda p: p != "")
    slashes = lambda w: F.length(w) - F.length(F.replace(w, F.lit("/"), F.lit("")))
    cut = lambda w: F.when(F.contains(w, F.lit("-")), hyphens(w)).when((slashes(w) == 1) & (F.length(w) >= 6), F.split(w, "/")).otherwise(F.array(w))
    return F.flatten(F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""), cut))


def is_stop(word: Column) -> Column:
    return word.isin(*STOP_WORDS) | word.rlike(r"^\((19\d\d|2[0-2]\d\d|2300)\)$")


def stripped(word: Column) -> Column:
    """A word without the punctuation around it: each mark of STARTS, then of ENDS, is looked at once."""
    for mark in STARTS:
        word = F.ltrim(word, F.lit(mark))
    for mark in ENDS:
        word = F.rtrim(word, F.lit(mark)) if len(mark) == 1 else let(word, lambda w: F.when(F.endswith(w, F.lit(mark)), F.rtrim(w, F.lit(mark))).otherwise(w))  # noqa: B023
    return word


def mapped(word: Column) -> Column:
    """A word without a possessive end, or what it stands for."""
    table = F.create_map(*(F.lit(x) for pair in STEMS.items() for x in pair))
    return let(F.regexp_replace(word, "'s$", ""), lambda bare: F.coalesce(F.try_element_at(table, bare), bare))


@F.pandas_udf(ArrayType(StringType()))
def stemmed(words: pd.Series) -> pd.Series:
    """The stems of each array's words; a word is stemmed once for each batch."""
    known: dict[str, str] = {}

    def of(word: str) -> str:
        if word not in known:
            known[word] = porter.stem(word)
        return known[word]

    return words.map(lambda w: None if w is None else [of(x) for x in w])


def _paired(text: Column) -> Column:
    """The words of a text that are no stop words, in lower case as r and cleaned as t."""
    raw = F.filter(F.transform(words(text), F.lower), lambda w: ~is_stop(w))
    return F.transform(raw, lambda w: F.struct(w.alias("r"), mapped(stripped(w)).alias("t")))


def _kept(pairs: Column) -> Column:
    """The terms of cleaned words: those that are not empty, and no stop words that only cleaning made."""
    kept = F.filter(pairs, lambda x: (F.length(x["t"]) > 0) & ~((F.length(x["t"]) < F.length(x["r"])) & is_stop(x["t"])))
    return F.transform(kept, lambda x: x["t"])


def term_lists(titles: DataFrame, stem: bool = True, id_col: str = "item_id", text_col: str = "title") -> DataFrame:
    """(item_id, tokens array<string>): the terms of each title, in order; nothing is shuffled.

    One row for each row of titles, also where rows share an id; null and empty titles, and those of stop
    words only, have an empty array.
    """
    paired = titles.select(F.col(id_col).alias("item_id"), _paired(F.col(text_col)).alias("pairs"))
    if stem:
        stems = paired.withColumn("stems", stemmed(F.col("pairs")["t"]))
        paired = stems.select("item_id", F.zip_with(F.col("pairs"), "stems", lambda x, t: F.struct(x["r"].alias("r"), t.alias("t"))).alias("pairs"))
    return paired.select("item_id", _kept(F.col("pairs")).alias("tokens"))


def tokens(lists: DataFrame) -> DataFrame:
    """(item_id, pos, token) of term_lists()'s rows, places from 0."""
    return lists.select("item_id", F.posexplode("tokens").alias("pos", "token"))


def neighbours(terms: Column) -> Column:
    """Each two terms of an array that follow each other, joined by a blank."""
    n = F.greatest(F.size(terms) - 1, F.lit(0))
    return F.zip_with(F.slice(terms, F.lit(1), n), F.slice(terms, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def bigrams(lists: DataFrame) -> DataFrame:
    """(item_id, pos, bigram): neighbours among the terms of each title, joined by a blank."""
    return lists.select("item_id", F.posexplode(neighbours(F.col("tokens"))).alias("pos", "bigram"))
