"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

#: Columns besides doc_id and text, named like what operators use inside.
CLASHES = "fp bigint, way int, key bigint, n bigint, count bigint, codes string, kind string, base string, spans string, index int, c0 string, media binary, score double, part int, `__text` string, `label` int"
N_CLASHES = 16
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("an", "the", "re", "ing", "é", "ou", "st", "Ti", "ß")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def hard_texts() -> list[str | None]:
    shared = words(1, 60)
    return [
        None, "", " \t\n", "x", "One two", shared, shared, shared + " tail", "head " + shared, words(2, 30) + " " + shared + " " + words(3, 30),
        "a" * 700, "ab" * 300, words(4, 20_000), "é" * 250, "日本語 " * 90, "́combining ﬁ ligature \U0001f600  nbsp", words(5, 40).upper(), "!!" * 200, "0" * 500,
    ]


def documents(spark, texts: list[str | None] | None = None):
    rows = [(i, t, "en", "s", None if t is None else len(t), *([None] * N_CLASHES)) for i, t in enumerate(hard_texts() if texts is None else texts)]
    if texts is None:
        rows += [(None, "no id", None, None, 5, *([None] * N_CLASHES)), (3, "x", "en", "s", 1, *([None] * N_CLASHES))]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
