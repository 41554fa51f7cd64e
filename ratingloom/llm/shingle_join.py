"""Near-duplicates by the exact Jaccard similarity of word shingles: SimHash signatures and a prefix-filtered join.

Each set of shingles has a fingerprint, and the deletion-variant signatures of ``simhash`` find those that differ in
few bits. What they find is verified by whole sets like all else. Similar sets may differ in more bits, and those are
found by the join.

A text is the set of the 64-bit hashes of its shingles. Of two sets with the similarity asked for, the
first shingles in any common order share one: as many as may be missing, and one more. Those are
indexed, rarest first, and what meets under a key is compared by its whole sets. The order comes from
the frequent shingles of a sample; it decides how much is compared, never what is found.

Equal sets are folded before any join. Similar sets have similar sizes, so a key's sets are grouped by bands
of sizes, each with the band below. A group of more than ``dense`` sets is not paired off in rows: each of its
sets is first compared with two of them, of the least and the greatest hash. With the signatures' links that connects what is copied very
often, over all the keys that the copies share. Only a group whose sets are then still in several components is
compared whole: its sets are dealt into blocks, every pair of blocks is compared in a task, and only the links
that connect components come back. No link between components is lost; the work of such a group grows with the
square of its distinct sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .storage import dropped, saved, settled, slices, stored

SEED = simhash.SEED
#: Of so many texts one is looked at for frequent shingles, of which so many are known at most.
SAMPLE, FREQUENT = 16, 100_000
#: Sets and shingles in a block of a dense key, and shingles compared at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 18, 4096
#: Texts that are looked at again are found by a broadcast of so many hashes at most, beyond that by a join.
BROADCAST = 1_000_000
#: Bands of sizes are wider than similarity asks for, so that rounding cannot part two similar sets by a whole band.
BAND = 1.01


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted: none without words; the whole sequence where it has fewer than width."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    parts = zip(*(itertools.islice(words, i, None) for i in range(width))) if len(words) >= width else [words]
    hash64 = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hash64(b" ".join(s), SEED) for s in parts), np.uint64, max(1, len(words) - width + 1)).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _hashes(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64))


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several distinct texts of a sample share, sorted, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, width) for t in batch.column(0).to_pylist()]))], ["h"])

    sample = texts.where(F.pmod("h", F.lit(SAMPLE)) == 0).dropDuplicates(["h"]).select("text").mapInArrow(run, "h bigint")
    rows = sample.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow().sort_by("h")
    return rows["h"].to_numpy(), rows["n"].to_numpy()


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: tuple[int, int]) -> DataFrame:
    """(doc_id, h, fp, mark, n, keys): each row's text's hash, and its set's hash, fingerprint, size and indexed shingles."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    known, counts = _frequent(texts, width)
    top, bottom = similarity

    def first(h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        often = np.zeros(len(h), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            often = np.where(known[at] == h, counts[at], 0)
        return h[np.lexsort((h, often))[: len(h) + (-top * len(h)) // bottom + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            sets = [shingles(t, width) for t in batch.column(2).to_pylist()]
            marks = pa.array(np.array([simhash._majority(s.view(np.uint64)) for s in sets], np.uint64).view(np.int64))
            cols = [batch.column(0), batch.column(1), _hashes(sets), marks, pa.array([len(s) for s in sets], pa.int64()), _lists([first(s) for s in sets])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "fp", "mark", "n", "keys"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, h bigint, fp bigint, mark bigint, n bigint, keys array<bigint>")


def signature_pairs(sets: DataFrame, similarity: tuple[int, int], distance: int = 2) -> DataFrame:
    """(a, b), a < b: fps of distinct sets whose fingerprints (mark) are linked by signatures, and whose sizes allow the similarity.

    They are to be verified. Of sets of one fingerprint each meets that of the least fp, which also meets other fingerprints'.
    """
    top, bottom = similarity
    own = sets.select("mark", "fp", "n").dropDuplicates(["fp"])
    heads = saved(own.groupBy("mark").agg(F.min(F.struct("fp", "n")).alias("head"), F.count("*").alias("k")))
    alike = own.join(heads.where("k > 1"), "mark").select(F.col("head").alias("x"), F.struct("fp", "n").alias("y"))
    links = saved(simhash.fingerprint_links(heads.select(F.col("mark").alias("fp")), distance))
    settled(sets.sparkSession)
    side = lambda c, as_: heads.select(F.col("mark").alias(c), F.col("head").alias(as_))
    met = alike.unionByName(links.join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y"))
    sized = (F.least("x.n", "y.n") * bottom >= F.greatest("x.n", "y.n") * top) & (F.col("x.fp") != F.col("y.fp"))
    return met.where(sized).select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b"))


def _bodies(docs: DataFrame, sets: DataFrame, wanted: DataFrame, text_col: str, width: int) -> DataFrame:
    """(fp, shingles): the whole sets of the wanted fps, made anew from a text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            found = [shingles(t, width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([_hashes(found), _lists(found)], ["fp", "shingles"])

    hashes = saved(sets.select("fp", "h").join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("h").alias("h")).select("h").distinct())
    few = hashes.count() <= BROADCAST
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).join(F.broadcast(hashes) if few else hashes, "h", "left_semi")
    return stored(texts.select("text").mapInArrow(run, "fp bigint, shingles array<bigint>").dropDuplicates(["fp"]), "bodies")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the left sets shares with each of the right ones, if it is another set."""
    values, times = np.unique(np.concatenate(left if left is right else left + right), return_counts=True)
    both = values[times > 1]
    out = np.zeros((len(left), len(right)), np.float32)

    def marks(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        m = np.zeros((len(sets), len(part)), np.float32)
        for row, s in zip(m, sets, strict=True):
            at = np.minimum(np.searchsorted(part, s), len(part) - 1)
            row[at[part[at] == s]] = 1
        return m

    for i in range(0, len(both), COLUMNS):
        part = both[i : i + COLUMNS]
        out += marks(left, part) @ marks(right, part).T
    return out.astype(np.int64)


def _block_links(rows: pd.DataFrame, top: int, bottom: int) -> pd.DataFrame:
    """(a, b): links that connect what the similar pairs of a pair of blocks connect, but for sets of one root, which are connected."""
    sides = [rows[rows["own"] == rows[c].iloc[0]] for c in ("lo", "hi")]
    (left, right), (a, b) = ([list(s["shingles"]) for s in sides], [s["fp"].to_numpy() for s in sides])
    if not len(a) or not len(b):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    common = _common(left, left if rows["lo"].iloc[0] == rows["hi"].iloc[0] else right)
    total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - common
    root = {r: r for r in rows["root"].tolist()} | dict(zip(rows["fp"].tolist(), rows["root"].tolist(), strict=True))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    for i, j in zip(*np.nonzero((bottom * common >= top * total) & (a[:, None] != b[None, :])), strict=True):
        x, y = int(a[i]), int(b[j])
        if (p := find(x)) != (q := find(y)):
            root[p] = q
            links.append((min(x, y), max(x, y)))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def set_links(docs: DataFrame, sets: DataFrame, text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (4, 5), dense: int = 32) -> DataFrame:
    """(a, b), a < b: links between the fps of distinct sets whose similarity is at least top / bottom.

    Every such pair outside dense groups; within dense groups, links that connect the same sets.
    """
    top, bottom = similarity
    index = stored(sets.select("fp", "n", "keys").dropDuplicates(["fp"]).select("fp", "n", F.posexplode("keys").alias("at", "key")), "index")
    # Nearly all keys hold one set: they are counted by an aggregate, and only what meets another is kept.
    several = stored(index.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "keys")
    few = several.count() <= simhash.BROADCAST
    # Similar sets are of one band of sizes or of two neighbouring ones: a group is a key's sets of a band and of the one below.
    own = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND * bottom / top))
    banded = index.join(F.broadcast(several) if few else several, "key").withColumn("own", own).withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
    held = stored(banded, "held")
    # The first key that a pair shares is early in the smaller of them, or too little follows.
    early = F.max(F.col("at") * (top + bottom) <= F.col("n") * (bottom - top))
    groups = held.groupBy("key", "band").agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.max(F.col("own") == F.col("band")).alias("some"), early.alias("early"))
    met = stored(held.join(groups.where("m > 1 and some").drop("some"), ["key", "band"]), "met")
    for used in (index, several, held):
        dropped(used)
    settled(docs.sparkSession)
    signed = stored(signature_pairs(sets, similarity), "signed")
    settled(docs.sparkSession)
    crowds = F.count(F.when(F.col("m") > dense, 1)).over(Window.partitionBy("fp"))
    sparse = met.withColumn("d", crowds).where(F.col("m") <= dense)
    side = lambda x: sparse.select("key", "band", F.col("fp").alias(x), *(F.col(c).alias(c + x) for c in ("n", "at", "d", "own")))
    near = lambda a, b: F.least(a, b) * bottom >= F.greatest(a, b) * top
    together = (F.col("a") < F.col("b")) & (F.greatest("owna", "ownb") == F.col("band")) & near("na", "nb")
    shared = side("a").join(side("b"), ["key", "band"]).where(together).groupBy("a", "b", "na", "nb", "da", "db")
    # Both sets share what meets in their keys, what may meet in dense ones, and what follows the last that meets, at most.
    most = F.col("met") + F.least("da", "db") + F.least(F.col("na") - F.col("ata") - 1, F.col("nb") - F.col("atb") - 1)
    shared = shared.agg(F.count("*").alias("met"), F.max("ata").alias("ata"), F.max("atb").alias("atb"))
    met_once = stored(shared.where(most * (top + bottom) >= (F.col("na") + F.col("nb")) * top).select("a", "b"), "once")
    settled(docs.sparkSession)
    crowded = met.where((F.col("m") > dense) & F.col("early")).select("key", "band", "fp", "n", "m", "size")
    ends = crowded.groupBy("key", "band").agg(F.array(F.min(F.struct("fp", "n")), F.max(F.struct("fp", "n"))).alias("ends"))
    stars = crowded.join(ends, ["key", "band"]).select("fp", "n", F.explode("ends").alias("e")).where((F.col("fp") != F.col("e.fp")) & near(F.col("n"), F.col("e.n")))
    pairs = stored(met_once.unionByName(stars.select(F.least("fp", "e.fp").alias("a"), F.greatest("fp", "e.fp").alias("b"))).unionByName(signed).distinct(), "pairs")
    for used in (met_once, signed):
        dropped(used)
    settled(docs.sparkSession)
    bodies = _bodies(docs, sets, pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), text_col, width)
    settled(docs.sparkSession)
    body = lambda x: bodies.select(F.col("fp").alias(x), F.col("shingles").alias(f"s{x}"))
    common = F.size(F.array_intersect("sa", "sb"))
    close = saved(pairs.join(body("a"), "a").join(body("b"), "b").where(common * bottom >= (F.size("sa") + F.size("sb") - common) * top).select("a", "b"))
    for used in (pairs, bodies):
        dropped(used)
    settled(docs.sparkSession)
    roots = saved(simhash.components(close))
    settled(docs.sparkSession)
    placed = crowded.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    apart = saved(placed.groupBy("key", "band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "band"))
    settled(docs.sparkSession)
    open_ = stored(placed.join(apart, ["key", "band"], "left_semi"), "open")
    dropped(met)
    settled(docs.sparkSession)
    if open_.isEmpty():
        return close
    bodies = _bodies(docs, sets, open_.select("fp").distinct(), text_col, width)
    settled(docs.sparkSession)
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES))
    dealt = open_.select("key", "band", "fp", "root", F.pmod(F.xxhash64("fp"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other"))
    dealt = dealt.select("key", "band", "fp", "root", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    linked = dealt.join(bodies, "fp").groupBy("key", "band", "lo", "hi").applyInPandas(lambda rows: _block_links(rows, top, bottom), "a bigint, b bigint")
    return close.unionByName(linked).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (4, 5), dense: int = 32) -> DataFrame:
    """(doc_id, fp, component_id): as simhash.near_duplicates, linked where the shingle sets' Jaccard similarity is at least top / bottom."""
    sets = stored(_sets(docs, id_col, text_col, width, similarity), "shingles")
    settled(docs.sparkSession)
    return simhash.named(sets.select("doc_id", "fp"), lambda classes: set_links(docs, sets, text_col, width, similarity, dense))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the near-duplicates of a smaller doc_id, as simhash.one_of_each."""
    return simhash.kept(docs, near_duplicates(docs, id_col, text_col, **options), id_col)
