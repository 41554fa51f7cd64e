"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that, of two fingerprints at the allowed distance,
some segment differs in one bit at most (distance 2: two segments of 32 bits). Every fingerprint is
indexed under each segment as it is and under each of the segment's variants with one bit left out.
Fingerprints that meet under a key are verified by their full distance. Links become components by
alternating large-star and small-star rounds.

Copies are folded before any join: the index holds distinct fingerprints only. A key under which
more than ``dense`` fingerprints meet is not paired off: its fingerprints are indexed under all
variants with ``distance`` bits left out, in which any two members are within the distance, so that
one link from each member to the smallest one keeps the group connected (linear, and exact).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import saved, settled, slices

BITS = 64
SEED = 42
#: Keys that several fingerprints share are broadcast up to this number, and beyond it joined by a shuffle.
BROADCAST = 500_000


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned integer."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text: 0 without words; the whole sequence where it has fewer than width."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = zip(*(itertools.islice(words, i, None) for i in range(width))) if len(words) >= width else [words]
    hash64 = xxhash.xxh64_intdigest
    return _majority(np.fromiter((hash64(b" ".join(s), SEED) for s in shingles), np.uint64, n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as the signed long of its 64 bits.

    Null and empty texts have fingerprint 0. Repeated rows stay repeated. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([simhash(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _bit(j: int) -> int:
    return (1 << j) - (1 << BITS if j == BITS - 1 else 0)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def fingerprint_links(fps: DataFrame, distance: int = 2, dense: int = 256) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints (column fp) at distance 1 to ``distance``.

    Every such pair outside dense keys; within dense keys, links that connect the same fingerprints.
    """
    n_seg = max(1, (distance + 2) // 2)
    ends = [BITS * i // n_seg for i in range(n_seg + 1)]
    # one number for each way to be indexed: segment s as it is, or with bit j left out
    ways = []
    for s in range(n_seg):
        inside = sum(1 << j for j in range(ends[s], ends[s + 1]))
        ways.append((inside, 0))
        ways += [(inside, 1 << j) for j in range(ends[s], ends[s + 1])]
    signed = lambda x: x - (1 << BITS) if x >= 1 << (BITS - 1) else x
    table = F.array(*(F.struct(F.lit(k).alias("way"), F.lit(signed(inside & ~out)).alias("mask"), F.lit(signed(out)).alias("out")) for k, (inside, out) in enumerate(ways)))
    # The few classes fill few partitions; their many variants are made in as many tasks as a shuffle has.
    spread = fps.select("fp").where("fp is not null").distinct().repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    index = (
        spread.select("fp", F.explode(table).alias("w"))
        .select("fp", F.col("w.way").alias("way"), F.col("fp").bitwiseAND(F.col("w.mask")).alias("key"),
                F.when(F.col("w.out") == 0, F.lit(None).cast("boolean")).otherwise(F.col("fp").bitwiseAND(F.col("w.out")) != 0).alias("side"))
    )
    # Nearly all keys hold one fingerprint: they are counted by an aggregate, which adds up before it sends, and
    # only what meets another is kept. The few shared keys are joined back, and Spark splits the hot ones.
    shared = saved(index.groupBy("way", "key").agg(F.count("*").alias("n")).where("n > 1"))
    met = saved(index.join(F.broadcast(shared) if shared.count() <= BROADCAST else shared, ["way", "key"]))
    sparse = met.where(F.col("n") <= dense)
    # A variant pairs those that have the left-out bit with those that lack it: pairs that agree in it also meet in the whole segment.
    left = sparse.where("side is null or not side").select("way", "key", F.col("fp").alias("a"))
    right = sparse.where("side is null or side").select("way", "key", F.col("fp").alias("b"), F.col("side").alias("bs"))
    close = left.join(right, ["way", "key"]).where((F.col("bs").isNotNull() | (F.col("a") < F.col("b"))) & (_distance("a", "b") <= distance))
    pairs = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    members = met.where(F.col("n") > dense).select("fp").distinct()
    masks = [signed(~sum(1 << j for j in js) & ((1 << BITS) - 1)) for js in itertools.combinations(range(BITS), distance)]
    variants = members.select("fp", F.posexplode(F.array(*map(F.lit, masks))).alias("way", "mask")).select("fp", "way", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    heads = variants.groupBy("way", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    stars = variants.join(heads, ["way", "key"]).where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links (a, b) reach from each node that has a link.

    Alternating large-star and small-star rounds until nothing changes, which they always reach; both
    halves of a round are kept on shared storage, so that the driver never plans a whole round at once.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = saved(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.withColumnRenamed("m", "v"))
        edges = saved(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = now
        settled(links.sparkSession)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2, dense: int = 256) -> DataFrame:
    """(doc_id, fp, component_id): every row's fingerprint and the smallest doc_id that links reach from it.

    One row for each row of docs. A null doc_id keeps its row and takes part, but never names a
    component unless all its members' ids are null. An empty table gives an empty result.
    """
    return named(saved(fingerprints(docs, id_col, text_col, width)), lambda classes: fingerprint_links(classes, distance, dense))


def named(fps: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, fp, component_id) of rows (doc_id, fp), by the links (a, b) that are found between distinct fps."""
    classes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = saved(components(links(classes)))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    names = saved(rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id"))
    settled(fps.sparkSession)
    return fps.join(names, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the near-duplicates of a smaller doc_id: of each component, the row of its smallest id stays.

    All columns stay as they are; of rows that repeat the kept doc_id one stays. Rows without an id stay.
    """
    return kept(docs, near_duplicates(docs, id_col, text_col, **options), id_col)


def kept(docs: DataFrame, near: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without those that near (doc_id, component_id) puts into a component of a smaller id."""
    found = near.where("doc_id = component_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    with_id = docs.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    return with_id.join(found, F.col(id_col) == F.col("__kept_id"), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
