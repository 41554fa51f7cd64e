"""An index of terms in sorted blocks: a search reads the blocks of its terms, and of common terms only those where a candidate may be.

Postings are sorted by term and item and cut into blocks of at most 1024 items, kept as Parquet whose files have
disjoint ranges; a list of these ranges tells which files a search opens. A posting weighs what its term weighs
(n is all that a weight depends on), so a block's best score is its term's weight, and the terms' counts alone give
a score that the last of the best must reach.
"""

from __future__ import annotations

import bisect
import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..files import erased
from ..functions.text import term_lists
from ..session import saved, written
from .search import PAIR, _all_terms

#: Items of a block; blocks of a file; distinct keys of a search up to which files are looked up by the driver.
BLOCK, FILE, LOOKUPS = 1024, 65_536, 10_000

#: Scores are whole numbers of this unit while they are summed, so that no order of adding matters.
UNIT = 1e12

_TERM = ["term", "kind"]


def _cut(block: int):
    """For mapInArrow: sorted rows (term, kind, cell, item_id) as blocks; a block ends with its cell, or when it is full."""

    def made(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ends = np.append(starts[1:], rows.num_rows)
        ids = rows.column("item_id").combine_chunks()
        of = rows.take(pa.array(starts)).combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, rows.num_rows).astype(np.int32)), ids)
        last = ids.take(pa.array(ends - 1))
        columns = [of.column(c).combine_chunks() for c in ("term", "kind", "cell", "item_id")]
        return pa.RecordBatch.from_arrays([*columns, last, lists], ["term", "kind", "cell", "first", "last", "ids"])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in source:
            if not batch.num_rows:
                continue
            fresh = pa.Table.from_batches([batch])
            rows = (fresh if held is None else pa.concat_tables([held, fresh])).combine_chunks()
            differs = np.zeros(rows.num_rows, bool)
            differs[0] = True
            for name in ("term", "kind", "cell"):
                column = rows.column(name)
                differs[1:] |= pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy()
            runs = np.flatnonzero(differs)
            place = np.arange(rows.num_rows) - np.repeat(runs, np.diff(np.append(runs, rows.num_rows)))
            starts = np.flatnonzero(place % block == 0)
            # what follows may belong to the last block
            if len(starts) > 1:
                yield made(rows.slice(0, int(starts[-1])), starts[:-1])
            held = rows.slice(int(starts[-1]))
        if held is not None:
            yield made(held.combine_chunks(), np.zeros(1, np.int64))

    return run


@dataclasses.dataclass(frozen=True)
class BlockIndex:
    """A folder with terms (term, kind, n, df, shift), blocks (term, kind, cell, first, last, ids) and files (path, lo, hi).

    df is the number of items, cell an item's id without its last ``shift`` bits: a term's ids spread evenly
    fill a block for each cell, crowded ids take several.
    """

    spark: SparkSession
    path: str
    stem: bool = True

    @classmethod
    def build(cls, titles: DataFrame, path: str, stem: bool = True, block: int = BLOCK, per_file: int = FILE) -> BlockIndex:
        """Write the terms of titles (item_id, title) as blocks.

        A term that an item repeats, or that rows of one id share, counts in n each time and is one posting. Rows
        without an id count in n alone, as in build_index().
        """
        spark = titles.sparkSession
        lists = term_lists(titles.withColumn("item_id", F.col("item_id").cast("bigint")), stem)
        postings, folder = written(_all_terms(lists).groupBy("term", "kind", "item_id").agg(F.count("*").alias("m")), "postings")
        span = F.col("hi").cast("double") - F.col("lo").cast("double") + 1
        shift = F.greatest(F.lit(0), F.least(F.lit(62), F.ceil(F.log2(span * block / F.col("df"))))).cast("int")
        counts = postings.groupBy(_TERM).agg(F.sum("m").alias("n"), F.count("item_id").alias("df"), F.min("item_id").alias("lo"), F.max("item_id").alias("hi"))
        terms = counts.where("df > 0").select("term", "kind", "n", "df", shift.alias("shift"))
        terms.repartitionByRange("term", "kind").sortWithinPartitions("term", "kind").write.mode("overwrite").parquet(f"{path}/terms")
        known = spark.read.parquet(f"{path}/terms")
        placed = postings.where("item_id is not null").join(known.select("term", "kind", "shift"), _TERM).select("term", "kind", F.expr("shiftright(item_id, shift)").alias("cell"), "item_id")
        # the item takes part in the ranges: a term that everything has is in many of them
        dealt = placed.repartitionByRange("term", "kind", "item_id").sortWithinPartitions("term", "kind", "item_id")
        blocks = dealt.mapInArrow(_cut(block), "term string, kind string, cell bigint, first bigint, last bigint, ids array<bigint>")
        blocks.write.mode("overwrite").option("maxRecordsPerFile", per_file).option("parquet.writer.version", "v2").parquet(f"{path}/blocks")
        key = F.struct("term", "kind", "cell")
        files = spark.read.parquet(f"{path}/blocks").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        files.write.mode("overwrite").parquet(f"{path}/files")
        erased(spark, folder)
        return cls(spark, path, stem)

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    def blocks(self, keys: DataFrame | None = None) -> DataFrame:
        """All blocks, or of the files where keys (term, kind, and cell if given) may be found.

        Up to LOOKUPS keys, which are counted, are looked up in the list of files, a row for each; with more, all
        files are read. Other terms' blocks of an opened file are left out by the filter on its pages.
        """
        every = self.spark.read.parquet(f"{self.path}/blocks")
        if keys is None:
            return every
        cells = "cell" in keys.columns
        found = keys.distinct().limit(LOOKUPS + 1).collect()
        if len(found) > LOOKUPS:
            return every
        ranges = sorted((tuple(r["lo"]), tuple(r["hi"]), r["path"]) for r in self.spark.read.parquet(f"{self.path}/files").collect())
        ends, paths = [hi for _, hi, _ in ranges], set()
        for key in found:
            low, high = ((key["term"], key["kind"], key["cell"]),) * 2 if cells else ((key["term"], key["kind"], -(1 << 63)), (key["term"], key["kind"], 1 << 63))
            at = bisect.bisect_left(ends, low)
            while at < len(ranges) and ranges[at][0] <= high:
                paths.add(ranges[at][2])
                at += 1
        if not paths:
            return every.limit(0)
        return self.spark.read.schema(every.schema).parquet(*sorted(paths)).where(F.col("term").isin(sorted({k["term"] for k in found})))

    def _weights(self, texts: DataFrame) -> DataFrame:
        """(query_id, term, kind, w, df, shift) of the terms of texts (query_id, title) that the index has; a text's rows are one text's parts."""
        lists = term_lists(texts, self.stem, "query_id").where("item_id is not null")
        asked = _all_terms(lists).groupBy(F.col("item_id").alias("query_id"), *_TERM).agg(F.count("*").alias("times"))
        weight = F.col("times") * F.when(F.col("kind") == "bigram", PAIR).otherwise(1.0) / F.col("n")
        return asked.join(self.terms, _TERM).select("query_id", *_TERM, F.round(weight * UNIT).cast("bigint").alias("w"), "df", "shift")

    def search(self, texts: DataFrame, limit: int = 100) -> DataFrame:
        """(query_id, rank, item_id, score): for each text of texts (query_id, title) its best items, scored as search.search() does.

        Ties go to the larger id; texts without a known term, null and empty ones among them, have no rows, and
        neither have null query ids. A text's last score is at least that of its heaviest term with ``limit``
        items. Terms that all together weigh less than that can't bring an item in by themselves: the others'
        items are the candidates, and only blocks where one of these may be are looked at for the light terms.
        Weights are rounded to 1e-12.
        """
        of = Window.partitionBy("query_id")
        least = F.coalesce(F.max(F.when(F.col("df") >= limit, F.col("w"))).over(of), F.lit(0))
        up_to = F.sum("w").over(of.orderBy("w", *_TERM).rowsBetween(Window.unboundedPreceding, 0))
        weights = saved(self._weights(texts).withColumn("light", up_to < least))
        heavy, light = weights.where("not light"), weights.where("light")

        hits = self.blocks(heavy.select(_TERM)).join(heavy.select("query_id", *_TERM, "w"), _TERM).select("query_id", "w", F.explode("ids").alias("item_id"))
        scored = hits.groupBy("query_id", "item_id").agg(F.sum("w").alias("s"))
        if light.isEmpty():
            return self._best(scored, limit)
        scored = written(scored, "candidates")[0]
        rest = light.groupBy("query_id").agg(F.sum("w").alias("rest"))
        last = self._ranked(scored, limit).where(F.col("rank") == limit).select("query_id", F.col("s").alias("last"))
        near = scored.join(rest, "query_id", "left").join(last, "query_id", "left").where(F.col("s") + F.coalesce("rest", F.lit(0)) >= F.coalesce("last", F.lit(0)))
        near = saved(near.select("query_id", "item_id", "s"))
        asked = near.select("query_id", "item_id").join(light, "query_id").select("query_id", "item_id", *_TERM, "w", F.expr("shiftright(item_id, shift)").alias("cell"))
        blocks = self.blocks(asked.select(*_TERM, "cell"))
        there = (F.col("item_id") >= F.col("first")) & (F.col("item_id") <= F.col("last")) & F.array_contains("ids", F.col("item_id"))
        more = asked.join(blocks, [*_TERM, "cell"]).where(there).select("query_id", "item_id", F.col("w").alias("s"))
        return self._best(near.unionByName(more).groupBy("query_id", "item_id").agg(F.sum("s").alias("s")), limit)

    @staticmethod
    def _ranked(scored: DataFrame, limit: int) -> DataFrame:
        # each partition keeps its own best before rows of a text meet
        order = Window.partitionBy("query_id").orderBy(F.desc("s"), F.desc("item_id"))
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)

    def _best(self, scored: DataFrame, limit: int) -> DataFrame:
        return self._ranked(scored, limit).select("query_id", "rank", "item_id", (F.col("s") / UNIT).alias("score"))
