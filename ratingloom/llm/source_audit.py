"""How sources differ in the terms they use, by systolic rotation.

Terms are counted by language and source; a language keeps the terms that enough of its documents hold, numbers
them, and cuts the numbers into blocks. Its sources are numbered too, and cut into cells of a few. What a cell's
sources say of a block's terms is written once as a compressed file of term numbers and probabilities: the
resident. Residents of one block then meet as in a round-robin tournament: in each round a resident's task reads
the file of the peer that the schedule names, one at a time, and a meeting gives the divergences of all pairs of
their sources, in both directions. Each pair of cells meets once, at one of the two, which of them alternates.

What a task holds is bounded by the sizes of blocks and cells, however many terms and sources there are, and
however large one source is. As a source's terms pass on their way into a file, a heap of the block's most
divergent ones is kept; the few of each block are ranked at the end.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import new_file, new_folder, open_fs, saved, slices, stored

#: A term, in lower-cased UTF-8: letters A to Z and everything beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE, SMOOTH = 1_000_000_000, 2
#: Distinct (language, source, term) that a task holds before it sends them on; 200 characters of text count as one more, as terms can be long.
HELD = 400_000
#: Terms of a block, sources of a cell, rounds of one task.
BLOCK, CELL, ROUNDS = 1 << 14, 16, 64

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"
_VECTORS = pa.schema([("source", pa.string()), ("absent", pa.int64()), ("size", pa.int64()), ("codes", pa.list_(pa.int32())), ("p", pa.list_(pa.int64()))])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term; a row with a null term for each group.

    Nulls of text, lang and source are ''. Counts are added up in the task before they are sent, so that a hot
    source or term is a few rows a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        seen, size = set(), 0

        def sent() -> pa.RecordBatch:
            columns = [[], [], [], [], []]
            for (lang, source), (n, docs_) in held.items():
                terms = list(n)
                columns[2].append(pa.array(terms, pa.binary()).cast(pa.string()))
                columns[3].append(pa.array(n.values(), pa.int64()))
                columns[4].append(pa.array(map(docs_.__getitem__, terms), pa.int64(), size=len(terms)))
                if (lang, source) not in seen:
                    seen.add((lang, source))
                    columns[2].append(pa.nulls(1, pa.string()))
                    columns[3].append(pa.array([0]))
                    columns[4].append(pa.array([0]))
                rows = sum(map(len, columns[2])) - sum(map(len, columns[0]))
                columns[0].append(pa.repeat(pa.scalar(lang, pa.string()), rows))
                columns[1].append(pa.repeat(pa.scalar(source, pa.string()), rows))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["lang", "source", "term", "n", "docs"])

        for batch in slices(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                n, docs_ = held[lang, source]
                words = TERM.findall(text.encode("utf-8", "surrogatepass").lower())
                before = len(n)
                n.update(words)
                docs_.update(set(words))
                size += len(n) - before + len(text) // 200
                if size > HELD:
                    yield sent()
                    size = 0
        if held:
            yield sent()

    empty = F.lit("")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text"))).mapInArrow(run, _COUNTS)
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def numbered(rows: DataFrame, group: str, key: str) -> DataFrame:
    """rows (group, key, ...) with ``id``: places from 0 in the order of key within each group.

    Rows are dealt by ranges; a range's numbers follow those of the group's ranges before it, whose sizes an
    aggregate tells: a row for each range and group in it.
    """
    # the lower 33 bits of this id number the rows of a partition
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = saved(rows.repartitionByRange(group, key).sortWithinPartitions(group, key).select("*", F.spark_partition_id().alias("__part"), within.alias("__k")))
    sizes = placed.groupBy("__part", group).agg(F.count("*").alias("__n"), F.min("__k").alias("__least"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select(F.col("__part").alias("__p"), F.col(group).alias("__g"), (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__least")).alias("__start"))
    joined = placed.join(start, (F.col("__part") == F.col("__p")) & (F.col(group) == F.col("__g")))
    return joined.select(*rows.columns, (F.col("__start") + F.col("__k")).alias("id"))


def probability(count: str, total: str, terms: str) -> F.Column:
    """1 + floor(SCALE (count + 2) / (total + 2 terms)), exact at any count."""
    below = f"({total} + {SMOOTH} * {terms})"
    small = f"({SCALE} * ({count} + {SMOOTH})) div {below}"
    large = f"cast(cast({count} + {SMOOTH} as decimal(19,0)) * cast({SCALE} as decimal(10,0)) as decimal(29,0)) div cast({below} as decimal(19,0))"
    return F.expr(f"1 + CASE WHEN {count} < 9000000000 THEN {small} ELSE {large} END")


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); p and q are at most 1e9 + 1, so that 64 bits hold it all."""
    d = p - q
    return d * d // (p + q)


def _resident(folder: str, lang: int, block: int, cell: int) -> str:
    return f"{folder}/{lang:06d}/{block:06d}/cell-{cell:08d}"


def _write(rows: DataFrame, folder: str, top: int) -> DataFrame:
    """Residents' files from rows (lang_id, block, cell, lang, source, absent, size, code, term, p, q); the heaps' terms as (lang, source, item, value).

    Rows come by (lang_id, block, cell), one whole in one task, by source and code within it; a row without a
    code tells that the source is there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang_id", "block", "cell", "lang", "source", "absent", "size", "code", "term", "p", "q"]
        whole = (r for b in batches for s in range(0, b.num_rows, 4096) for r in zip(*(b.slice(s, 4096).column(b.schema.get_field_index(c)).to_pylist() for c in names)))
        for (lang_id, block, cell), of_cell in itertools.groupby(whole, lambda r: r[:3]):
            vectors, best = [], []
            for (lang, source), of_source in itertools.groupby(of_cell, lambda r: r[3:5]):
                codes, ps, absent, size, heap = [], [], 1, 0, []
                for *_, absent, size, code, term, p, q in of_source:
                    if code is None:
                        continue
                    codes.append(code)
                    ps.append(p)
                    if p > q:
                        heap.append(((p - q) * (p - q) // (p + q), term))
                        if len(heap) > 4096:
                            heap = heapq.nsmallest(top, heap, key=lambda x: (-x[0], x[1].encode("utf-8", "surrogatepass")))
                vectors.append((source, absent, size, codes, ps))
                best += [(lang, source, term, f) for f, term in heapq.nsmallest(top, heap, key=lambda x: (-x[0], x[1].encode("utf-8", "surrogatepass")))]
            with new_file(_resident(folder, lang_id, block, cell)) as out, pa.ipc.new_stream(out, _VECTORS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as sink:
                sink.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*vectors), _VECTORS)], schema=_VECTORS))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*best) if best else [()] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "source", "item", "value"])

    return rows.mapInArrow(run, "lang string, source string, item string, value bigint")


class _Cell:
    """A resident in memory: its sources, and their term numbers and probabilities."""

    def __init__(self, uri: str):
        files, path = open_fs(uri)
        with files.open_input_stream(path) as source:
            table = pa.ipc.open_stream(source).read_all().combine_chunks()
        self.names = table.column("source").to_pylist()
        self.absent = np.asarray(table.column("absent"))
        self.size = int(table.column("size")[0].as_py())
        self.codes = [np.asarray(c.values) for c in table.column("codes")]
        self.p = [np.asarray(c.values) for c in table.column("p")]

    def dense(self, used: np.ndarray) -> np.ndarray:
        """A row for each source, a column for each number of ``used``."""
        out = np.repeat(self.absent[:, None], len(used), axis=1)
        for row, codes, p in zip(out, self.codes, self.p):
            row[np.searchsorted(used, codes)] = p
        return out


def meeting(a: _Cell, b: _Cell | None) -> Iterator[tuple[str, str, int]]:
    """(source, other, divergence over the block) of all pairs of two residents, or (b is None) within one, in both directions."""
    used = np.unique(np.concatenate([*a.codes, *(b.codes if b else ())]).astype(np.int64)) if a.codes else np.zeros(0, np.int64)
    left = a.dense(used)
    right = b.dense(used) if b else left
    names, absent = (b or a).names, (b or a).absent
    for i, own in enumerate(a.names):
        first = 0 if b else i + 1
        # terms of the block that neither cell has all have one value for a pair
        values = divergence(left[i], right[first:]).sum(axis=1) + (a.size - len(used)) * divergence(a.absent[i], absent[first:])
        for other, value in zip(names[first:], values.tolist()):
            yield own, other, value
            yield other, own, value


def opponent(cell: int, cells: int, turn: int) -> int | None:
    """Whom a cell meets in a turn of the tournament: of an odd number of cells one rests (None)."""
    even = cells + cells % 2
    if cell == even - 1:
        # the last one meets the cell that would meet itself
        other = turn * (even // 2) % (even - 1)
    else:
        other = (turn - cell) % (even - 1)
        other = even - 1 if other == cell else other
    return other if other < cells else None


def is_host(cell: int, other: int) -> bool:
    """Whether a meeting of two cells is at the first one's; it is at one of them, by turns the smaller and the larger."""
    return (cell < other) == ((cell + other) % 2 == 1)


def _tournament(residents: DataFrame, folder: str) -> DataFrame:
    """(lang, source, item, value): what all meetings of residents (lang_id, lang, block, cell, cells, turns from, to) give, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = lambda cell: _Cell(_resident(folder, r["lang_id"], r["block"], cell))  # noqa: B023, E731
                own = at(r["cell"])
                for turn in range(r["first"], r["stop"]):
                    # turn -1 is the meeting of a cell's own sources
                    other = None if turn < 0 else opponent(r["cell"], r["cells"], turn)
                    if turn >= 0 and (other is None or not is_host(r["cell"], other)):
                        continue
                    rows = list(meeting(own, None if turn < 0 else at(other)))
                    if rows:
                        a, b, v = zip(*rows)
                        yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(a)), pa.array(a), pa.array(b), pa.array(v, pa.int64())], ["lang", "source", "item", "value"])

    return residents.mapInArrow(run, "lang string, source string, item string, value bigint")


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, block: int = BLOCK, cell: int = CELL, rounds: int = ROUNDS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source).

    Part "pair" has, for each group (lang, source) and each other source of the lang, the sum of the divergences
    of the lang's kept terms; part "term" the ``top`` kept terms that the group has and holds likelier than its
    lang does, by divergence. Ranks go from 1, value descending, items by UTF-8 ascending.

    Nulls of text, lang and source are '', so that null and empty are one group. A group without any term is a
    group too, and diverges by what absent terms give; a lang without kept terms has values of 0. One source
    alone has no pairs. Other columns aren't read. An empty table has no rows.
    """
    spark = docs.sparkSession
    counts = stored(term_counts(docs), "audit-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("q_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    terms = stored(numbered(kept.select("lang", "term", "q_n"), "lang", "term"), "audit-terms")
    of_langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("q_n").alias("q_total"))
    # one row for a group's term that its lang keeps; Spark splits the rows of a term that very many sources have
    own = counts.where("term is not null").select("lang", "source", "term", "n").join(terms, ["lang", "term"])
    own = stored(own, "audit-own")
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = numbered(counts.where("term is null").select("lang", "source"), "lang", "source").withColumnRenamed("id", "number")
    langs = numbered(groups.groupBy("lang").agg(F.count("*").alias("sources")).withColumn("all", F.lit(0)), "all", "lang").select("lang", F.col("id").alias("lang_id"), "sources")
    langs = langs.join(of_langs, "lang", "left").fillna(0, ["terms", "q_total"])
    groups = groups.join(sums, ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang")
    groups = stored(groups.withColumn("absent", F.when(F.col("terms") == 0, 1).otherwise(probability("0", "total", "terms"))).withColumn("cell", F.floor(F.col("number") / cell)), "audit-groups")
    blocks = F.greatest(F.ceil(F.col("terms") / block), F.lit(1))
    at = lambda b: F.greatest(F.least(F.col("terms") - b * block, F.lit(block)), F.lit(0))
    there = groups.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), (blocks - 1).cast("bigint"))).alias("block"))
    there = there.select("lang_id", "block", "cell", "lang", "source", "absent", at(F.col("block")).alias("size"), *(F.lit(None).cast(t).alias(c) for c, t in (("code", "bigint"), ("term", "string"), ("p", "bigint"), ("q", "bigint"))))
    said = own.join(groups, ["lang", "source"]).withColumn("block", F.floor(F.col("id") / block))
    said = said.select("lang_id", "block", "cell", "lang", "source", "absent", at(F.col("block")).alias("size"), (F.col("id") % block).alias("code"), "term", probability("n", "total", "terms").alias("p"), probability("q_n", "q_total", "terms").alias("q"))
    folder = new_folder(spark, "audit-residents")
    dealt = there.unionByName(said).repartition("lang_id", "block", "cell").sortWithinPartitions("lang_id", "block", "cell", "source", "code")
    best = stored(_write(dealt, folder, top), "audit-terms")
    cells = F.ceil(F.col("sources") / cell)
    turns = F.when(cells > 1, cells + cells % 2 - 1).otherwise(0)
    residents = groups.select("lang_id", "lang", "cell", cells.alias("cells"), turns.alias("turns"), blocks.alias("blocks")).distinct()
    residents = residents.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("blocks") - 1).cast("bigint"))).alias("block"))
    residents = residents.select("lang_id", "lang", "block", "cell", "cells", "turns", F.explode(F.sequence(F.lit(-1).cast("bigint"), F.greatest(F.col("turns") - 1, F.lit(-1)).cast("bigint"), F.lit(rounds).cast("bigint"))).alias("first"))
    residents = residents.withColumn("stop", F.least(F.col("first") + rounds, F.col("turns"))).withColumn("stop", F.greatest("stop", F.col("first") + 1))
    pairs = _tournament(residents.repartition("lang_id", "block", "cell", "first"), folder).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    # Spark keeps the first ``top`` of each group in each task before they meet
    listed = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return ranked.unionByName(listed).select("lang", "source", "part", "item", "value", "rank")
