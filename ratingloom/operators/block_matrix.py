"""Sparse matrices cut into blocks that stay where they are, and least squares over them.

Rows and columns are dealt into parts by the hashes of their ids, a part's ids numbered in order. The entries that
a row part and a column part share are a block: compressed sparse rows, and beside them the same entries as
compressed rows of the transpose, both sorted once. A block is a file on shared storage. A vector is a row of
doubles for each part. A product ships each part of the vector to the blocks that need it, multiplies, and adds up
the parts that come out: entries are neither joined nor shuffled again.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..files import batches, erased, writer
from ..session import collected, new_folder, saved, written

#: Ids of a part and entries of a block, about.
PART, BLOCK = 1 << 20, 1 << 20
#: Blocks whose names are sent to all tasks; more of them are joined by a shuffle.
BROADCAST = 200_000
#: Blocks from which on the shuffles of each round are dropped before the next.
MANY = 1

_INTS, _DOUBLES = pa.list_(pa.int32()), pa.list_(pa.float64())
_IDS = pa.schema([("ids", pa.list_(pa.int64()))])
#: A block's rows: the numbers of those that aren't empty, where each one's entries begin, and their columns and values.
_FILE = pa.schema([("transposed", pa.bool_()), ("rows", _INTS), ("starts", _INTS), ("columns", _INTS), ("values", _DOUBLES)])


@dataclasses.dataclass(frozen=True)
class Parts:
    """Ids dealt into ``n`` parts: ids (part, ids array<bigint>), each part's in order."""

    n: int
    ids: DataFrame

    @staticmethod
    def of(ids: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(ids), F.lit(n)).cast("int")

    def numbers(self) -> DataFrame:
        """(id, part, pos)."""
        return self.ids.select("part", F.posexplode("ids").alias("pos", "id")).select("id", "part", "pos")

    def vector(self, rows: DataFrame) -> DataFrame:
        """(part, v): rows (i, v) as arrays; entries of one id are added up, missing ones are 0, unknown ids left out."""
        given = rows.where("i is not null and v is not null").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("v").cast("double")).alias("v"))
        placed = self.numbers().join(given, "id", "left").select("part", "pos", F.coalesce("v", F.lit(0.0)).alias("v"))
        return placed.repartition("part").sortWithinPartitions("part", "pos").mapInArrow(_collected("v", pa.float64()), "part int, v array<double>")

    def rows(self, vector: DataFrame, column: str = "v") -> DataFrame:
        """(i, v) of a vector (part, v)."""
        both = self.ids.join(vector.select("part", F.col(column).alias("__v")), "part")
        return both.select(F.explode(F.arrays_zip(F.col("ids").alias("i"), F.col("__v").alias("v"))).alias("e")).select("e.i", "e.v")


def _runs(keys: np.ndarray) -> np.ndarray:
    """The places at which runs of equal rows of a matrix begin."""
    return np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else np.zeros(0, np.int64)


def _by_key(source: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """(key, batches) of consecutive rows with one key of integers."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in source:
        if batch.num_rows:
            values = np.stack([np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys], axis=1)
            cuts = [*_runs(values).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(values[a].tolist())
                if last is not None and key != last:
                    yield last, held
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
    if last is not None:
        yield last, held


def _column(rows: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([np.asarray(b.column(b.schema.get_field_index(name))) for b in rows])


def _collected(name: str, kind: pa.DataType) -> Callable:
    """For mapInArrow: the values of each part, which come in order, as one array."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), rows in _by_key(source, ("part",)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_column(rows, name)], pa.list_(kind))], ["part", name])

    return run


def _parts(ids: DataFrame, n: int, files: str) -> Parts:
    """ids (id), distinct, dealt into n parts, each of which is also a file ``files``-<part>."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _collected("ids", pa.int64())(source):
            with writer(f"{files}-{batch.column(0)[0].as_py()}", _IDS) as sink:
                sink.write_batch(pa.RecordBatch.from_arrays([batch.column(1)], schema=_IDS))
            yield batch

    dealt = ids.select(Parts.of(F.col("id"), n).alias("part"), F.col("id").alias("ids")).repartition("part").sortWithinPartitions("part", "ids")
    return Parts(n, saved(dealt.mapInArrow(run, "part int, ids array<bigint>")))


def _grid(sizes: list[int], blocks: int, part: int) -> tuple[int, int]:
    """Parts of rows and of columns, of at most ``part`` ids, that make as many blocks and let a product ship least: each part of one side goes to all of the other."""
    rows, columns = (max(1, math.ceil(n / part)) for n in sizes)
    rows = max(rows, min(blocks, math.ceil(math.sqrt(blocks * sizes[0] / max(1, sizes[1])))))
    return rows, max(columns, math.ceil(blocks / rows))


def compressed(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, starts, columns, values) of entries, sorted by row and column, entries of one place added up."""
    order = np.lexsort((columns, rows))
    at = np.stack([rows[order], columns[order]], axis=1)
    first = _runs(at)
    at, values = at[first], np.add.reduceat(values[order], first) if len(first) else values
    begins = _runs(at[:, :1])
    return at[begins, 0], begins, at[:, 1], values


def multiplied(block: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, n: int) -> np.ndarray:
    """The block times x, n numbers."""
    rows, starts, columns, values = block
    out = np.zeros(n)
    if len(rows):
        out[rows] = np.add.reduceat(values * x[columns], starts)
    return out


@dataclasses.dataclass(frozen=True)
class BlockMatrix:
    """blocks (block, r, c, rows, columns, entries): a row for each file ``folder``/block-<block>; rows and columns are the sizes of the parts."""

    rows: Parts
    columns: Parts
    blocks: DataFrame
    folder: str
    n_blocks: int
    turned: bool = False

    @classmethod
    def from_entries(cls, entries: DataFrame, grid: tuple[int, int] | None = None, block: int = BLOCK, part: int = PART) -> BlockMatrix:
        """From rows (i, j, v), i and j any integers; entries of one place are added up, rows with a null left out.

        The grid is fine enough that a block has about ``block`` entries and a part ``part`` ids. Where a hot row or
        column gives a block more, it is cut into several by the hash of the place. Entries are shuffled once, as they
        are; a block finds the numbers of its ids in its parts' files.
        """
        spark = entries.sparkSession
        entries, given = written(entries.where("i is not null and j is not null and v is not null").select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v")), "entries")
        ids, folders = zip(*(written(entries.select(F.col(c).alias("id")).distinct(), "ids") for c in "ij"))
        sizes = [d.count() for d in ids]
        collected(spark)
        if grid is None:
            grid = _grid(sizes, max(1, math.ceil(entries.count() / block)), part)
        folder = new_folder(spark, "matrix")
        rows, columns = (_parts(d, max(1, min(n, size)), f"{folder}/{name}") for d, n, size, name in zip(ids, grid, sizes, ("rows", "columns")))
        placed = entries.select(Parts.of(F.col("i"), rows.n).alias("r"), Parts.of(F.col("j"), columns.n).alias("c"), "i", "j", "v")
        # at most a row for each place of the grid, which is small beside the entries
        pieces = placed.groupBy("r", "c").agg(F.ceil(F.count("*") / block).alias("pieces"))
        pieces = F.broadcast(pieces) if rows.n * columns.n <= BROADCAST else pieces
        placed = placed.join(pieces, ["r", "c"]).select("r", "c", F.pmod(F.xxhash64("i", "j"), F.col("pieces")).cast("int").alias("piece"), "i", "j", "v")

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, of in _by_key(source, ("r", "c", "piece")):
                known = (np.asarray(next(batches(f"{folder}/{name}-{k}")).column(0)[0].values) for name, k in zip(("rows", "columns"), key))
                i, j = (np.searchsorted(ids, _column(of, name)).astype(np.int32) for ids, name in zip(known, "ij"))
                v = _column(of, "v")
                with writer(f"{folder}/block-{key[0]}-{key[1]}-{key[2]}", _FILE) as sink:
                    for turned, a, b in ((False, i, j), (True, j, i)):
                        arrays = [pa.array([x], f.type) for x, f in zip(compressed(a, b, v), list(_FILE)[1:])]
                        sink.write_batch(pa.RecordBatch.from_arrays([pa.array([turned]), *arrays], schema=_FILE))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()) for k in key] + [pa.array([len(v)])], ["r", "c", "piece", "entries"])

        sizes = lambda side, name, out: side.ids.select(F.col("part").alias(name), F.size("ids").alias(out))
        each = placed.repartition("r", "c", "piece").sortWithinPartitions("r", "c", "piece").mapInArrow(run, "r int, c int, piece int, entries bigint")
        blocks = written(each, "matrix-blocks")[0].join(sizes(rows, "r", "rows"), "r").join(sizes(columns, "c", "columns"), "c")
        named = blocks.select(F.concat_ws("-", "r", "c", "piece").alias("block"), "r", "c", "rows", "columns", "entries")
        named = saved(named)
        for used in (given, *folders):
            erased(spark, used)
        collected(spark)
        return cls(rows, columns, named, folder, named.count())

    @classmethod
    def from_dense(cls, rows: DataFrame, **how) -> BlockMatrix:
        """From rows (i, x array<double>); zeros are no entries."""
        each = rows.select("i", F.posexplode("x").alias("j", "v")).where("v <> 0")
        return cls.from_entries(each.select("i", "j", "v"), **how)

    def transpose(self) -> BlockMatrix:
        """The transpose, over the same files: both orders of a block's entries were written."""
        return dataclasses.replace(self, rows=self.columns, columns=self.rows, turned=not self.turned)

    def entries(self) -> DataFrame:
        """(i, j, v): the matrix as rows again."""
        folder, turned = self.folder, self.turned

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                for name, r, c in zip(*(x.to_pylist() for x in batch.columns)):
                    rows, starts, columns, values = _block(folder, name, turned)
                    each = np.repeat(rows, np.diff(np.append(starts, len(columns))))
                    whole = [np.full(len(columns), r, np.int32), np.full(len(columns), c, np.int32), each, columns, values]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in whole], ["r", "c", "i_at", "j_at", "v"])

        r, c = ("c", "r") if turned else ("r", "c")
        found = self.blocks.select("block", r, c).mapInArrow(run, "r int, c int, i_at int, j_at int, v double")
        side = lambda parts, names: parts.numbers().toDF(*names)
        return found.join(side(self.rows, ("i", "r", "i_at")), ["r", "i_at"]).join(side(self.columns, ("j", "c", "j_at")), ["c", "j_at"]).select("i", "j", "v")

    def partial(self, x: DataFrame, factor: float = 1.0) -> DataFrame:
        """(part, v): what each block gives of factor times the matrix times x (part, v), still to be added up by part.

        Only parts of x move: each to the blocks that need it.
        """
        folder, turned = self.folder, self.turned
        need, give, n = ("r", "c", "columns") if turned else ("c", "r", "rows")
        needs = self.blocks.select("block", F.col(need).alias("part"), F.col(give).alias("to"), F.col(n).alias("n"))
        shipped = x.select("part", "v").join(F.broadcast(needs) if self.n_blocks <= BROADCAST else needs, "part").select("block", "to", "n", "v").repartition(max(1, min(self.n_blocks, 4 * x.sparkSession.sparkContext.defaultParallelism)), "block")

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                for k in range(batch.num_rows):
                    name, to, n = (batch.column(c)[k].as_py() for c in range(3))
                    out = multiplied(_block(folder, name, turned), factor * np.asarray(batch.column(3)[k].values), n)
                    yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([out], _DOUBLES)], ["part", "v"])

        return shipped.mapInArrow(run, "part int, v array<double>")

    def settle(self) -> None:
        """Drop what the products so far have shuffled; for between a solver's rounds, where there is much of it."""
        if self.n_blocks > MANY:
            collected(self.blocks.sparkSession)

    def times(self, x: DataFrame) -> DataFrame:
        """(i, v): the matrix times x (j as i, v); rows without entries have no row."""
        return self.rows.rows(_summed(self.partial(self.columns.vector(x)), 1.0, 0.0))


def _block(folder: str, name: str, turned: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    of = next(b for b in batches(f"{folder}/block-{name}") if b.column(0)[0].as_py() == turned)
    return tuple(np.asarray(of.column(k)[0].values) for k in range(1, 5))


#: What a step makes of a part's vector and of the vectors beside it.
Update = Callable[[np.ndarray, list[np.ndarray]], list[np.ndarray]]


def _summed(parts: DataFrame, own: float, old: float, state: DataFrame | None = None, beside: tuple[str, ...] = (), update: Update = lambda v, beside: beside) -> DataFrame:
    """(part, v, beside..., squares): own times the sum of each part's vectors, plus old times the state's.

    state has (part, v, beside...), a row for each part; update makes new vectors beside from the state's. Squares
    are the squared norms of v and of those beside, as an array.
    """
    names = ["v", *beside]
    rows = parts.select("part", "v", *(F.lit(None).cast("array<double>").alias(b) for b in beside), F.lit(False).alias("held"))
    if state is not None:
        rows = rows.unionByName(state.select("part", *names, F.lit(True).alias("held")))
    schema = ", ".join(["part int", *(f"{c} array<double>" for c in names), "squares array<double>"])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), of in _by_key(source, ("part",)):
            total, before = None, None
            for batch in of:
                for k in range(batch.num_rows):
                    arrays = [np.asarray(x.values) for x in (batch.column(c)[k] for c in range(1, 1 + len(names))) if x.is_valid]
                    if batch.column(len(names) + 1)[k].as_py():
                        before = arrays
                    else:
                        total = own * arrays[0] if total is None else total + own * arrays[0]
            new = update(before[0], before[1:]) if before is not None else []
            if before is not None and old:
                total = old * before[0] if total is None else total + old * before[0]
            if total is None:
                total = np.zeros(len(before[0]))
            out = [total, *new]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], _DOUBLES) for x in out), pa.array([[float(x @ x) for x in out]], _DOUBLES)], ["part", *names, "squares"])

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


class _Vectors:
    """A distributed vector and those beside it, as the rounds of a solver change them."""

    def __init__(self, rows: DataFrame, beside: tuple[str, ...] = ()):
        self.beside, self.rows, self.folder, self.squares = beside, None, None, []
        self.put(rows)

    def put(self, rows: DataFrame) -> None:
        """Replace the vectors: the new ones are written, and the old ones' files deleted."""
        last = self.folder
        self.rows, self.folder = written(rows, "vectors")
        sums = self.rows.agg(*(F.sum(F.get("squares", F.lit(k))).alias(f"s{k}") for k in range(1 + len(self.beside)))).first()
        self.squares = [float(x or 0.0) for x in sums]
        if last:
            erased(rows.sparkSession, last)

    def step(self, parts: DataFrame, own: float, old: float, update: Update = lambda v, beside: beside) -> float:
        """v becomes own times the sum of parts plus old times v; the norm of the new v."""
        self.put(_summed(parts, own, old, self.rows, self.beside, update))
        return math.sqrt(self.squares[0])


@dataclasses.dataclass(frozen=True)
class Solution:
    """x (i, v); why and after how many rounds it ended; estimates of |b - A x|, |A'(b - A x)|, |A|, cond(A) and |x|."""

    x: DataFrame
    stop: str
    rounds: int
    residual: float
    gradient: float
    norm: float
    condition: float
    size: float


def _start(matrix: BlockMatrix, b: DataFrame, beside: tuple[str, ...]) -> tuple[_Vectors, float, _Vectors, float]:
    """u = b and v = A'u, with their norms; vectors beside v begin as 0."""
    squared = F.array(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    u = _Vectors(matrix.rows.vector(b).withColumn("squares", squared))
    beta = math.sqrt(u.squares[0])
    zero = F.transform("v", lambda x: F.lit(0.0))
    first = _summed(matrix.transpose().partial(u.rows, 1 / beta if beta else 0.0), 1.0, 0.0)
    v = _Vectors(first.select("part", "v", *(zero.alias(c) for c in beside), F.concat("squares", F.array_repeat(F.lit(0.0), len(beside))).alias("squares")), beside)
    return u, beta, v, math.sqrt(v.squares[0])


def _stopped(atol: float, btol: float, conlim: float, b: float, residual: float, gradient: float, norm: float, condition: float, size: float) -> str | None:
    """The published rules: which one is met."""
    if residual <= btol * b + atol * norm * size:
        return "compatible"
    if gradient <= atol * norm * residual:
        return "least squares"
    if conlim and condition >= conlim:
        return "condition"
    return None


def lsqr(matrix: BlockMatrix, b: DataFrame, atol: float = 1e-6, btol: float = 1e-6, conlim: float = 1e8, max_rounds: int = 1000) -> Solution:
    """x with least |b - A x| by Golub-Kahan bidiagonalisation and a QR factorisation that is carried along.

    b is (i, v). A round is two products; u, v and the search direction stay distributed and are not normalised
    but carry their norms, so that each is passed over once a round, and x and the direction follow a step
    behind. The driver gets three numbers a round. A b or A'b of 0 has x = 0. conlim of 0 sets no such limit.
    """
    u, beta, v, alpha = _start(matrix, b, ("w", "x"))
    turned, size_b = matrix.transpose(), beta
    found = (beta, alpha * beta, 0.0, 0.0, 0.0)
    if not alpha * beta:
        return Solution(matrix.columns.rows(v.rows, "x"), "zero", 0, *found)
    phi_bar, rho_bar, norm_2, directions, size_2, z, c2, s2 = beta, alpha, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0
    along, over = 0.0, 0.0  # x += along * w, then w = v - over * w, applied when v is passed over next

    def caught_up(along: float, over: float, scale: float) -> Update:
        def update(v: np.ndarray, beside: list[np.ndarray]) -> list[np.ndarray]:
            w, x = beside
            return [scale * v - over * w, x + along * w]

        return update

    stop, n = "rounds", 0
    for n in range(1, max_rounds + 1):
        before = alpha
        matrix.settle()
        beta = u.step(matrix.partial(v.rows, 1 / alpha), 1.0, -alpha / beta)
        norm_2 += alpha * alpha + beta * beta
        # without a beta the vectors beside v catch up, and v becomes 0
        parts, old = (turned.partial(u.rows, 1 / beta), -beta / before) if beta else (v.rows.select("part", "v").limit(0), 0.0)
        alpha = v.step(parts, 1.0, old, caught_up(along, over, 1 / before))
        rho = math.hypot(rho_bar, beta)
        c, s = rho_bar / rho, beta / rho
        theta, rho_bar, phi, phi_bar = s * alpha, -c * alpha, c * phi_bar, s * phi_bar
        along, over = phi / rho, theta / rho
        directions += v.squares[1] / rho**2
        delta, gamma_bar = s2 * rho, -c2 * rho
        size = math.sqrt(size_2 + ((phi - delta * z) / gamma_bar) ** 2)
        gamma = math.hypot(gamma_bar, theta)
        z, c2, s2 = (phi - delta * z) / gamma, gamma_bar / gamma, theta / gamma
        size_2 += z * z
        norm = math.sqrt(norm_2)
        found = (abs(phi_bar), alpha * abs(s * phi), norm, norm * math.sqrt(directions), size)
        stop = "exact" if not alpha * beta else _stopped(atol, btol, conlim, size_b, *found)
        if stop:
            break
    x = _summed(v.rows.select("part", "v"), 0.0, 0.0, v.rows, v.beside, caught_up(along, 0.0, 0.0))
    return Solution(saved(matrix.columns.rows(x, "x")), stop or "rounds", n, *found)


def _rotation(a: float, b: float) -> tuple[float, float, float]:
    """(c, s, r) that turn (a, b) to (r, 0)."""
    r = math.hypot(a, b)
    return (a / r, b / r, r) if r else (1.0, 0.0, 0.0)


def lsmr(matrix: BlockMatrix, b: DataFrame, atol: float = 1e-6, btol: float = 1e-6, conlim: float = 1e8, max_rounds: int = 1000) -> Solution:
    """As lsqr(), by a second QR factorisation, which lets |A'(b - A x)| fall in every round: it can be stopped earlier."""
    u, beta, v, alpha = _start(matrix, b, ("h", "h_bar", "x"))
    turned, size_b = matrix.transpose(), beta
    found = (beta, alpha * beta, 0.0, 0.0, 0.0)
    if not alpha * beta:
        return Solution(matrix.columns.rows(v.rows, "x"), "zero", 0, *found)
    zeta_bar, alpha_bar, rho, rho_bar, c_bar, s_bar, zeta = alpha * beta, alpha, 1.0, 1.0, 1.0, 0.0, 0.0
    beta_dd, beta_d, rho_d, tau, theta_tilde, norm_2 = beta, 0.0, 1.0, 0.0, 0.0, alpha * alpha
    most, least = 0.0, math.inf
    back, along, over = 0.0, 0.0, 0.0  # h_bar = h - back * h_bar, x += along * h_bar, h = v - over * h, a step behind

    def caught_up(back: float, along: float, over: float, scale: float) -> Update:
        def update(v: np.ndarray, beside: list[np.ndarray]) -> list[np.ndarray]:
            h, h_bar, x = beside
            h_bar = h - back * h_bar
            return [scale * v - over * h, h_bar, x + along * h_bar]

        return update

    stop, n = "rounds", 0
    for n in range(1, max_rounds + 1):
        before = alpha
        matrix.settle()
        beta = u.step(matrix.partial(v.rows, 1 / alpha), 1.0, -alpha / beta)
        parts, old = (turned.partial(u.rows, 1 / beta), -beta / before) if beta else (v.rows.select("part", "v").limit(0), 0.0)
        alpha = v.step(parts, 1.0, old, caught_up(back, along, over, 1 / before))
        rho_old, (c, s, rho) = rho, _rotation(alpha_bar, beta)
        theta_new, alpha_bar = s * alpha, c * alpha
        rho_bar_old, zeta_old, theta_bar, rho_temp = rho_bar, zeta, s_bar * rho, c_bar * rho
        c_bar, s_bar, rho_bar = _rotation(rho_temp, theta_new)
        zeta, zeta_bar = c_bar * zeta_bar, -s_bar * zeta_bar
        back, along, over = theta_bar * rho / (rho_old * rho_bar_old), zeta / (rho * rho_bar), theta_new / rho
        # the residual's norm, by a third factorisation
        beta_hat, beta_dd = c * beta_dd, -s * beta_dd
        theta_old, (c_tilde, s_tilde, rho_tilde) = theta_tilde, _rotation(rho_d, theta_bar)
        theta_tilde, rho_d, beta_d = s_tilde * rho_bar, c_tilde * rho_bar, c_tilde * beta_hat - s_tilde * beta_d
        tau = (zeta_old - theta_old * tau) / rho_tilde
        residual = math.hypot(beta_d - (zeta - theta_tilde * tau) / rho_d, beta_dd)
        norm_2 += beta * beta
        norm, norm_2 = math.sqrt(norm_2), norm_2 + alpha * alpha
        most, least = max(most, rho_bar_old), min(least, rho_bar_old) if n > 1 else least
        # the size of x as it was a step ago, which is what was passed over
        found = (residual, abs(zeta_bar), norm, max(most, rho_temp) / min(least, rho_temp), math.sqrt(v.squares[3]))
        stop = "exact" if not alpha * beta else _stopped(atol, btol, conlim, size_b, *found)
        if stop:
            break
    x = saved(_summed(v.rows.select("part", "v"), 0.0, 0.0, v.rows, v.beside, caught_up(back, along, 0.0, 0.0)))
    size = math.sqrt(x.agg(F.sum(F.get("squares", F.lit(3)))).first()[0] or 0.0)
    return Solution(saved(matrix.columns.rows(x, "x")), stop or "rounds", n, *found[:4], size)


def cg(matrix: BlockMatrix, b: DataFrame, tolerance: float = 1e-6, min_decrease: float = 0.01, max_rounds: int = 200) -> Solution:
    """x with least |b - A x| by conjugate gradients on the normal equations, with linalg.cg_least_squares' stopping rules.

    What the direction gives is carried along on the rows' side, so that only the residual of the normal
    equations is shipped.
    """
    u, beta, v, alpha = _start(matrix, b, ("p", "x"))
    turned, rr = matrix.transpose(), (alpha * beta) ** 2
    v.put(_summed(v.rows.select("part", "v"), beta, 0.0, v.rows, v.beside))  # A'b itself
    step, ratio, slow, n = 0.0, 0.0, 0, 0

    def caught_up(ratio: float, step: float) -> Update:
        def update(v: np.ndarray, beside: list[np.ndarray]) -> list[np.ndarray]:
            p = v + ratio * beside[0]
            return [p, beside[1] + step * p]

        return update

    while rr >= tolerance and n < max_rounds and slow < 2:
        matrix.settle()
        along = u.step(matrix.partial(v.rows), 1.0, ratio if n else 0.0)
        step = rr / along**2
        new = v.step(turned.partial(u.rows), -step, 1.0, caught_up(ratio, step)) ** 2
        slow = slow + 1 if new > (1 - min_decrease) * rr else 0
        ratio, rr, n = new / rr, new, n + 1
    stop = "least squares" if rr < tolerance else "rounds" if n == max_rounds else "slow"
    left = _summed(matrix.partial(v.rows.select("part", F.col("x").alias("v"))), -1.0, 1.0, matrix.rows.vector(b))
    residual = math.sqrt(left.agg(F.sum(F.get("squares", F.lit(0)))).first()[0] or 0.0)
    return Solution(saved(matrix.columns.rows(v.rows, "x")), stop, n, residual, math.sqrt(rr), 0.0, 0.0, math.sqrt(v.squares[2]))
