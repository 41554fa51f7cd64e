import numpy as np
import pytest

from ratingloom.operators import block_matrix, linalg
from ratingloom.operators.block_matrix import BlockMatrix


def frames(spark, a, b=None):
    entries = [(3 * int(i) - 20, 7 * int(j), float(a[i, j])) for i, j in np.argwhere(a)]
    out = spark.createDataFrame(entries, "i long, j long, v double")
    return out if b is None else (out, spark.createDataFrame([(3 * i - 20, float(v)) for i, v in enumerate(b)], "i long, v double"))


def sparse(seed, n, m, share=0.4):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, m)) * (rng.random((n, m)) < share), rng.normal(size=n)


def values(x):
    return {r["i"]: r["v"] for r in x.collect()}


@pytest.mark.parametrize("grid", [None, (1, 1), (3, 2), (4, 50)])
def test_products_equal_numpy(spark, grid):
    a, b = sparse(1, 40, 9)
    a[7] = 0
    entries, y = frames(spark, a, b)
    m = BlockMatrix.from_entries(entries, grid=grid)
    x = spark.createDataFrame([(7 * j, float(j + 1)) for j in range(9)] + [(99, 5.0)], "i long, v double")
    want = a @ np.arange(1.0, 10)
    got = values(m.times(x))
    assert 1 not in got and all(np.isclose(got[3 * i - 20], want[i]) for i in range(40) if i != 7)
    got = values(m.transpose().times(y))
    assert np.allclose([got[7 * j] for j in range(9)], a.T @ b)
    back = {(r["i"], r["j"]): r["v"] for r in m.entries().collect()}
    assert back == {(3 * i - 20, 7 * j): a[i, j] for i, j in np.argwhere(a).tolist()}
    turned = {(r["j"], r["i"]): r["v"] for r in m.transpose().entries().collect()}
    assert turned == back
    assert values(linalg.spmv(m.entries(), x)).keys() == values(m.times(x)).keys()


def test_hot_rows_are_cut_and_repeated_entries_added_up(spark):
    rows = [(5, j, 1.0) for j in range(300)] * 2 + [(i, 3, 0.5) for i in range(20)] + [(None, 1, 1.0), (1, None, 1.0), (1, 1, None)]
    entries = spark.createDataFrame(rows, "i long, j long, v double")
    m = BlockMatrix.from_entries(entries, grid=(2, 2), block=50)
    assert m.n_blocks > 8 and max(r["entries"] for r in m.blocks.collect()) < 100
    x = spark.range(300).selectExpr("id AS i", "1.0D AS v")
    got = values(m.times(x))
    assert got[5] == 600.5 and got[0] == 0.5


def test_dense_and_empty_matrices(spark):
    dense = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, [0.0, 0.0, 0.0]), (4, [0.0, 3.0, 0.0])], "i long, x array<double>")
    m = BlockMatrix.from_dense(dense)
    assert sorted(map(tuple, m.entries().collect())) == [(1, 0, 1.0), (1, 2, 2.0), (4, 1, 3.0)]
    empty = BlockMatrix.from_dense(dense.limit(0))
    b = spark.createDataFrame([(1, 1.0)], "i long, v double")
    assert empty.times(b).count() == 0 and empty.entries().count() == 0
    for solve in (block_matrix.lsqr, block_matrix.lsmr, block_matrix.cg):
        assert solve(empty, b).x.count() == 0
    zero = block_matrix.lsqr(m, b.selectExpr("i", "0.0D AS v"))
    assert zero.stop == "zero" and values(zero.x) == {0: 0.0, 1: 0.0, 2: 0.0}


def test_sorted_rows():
    rng = np.random.default_rng(0)
    i, j, v = rng.integers(0, 6, 40), rng.integers(0, 5, 40), rng.normal(size=40)
    dense = np.zeros((6, 5))
    np.add.at(dense, (i, j), v)
    rows, starts, columns, values_ = block_matrix.compressed(i, j, v)
    assert (np.diff(rows) > 0).all() and all((np.diff(c) > 0).all() for c in np.split(columns, starts[1:]))
    x = rng.normal(size=5)
    assert np.allclose(block_matrix.multiplied((rows, starts, columns, values_), x, 6), dense @ x)


def test_no_entry_is_shuffled_by_a_product(spark):
    a, b = sparse(2, 50, 8)
    m = BlockMatrix.from_entries(frames(spark, a), grid=(2, 2))
    plan = m.partial(m.columns.vector(spark.createDataFrame([(0, 1.0)], "i long, v double")))._jdf.queryExecution().executedPlan().toString()
    # blocks are read in the tasks: what moves are parts of x with the names of the blocks that need them
    exchanged = [line for line in plan.split("\n") if "Exchange hashpartitioning(block" in line]
    assert len(exchanged) == 1 and not any(column in plan for column in ("i_at", "j_at", "starts", "columns array", "j#"))


@pytest.mark.parametrize("solve", [block_matrix.lsqr, block_matrix.lsmr])
def test_least_squares_and_estimates(spark, solve):
    a, b = sparse(3, 40, 6, 0.6)
    entries, y = frames(spark, a, b)
    found = solve(BlockMatrix.from_entries(entries, grid=(2, 2)), y, atol=1e-12, btol=1e-12)
    got = values(found.x)
    x = np.array([got[7 * j] for j in range(6)])
    assert np.allclose(x, np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-8)
    r = b - a @ x
    assert np.isclose(found.residual, np.linalg.norm(r)) and np.isclose(found.size, np.linalg.norm(x)) and found.gradient < 1e-8
    assert found.stop == "least squares" and found.rounds <= 10 and 0.3 * np.linalg.norm(a) < found.norm < 10 * np.linalg.norm(a)


def test_bidiagonalisation_goes_on_where_conjugate_gradients_stall(spark):
    """Columns of sizes 1 to 1e-4: squared, their condition number leaves conjugate gradients with a wrong x."""
    a, _ = sparse(4, 30, 5, 1.0)
    a = np.linalg.qr(a)[0] * 10.0 ** np.array([0, -1, -2, -3, -4])
    x = np.array([1.0, -2.0, 3.0, -4.0, 5.0])
    entries, y = frames(spark, a, a @ x)
    m = BlockMatrix.from_entries(entries)
    of = lambda found: np.array([values(found.x)[7 * j] for j in range(5)])
    stalled = np.abs(of(block_matrix.cg(m, y)) - x).max()
    assert stalled > 1
    for solve in (block_matrix.lsqr, block_matrix.lsmr):
        assert np.abs(of(solve(m, y, atol=1e-14, btol=1e-14, conlim=0)) - x).max() < 1e-4


def test_condition_limit_stops(spark):
    a = np.diag([1.0, 1e-3, 1e-6])
    entries, y = frames(spark, a, np.ones(3))
    assert block_matrix.lsqr(BlockMatrix.from_entries(entries), y, atol=0, btol=0, conlim=10).stop == "condition"


def test_conjugate_gradients_equal_those_over_rows(spark):
    a, b = sparse(5, 30, 5, 0.8)
    entries, y = frames(spark, a, b)
    found = block_matrix.cg(BlockMatrix.from_entries(entries, grid=(2, 1)), y)
    x, rounds, rr = linalg.cg_least_squares(entries, y)
    assert found.rounds == rounds and np.isclose(found.gradient, rr**0.5, atol=1e-6)
    assert np.allclose([values(found.x)[7 * j] for j in range(5)], [values(x)[7 * j] for j in range(5)], atol=1e-6)


def test_entries_are_shuffled_once(spark, monkeypatch):
    """No entry is joined to its numbers: what is dealt to the blocks is as it was given, and the rest is small."""
    a, b = sparse(6, 60, 12)
    plans, plain = [], block_matrix.written

    def seen(df, kind):
        plans.append((kind, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, kind)

    monkeypatch.setattr(block_matrix, "written", seen)
    BlockMatrix.from_entries(frames(spark, a), grid=(3, 2))
    of = next(plan for kind, plan in plans if kind == "matrix-blocks")
    assert "SortMergeJoin" not in of and "i_at" not in of and of.count("Exchange hashpartitioning(r") <= 2


@pytest.mark.parametrize(("sizes", "blocks", "want"), [([10, 10], 1, (1, 1)), ([54_000_000, 7_200_000], 206, (52, 7)), ([1000, 1000], 16, (4, 4)), ([100, 0], 1, (1, 1))])
def test_grids_ship_little(sizes, blocks, want):
    assert block_matrix._grid(sizes, blocks, 1 << 20) == want
