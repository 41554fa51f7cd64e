"""Sparse matrices as (i, j, v) rows and vectors as (i, v) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved


def spmv(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v): the matrix times x; rows without entries have no row."""
    right = x.select(F.col("i").alias("j"), F.col("v").alias("x"))
    return matrix.join(right, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def spmv_t(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v): the transposed matrix times x."""
    return spmv(transpose(matrix), x)


def axpby(a: float, x: DataFrame, b: float, y: DataFrame) -> DataFrame:
    """(i, v): a x + b y; a missing entry is 0. The entries are added up, so that neither side is joined."""
    both = x.select("i", (F.col("v") * F.lit(float(a))).alias("v")).unionByName(y.select("i", (F.col("v") * F.lit(float(b))).alias("v")))
    return both.groupBy("i").agg(F.sum("v").alias("v"))


def scale(a: float, x: DataFrame) -> DataFrame:
    return x.select("i", (F.col("v") * F.lit(float(a))).alias("v"))


def dot(x: DataFrame, y: DataFrame) -> float:
    """The dot product; a number, so the driver gets one row."""
    return x.join(y.select("i", F.col("v").alias("w")), "i").agg(F.sum(F.col("v") * F.col("w"))).first()[0] or 0.0


def column_counts(matrix: DataFrame) -> DataFrame:
    """(j, n): entries of each column."""
    return matrix.groupBy("j").agg(F.count("*").alias("n"))


def filled(spark, n: int, kind: str = "uniform", low: float = 0.0, high: float = 1.0, seed: int = 42) -> DataFrame:
    """(i, v) for i below n: uniform from low to high, or normal with mean low and deviation high."""
    value = F.rand(seed) * (high - low) + low if kind == "uniform" else F.randn(seed) * high + low
    return spark.range(n).select(F.col("id").alias("i"), value.alias("v"))


def cg_least_squares(matrix: DataFrame, b: DataFrame, min_r_decrease: float = 0.01, max_iter: int = 200, tolerance: float = 1e-6) -> tuple[DataFrame, int, float]:
    """(x, iterations, final_rr): x with least |matrix x - b| by conjugate gradients on the normal equations.

    Ends when the squared residual of the normal equations is below tolerance, or when twice running it
    falls by less than min_r_decrease. Vectors stay distributed and are kept on shared storage in each
    round; the driver gets two numbers of each.
    """
    residual = saved(spmv_t(matrix, b))
    x, direction, rr = scale(0.0, residual), residual, dot(residual, residual)
    slow = iterations = 0
    while rr >= tolerance and iterations < max_iter and slow < 2:
        along = saved(spmv_t(matrix, spmv(matrix, direction)))
        step = rr / dot(direction, along)
        x, residual = saved(axpby(1, x, step, direction)), saved(axpby(1, residual, -step, along))
        new = dot(residual, residual)
        slow = slow + 1 if new > (1 - min_r_decrease) * rr else 0
        direction, rr, iterations = saved(axpby(1, residual, new / rr, direction)), new, iterations + 1
    return x, iterations, rr
