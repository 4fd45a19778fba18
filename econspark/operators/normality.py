"""Normality tests on whole columns: Jarque–Bera and Shapiro–Wilk."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from econspark.functions.dist import norm_ppf, norm_sf, normal_quantile_sql
from econspark.plans.ranks import value_ranks
from econspark.schema import number

# Fixed polynomials of Royston's approximation (Applied Statistics algorithm R94, 1995).
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
NEXT_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_LIMIT = (-2.273, 0.459)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_SCALE = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_SCALE = (-0.4803, -0.082676, 0.0030302)

EXPLICIT_TAIL = 2_000  # ranks at either end whose normal scores are summed one by one


def jarque_bera(shape: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add the statistic, p-value and verdict to rows with ``n``, ``skew_pop``, ``kurt_pop``."""
    jb = F.col("n") / 6 * (F.col("skew_pop") * F.col("skew_pop") + F.col("kurt_pop") * F.col("kurt_pop") / 4)
    return (
        shape.withColumn("jb_stat", jb)
        .withColumn("jb_p_value", F.exp(-F.col("jb_stat") / 2))
        .withColumn("normal", F.col("jb_p_value") > alpha)
    )


def _poly(coefs, x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coefs))


def _density(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _score(i: float, n: int) -> float:
    """Blom's normal score of rank i."""
    return norm_ppf((i - 0.375) / (n + 0.25))


def _integral(lo: int, hi: int, n: int, antiderivative) -> float:
    """Σ over ranks lo..hi by the midpoint rule; exact to rounding away from the tails."""
    a, b = _score(lo - 0.5, n), _score(hi + 0.5, n)
    return (n + 0.25) * (antiderivative(b) - antiderivative(a))


def _spread_sum(lo: int, hi: int, n: int, term, antiderivative) -> float:
    """Σ term(score) over ranks lo..hi: one by one near the ends, in closed form between."""
    total, inner_lo, inner_hi = 0.0, max(lo, EXPLICIT_TAIL + 1), min(hi, n - EXPLICIT_TAIL)
    if inner_hi - inner_lo < EXPLICIT_TAIL:
        return sum(term(_score(i, n)) for i in range(lo, hi + 1))
    total += sum(term(_score(i, n)) for i in range(lo, inner_lo))
    total += sum(term(_score(i, n)) for i in range(inner_hi + 1, hi + 1))
    return total + _integral(inner_lo, inner_hi, n, antiderivative)


def weight_constants(n: int) -> tuple[float, float, float]:
    """(last weight, second to last weight or 0, divisor of the inner scores)."""
    if n == 3:
        return math.sqrt(0.5), 0.0, 1.0
    squares = _spread_sum(1, n, n, lambda z: z * z, lambda z: 1 - norm_sf(z) - z * _density(z))
    first, second, root = _score(1, n), _score(2, n), 1 / math.sqrt(n)
    a1 = _poly(LAST_WEIGHT, root) - first / math.sqrt(squares)
    if n <= 5:
        return a1, 0.0, math.sqrt((squares - 2 * first**2) / (1 - 2 * a1**2))
    a2 = _poly(NEXT_WEIGHT, root) - second / math.sqrt(squares)
    return a1, a2, math.sqrt((squares - 2 * first**2 - 2 * second**2) / (1 - 2 * a1**2 - 2 * a2**2))


def block_weight(before: int, count: int, n: int, constants: tuple[float, float, float] | None = None) -> float:
    """Sum of the Shapiro–Wilk weights of ranks before+1 … before+count."""
    a1, a2, divisor = constants or weight_constants(n)
    edge = 1 if n <= 5 else 2
    lo, hi = before + 1, before + count
    total = 0.0
    for rank, weight in ((1, -a1), (2, -a2), (n - 1, a2), (n, a1)):
        if lo <= rank <= hi and (rank in (1, n) or edge == 2):
            total += weight
    lo, hi = max(lo, edge + 1), min(hi, n - edge)
    if lo > hi or n == 3:
        return total
    return total + _spread_sum(lo, hi, n, lambda z: z, lambda z: -_density(z)) / divisor


def shapiro_p(w: float, n: int) -> float:
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0
    y = math.log(1 - w)
    if n <= 11:
        limit = _poly(SMALL_LIMIT, n)
        if y >= limit:
            return 0.0
        y, mean, scale = -math.log(limit - y), _poly(SMALL_MEAN, n), math.exp(_poly(SMALL_SCALE, n))
    else:
        x = math.log(n)
        mean, scale = _poly(LARGE_MEAN, x), math.exp(_poly(LARGE_SCALE, x))
    return norm_sf((y - mean) / scale)


FEW_RANKS = 16  # shorter runs of ranks are summed one by one


def block_weight_column(n: int) -> Column:
    """``block_weight`` of the columns ``before`` and ``n`` for a table of ``n`` rows, in built-in functions.

    The constants of the table are literals. Runs of equal values are summed one by one near the ends and where they are short,
    in closed form between.
    """
    a1, a2, divisor = weight_constants(n)
    edge = 1 if n <= 5 else 2

    def score(i: str) -> str:
        return normal_quantile_sql(f"(({i} - 0.375D) / {n + 0.25!r}D)")

    def one_by_one(lo: str, hi: str) -> str:
        return f"CASE WHEN {lo} <= {hi} THEN aggregate(sequence({lo}, {hi}), 0D, (s, i) -> s + {score('i')}) ELSE 0D END"

    def density(z: str) -> str:
        return f"exp(-0.5D * pow({z}, 2)) / {math.sqrt(2 * math.pi)!r}D"

    def closed(lo: str, hi: str) -> str:
        return f"{n + 0.25!r}D * ({density(score(f'({lo} - 0.5D)'))} - {density(score(f'({hi} + 0.5D)'))})"

    lo, hi = f"greatest(before + 1, {edge + 1}L)", f"least(before + n, {n - edge}L)"
    left, right = f"least({hi}, {EXPLICIT_TAIL}L)", f"greatest({lo}, {n - EXPLICIT_TAIL + 1}L)"
    inner_lo, inner_hi = f"greatest({lo}, {EXPLICIT_TAIL + 1}L)", f"least({hi}, {n - EXPLICIT_TAIL}L)"
    if n <= 2 * EXPLICIT_TAIL:
        inner = one_by_one(lo, hi)
    else:
        middle = f"CASE WHEN {inner_hi} - {inner_lo} < {FEW_RANKS} THEN {one_by_one(inner_lo, inner_hi)} ELSE {closed(inner_lo, inner_hi)} END"
        inner = f"{one_by_one(lo, left)} + {middle} + {one_by_one(right, hi)}"
    ends = {1: -a1, n: a1} if edge == 1 else {1: -a1, 2: -a2, n - 1: a2, n: a1}
    at_ends = " + ".join(f"CASE WHEN {rank}L BETWEEN before + 1 AND before + n THEN {weight!r}D ELSE 0D END" for rank, weight in ends.items())
    return F.expr(at_ends if n == 3 else f"{at_ends} + ({inner}) / {divisor!r}D")


@F.pandas_udf(T.DoubleType())
def _shapiro_p_col(w: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([shapiro_p(float(a), int(b)) for a, b in zip(w, n)], dtype="float64")


def shapiro_wilk(df: DataFrame, col: str, alpha: float = 0.05) -> DataFrame:
    """W, p and verdict over all rows; empty below 3 rows or without variation.

    Ranks come as counts per distinct value, so a value shared by many rows is one row here. One job counts the
    rows when called. The p approximation was fitted for up to 5000 rows; beyond that W is right and p is extrapolated.
    """
    size = df.agg(F.count(number(df, col)).alias("n"), F.avg(number(df, col)).alias("mean")).first()
    ranks = value_ranks(df, col).filter(F.col("total") >= 3)
    weight = block_weight_column(size["n"]) if size["n"] >= 3 else F.lit(0.0)
    sums = (
        ranks.withColumn("x", F.col("value") - F.lit(size["mean"]))
        .withColumn("weight", weight)
        .agg(
            F.max("total").alias("n"),
            F.sum(F.col("weight") * F.col("x")).alias("wx"),
            (F.sum(F.col("n") * F.col("x") * F.col("x")) - F.pow(F.sum(F.col("n") * F.col("x")), F.lit(2.0)) / F.sum("n")).alias("ss"),
        )
    )
    w = F.least(F.lit(1.0), F.col("wx") * F.col("wx") / F.col("ss"))
    return (
        sums.filter("n >= 3 and ss > 0")
        .select("n", w.alias("w_stat"))
        .withColumn("p_value", _shapiro_p_col("w_stat", "n"))
        .withColumn("normal", F.col("p_value") > alpha)
    )
