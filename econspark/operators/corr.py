"""Correlation matrices, pairwise tests and partial correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from econspark.functions.dist import t_two_sided, t_two_sided_col
from econspark.operators.describe import COLUMNS_PER_AGGREGATE
from econspark.plans.moments import Moments, MomentSource
from econspark.plans.pairwise import pairwise_correlations
from econspark.plans.solver import solve_cross
from econspark.schema import as_list, check_columns, complete_cases, drop_missing, number, numeric_columns

# Fixed cut-offs of the strength marks.
STRENGTH = ((0.7, "***"), (0.5, "**"), (0.3, "*"))


def strength_mark(r: Column) -> Column:
    mark = F.when(F.abs(r) >= STRENGTH[0][0], STRENGTH[0][1])
    for limit, stars in STRENGTH[1:]:
        mark = mark.when(F.abs(r) >= limit, stars)
    return mark.otherwise("")


def _pair_rows(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str]) -> DataFrame:
    """r and the number of complete pairs for each (a, b), in as few aggregates as codegen allows."""
    frames = []
    for start in range(0, len(pairs), COLUMNS_PER_AGGREGATE):
        part = pairs[start : start + COLUMNS_PER_AGGREGATE]
        stats = []
        for i, (a, b) in enumerate(part):
            x, y = number(df, a), number(df, b)
            stats += [F.corr(x, y).alias(f"r{i}"), F.count_if(x.isNotNull() & y.isNotNull()).alias(f"n{i}")]
        wide = df.groupBy(*[F.col(f"`{k}`") for k in by]).agg(*stats)
        rows = [
            F.struct(
                F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r")
            )
            for i, (a, b) in enumerate(part)
        ]
        frames.append(wide.select(*[F.col(f"`{k}`") for k in by], F.inline(F.array(*rows))))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def correlation_pairs(df: DataFrame, cols=None, by=None) -> DataFrame:
    """Pearson r of every pair of columns over the rows complete for that pair, with strength mark."""
    by = as_list(by)
    cols = as_list(cols) or numeric_columns(df, exclude=by)
    check_columns(df, [*cols, *by])
    if len(cols) < 2:
        raise ValueError("at least two numeric columns are needed")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if not by and len(pairs) > COLUMNS_PER_AGGREGATE:  # one aggregate does not hold them: products of matrices, still one read
        out = pairwise_correlations(df, cols)
    else:
        out = _pair_rows(drop_missing(df, by), pairs, by)
    return out.withColumn("strength", strength_mark(F.col("r")))


def correlation_matrix(df: DataFrame, cols=None, triangle: bool = False) -> DataFrame:
    """Both triangles and the diagonal in long form; ``triangle`` keeps the lower triangle only."""
    cols = as_list(cols) or numeric_columns(df)
    upper = correlation_pairs(df, cols).select("var1", "var2", "r", "strength")
    lower = upper.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "r", "strength")
    if triangle:
        return lower
    spark = df.sparkSession
    diagonal = spark.createDataFrame([(c, c, 1.0, "") for c in cols], "var1 string, var2 string, r double, strength string")
    return upper.unionByName(lower).unionByName(diagonal)


def correlation_wide(df: DataFrame, cols=None) -> DataFrame:
    """The matrix with one column per variable."""
    cols = as_list(cols) or numeric_columns(df)
    return correlation_matrix(df, cols).groupBy("var1").pivot("var2", cols).agg(F.first("r"))


def correlation_summary(df: DataFrame, cols=None) -> DataFrame:
    """Count, mean, sd (population), min and max of the off-diagonal correlations."""
    return correlation_pairs(df, cols).agg(
        F.count("r").alias("count"),
        F.avg("r").alias("mean"),
        F.stddev_pop("r").alias("sd"),
        F.min("r").alias("min"),
        F.max("r").alias("max"),
    )


def correlation_tests(df: DataFrame, y: str, xs, alpha: float = 0.05, by=None) -> DataFrame:
    """r of ``y`` with each x, N, t, p and a significance flag."""
    by = as_list(by)
    out = _pair_rows(drop_missing(df, by), [(y, x) for x in as_list(xs)], by)
    dof = (F.col("n") - 2).cast("double")
    t = F.when(F.abs("r") < 1, F.col("r") * F.sqrt(dof / (1 - F.col("r") * F.col("r"))))
    p = F.when(F.abs("r") >= 1, 0.0).otherwise(t_two_sided_col(t, dof))
    return out.withColumn("t_stat", t).withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)


def partial_r(m: Moments, a: str, b: str, controls: Sequence[str]) -> float:
    """Correlation of a and b after both are regressed on the controls (with constant)."""
    pair, ctrl = m.at([a, b]), m.at(controls)
    block = m.comoment[np.ix_(pair, pair)].copy()
    if ctrl:
        cross = m.comoment[np.ix_(ctrl, pair)]
        _, inverse, _ = solve_cross(m.comoment[np.ix_(ctrl, ctrl)], np.zeros(len(ctrl)))
        block -= cross.T @ inverse @ cross
    size = block[0, 0] * block[1, 1]
    # nothing of a or b is left once the controls explain it
    if size <= 1e-18 * m.comoment[pair[0], pair[0]] * m.comoment[pair[1], pair[1]]:
        return math.nan
    return float(np.clip(block[0, 1] / math.sqrt(size), -1, 1))


def _partial_row(kind, variable, given, m, a, b, controls, alpha) -> dict:
    r = partial_r(m, a, b, controls)
    p = 0.0 if abs(r) == 1 else t_two_sided(r * math.sqrt((m.n - 2) / (1 - r * r)), m.n - 2)
    return {
        "variable": variable,
        "type": kind,
        "given": given,
        "n": m.n,
        "correlation": r,
        "p_value": p,
        "significant": bool(p < alpha),
    }


def partial_correlations(df: DataFrame, y: str, x: str, controls=None, by=None, alpha: float = 0.05) -> DataFrame:
    """Partial correlation of x and y given the controls, then given the controls without each one,
    then the partial correlation of y with each control given x and the other controls."""
    by, controls = as_list(by), as_list(controls)
    cols = [y, x, *controls]
    source = MomentSource(complete_cases(df, cols, by), cols, by)

    def rows(m: Moments) -> list[dict]:
        if m.n < 3:
            return []
        if not controls:
            return [_partial_row("Simple Correlation", x, "", m, x, y, [], alpha)]
        out = [_partial_row("Partial Correlation", x, ", ".join(controls), m, x, y, controls, alpha)]
        for c in controls:
            rest = [d for d in controls if d != c]
            given = ", ".join(rest)
            out.append(_partial_row("Partial Correlation without control", f"{x} | controls - {c}", given, m, x, y, rest, alpha))
        for c in controls:
            rest = [x, *[d for d in controls if d != c]]
            out.append(_partial_row("Partial Correlation of control", c, ", ".join(rest), m, c, y, rest, alpha))
        return out

    return source.solve(
        rows,
        "variable string, type string, given string, n long, correlation double, p_value double, significant boolean",
    )
