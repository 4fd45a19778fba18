"""Marginal-effect curves, interaction curves and fitted lines on evenly spaced grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from econspark.functions.dist import t_ppf
from econspark.operators.ols import MIN_ROWS, Regression
from econspark.plans.moments import MomentSource
from econspark.plans.ranks import quantiles
from econspark.plans.solver import COEFFICIENT_SCHEMA, ols
from econspark.schema import as_list, complete_cases

# Fixed sizes of the reported grids and levels of the moderator.
CURVE_POINTS = 50
INTERACTION_POINTS = 20
LINE_POINTS = 100
MODERATOR_LEVELS = (("Low (25th)", 0.25), ("Medium (50th)", 0.5), ("High (75th)", 0.75))


def linspace(df: DataFrame, lo: Column, hi: Column, points: int, out: str) -> DataFrame:
    """Each row of a small table times ``points`` evenly spaced values from ``lo`` to ``hi``."""
    grid = df.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    step = (hi - lo) / F.lit(max(points - 1, 1))
    value = F.when(F.col("point") == points - 1, hi).otherwise(lo + F.col("point") * step) if points > 1 else lo
    return grid.withColumn(out, value)


def _limits(rows: DataFrame, cols) -> DataFrame:
    """``variable, lo, hi`` per column."""
    parts = [F.struct(F.lit(c).alias("variable"), F.min(f"`{c}`").alias("lo"), F.max(f"`{c}`").alias("hi")) for c in cols]
    return rows.agg(F.array(*parts).alias("_rows")).select(F.inline("_rows"))


def marginal_curves(df: DataFrame, y: str, xs, points: int = CURVE_POINTS, level: float = 0.95) -> DataFrame:
    """ŷ along each x from its minimum to its maximum, the other x at their means, with the
    confidence band of the mean prediction."""
    r = Regression(df, y, xs)
    fit = r.fit
    cov = fit.cov[1:, 1:]
    base = fit.const + float(fit.beta @ fit.x_mean)
    crit = t_ppf((1 + level) / 2, fit.df_resid)
    table = r.rows.sparkSession.createDataFrame(
        [
            (x, float(fit.beta[j]), float(fit.x_mean[j]), float(cov[j, j]))
            for j, x in enumerate(r.xs)
        ],
        "variable string, slope double, mean double, slope_var double",
    )
    grid = linspace(_limits(r.rows, r.xs).join(F.broadcast(table), "variable"), F.col("lo"), F.col("hi"), points, "x")
    off = F.col("x") - F.col("mean")
    band = crit * F.sqrt(F.lit(fit.mse / fit.n) + off * off * F.col("slope_var"))
    fitted = F.lit(base) + F.col("slope") * off
    return grid.select(
        "variable", "point", "x", fitted.alias("fitted"), (fitted - band).alias("lower"), (fitted + band).alias("upper")
    )


def _interaction(df: DataFrame, y: str, x1: str, x2: str) -> tuple[DataFrame, MomentSource]:
    rows = complete_cases(df, [y, x1, x2])
    wide = rows.select(
        F.col(f"`{y}`").alias("_y"), F.col(f"`{x1}`").alias("_a"), F.col(f"`{x2}`").alias("_b"),
        (F.col(f"`{x1}`") * F.col(f"`{x2}`")).alias("_ab"),
    )
    return rows, MomentSource(wide, ["_y", "_a", "_b", "_ab"])


def interaction_model(df: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """Coefficients of y on x1, x2 and their product."""
    names = {"_a": x1, "_b": x2, "_ab": f"{x1} x {x2}"}

    def rows(m) -> list[dict]:
        if m.n < MIN_ROWS:
            return []
        out = ols(m, "_y", ["_a", "_b", "_ab"]).coefficient_rows()
        return [r | {"variable": names.get(r["variable"], r["variable"])} for r in out]

    return _interaction(df, y, x1, x2)[1].solve(rows, COEFFICIENT_SCHEMA)


def interaction_curves(df: DataFrame, y: str, x1: str, x2: str, points: int = INTERACTION_POINTS) -> DataFrame:
    """ŷ along x1 with x2 held at its lower quartile, median and upper quartile."""
    rows, source = _interaction(df, y, x1, x2)
    if source.moments.n < MIN_ROWS:
        raise ValueError(f"only {source.moments.n} complete rows, {MIN_ROWS} are needed")
    fit = ols(source.moments, "_y", ["_a", "_b", "_ab"])
    b0, (b1, b2, b3) = float(fit.const), map(float, fit.beta)
    at = quantiles(rows, x2, [p for _, p in MODERATOR_LEVELS])
    labels = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(n).alias("level")) for i, (n, _) in enumerate(MODERATOR_LEVELS)])
    levels = at.select("q", F.inline(labels)).select("level", F.get("q", F.col("order")).alias("x2"))
    limit = rows.agg(F.struct(F.min(f"`{x1}`").alias("lo"), F.max(f"`{x1}`").alias("hi")).alias("r")).scalar()
    grid = linspace(levels.withColumn("_r", limit), F.col("_r.lo"), F.col("_r.hi"), points, "x1")
    fitted = b0 + b1 * F.col("x1") + b2 * F.col("x2") + b3 * F.col("x1") * F.col("x2")
    return grid.select("level", "x2", "point", "x1", fitted.alias("fitted"))


def fitted_lines(df: DataFrame, y: str, xs, points: int = LINE_POINTS, levels=(0.95, 0.68), kind: str = "mean") -> DataFrame:
    """Simple-regression line of y on each x with confidence (``mean``) or prediction (``obs``)
    bands on an even grid over the range of x."""
    if kind not in ("mean", "obs"):
        raise ValueError("kind is 'mean' or 'obs'")
    frames = []
    for x in as_list(xs):
        r = Regression(df, y, x, min_rows=3)
        fit = r.fit
        sxx = float(r.source.moments.comoment[1, 1])
        grid = linspace(_limits(r.rows, [x]), F.col("lo"), F.col("hi"), points, "x")
        off = F.col("x") - F.lit(float(fit.x_mean[0]))
        inner = F.lit(1 / fit.n + (1.0 if kind == "obs" else 0.0)) + (off * off / sxx if sxx > 0 else F.lit(0.0))
        se = math.sqrt(fit.mse) * F.sqrt(inner)
        fitted = F.lit(float(fit.const)) + float(fit.beta[0]) * F.col("x")
        bands = []
        for lv in levels:
            reach = t_ppf((1 + lv) / 2, fit.df_resid) * se
            bands += [(fitted - reach).alias(f"lower_{round(100 * lv)}"), (fitted + reach).alias(f"upper_{round(100 * lv)}")]
        frames.append(grid.select("variable", "point", "x", fitted.alias("fitted"), *bands))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def margins(df: DataFrame, y: str, xs) -> dict[str, DataFrame]:
    """All marginal-effect tables."""
    r = Regression(df, y, xs)
    tables = {"effects": r.marginal_effects(), "scenarios": r.predicted_scenarios(), "curves": marginal_curves(df, y, xs)}
    if len(r.xs) > 1:
        tables["interaction"] = interaction_model(df, y, r.xs[0], r.xs[1])
        tables["interaction_curves"] = interaction_curves(df, y, r.xs[0], r.xs[1])
    return tables


