"""The numbers behind the figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from econspark.functions.dist import normal_quantile_sql
from econspark.operators.corr import correlation_matrix, correlation_tests
from econspark.operators.describe import OUTLIER_REACH
from econspark.operators.groups import group_cells, group_means, group_sizes
from econspark.operators.margins import fitted_lines
from econspark.operators.ols import Regression, added_variable_row, simple_regressions
from econspark.operators.rows import sample_order
from econspark.operators.tables import top_categories
from econspark.plans.moments import MomentSource
from econspark.plans.ranks import long_values, quantiles, spaced_order_statistics
from econspark.plans.solver import ols
from econspark.schema import as_list, complete_cases, drop_missing, number

# Fixed sizes of the figures.
MAX_BINS = 30
MAX_GROUP_BINS = 20
RESIDUAL_BINS = 20
DENSITY_POINTS = 100
KERNEL_REACH, KERNEL_BINS = 8.5, 16  # bandwidths that a bin reaches, bins of a bandwidth
PLOT_POINTS = 5_000


def _bin_count(df: DataFrame, v: Column, limit: int, approximate: int) -> int:
    """min(limit, distinct values); values are only counted exactly where the estimate is low."""
    if approximate > 2 * limit:
        return limit
    return max(1, min(limit, df.agg(F.count_distinct(v)).first()[0]))


def _bin_number(v: Column, lo: Column, hi: Column, bins: Column) -> Column:
    """1-based left-closed bin, the last one closed on both sides; a single value sits mid-range."""
    place = F.floor((v - lo) / ((hi - lo) / bins)) + 1
    return F.when(hi == lo, F.floor(bins / 2) + 1).otherwise(F.least(bins, place)).cast("int")


def _edges(lo: Column, hi: Column, bins: Column, bin_no: Column) -> tuple[Column, Column]:
    wide_lo = F.when(hi == lo, lo - 0.5).otherwise(lo)
    wide_hi = F.when(hi == lo, hi + 0.5).otherwise(hi)
    step = (wide_hi - wide_lo) / bins
    return wide_lo + (bin_no - 1) * step, F.when(bin_no == bins, wide_hi).otherwise(wide_lo + bin_no * step)


def histogram(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """``bin, lower, upper, n`` for all bins, empty ones included."""
    v = number(df, col)
    row = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.approx_count_distinct(v).alias("d")).first()
    bins = bins or _bin_count(df, v, MAX_BINS, row["d"])
    lo, hi, b = F.lit(row["lo"]).cast("double"), F.lit(row["hi"]).cast("double"), F.lit(bins)
    counts = (
        df.select(v.alias("v")).filter("v is not null").groupBy(_bin_number(F.col("v"), lo, hi, b).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    lower, upper = _edges(lo, hi, b, F.col("bin"))
    out = every.join(counts, "bin", "left").select(
        "bin", lower.alias("lower"), upper.alias("upper"), F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )
    return out if row["lo"] is not None else out.filter("false")


def grouped_histogram(df: DataFrame, group: str, col: str, limit: int = MAX_GROUP_BINS) -> DataFrame:
    """Histogram of ``col`` inside each group on the group's own range with min(limit, distinct)
    bins; empty bins have n = 0. Group n, mean and sd ride along."""
    rows = drop_missing(df, [group]).select(F.col(f"`{group}`").alias("group"), number(df, col).alias("v"))
    rows = rows.filter("v is not null")
    stats = rows.groupBy("group").agg(
        F.count("v").alias("group_n"),
        F.avg("v").alias("group_mean"),
        F.stddev_samp("v").alias("group_sd"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        F.approx_count_distinct("v").alias("estimate"),
    )
    # values are only counted exactly in groups with few of them, where partial aggregation keeps them few
    low = stats.filter(F.col("estimate") <= 2 * limit).select("group")
    exact = rows.join(low, "group").groupBy("group").agg(F.count_distinct("v").alias("distinct"))
    bins = F.least(F.coalesce("distinct", F.lit(limit)), F.lit(limit)).cast("int")
    stats = stats.join(exact, "group", "left").withColumn("bins", bins).drop("estimate", "distinct")
    joined = rows.join(stats, "group")
    bin_no = _bin_number(F.col("v"), F.col("lo"), F.col("hi"), F.col("bins")).alias("bin")
    counts = joined.groupBy("group", bin_no).agg(F.count("*").alias("n"))
    lower, upper = _edges(F.col("lo"), F.col("hi"), F.col("bins"), F.col("bin"))
    every = stats.withColumn("bin", F.explode(F.sequence(F.lit(1), F.col("bins"))))
    filled = every.join(counts, ["group", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return filled.select(
        "group", "bin", lower.alias("lower"), upper.alias("upper"), "n", "group_n", "group_mean", "group_sd"
    )


def group_size_histogram(df: DataFrame, group_cols) -> DataFrame:
    return histogram(group_sizes(df, group_cols), "size")


def box_stats(df: DataFrame, cols, by=None) -> DataFrame:
    """Quartiles, whisker ends (last values within reach of the box) and number of outliers."""
    cols, by = as_list(cols), as_list(by)
    keys = [F.col(f"`{k}`") for k in by]
    group = [*by, "variable"]
    q = quantiles(df, cols, [0.25, 0.5, 0.75], by)
    q1, q3 = F.col("q")[0], F.col("q")[2]
    box = q.select(
        *keys, "variable", "n", q1.alias("q1"), F.col("q")[1].alias("median"), q3.alias("q3"),
        (q1 - OUTLIER_REACH * (q3 - q1)).alias("fence_lo"), (q3 + OUTLIER_REACH * (q3 - q1)).alias("fence_hi"),
    )
    rows = long_values(drop_missing(df, by), cols, by)
    limits = box.select(*group, "fence_lo", "fence_hi")
    inside = (F.col("value") >= F.col("fence_lo")) & (F.col("value") <= F.col("fence_hi"))
    ends = (
        rows.join(limits if by else F.broadcast(limits), group)
        .groupBy(*group)
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )
    return box.drop("fence_lo", "fence_hi").join(ends, group)


def category_bars(df: DataFrame, col: str) -> DataFrame:
    return top_categories(df, col)


def mean_bars(df: DataFrame, group: str, var: str) -> DataFrame:
    return group_means(df, group, var)


def plot_sample(df: DataFrame, cols, key, points: int = PLOT_POINTS, seed: int = 42) -> DataFrame:
    """Up to ``points`` reproducible rows with all of ``cols`` present, for drawing."""
    keys = as_list(key)
    rows = complete_cases(df, as_list(cols), keep=keys)
    order = [sample_order(keys, seed), *[F.col(f"`{k}`") for k in keys]]
    return rows.orderBy(*order).limit(points)


def scatter(df: DataFrame, y: str, x: str, key, points: int = PLOT_POINTS) -> dict[str, DataFrame]:
    """Sampled points; trend line, correlation and means over all rows."""
    pairs = complete_cases(df, [y, x])
    means = pairs.agg(F.avg(f"`{x}`").alias("mean_x"), F.avg(f"`{y}`").alias("mean_y"))
    line = simple_regressions(df, y, x).select("variable", "slope", "intercept")
    test = correlation_tests(df, y, x).select(F.col("var2").alias("variable"), "n", "r", "p_value", "significant")
    packed = means.select(F.struct("mean_x", "mean_y")).scalar()
    stats = line.join(test, "variable").withColumn("_m", packed).select("*", "_m.*").drop("_m")
    return {"points": plot_sample(df, [y, x], key, points), "statistics": stats}


def scatter_statistics(df: DataFrame, y: str, xs) -> DataFrame:
    """N, r, p, significance, trend line per x."""
    line = simple_regressions(df, y, xs).select("variable", "slope", "intercept")
    test = correlation_tests(df, y, xs).select(F.col("var2").alias("variable"), "n", "r", "p_value", "significant")
    return test.join(line, "variable")


def heat_map(df: DataFrame, cols=None) -> DataFrame:
    """Lower triangle of the correlation matrix."""
    return correlation_matrix(df, cols, triangle=True).select("var1", "var2", "r")


def density(df: DataFrame, col: str, points: int = DENSITY_POINTS) -> DataFrame:
    """Gaussian kernel density (Scott's bandwidth) on an even grid three bandwidths past the data.

    A truncated Gauss transform: rows are summed by bins of a fixed part of the bandwidth, as count and powers of the distance from the bin's
    middle, and a bin counts towards the grid points within reach by the Hermite expansion of the kernel, to some nine digits.
    Bins out of reach of every grid point are left out first, so their number is bounded by the grid, not by the rows or the range.
    """
    v = number(df, col)
    row = df.agg(
        F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("sd")
    ).first()
    spark = df.sparkSession
    if not row["n"] or not row["sd"]:
        return spark.createDataFrame([], "point int, x double, density double")
    width = row["sd"] * row["n"] ** -0.2
    lo, hi = row["lo"] - 3 * width, row["hi"] + 3 * width
    step = (hi - lo) / (points - 1)
    reach, fine = KERNEL_REACH * width, width / KERNEL_BINS
    place = (F.col("v") - lo) / step
    near = F.abs(place - F.rint(place)) * step <= reach + fine
    middle = F.lit(row["lo"]) + (F.col("bin") + 0.5) * fine
    rows = df.select(v.alias("v")).filter("v is not null").filter(near)
    rows = rows.withColumn("bin", F.floor((F.col("v") - row["lo"]) / fine)).withColumn("t", (F.col("v") - middle) / width)
    powers = [F.sum(F.expr("*".join(["t"] * k))).alias(f"s{k}") for k in range(1, 5)]
    bins = rows.groupBy("bin").agg(F.count("*").cast("double").alias("s0"), *powers).withColumn("middle", middle)
    first = F.greatest(F.lit(0), F.ceil((F.col("middle") - reach - lo) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((F.col("middle") + reach - lo) / step)).cast("int")
    near_points = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    parts = bins.withColumn("point", F.explode(near_points)).withColumn("z", (F.lit(lo) + F.col("point") * F.lit(step) - F.col("middle")) / width)
    z = F.col("z")
    hermite = [F.lit(1.0), z, z * z - 1, z * (z * z - 3), z * z * (z * z - 6) + 3]
    series = sum((F.col(f"s{k}") * hermite[k] / math.factorial(k) for k in range(1, 5)), F.col("s0"))
    kernel = F.exp(-z * z / 2) * F.lit(1 / (width * math.sqrt(2 * math.pi)))
    sums = parts.groupBy("point").agg(F.sum(series * kernel).alias("total"))
    grid = spark.range(points).select(F.col("id").cast("int").alias("point")).join(F.broadcast(sums), "point", "left")  # at most ``points`` rows
    return grid.select("point", (F.lit(lo) + F.col("point") * F.lit(step)).alias("x"), (F.coalesce("total", F.lit(0.0)) / row["n"]).alias("density"))


def pair_grid(df: DataFrame, cols, key, points: int = PLOT_POINTS) -> dict[str, DataFrame]:
    """One sample of rows complete in all columns, and a density per column."""
    cols = as_list(cols)
    rows = complete_cases(df, cols)
    return {"points": plot_sample(df, cols, key, points)} | {f"density_{c}": density(rows, c) for c in cols}


def residual_points(df: DataFrame, y: str, x: str, key, points: int = PLOT_POINTS) -> DataFrame:
    """Sampled rows with x, fitted and residual of the simple regression over all rows."""
    keys = as_list(key)
    r = Regression(df, y, x, min_rows=3, keep=keys)
    order = [sample_order(keys, 42), *[F.col(f"`{k}`") for k in keys]]
    return r.predictions.orderBy(*order).limit(points).select(*[f"`{k}`" for k in keys], f"`{x}`", "fitted", "residual")


def residual_histogram(df: DataFrame, y: str, x: str, bins: int = RESIDUAL_BINS) -> DataFrame:
    return histogram(Regression(df, y, x, min_rows=3).predictions, "residual", bins)


def qq_points(df: DataFrame, col: str, points: int = 1_000) -> DataFrame:
    """Normal quantile plot at evenly spaced ranks (every rank, if there are no more than ``points``).

    Theoretical quantiles use Filliben's plotting positions.
    """
    table = spaced_order_statistics(df, col, points)
    rank, n = F.col("rank"), F.col("total")
    end = F.pow(F.lit(0.5), 1 / n)
    position = F.when(rank == n, end).when(rank == 1, 1 - end).otherwise((rank - 0.3175) / (n + 0.365))
    return table.withColumn("position", position).select("rank", F.expr(normal_quantile_sql("position")).alias("theoretical"), F.col("value").alias("observed"))


def qq_line(points: DataFrame) -> DataFrame:
    """Least-squares line through quantile-plot points with its r."""
    return points.agg(
        F.regr_slope("observed", "theoretical").alias("slope"),
        F.regr_intercept("observed", "theoretical").alias("intercept"),
        F.corr("observed", "theoretical").alias("r"),
    )


def heat_cells(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    return group_cells(df, row, col, value)


def added_variable_points(df: DataFrame, y: str, x: str, controls, key, points: int = PLOT_POINTS) -> DataFrame:
    """Sampled pairs of residuals of x and y given the controls, from two fits over all rows."""
    keys, controls = as_list(key), as_list(controls)
    pairs = _residual_pairs(df, y, x, controls, keys)
    order = [sample_order(keys, 42), *[F.col(f"`{k}`") for k in keys]]
    return pairs.orderBy(*order).limit(points)


def _residual_pairs(df, y, x, controls, keys) -> DataFrame:
    cols = [y, x, *controls]
    rows = complete_cases(df, cols, keep=keys)
    m = MomentSource(rows, cols).moments

    def residual(target: str) -> Column:
        out = F.col(f"`{target}`")
        if not controls:
            return out - float(m.mean[m.cols.index(target)])
        fit = ols(m, target, controls)
        for b, c in zip(fit.beta, controls):
            out = out - float(b) * F.col(f"`{c}`")
        return out - float(fit.const)

    return rows.select(*[F.col(f"`{k}`") for k in keys], residual(x).alias("x_residual"), residual(y).alias("y_residual"))


def added_variable(df: DataFrame, y: str, x: str, controls=None) -> DataFrame:
    """Partial slope, R², F, p and r of x given the controls."""
    controls = as_list(controls)
    cols = [y, x, *controls]

    def rows(m) -> list[dict]:
        return [added_variable_row(m, y, x, controls)] if m.n >= 3 else []

    return MomentSource(complete_cases(df, cols), cols).solve(
        rows,
        "variable string, n long, partial_slope double, partial_intercept double, partial_r2 double, "
        "partial_f double, partial_f_p double, partial_r double, partial_r_p double",
    )


def added_variable_line(df: DataFrame, y: str, x: str, controls=None, points: int = 100) -> DataFrame:
    """Fitted line and 95 % band over the residual pairs."""
    pairs = _residual_pairs(df, y, x, as_list(controls), [])
    return fitted_lines(pairs, "y_residual", "x_residual", points, levels=(0.95,))
