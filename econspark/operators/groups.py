"""Binning, grouped summaries and collapse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from econspark.operators.describe import tabstat
from econspark.plans.ranks import quantiles
from econspark.schema import as_list, check_columns, drop_missing, number

# Bins per named method, the labels of three bins, the aggregates of collapse.
BINS_OF_METHOD = {"quartiles": 4, "quintiles": 5, "deciles": 10}
TERCILE_LABELS = ("Low", "Medium", "High")
AGGREGATES = ("mean", "sum", "count", "std", "min", "max", "median")


def quantile_edges(df: DataFrame, col: str, q: int) -> list[float]:
    """The distinct edges of ``q`` equally filled bins: at most q + 1 numbers, taken in one go."""
    row = quantiles(df, col, [i / q for i in range(q + 1)]).first()
    return sorted(set(row["q"])) if row else []


def quantile_bins(
    df: DataFrame, col: str, q: int = 4, out: str = "bin", labels: Sequence[str] | None = None
) -> DataFrame:
    """Add a 1-based bin number and ``<out>_label``; missing values get NULL.

    Bins are closed on the right and the lowest value belongs to the first. Equal edges merge, and
    numbers and labels follow the surviving bins.
    """
    if q < 2:
        raise ValueError("at least two bins are needed")
    labels = list(labels or [f"Q{i + 1}" for i in range(q)])
    v = number(df, col)
    inner = quantile_edges(df, col, q)[1:-1]
    bin_no = F.when(v.isNull(), F.lit(None).cast("int"))
    for i in range(len(inner), 0, -1):
        bin_no = bin_no.when(v > inner[i - 1], i + 1)
    bin_no = bin_no.otherwise(1)
    return df.withColumn(out, bin_no).withColumn(f"{out}_label", _label(F.col(out), labels))


def _label(bin_no: Column, labels: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), bin_no - 1)


def width_bins(df: DataFrame, col: str, bins: int = 4, out: str = "bin") -> DataFrame:
    """Add an equal-width bin number (right-closed, lowest value in the first) and ``Bin_i`` labels."""
    v = number(df, col)
    row = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is None:
        bin_no = F.lit(None)
    elif lo == hi:
        bin_no = F.lit((bins + 1) // 2)
    else:
        bin_no = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((v - lo) / ((hi - lo) / bins))))
    return df.withColumn(out, F.when(v.isNotNull(), bin_no).cast("int")).withColumn(
        f"{out}_label", F.concat(F.lit("Bin_"), F.col(out).cast("string"))
    )


def with_groups(
    df: DataFrame, group_col: str, method: str = "quartiles", n_bins: int = 4, out: str = "group"
) -> DataFrame:
    """Add ``out`` (label) and ``out_order`` by one of the grouping methods; NULL groups are dropped.

    Methods: ``categories``, ``quartiles``, ``quintiles``, ``deciles``, ``quantiles`` (``n_bins``)
    and ``custom bins`` (``n_bins`` of equal width).
    """
    check_columns(df, [group_col])
    method = method.lower()
    if method == "categories":
        label = F.col(f"`{group_col}`").cast("string")
        return drop_missing(df, [group_col]).withColumns({out: label, f"{out}_order": F.lit(0)})
    if method == "custom bins":
        binned = width_bins(df, group_col, n_bins, "_bin")
    elif method == "quantiles" or method in BINS_OF_METHOD:
        binned = quantile_bins(df, group_col, BINS_OF_METHOD.get(method, n_bins), "_bin")
    else:
        raise ValueError(f"unknown grouping method: {method}")
    return (
        binned.filter(F.col("_bin").isNotNull())
        .withColumnsRenamed({"_bin_label": out, "_bin": f"{out}_order"})
    )


def grouped_summary(df: DataFrame, group: str, var: str) -> DataFrame:
    """Group size, N, mean, sd, min, max, median, quartiles, IQR and CV % per group."""
    rows = drop_missing(df, [group]).filter(number(df, var).isNotNull())
    table = tabstat(rows, var, by=group)
    return table.select(
        F.col(f"`{group}`").alias("group"),
        F.col("n").alias("group_size"),
        "n", "mean", "sd", "min", "max", "median", "p25", "p75", "iqr",
        (100 * F.col("cv")).alias("cv_pct"),
    )


def bysort(
    df: DataFrame, group_col: str, var_col: str, method: str = "quartiles", n_bins: int = 4
) -> DataFrame:
    """Grouped summary of ``var_col`` by ``group_col`` cut with ``method``."""
    return grouped_summary(with_groups(df, group_col, method, n_bins), "group", var_col)


def reverse_bysort(df: DataFrame, group_col: str, var_col: str) -> DataFrame:
    """Terciles of ``var_col``, summarising ``group_col`` in each."""
    binned = quantile_bins(df, var_col, 3, "_bin", TERCILE_LABELS).filter(F.col("_bin").isNotNull())
    return grouped_summary(binned.withColumnRenamed("_bin_label", "group"), "group", group_col)


def group_means(df: DataFrame, group: str, var: str) -> DataFrame:
    """Group means with standard errors."""
    v = number(df, var)
    rows = drop_missing(df, [group]).filter(v.isNotNull())
    return rows.groupBy(F.col(f"`{group}`").alias("group")).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("std_error"),
    )


def collapse(
    df: DataFrame,
    group_cols: str | Sequence[str],
    agg_cols: str | Sequence[str],
    fns: Sequence[str] = ("mean", "count"),
) -> DataFrame:
    """One row per group with ``{fn}_{col}`` columns; rows with a missing key are dropped."""
    keys, cols, fns = as_list(group_cols), as_list(agg_cols), list(fns)
    check_columns(df, [*keys, *cols])
    unknown = [f for f in fns if f not in AGGREGATES]
    if unknown:
        raise ValueError(f"unknown aggregate: {', '.join(unknown)}")
    rows = drop_missing(df, keys)
    built_in = {
        "mean": F.avg, "sum": F.sum, "count": F.count, "std": F.stddev_samp, "min": F.min, "max": F.max,
    }
    plain = [f for f in fns if f != "median"]
    aggs = []
    for c in cols:
        v = F.col(f"`{c}`") if set(plain) <= {"count"} else number(df, c)
        aggs += [_sum_or_zero(built_in[f](v), f).alias(f"{f}_{c}") for f in plain]
    out = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*(aggs or [F.count("*").alias("_n")]))
    if "median" in fns:
        medians = quantiles(df, cols, [0.5], keys)
        wide = medians.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
            *[F.max(F.when(F.col("variable") == c, F.col("q")[0])).alias(f"median_{c}") for c in cols]
        )
        out = out.join(wide, keys, "left")
    return out.select(*[F.col(f"`{k}`") for k in keys], *[f"{f}_{c}" for c in cols for f in fns])


def _sum_or_zero(agg: Column, fn: str) -> Column:
    """The sum of no values is 0."""
    return F.coalesce(agg, F.lit(0.0)) if fn == "sum" else agg


def dense_groups(collapsed: DataFrame, levels: dict[str, DataFrame], counts: Sequence[str] = ()) -> DataFrame:
    """Keep every combination of the key levels; absent ones get NULL aggregates and zero counts.

    ``levels`` gives the level rows of each key. The grid of all combinations is the result itself, so it is built as a
    join of the level tables and spread over tasks, whatever their number.
    """
    grid = None
    for key, frame in levels.items():
        rows = frame.select(F.col(f"`{key}`").alias(key)).distinct()
        grid = rows if grid is None else grid.join(rows, F.lit(True))
    out = grid.join(collapsed, list(levels), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in counts})


def collapse_summary(df: DataFrame, collapsed: DataFrame, group_cols, agg_cols) -> DataFrame:
    """Rows before and after, the reduction factor, number of keys and aggregated columns."""
    after = collapsed.agg(F.count("*")).scalar()
    return (
        drop_missing(df, as_list(group_cols))
        .agg(F.count("*").alias("original_rows"))
        .withColumn("collapsed_rows", after)
        .withColumn("reduction_factor", F.col("original_rows") / F.col("collapsed_rows"))
        .withColumn("grouping_variables", F.lit(len(as_list(group_cols))).cast("long"))
        .withColumn("aggregated_variables", F.lit(len(as_list(agg_cols))).cast("long"))
    )


def group_sizes(df: DataFrame, group_cols) -> DataFrame:
    keys = as_list(group_cols)
    return drop_missing(df, keys).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("size"))


def group_size_distribution(df: DataFrame, group_cols) -> DataFrame:
    """Number of groups and min, max, mean, median, sd and quartiles of their sizes."""
    return tabstat(group_sizes(df, group_cols), "size").select(
        F.col("n").alias("groups"), "min", "max", "mean", "median", "sd", "p25", "p75"
    )


def table_statistics(df: DataFrame, cols=None) -> DataFrame:
    """Count, mean, sd, min, quartiles and max per numeric column."""
    return tabstat(df, cols).select(
        "variable", F.col("n").alias("count"), "mean", "sd", "min", "p25", F.col("median").alias("p50"), "p75", "max"
    )


def aggregation_comparison(df: DataFrame, collapsed: DataFrame, col: str, collapsed_col: str | None = None) -> DataFrame:
    """The same eight statistics of a column before and after collapsing, one row per statistic."""
    collapsed_col = collapsed_col or f"mean_{col}"

    def long(table: DataFrame, name: str) -> DataFrame:
        stats = ["count", "mean", "sd", "min", "p25", "p50", "p75", "max"]
        one = table.select(*[F.col(s).cast("double").alias(s) for s in stats])
        return one.unpivot([], stats, "statistic", name)

    before = long(table_statistics(df, col), "original")
    return before.join(long(table_statistics(collapsed, collapsed_col), "collapsed"), "statistic")


def group_pivot(df: DataFrame, row: str, col: str, value: str, levels: list | None = None) -> DataFrame:
    """Means of ``value`` with ``row`` down and ``col`` across."""
    rows = drop_missing(df, [row, col])
    return rows.groupBy(f"`{row}`").pivot(col, levels).agg(F.avg(number(df, value)))


def group_cells(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """The cells of :func:`group_pivot` in long form."""
    rows = drop_missing(df, [row, col])
    return rows.groupBy(
        F.col(f"`{row}`").alias("row_value"), F.col(f"`{col}`").alias("col_value")
    ).agg(F.avg(number(df, value)).alias("mean"), F.count("*").alias("n"))
