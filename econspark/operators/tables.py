"""Frequency tables and cross-tabulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from econspark.plans.buckets import ordered_parts, part_offsets
from econspark.schema import as_list, check_columns, drop_missing

TOP_BARS = 20  # categories kept by the bar chart
TOP_VALUES = 49  # values kept by the unique-value table
OTHER = "Other"
TOTAL = "Total"


def value_counts(df: DataFrame, col: str) -> DataFrame:
    check_columns(df, [col])
    return drop_missing(df, [col]).groupBy(F.col(f"`{col}`").alias("value")).agg(F.count("*").alias("n"))


def frequency(df: DataFrame, col: str) -> DataFrame:
    """Count, percent, running count and running percent, most frequent first, ties by value.

    Levels lie in range partitions of (count, value), so equal counts spread over tasks like any others.
    """
    order = (F.desc("n"), F.asc("value"))
    parts = ordered_parts(value_counts(df, col), *order)
    upto = F.sum("n").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ranked = parts.withColumn("upto", upto).join(F.broadcast(part_offsets(parts, F.sum("n"))), "part")
    cum = F.col("before") + F.col("upto")
    return ranked.select(
        "value",
        "n",
        (100 * F.col("n") / F.col("total")).alias("percent"),
        cum.alias("cum_n"),
        (100 * cum / F.col("total")).alias("cum_percent"),
    )


def top_categories(df: DataFrame, col: str, k: int = TOP_BARS) -> DataFrame:
    """The ``k`` most frequent values as text plus one "Other" row with the rest, if any.

    Sorting takes the top k per task; the rest is total minus top, so no task sees all levels.
    """
    counts = value_counts(df, col).withColumn("value", F.col("value").cast("string"))
    top = counts.orderBy(F.desc("n"), "value").limit(k)
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("levels"))
    top_sum = top.agg(F.sum("n")).scalar()
    rest = sums.filter(F.col("levels") > k).select(F.lit(OTHER).alias("value"), (F.col("n") - top_sum).alias("n"))
    return top.withColumn("is_other", F.lit(False)).unionByName(rest.withColumn("is_other", F.lit(True)))


def unique_values(df: DataFrame, col: str, k: int = TOP_VALUES) -> DataFrame:
    """Value, count, percent, running count and percent for the top ``k`` values plus "Other".

    "Other" appears once there are more than ``k + 1`` levels.
    """
    counts = value_counts(df, col).withColumn("value", F.col("value").cast("string"))
    levels = counts.agg(F.count("*")).scalar()
    # with exactly k + 1 levels the last one is shown instead of an "Other" of one level
    candidates = counts.orderBy(F.desc("n"), "value").limit(k + 1)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "value"))
    top = (
        candidates.withColumn("place", place)
        .filter((F.col("place") <= k) | (levels <= k + 1))
        .select("value", "n", F.lit(False).alias("is_other"))
    )
    total = counts.agg(F.sum("n")).scalar()
    rest = counts.agg(F.sum("n").alias("n"), F.count("*").alias("levels")).filter(F.col("levels") > k + 1)
    rest = rest.select(
        F.lit(OTHER).alias("value"), (F.col("n") - top.agg(F.sum("n")).scalar()).alias("n"), F.lit(True).alias("is_other")
    )
    shown = top.unionByName(rest)  # at most k + 1 rows
    order = Window.orderBy("is_other", F.desc("n"), "value").rowsBetween(Window.unboundedPreceding, 0)
    return shown.select(
        "value",
        "n",
        (100 * F.col("n") / total).alias("percent"),
        F.sum("n").over(order).alias("cum_n"),
        (100 * F.sum("n").over(order) / total).alias("cum_percent"),
        "is_other",
    )


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """Cell counts with row, column and grand totals and the row percentages, in long form.

    A total has NULL in its key and 1 in ``row_total`` / ``col_total``.
    """
    check_columns(df, [row, col])
    r, c = F.col(f"`{row}`"), F.col(f"`{col}`")
    cube = (
        drop_missing(df, [row, col])
        .cube(r, c)
        .agg(
            F.count("*").alias("n"),
            F.grouping(r).cast("int").alias("row_total"),
            F.grouping(c).cast("int").alias("col_total"),
        )
        .withColumnsRenamed({row: "row_value", col: "col_value"})
    )
    sums = cube.filter("col_total = 1").select(F.col("row_total").alias("_t"), F.col("row_value").alias("_v"), F.col("n").alias("_n"))
    joined = cube.join(sums, (F.col("row_total") == F.col("_t")) & F.col("row_value").eqNullSafe(F.col("_v")))
    return joined.withColumn("row_percent", 100 * F.col("n") / F.col("_n")).drop("_t", "_v", "_n")


def crosstab_wide(df: DataFrame, row: str, col: str, levels: list | None = None, percent: bool = False) -> DataFrame:
    """Cross-tab with one column per level of ``col`` and a Total row and column.

    Without ``levels`` Spark looks the distinct values up first (at most
    ``spark.sql.pivotMaxValues`` of them).
    """
    cells = crosstab(df, row, col).select(
        F.when(F.col("row_total") == 1, TOTAL).otherwise(F.col("row_value").cast("string")).alias(row),
        F.when(F.col("col_total") == 1, TOTAL).otherwise(F.col("col_value").cast("string")).alias("level"),
        "n",
        "row_percent",
    )
    names = [*map(str, levels), TOTAL] if levels is not None else None
    wide = cells.groupBy(row).pivot("level", names)
    return wide.agg(F.first("row_percent")) if percent else wide.agg(F.first("n")).na.fill(0)


def frequencies(df: DataFrame, cols) -> dict[str, DataFrame]:
    return {c: frequency(df, c) for c in as_list(cols)}
