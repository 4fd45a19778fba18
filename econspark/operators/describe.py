"""Descriptive statistics: summarize, mean, tabstat, detail, describe, codebook."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from econspark.functions.dist import t_ppf_col
from econspark.plans.ranks import long_values, moments_and_quantiles, quantiles
from econspark.schema import (
    CATEGORICAL_MAX_LEVELS,
    as_list,
    check_columns,
    countable_columns,
    drop_missing,
    is_numeric,
    number,
    numeric_columns,
)

COLUMNS_PER_AGGREGATE = 50  # keeps one aggregate's generated code within the compiler's limits

# Fixed values of the statistical tables.
DETAIL_PERCENTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)
CV_LOW, CV_MEDIUM = 0.1, 0.5
SHAPE_LIMIT = 0.5
MISSING_GOOD, MISSING_FAIR = 5.0, 20.0
OUTLIER_REACH = 1.5



def _chosen(df: DataFrame, cols) -> list[str]:
    cols = as_list(cols) or numeric_columns(df)
    check_columns(df, cols)
    if not cols:
        raise ValueError("no numeric column")
    return cols


def _chunks(cols: Sequence[str]) -> list[list[str]]:
    return [list(cols[i : i + COLUMNS_PER_AGGREGATE]) for i in range(0, len(cols), COLUMNS_PER_AGGREGATE)]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _by_column(df: DataFrame, cols: Sequence[str], by: Sequence[str], stats) -> DataFrame:
    """``stats(column name)`` of all columns in a single aggregate, then one row per column."""
    keys = [F.col(f"`{k}`") for k in by]
    frames = []
    for part in _chunks(cols):
        rows = F.array(*[F.struct(F.lit(c).alias("variable"), *stats(c)) for c in part])
        frames.append(df.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, F.inline("_rows")))
    return _union(frames)


# Fixed form of a number in text; the test spares the failed parse of every other cell.
NUMBER_TEXT = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


# White space as Python's str.strip takes it.
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def strip(cell: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(cell, rf"^{_SPACE}|{_SPACE}\z", "")


def text_number(cell: Column) -> Column:
    """The number a trimmed text cell stands for, NULL if it is none."""
    return F.when(cell.rlike(NUMBER_TEXT), cell.try_cast("double"))


def summarize(df: DataFrame, cols=None, by=None) -> DataFrame:
    """N (non-empty), mean, sd, min, max per column; text columns whose non-empty cells all parse
    as numbers count as numeric, other columns report only N."""
    by = as_list(by)
    cols = as_list(cols) or [c for c in countable_columns(df) if c not in by]
    check_columns(df, [*cols, *by])

    keys = [F.col(f"`{k}`") for k in by]
    place = {c: i for i, c in enumerate(cols)}
    cells = []
    for c, i in place.items():
        dtype, col = df.schema[c].dataType, F.col(f"`{c}`")
        if isinstance(dtype, T.StringType):
            cells.append(F.nullif(strip(col), F.lit("")).alias(f"_c{i}"))
        elif is_numeric(dtype):
            cells.append(number(df, c).alias(f"_c{i}"))
        else:
            cells.append(col.alias(f"_c{i}"))
    rows = drop_missing(df, by).select(*keys, *cells)
    rows = rows.withColumns(
        {f"_v{i}": text_number(F.col(f"_c{i}")) for c, i in place.items() if isinstance(df.schema[c].dataType, T.StringType)}
    )

    def stats(name: str) -> list[Column]:
        dtype, cell = df.schema[name].dataType, F.col(f"_c{place[name]}")
        text = isinstance(dtype, T.StringType)
        out = [F.count(cell).alias("n")]
        if not text and not is_numeric(dtype):
            return out + [F.lit(None).cast("double").alias(a) for a in ("mean", "sd", "min", "max")]
        value = F.col(f"_v{place[name]}") if text else cell
        if text:  # NaN is a number without a value
            all_numbers = F.count(cell) == F.count(value)
            value = F.when(~F.isnan(value), value)
        figures = {"mean": F.avg(value), "sd": F.stddev_samp(value), "min": F.min(value), "max": F.max(value)}
        return out + [(F.when(all_numbers, f) if text else f).alias(a) for a, f in figures.items()]

    return _by_column(rows, cols, by, stats)


def mean_ci(df: DataFrame, cols=None, by=None, level: float = 0.95) -> DataFrame:
    """Mean, standard error, t interval, interval width and ± precision."""
    by, cols = as_list(by), _chosen(df, cols)

    def stats(name: str) -> list[Column]:
        v = number(df, name)
        return [
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("std_error"),
        ]

    out = _by_column(drop_missing(df, by), cols, by, stats).filter("n > 0")
    reach = t_ppf_col(F.lit((1 + level) / 2), (F.col("n") - 1).cast("double")) * F.col("std_error")
    return (
        out.withColumn("reach", reach)
        .withColumn("ci_lower", F.col("mean") - F.col("reach"))
        .withColumn("ci_upper", F.col("mean") + F.col("reach"))
        .withColumn("ci_width", 2 * F.col("reach"))
        .withColumnRenamed("reach", "precision")
    )


def _moments_and_quantiles(df, cols, by, stats, probs, accuracy, method="auto") -> DataFrame:
    """``stats`` and quantiles by column. Exact ones of whole columns take two reads that give all moments as well."""
    if len(cols) > COLUMNS_PER_AGGREGATE:
        return _union([_moments_and_quantiles(df, part, by, stats, probs, accuracy, method) for part in _chunks(cols)])
    if not by and accuracy is None and method == "auto":
        found = moments_and_quantiles(df, cols, probs)
        if found is not None:
            return found
    base = _by_column(drop_missing(df, by), cols, by, stats)
    q = quantiles(df, cols, probs, by, accuracy=accuracy, method=method).drop("n")
    return base.join(q, [*by, "variable"], "left")


def tabstat(df: DataFrame, cols=None, by=None, accuracy: int | None = None) -> DataFrame:
    """N, mean, sd, min, max, median, quartiles, range, IQR and CV per column."""
    by, cols = as_list(by), _chosen(df, cols)

    def stats(name: str) -> list[Column]:
        v = number(df, name)
        return [
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("sd"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
        ]

    rows = _moments_and_quantiles(df, cols, by, stats, [0.25, 0.5, 0.75], accuracy).filter("n > 0")
    cv = F.when(F.col("mean") != 0, F.col("sd") / F.col("mean"))
    return rows.select(
        *[F.col(f"`{k}`") for k in by],
        "variable", "n", "mean", "sd", "min", "max",
        F.col("q")[1].alias("median"),
        F.col("q")[0].alias("p25"),
        F.col("q")[2].alias("p75"),
        (F.col("max") - F.col("min")).alias("range"),
        (F.col("q")[2] - F.col("q")[0]).alias("iqr"),
        cv.alias("cv"),
    )


def transpose_stats(table: DataFrame, index: str = "variable") -> DataFrame:
    """Statistics as rows, variables as columns; for small result tables."""
    numeric = [c for c in numeric_columns(table) if c != index]
    cells = table.select(index, *[F.col(c).cast("double") for c in numeric])
    return cells.transpose(index).withColumnRenamed("key", "statistic")


def variation_class(cv: Column) -> Column:
    return (
        F.when(cv.isNull(), "Unknown")
        .when(cv < CV_LOW, "Low Variation (CV < 0.1)")
        .when(cv < CV_MEDIUM, "Medium Variation (CV 0.1-0.5)")
        .otherwise("High Variation (CV > 0.5)")
    )


def variation_summary(table: DataFrame) -> DataFrame:
    """Number of variables and average mean, sd and CV per variation class of a tabstat table."""
    return (
        table.withColumn("variation_group", variation_class(F.col("cv")))
        .groupBy("variation_group")
        .agg(
            F.count("*").alias("variables"),
            F.avg("mean").alias("mean"),
            F.avg("sd").alias("sd"),
            F.avg("cv").alias("cv"),
        )
    )


def skew_class(skew: Column) -> Column:
    return (
        F.when(F.abs(skew) < SHAPE_LIMIT, "Approximately symmetric")
        .when(skew > SHAPE_LIMIT, "Right-skewed (positive skew)")
        .otherwise("Left-skewed (negative skew)")
    )


def kurtosis_class(kurt: Column) -> Column:
    return (
        F.when(F.abs(kurt) < SHAPE_LIMIT, "Approximately normal")
        .when(kurt > SHAPE_LIMIT, "Heavy-tailed (leptokurtic)")
        .otherwise("Light-tailed (platykurtic)")
    )


def _shape(df: DataFrame, name: str) -> list[Column]:
    v = number(df, name)
    return [
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.skewness(v).alias("skew_pop"),
        F.kurtosis(v).alias("kurt_pop"),
    ]


def detail(df: DataFrame, cols=None, by=None, accuracy: int | None = None) -> DataFrame:
    """Nine percentiles, moments, shape and their verbal classes per column."""
    by, cols = as_list(by), _chosen(df, cols)
    probs = [p / 100 for p in DETAIL_PERCENTS]
    rows = _moments_and_quantiles(df, cols, by, lambda c: _shape(df, c), probs, accuracy).filter("n > 0")
    return rows.select(
        *[F.col(f"`{k}`") for k in by],
        "variable", "n", "mean", "sd", "min", "max",
        *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate(DETAIL_PERCENTS)],
        "skew_pop", "kurt_pop",
        skew_class(F.col("skew_pop")).alias("skew_class"),
        kurtosis_class(F.col("kurt_pop")).alias("kurtosis_class"),
    )


def adjusted_shape(n: Column, skew: Column, kurt: Column) -> tuple[Column, Column]:
    """Bias-corrected skewness and excess kurtosis from the population forms."""
    n = n.cast("double")
    g1 = F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))
    g2 = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6))
    return g1, g2


def with_k2(table: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add D'Agostino–Pearson z of skewness and kurtosis, K², p and verdict to rows with ``n``,
    ``skew_pop``, ``kurt_pop``; NULL below 8 rows. Step by step, so that no term is written twice."""
    n, c = F.col("_n"), F.col
    steps = {
        "_n": F.when(c("n") >= 8, c("n").cast("double")),
        "_y": c("skew_pop") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2))),
        "_beta2": 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)),
        "_w2": -1 + F.sqrt(2 * (c("_beta2") - 1)),
        "_u": c("_y") * F.sqrt((c("_w2") - 1) / 2),
        "z_skew": F.asinh("_u") / F.sqrt(F.lit(0.5) * F.log("_w2")),
        "_spread": 24 * n * (n - 2) * (n - 3) / (F.pow(n + 1, F.lit(2.0)) * (n + 3) * (n + 5)),
        "_x": (c("kurt_pop") + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt("_spread"),
        "_b1": 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))),
        "_a": 6 + 8 / c("_b1") * (2 / c("_b1") + F.sqrt(1 + 4 / (c("_b1") * c("_b1")))),
        "_base": 1 + c("_x") * F.sqrt(2 / (c("_a") - 4)),
        "_cube": F.signum("_base") * F.cbrt((1 - 2 / c("_a")) / F.abs("_base")),
        "z_kurt": (1 - 2 / (9 * c("_a")) - c("_cube")) / F.sqrt(2 / (9 * c("_a"))),
        "k2": c("z_skew") * c("z_skew") + c("z_kurt") * c("z_kurt"),
        "p_value": F.exp(-c("k2") / 2),
        "normal": c("p_value") >= alpha,
    }
    for name, step in steps.items():
        table = table.withColumn(name, step)
    return table.drop(*[name for name in steps if name.startswith("_")])


def normality_test(df: DataFrame, cols=None, by=None, alpha: float = 0.05) -> DataFrame:
    """D'Agostino–Pearson K² per column with the verdict at ``alpha``."""
    by, cols = as_list(by), _chosen(df, cols)
    rows = _by_column(drop_missing(df, by), cols, by, lambda c: _shape(df, c)).filter("n > 0")
    return with_k2(rows.drop("mean", "sd", "min", "max"), alpha)


def outliers(df: DataFrame, cols=None, by=None) -> DataFrame:
    """Quartile fences and the number of values outside them."""
    by, cols = as_list(by), _chosen(df, cols)
    group = [*by, "variable"]
    fences = outlier_fences(df, cols, by)
    rows = long_values(drop_missing(df, by), cols, by)
    limits = fences.select(*group, "lower", "upper")
    # without groups the fences are one row per column
    outside = rows.join(limits if by else F.broadcast(limits), group).filter(
        (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    )
    counts = outside.groupBy(*group).agg(F.count("*").alias("n_outliers"))
    return fences.join(counts, group, "left").withColumn(
        "n_outliers", F.coalesce("n_outliers", F.lit(0).cast("long"))
    )


def outlier_fences(df: DataFrame, cols, by=()) -> DataFrame:
    q = quantiles(df, cols, [0.25, 0.75], by)
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return q.select(
        *[F.col(f"`{k}`") for k in as_list(by)],
        "variable",
        "n",
        q1.alias("q1"),
        q3.alias("q3"),
        (q3 - q1).alias("iqr"),
        (q1 - OUTLIER_REACH * (q3 - q1)).alias("lower"),
        (q3 + OUTLIER_REACH * (q3 - q1)).alias("upper"),
    )


def outlier_values(df: DataFrame, col: str, order_by, k: int = 5) -> DataFrame:
    """The first ``k`` values outside the fences in the order of ``order_by``."""
    order_by = as_list(order_by)
    fence = outlier_fences(df, [col])
    low, high = fence.select("lower").scalar(), fence.select("upper").scalar()
    v = number(df, col)
    return (
        df.filter((v < low) | (v > high))
        .orderBy(*order_by)
        .limit(k)
        .select(*[F.col(f"`{c}`") for c in order_by if c != col], v.alias(col))
    )


# --- variable and data-set overviews ------------------------------------------------------------


def type_class(dtype: T.DataType) -> str:
    return "numeric" if is_numeric(dtype) else "string"


def type_label(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "Integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "Float"
    if isinstance(dtype, T.StringType):
        return "String"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "DateTime"
    return dtype.simpleString()


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``variable, unique, non_null, total`` in one read and one exchange, whatever the number of columns.

    A row becomes one small entry a column: its number and a digest of the value. Tasks count equal entries in a hash
    map that spills, so only (column, digest) pairs are exchanged. The 64-bit digest of a number or date is one to one; text and long decimals
    have 128 bits, of which two of d values are equal with a probability of about d² / 2¹²⁹.
    """
    entries = []
    for i, c in enumerate(cols):
        cell = _cell(df, c)
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            cell = cell + F.lit(0.0).cast(df.schema[c].dataType)  # the two zeros are one value
        long = isinstance(df.schema[c].dataType, (T.StringType, T.DecimalType))
        second = F.xxhash64(F.lit(i), cell, F.lit("salt")) if long else F.lit(0).cast("long")
        entries.append(F.struct(F.lit(i).alias("i"), F.when(cell.isNotNull(), F.xxhash64(cell)).alias("h1"), second.alias("h2")))
    counts = df.select(F.inline(F.array(*entries))).groupBy("i", "h1", "h2").agg(F.count("*").alias("n"))
    table = counts.groupBy("i").agg(F.count("h1").alias("unique"), F.coalesce(F.sum(F.when(F.col("h1").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"), F.sum("n").alias("total"))
    names = F.array(*[F.lit(c) for c in cols])
    # a table without rows has no entries, but every column has its line
    lines = df.sparkSession.range(len(cols)).select(F.col("id").cast("int").alias("i"), F.get(names, F.col("id").cast("int")).alias("variable"))
    zero = F.lit(0).cast("long")
    return lines.join(F.broadcast(table), "i", "left").select("variable", *[F.coalesce(c, zero).alias(c) for c in ("unique", "non_null", "total")])


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """``variable, unique``, exact or from a sketch; either way one read."""
    if approximate:
        return _by_column(
            df, cols, [], lambda c: [F.approx_count_distinct(_cell(df, c), 0.02).alias("unique")]
        )
    return value_counts(df, cols).select("variable", "unique")


def _cell(df: DataFrame, name: str) -> Column:
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col)
    return col


def describe(df: DataFrame, cols=None, approximate: bool = False) -> DataFrame:
    """Type class, storage type, non-null and null counts, null % and distinct values per column.

    Nested columns are counted for nulls only. ``approximate`` sketches the distinct counts.
    """
    cols = as_list(cols) or df.columns
    check_columns(df, cols)

    countable = [c for c in countable_columns(df) if c in cols]
    nested = [c for c in cols if c not in countable]

    def stats(name: str) -> list[Column]:
        cell = _cell(df, name)
        unique = F.approx_count_distinct(cell, 0.02) if name in countable else F.lit(None).cast("long")
        return [F.count(cell).alias("non_null"), (F.count(F.lit(1)) - F.count(cell)).alias("nulls"), unique.alias("unique")]

    frames = []
    if countable and not approximate:
        frames.append(value_counts(df, countable).select("variable", "non_null", (F.col("total") - F.col("non_null")).alias("nulls"), "unique"))
    rest = cols if approximate else nested
    if rest:
        frames.append(_by_column(df, rest, [], stats))
    kinds = [F.struct(F.lit(c).alias("variable"), F.lit(type_class(df.schema[c].dataType)).alias("type"), F.lit(df.schema[c].dataType.simpleString()).alias("storage")) for c in cols]
    rows = df.sparkSession.range(1).select(F.inline(F.array(*kinds))).join(F.broadcast(_union(frames)), "variable")  # a line a column
    total = F.col("non_null") + F.col("nulls")
    few = F.col("unique") <= CATEGORICAL_MAX_LEVELS
    return rows.select(
        "variable",
        F.when(few, F.concat(F.col("type"), F.lit(" (categorical)"))).otherwise(F.col("type")).alias("type"),
        "storage",
        "non_null",
        "nulls",
        F.when(total > 0, 100 * F.col("nulls") / total).otherwise(0.0).alias("null_pct"),
        "unique",
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns by class, missing cells and their share."""
    missing = [F.count(F.lit(1)) - F.count(_cell(df, c)) for c in df.columns]
    cells = sum(missing[1:], missing[0])
    numeric, text = len(numeric_columns(df)), sum(isinstance(f.dataType, T.StringType) for f in df.schema)
    n_cols = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("observations"), cells.alias("missing_values")).select(
        "observations",
        F.lit(n_cols).cast("long").alias("variables"),
        F.lit(numeric).cast("long").alias("numeric_variables"),
        F.lit(text).cast("long").alias("string_variables"),
        F.lit(len({f.dataType.simpleString() for f in df.schema})).cast("long").alias("column_types"),
        "missing_values",
        F.when(
            F.col("observations") > 0, 100 * F.col("missing_values") / (F.col("observations") * n_cols)
        ).alias("missing_pct"),
    )


_FIXED_WIDTH = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
    "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def column_sizes(df: DataFrame) -> DataFrame:
    """Data volume per column: type width times rows, or the bytes of text; largest first."""

    def stats(name: str) -> list[Column]:
        dtype, col = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(dtype, (T.StringType, T.BinaryType)):
            size = F.coalesce(F.sum(F.octet_length(col)), F.lit(0))
        elif isinstance(dtype, T.ArrayType):
            width = _FIXED_WIDTH.get(dtype.elementType.simpleString(), 8)
            size = F.coalesce(F.sum(F.greatest(F.size(col), F.lit(0))), F.lit(0)) * width
        else:
            size = F.count(F.lit(1)) * _FIXED_WIDTH.get(dtype.simpleString(), 16)
        return [size.cast("long").alias("bytes")]

    return (
        _by_column(df, df.columns, [], stats)
        .withColumn("megabytes", F.col("bytes") / (1024 * 1024))
        .orderBy(F.desc("bytes"), "variable")
    )


def quality_grade(missing_pct: Column) -> Column:
    return F.when(missing_pct < MISSING_GOOD, "Good").when(missing_pct < MISSING_FAIR, "Fair").otherwise("Poor")


def data_quality(df: DataFrame) -> DataFrame:
    """Friendly type, missing % and grade per column."""

    def stats(name: str) -> list[Column]:
        cell = _cell(df, name)
        return [
            F.lit(type_label(df.schema[name].dataType)).alias("type"),
            F.when(
                F.count(F.lit(1)) > 0, 100 * (F.count(F.lit(1)) - F.count(cell)) / F.count(F.lit(1))
            ).alias("missing_pct"),
        ]

    return _by_column(df, df.columns, [], stats).withColumn("quality", quality_grade(F.col("missing_pct")))


def value_counts_long(df: DataFrame, cols: Sequence[str], as_text: bool) -> DataFrame:
    """``variable, value, n``: one shuffle of the distinct values of all columns."""
    if not as_text:
        return long_values(df, cols).groupBy("variable", "value").agg(F.count("*").alias("n"))
    pairs = [F.struct(F.lit(c).alias("variable"), _cell(df, c).cast("string").alias("value")) for c in cols]
    rows = df.select(F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())
    return rows.groupBy("variable", "value").agg(F.count("*").alias("n"))


def modes(df: DataFrame, cols=None) -> DataFrame:
    """Most frequent value per numeric column (the smallest of several) and the distinct count."""
    counts = value_counts_long(df, _chosen(df, cols), as_text=False)
    return counts.groupBy("variable").agg(
        F.max_by("value", F.struct(F.col("n"), -F.col("value"))).alias("mode"),
        F.max("n").alias("mode_n"),
        F.count("*").alias("unique"),
    )


def codebook_numeric(df: DataFrame, cols=None, accuracy: int | None = None) -> DataFrame:
    """Counts, missing share, distinct values, moments, bias-corrected shape, quartiles, mode."""
    cols = _chosen(df, cols)

    def stats(name: str) -> list[Column]:
        return [F.count(F.lit(1)).alias("n_total"), *_shape(df, name)]

    rows = _moments_and_quantiles(df, cols, [], stats, [0.25, 0.5, 0.75], accuracy)
    rows = rows.join(modes(df, cols), "variable", "left")
    g1, g2 = adjusted_shape(F.col("n"), F.col("skew_pop"), F.col("kurt_pop"))
    missing = F.col("n_total") - F.col("n")
    return rows.select(
        "variable", "n_total",
        missing.alias("n_missing"),
        F.when(F.col("n_total") > 0, 100 * missing / F.col("n_total")).alias("missing_pct"),
        F.col("n").alias("n_valid"),
        F.coalesce("unique", F.lit(0).cast("long")).alias("unique"),
        "min", "max", "mean",
        F.col("q")[1].alias("median"), "sd", "mode",
        g1.alias("skew_adj"), g2.alias("kurt_adj"),
        F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"),
        (F.col("q")[2] - F.col("q")[0]).alias("iqr"),
    )


def codebook_categorical(df: DataFrame, cols=None) -> DataFrame:
    """Counts, distinct values, most and least common value with share, text lengths.

    Ties go to the smaller value.
    """
    cols = as_list(cols) or [c for c in countable_columns(df) if not is_numeric(df.schema[c].dataType)]
    check_columns(df, cols)
    counts = value_counts_long(df, cols, as_text=True)
    common = counts.groupBy("variable").agg(
        F.count("*").alias("unique"),
        F.sum("n").alias("n_valid"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("most_common"),
        F.max("n").alias("most_common_n"),
        F.min_by("value", F.struct(F.col("n"), F.col("value"))).alias("least_common"),
        F.min("n").alias("least_common_n"),
        F.max(F.length("value")).alias("max_length"),
        F.min(F.length("value")).alias("min_length"),
    )
    totals = _by_column(df, cols, [], lambda c: [F.count(F.lit(1)).alias("n_total")])
    valid = F.coalesce("n_valid", F.lit(0).cast("long"))
    missing = F.col("n_total") - valid
    return totals.join(common, "variable", "left").select(
        "variable", "n_total",
        missing.alias("n_missing"),
        F.when(F.col("n_total") > 0, 100 * missing / F.col("n_total")).alias("missing_pct"),
        valid.alias("n_valid"),
        F.coalesce("unique", F.lit(0).cast("long")).alias("unique"),
        "most_common",
        F.coalesce("most_common_n", F.lit(0).cast("long")).alias("most_common_n"),
        (100 * F.col("most_common_n") / F.col("n_valid")).alias("most_common_pct"),
        "least_common",
        F.coalesce("least_common_n", F.lit(0).cast("long")).alias("least_common_n"),
        (100 * F.col("least_common_n") / F.col("n_valid")).alias("least_common_pct"),
        F.col("max_length").cast("long").alias("max_length"),
        F.col("min_length").cast("long").alias("min_length"),
    )
