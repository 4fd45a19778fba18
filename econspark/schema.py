"""Column classification and missing-value normalisation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

CATEGORICAL_MAX_LEVELS = 20


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in skip]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def countable_columns(df: DataFrame) -> list[str]:
    """Columns whose values can be grouped, compared and cast to text (no arrays, maps, structs)."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f.name for f in df.schema if not isinstance(f.dataType, nested)]


def categorical_columns(
    df: DataFrame, max_levels: int = CATEGORICAL_MAX_LEVELS, approximate: bool = True
) -> list[str]:
    """Text columns plus every column with at most ``max_levels`` distinct values.

    A sketch settles the clear cases in one aggregate; columns whose estimate lies near the limit
    are counted exactly. ``approximate=False`` counts all of them exactly.
    """
    text = set(string_columns(df))
    open_cols = [c for c in countable_columns(df) if c not in text]
    few: set[str] = set()
    if open_cols and approximate:
        row = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in open_cols]).first()
        few = {c for c in open_cols if row[c] < max_levels * 0.75}
        open_cols = [c for c in open_cols if max_levels * 0.75 <= row[c] <= max_levels * 1.25]
    if open_cols:
        # one read and one exchange of (column, value) pairs; a distinct aggregate of many columns would multiply the rows
        pairs = [F.struct(F.lit(i).alias("i"), F.xxhash64(F.col(f"`{c}`")).alias("h"), F.col(f"`{c}`").isNotNull().alias("known")) for i, c in enumerate(open_cols)]
        counts = df.select(F.inline(F.array(*pairs))).where("known").select("i", "h").distinct().groupBy("i").count().collect()
        unique = {r["i"]: r["count"] for r in counts}
        few |= {c for i, c in enumerate(open_cols) if unique.get(i, 0) <= max_levels}
    return [c for c in df.columns if c in text or c in few]


def check_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def as_list(value: str | Sequence[str] | None) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def number(df: DataFrame, name: str) -> Column:
    """The column as double with NaN turned into NULL."""
    dtype = df.schema[name].dataType
    if not is_numeric(dtype):
        raise TypeError(f"column {name} is {dtype.simpleString()}, a numeric column is needed")
    col = F.col(f"`{name}`").cast("double")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col)
    return col


def present(df: DataFrame, name: str) -> Column:
    """Predicate 'value is there'; the IS NOT NULL part reaches the scan."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return col.isNotNull() & ~F.isnan(col)
    return col.isNotNull()


def drop_missing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    for name in dict.fromkeys(names):
        df = df.filter(present(df, name))
    return df


def complete_cases(
    df: DataFrame, numeric: Sequence[str], keys: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Rows where all ``numeric`` and ``keys`` are present, the numeric ones as double.

    ``keep`` columns travel along unfiltered.
    """
    numeric = list(dict.fromkeys(numeric))
    keys = [k for k in dict.fromkeys(keys) if k not in numeric]
    keep = [k for k in dict.fromkeys(keep) if k not in numeric and k not in keys]
    check_columns(df, [*numeric, *keys, *keep])
    rows = drop_missing(df, [*numeric, *keys])
    return rows.select(
        *[F.col(f"`{k}`") for k in [*keys, *keep]],
        *[F.col(f"`{c}`").cast("double").alias(c) for c in numeric],
    )


def normalise(df: DataFrame) -> DataFrame:
    """NaN → NULL in every floating column, everything else unchanged."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})


def key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]
