"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from econspark.operators.describe import strip, text_number
from econspark.schema import normalise


def read_csv(spark: SparkSession, path, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header row. Types come from ``schema`` or, at the price of one more read, from the data."""
    reader = spark.read.option("header", True).options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return normalise(reader.csv(path))


def read_text_csv(spark: SparkSession, path, **options) -> DataFrame:
    """CSV with every cell as trimmed text; empty cells become NULL."""
    raw = spark.read.option("header", True).option("inferSchema", False).options(**options).csv(path)
    return raw.select(*[F.nullif(strip(F.col(f"`{c}`")), F.lit("")).alias(c) for c in raw.columns])


def parse_numbers(df: DataFrame, cols=None) -> DataFrame:
    """Turn text columns whose non-empty cells are all numbers into doubles.

    Which columns qualify is settled by one aggregate over the text columns.
    """
    text = cols or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    cells = {c: F.nullif(strip(F.col(f"`{c}`")), F.lit("")) for c in text}
    row = df.agg(
        *[
            ((F.count(cells[c]) > 0) & (F.count(cells[c]) == F.count(text_number(cells[c])))).alias(f"ok{i}")
            for i, c in enumerate(text)
        ]
    ).first()
    numeric = {c: text_number(cells[c]) for i, c in enumerate(text) if row[f"ok{i}"]}
    return normalise(df.withColumns(numeric)) if numeric else df


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)
