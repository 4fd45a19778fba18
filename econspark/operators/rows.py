"""Looking at rows: head, tail, reproducible sample, column information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from econspark.operators.describe import describe
from econspark.schema import as_list, check_columns


def head(df: DataFrame, order_by, k: int = 10) -> DataFrame:
    """First ``k`` rows in order; each task keeps only its own top ``k``."""
    order_by = as_list(order_by)
    check_columns(df, order_by)
    return df.orderBy(*[F.col(f"`{c}`").asc() for c in order_by]).limit(k)


def tail(df: DataFrame, order_by, k: int = 10) -> DataFrame:
    """Last ``k`` rows in order."""
    order_by = as_list(order_by)
    check_columns(df, order_by)
    return df.orderBy(*[F.col(f"`{c}`").desc() for c in order_by]).limit(k)


def key_digest(keys: list[str], seed: int) -> Column:
    """MD5 of the keys as text and the seed, joined by ``|``: the same digest in any engine."""
    return F.md5(F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in keys], F.lit(str(seed))))


def sample_order(keys: list[str], seed: int) -> Column:
    return key_digest(keys, seed)


def sample_rows(df: DataFrame, key, k: int = 10, seed: int = 42) -> DataFrame:
    """Exactly ``k`` rows (all, if there are fewer), the same ones on every run: the rows whose
    hashed key comes first."""
    keys = as_list(key)
    check_columns(df, keys)
    return df.orderBy(sample_order(keys, seed), *[F.col(f"`{c}`") for c in keys]).limit(k)


def data_information(df: DataFrame) -> DataFrame:
    """Type, non-null, null and distinct counts per column."""
    return describe(df).select("variable", F.col("storage").alias("type"), "non_null", "nulls", "unique")


def list_rows(df: DataFrame, order_by, key=None, k: int = 10, seed: int = 42) -> dict[str, DataFrame]:
    return {
        "first": head(df, order_by, k),
        "last": tail(df, order_by, k),
        "sample": sample_rows(df, key or order_by, k, seed),
        "information": data_information(df),
    }
