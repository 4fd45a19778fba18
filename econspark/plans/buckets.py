"""Order-preserving buckets: the split points that make global order work run in parallel.

A mergeable sketch gives at most MAX_BUCKETS row quantiles of a column. Every row then belongs
to one bucket by value alone, so the assignment survives recomputation on any executor. A bucket
holds about 1/B of the rows unless single values are heavier than that, and heavy values collapse
as soon as rows are counted per value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from econspark.session import cut_lineage

MIN_BUCKETS = 32
MAX_BUCKETS = 65_536  # split points in one row of the driver; a bucket of 100 TB is then 1.6 GB


@dataclass(frozen=True)
class OrderBuckets:
    splits: tuple[float, ...]

    @property
    def size(self) -> int:
        return len(self.splits) - 1

    def assign(self, df: DataFrame, column: str, out: str = "bucket") -> DataFrame:
        if not self.splits:
            return df.withColumn(out, F.lit(0))
        split = Bucketizer(
            splits=list(self.splits), inputCol=column, outputCol=out, handleInvalid="keep"
        )
        return split.transform(df).withColumn(out, F.col(out).cast("int"))


def bucket_count(df: DataFrame) -> int:
    """Buckets for a table: a few per shuffle partition, which is what the cluster sets by the size of its data."""
    return min(MAX_BUCKETS, max(MIN_BUCKETS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def sketch(column: str, buckets: int) -> Column:
    """Aggregate with the split points of a plainly named column; its state is bounded by the accuracy."""
    probs = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    return F.expr(f"percentile_approx({column}, array({probs}), {max(4 * buckets, 1000)})")


def from_sketch(points: Sequence[float] | None) -> OrderBuckets:
    if not points:
        return OrderBuckets(())
    return OrderBuckets((-math.inf, *sorted({float(p) for p in points if math.isfinite(p)}), math.inf))


def fit_buckets(df: DataFrame, value: Column) -> OrderBuckets:
    """One small job: the split points of ``value`` (numeric)."""
    row = df.select(value.alias("v")).agg(sketch("v", bucket_count(df)).alias("points")).first()
    return from_sketch(row["points"])


def ordered_parts(df: DataFrame, *order: Column | str, part: str = "part", tie: str = "tie") -> DataFrame:
    """``df`` in range partitions of the whole order, numbered by ``part``; ``tie`` tells equal rows apart.

    Every order column takes part in the split, of whatever type, and equal rows can be split by ``tie``: a
    value that most rows share, or a column of text, is spread like any other. The table is written once, since the
    split points are drawn from a sample.
    """
    numbered = df.withColumn(tie, F.monotonically_increasing_id())
    return cut_lineage(numbered.repartitionByRange(*order, F.col(tie)).withColumn(part, F.spark_partition_id()))


def part_offsets(parts: DataFrame, amount: Column, part: str = "part") -> DataFrame:
    """``part``, ``before`` (amount in earlier parts) and ``total``: as many rows as there are partitions."""
    cells = parts.groupBy(part).agg(amount.alias("cell"))
    upto = F.sum("cell").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, 0))
    return cells.select(part, (upto - F.col("cell")).alias("before"), F.sum("cell").over(Window.partitionBy()).alias("total"))
