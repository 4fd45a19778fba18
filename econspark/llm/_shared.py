"""What the operators here have in common: sending code by value, written tables, checks of columns."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from econspark.session import ensure_checkpoint_dir

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def send_by_value(name: str) -> None:
    """Tasks get the functions of module ``name`` inside their closures."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


send_by_value(__name__)


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


#: For rows of megabytes: Parquet's writer looks at sizes after each row, where it would hold 100 rows before its first look.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def written(df: DataFrame, label: str, options: dict[str, int] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder; later steps start from the files."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Tasks that write a narrow table: some per core, and no fewer than a sixteenth of the shuffle partitions."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))


def fewer(df: DataFrame) -> DataFrame:
    """``df`` in at most ``parts`` tasks, each of which takes several partitions one after another.

    A table has a file for each task at least, and where the folder is a local one, Hadoop starts two processes or more for
    each file (chmod), each of which counts for as much memory as its executor until it has begun.
    """
    return df.coalesce(parts(df.sparkSession))


def removed(table: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    context = table.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def append_struct(df: DataFrame, into: str, ddl: str, judge: Callable[[], Callable], *columns: str) -> DataFrame:
    """``df`` with a struct column made in tasks from ``columns``.

    ``judge()`` is called once per task and gives a function from the columns' values of one row (texts as bytes) to the
    values of the struct in order. The other columns pass through untouched. A column named ``into`` is replaced.
    """
    need(df, *columns)
    df = df.drop(into)
    at = [df.columns.index(c) for c in columns]
    kind = StructType.fromDDL(ddl)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        one, arrow = judge(), to_arrow_type(kind)
        for batch in batches:
            given = [batch.column(i) for i in at]
            given = [c.cast(pa.binary()) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c for c in given]
            rows = [dict(zip(kind.names, one(*(v.as_py() for v in values)), strict=True)) for values in zip(*given, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, arrow)], [*batch.schema.names, into])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(into, kind)]))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
