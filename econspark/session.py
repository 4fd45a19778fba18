"""Checkpoint folder of the session, and tables written there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

#: Writes packed rows, of megabytes each, in small row groups. Parquet otherwise looks at sizes every hundred rows only, and holds as much in memory on writing and reading.
PACKED_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder that the cluster names, else one in the warehouse, which all executors share too.

    A warehouse in a local folder is shared only where everything runs on one machine; elsewhere a folder must be named.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        if named.startswith(("file:", "/")) and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder as Parquet and go on from there; columns that nobody reads are then skipped."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    packed = any(isinstance(field.dataType, T.BinaryType) for field in df.schema.fields)
    df.write.options(**(PACKED_ROWS if packed else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table of ``cut_lineage`` that has been replaced; the frame and all made from it can't be read any more."""
    context = df.sparkSession.sparkContext
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
