"""Writing result tables."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "json", "csv", "orc")


def slug(title: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", title.lower()).strip("_") or "table"


def save_results(tables: dict[str, DataFrame], path: str, format: str = "parquet", mode: str = "overwrite") -> dict[str, str]:
    """Write every titled table to its own folder below ``path``: title → folder.

    Titles that differ only in punctuation get numbered folders.
    """
    if format not in FORMATS:
        raise ValueError(f"format is one of {', '.join(FORMATS)}")
    written: dict[str, str] = {}
    for title, table in tables.items():
        name, n = slug(title), 1
        while f"{path}/{name}" in written.values():
            n += 1
            name = f"{slug(title)}_{n}"
        writer = table.write.mode(mode).format(format)
        if format == "csv":
            writer = writer.option("header", True)
        writer.save(f"{path}/{name}")
        written[title] = f"{path}/{name}"
    return written


MANIFEST = "report.json"


def save_report(tables: dict[str, DataFrame], path: str, format: str = "parquet") -> dict[str, str]:
    """Write all titled tables as one report below ``path``, all or nothing: title → folder.

    The tables go to a folder of this run. Only when all are written does a manifest name them, put in place by one rename, so
    ``read_report`` sees the last whole report: a failed or killed run leaves the one before as it was. Folders of earlier runs that are
    no longer named are removed afterwards.
    """
    first = next(iter(tables.values()), None)
    spark = first.sparkSession if first is not None else SparkSession.getActiveSession()
    files, of = _file_system(spark, path)
    run = f"run-{uuid.uuid4().hex}"
    written = save_results(tables, f"{path}/{run}", format, mode="error")
    manifest = {"format": format, "run": run, "tables": {title: folder.rpartition("/")[2] for title, folder in written.items()}}
    draft = of(f"{path}/{run}-{MANIFEST}")
    files.mkdirs(of(path))
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    # The manifest that exists stays readable until the new one takes its place: Hadoop's rename with overwriting is one step.
    context = spark.sparkContext._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(context.Options.Rename, 1)
    overwrite[0] = context.Options.Rename.OVERWRITE
    context.FileContext.getFileContext(of(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(files.makeQualified(draft), files.makeQualified(of(f"{path}/{MANIFEST}")), overwrite)
    for status in files.listStatus(of(path)):
        name = status.getPath().getName()
        if name.startswith("run-") and not name.startswith(run):
            files.delete(status.getPath(), True)
    return written


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the report that was last written whole below ``path``, by title."""
    files, of = _file_system(spark, path)
    place = of(f"{path}/{MANIFEST}")
    if not files.exists(place):
        raise FileNotFoundError(f"no whole report below {path}")
    manifest = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/{MANIFEST}").collect()))
    reader = spark.read.format(manifest["format"])
    if manifest["format"] == "csv":
        reader = reader.option("header", True)
    return {title: reader.load(f"{path}/{manifest['run']}/{folder}") for title, folder in manifest["tables"].items()}


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and a maker of its paths."""
    context = spark.sparkContext
    of = context._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(context._jsc.hadoopConfiguration()), of
