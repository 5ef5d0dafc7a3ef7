"""File sinks and sources around the quality checkpoint and app tables.

Paths are Hadoop paths: local, HDFS or object stores all work the same way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_csv_extract(df: DataFrame, batch_dir: str) -> None:
    """CSV extract with a header and no index column (one batch directory)."""
    (df.write.mode("errorifexists").option("header", True).option("escape", '"')
     .option("multiLine", True).csv(batch_dir))


def latest_batch(spark: SparkSession, root: str) -> str | None:
    """Newest batch directory under ``root`` (names sort by time)."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    return f"{root.rstrip('/')}/{names[-1]}" if names else None


def read_latest_csv_batch(spark: SparkSession, root: str, schema: T.StructType | None = None,
                          na_values: list[str] | None = None) -> DataFrame:
    """Read the latest CSV batch (explicit schema; inference only if none given).

    ``na_values``: texts to read as missing in string columns (a pandas-style
    reader treats e.g. "None", "NA", "null" so), off by default.
    """
    path = latest_batch(spark, root)
    if path is None:
        raise FileNotFoundError(f"no batch under {root}")
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    if na_values:
        df = df.select(*[
            F.when(F.col(f"`{f.name}`").isin(*na_values), F.lit(None)).otherwise(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in df.schema.fields])
    return df


def publish_json(df: DataFrame, target: str) -> None:
    """Publish a report table as JSON lines to any Hadoop path (s3a://, hdfs://, file:)."""
    df.write.mode("overwrite").json(target)


def publish_reports(reports: dict[str, DataFrame], target: str) -> list[str]:
    """Publish every report under its relative path below ``target``; returns the paths."""
    paths = [f"{target.rstrip('/')}/{name.strip('/')}" for name in sorted(reports)]
    for path, name in zip(paths, sorted(reports), strict=True):
        publish_json(reports[name], path)
    return paths


def _open_target(target: str):
    """(file system, base path) of a target URI, as tasks reach it."""
    from pyarrow import fs
    if "://" not in target and not target.startswith("file:"):
        return fs.LocalFileSystem(), target
    system, path = fs.FileSystem.from_uri(target)
    return system, path


def publish_tree(spark: SparkSession, source: str, target: str, open_target=_open_target) -> DataFrame:
    """Copy every file below ``source`` to ``target`` under its relative path: (key, n_bytes).

    Spark lists and reads the files, one row a file, wherever they are stored; tasks write
    them through ``open_target`` (pyarrow's file system of the target's scheme; any other
    pair of a file system and a base path will do).  A file is written beside its place and
    moved there, so a task that runs again, or a second publication, leaves whole files
    alone; files that are gone from the source stay at the target.
    """
    ship_package(spark)  # workers import this module
    fs, p = _fs(spark, source)
    if not fs.exists(p):
        raise FileNotFoundError(source)
    root = fs.resolvePath(p).toUri().getPath().rstrip("/")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
             .select(F.substring_index(F.col("path"), root + "/", -1).alias("key"), "content"))
    # Spark's scans leave out files without a byte: those come from the listing.
    listed, empty = fs.listFiles(p, True), []
    while listed.hasNext():
        one = listed.next()
        if one.getLen() == 0:
            empty.append((one.getPath().toUri().getPath().removeprefix(root + "/"), bytearray()))
    files = files.unionByName(spark.createDataFrame(empty, files.schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_target(target)
        for batch in batches:
            for i in range(batch.num_rows):
                key, content = batch.column("key")[i].as_py(), batch.column("content")[i].as_buffer()
                place = f"{base.rstrip('/')}/{key}"
                folder, _, name = place.rpartition("/")
                system.create_dir(folder, recursive=True)
                aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as out:
                    out.write(content)
                system.move(aside, place)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([content.size], pa.int64())], ["key", "n_bytes"])

    return files.mapInArrow(run, "key string, n_bytes long")


def stored_files(spark: SparkSession, path: str) -> int:
    """Number of files below ``path``, by the file system's own summary: a scan of Spark
    would leave out files without a byte and those whose name begins with an underscore."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getFileCount()


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Create an empty Parquet table with ``schema`` if absent; return the table."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append rows (registry entries, new users, activity lines) to a table."""
    df.write.mode("append").parquet(path)
