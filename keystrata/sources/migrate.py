"""Reads a folder of binary logs and sorted tables (``wal/``, ``sstables/``) as one log, to be adopted by a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.schema import LOG
from keystrata.sources.binary import discover, load


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Tables count by their number, logs after all tables by theirs; unfinished files are not read."""
    tables, logs = (_files(f"{folder.rstrip('/')}/{sub}", suffix) for sub, suffix in (("sstables", ".sst"), ("wal", ".wal")))
    after = max((number for number, _ in tables if number is not None), default=-1) + 1
    found = spark.createDataFrame([], LOG)
    if tables:
        found = found.unionByName(load(spark, "sst", ",".join(path for _, path in tables)))
    if logs:
        rows = load(spark, "wal", ",".join(path for _, path in logs))
        found = found.unionByName(rows.withColumn("epoch", F.col("epoch") + after))
    return found


def _files(folder: str, suffix: str) -> list[tuple[int, str]]:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    return discover(folder, suffix) if store.get_file_info(name).type == fs.FileType.Directory else []
