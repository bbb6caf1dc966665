"""Tables that cut lineage, in the folder which the cluster shares (``spark.checkpoint.dir``).

Every table written here survives the loss of an executor, and belongs to the call that wrote it. A call
deletes what only it has read (``Tables``); what its result still reads stays until the caller, who alone
knows when the result has been written, leaves the ``held`` block that it made the call in. Nothing here
deletes a table of another call.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HELD: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one is set where none is configured and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="keystrata-")
        atexit.register(shutil.rmtree, local, True)
        folder = f"file://{local}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A path of its own in the shared folder, deleted at the end of the innermost ``held`` block unless ``keep``."""
    path = f"{shared_dir(spark)}/keystrata-{tag}-{uuid.uuid4().hex}"
    if _HELD and not keep:
        _HELD[-1].append(path)
    return path


def write(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """``df`` as a written table: the same rows, with no lineage behind them."""
    path = path or new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes one table or folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Tables:
    """The tables that one call writes for itself; they go when its block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        return self

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        self.paths.append(new_path(self.spark, tag, keep=True))
        return write(df, tag, self.paths[-1])

    def __exit__(self, *_) -> None:
        while self.paths:
            remove(self.spark, self.paths.pop())


@contextlib.contextmanager
def held(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what results that were made inside it read; write them before."""
    paths: list[str] = []
    _HELD.append(paths)
    try:
        yield
    finally:
        _HELD.remove(paths)
        for path in paths:
            remove(spark, path)


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Limits the bytes of an Arrow batch, since a text may have megabytes.

    Spark reads this setting when a plan runs, so it stays set in the session; a lower one is left alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > size:
        spark.conf.set(key, str(size))


BROADCAST_IDS = 1_000_000


def few(table: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``table`` (a few numbers a row, written), broadcast up to ``most`` rows, some tens of megabytes; beyond, joins shuffle it."""
    return F.broadcast(table) if table.count() <= most else table
