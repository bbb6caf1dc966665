"""Queries that go through a store: committed, maintained and read back from its runs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.plans.catalogue import _WITH
from keystrata.plans.store import Store
from keystrata.sources.adapters import padded
from keystrata.streaming.ingest import ingest


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one; a temporary one where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix=f"keystrata-{name}-")
        atexit.register(shutil.rmtree, local, True)
        return local
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select(padded("user_", "user_id").alias("key"), F.col("event_type").alias("value"), "event_id", (F.col("event_type") == "error").alias("gone"))


def _filled(spark: SparkSession, d: str, name: str) -> Store:
    store, changes = Store.open(spark, _folder(spark, name)), _changes(spark, d)
    for part in ("event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2"):
        store.write(changes.where(part), order_by="event_id", deletes=F.col("gone"))
    return store


def store_commit_read(spark: SparkSession, d: str) -> DataFrame:
    """Three commits, read as one."""
    return _filled(spark, d, "commits").scan()


def store_compacted_read(spark: SparkSession, d: str) -> DataFrame:
    """The same after flush, compaction and reopening."""
    store = _filled(spark, d, "compacted")
    store.flush()
    store.put("user_9999999999", "last")
    store.compact()
    return Store.open(spark, store.root).scan()


def store_runs(spark: SparkSession, d: str) -> DataFrame:
    """What the manifest knows of each run."""
    runs = _filled(spark, d, "runs").manifest().runs
    return spark.createDataFrame([(r.min_epoch, r.min_key, r.max_key, r.n_entries, r.n_tombstones) for r in runs], "epoch long, min_key string, max_key string, n_entries long, n_tombstones long")


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream into a store, then its newest versions."""
    root = _folder(spark, "stream")
    store = Store.open(spark, f"{root}/store")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")  # a file's own name is no folder to watch
    changes = events.select(padded("user_", "user_id").alias("key"), F.col("event_type").alias("value"), "event_id", (F.col("event_type") == "error").alias("gone"))
    ingest(store, changes, "events", f"{root}/checkpoint", order_by="event_id", deleted="gone").awaitTermination()
    return store.scan()


_THIRDS = """part AS (SELECT printf('user_%010d', user_id) AS key, event_id % 3 AS epoch, event_id AS seq,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS vtype, CASE WHEN event_type <> 'error' THEN event_type END AS data FROM events),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY epoch DESC, seq DESC) AS r FROM part) WHERE r = 1)"""

QUERIES = {f.__name__: f for f in (store_commit_read, store_compacted_read, store_runs, stream_ingest)}
SQL = {
    "store_commit_read": f"WITH {_THIRDS} SELECT key, data AS value FROM newest",
    "store_compacted_read": f"WITH {_THIRDS} SELECT key, data AS value FROM newest WHERE vtype = 0 UNION ALL SELECT 'user_9999999999', 'last'",
    "store_runs": f"WITH {_THIRDS} SELECT epoch, min(key) AS min_key, max(key) AS max_key, count(*) AS n_entries, count(*) FILTER (WHERE vtype = 1) AS n_tombstones FROM part GROUP BY epoch",
    "stream_ingest": f"{_WITH} SELECT key, data AS value FROM latest",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
