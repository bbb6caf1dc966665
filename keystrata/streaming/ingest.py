"""Streams of changes into a store, and a running view of the newest versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystrata.operators.versions import latest
from keystrata.plans.store import Store


def ingest(store: Store, changes: DataFrame, name: str, checkpoint: str, order_by: str | None = None, deleted: str | None = None, interval: str | None = None) -> StreamingQuery:
    """Commits each micro-batch of ``changes`` (key, value, ...) to ``store`` as one epoch.

    The manifest remembers the last batch of query ``name``, so a batch that is run again after a failure
    is committed once. There is no event time and no lateness: the order of arrival is the order of versions.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.write(batch, order_by=order_by, deletes=F.col(deleted) if deleted else None, batch=(name, number))

    writer = changes.writeStream.queryName(name).foreachBatch(commit).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    store.queries.append(query)
    return query


def running_latest(log: DataFrame) -> DataFrame:
    """The newest versions of a streaming log; its state is one row for each key."""
    return latest(log)


def tail(store: Store) -> DataFrame:
    """The rows of the store's commits as a stream, version after version of its manifest.

    It begins with what the oldest version kept holds. Rows of commits that failed never show up; flush and
    compaction add nothing. A stream that has fallen behind what ``vacuum`` keeps fails.
    """
    from keystrata.streaming.tail import TailSource

    store.spark.dataSource.register(TailSource)
    return store.spark.readStream.format(TailSource.name()).load(store.root)
