"""Tables as logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_log(table: DataFrame, key: Column, epoch: Column, seq: Column, data: Column, deleted: Column | None = None, ts: Column | None = None) -> DataFrame:
    """``table`` as a log. (epoch, seq) must be unique for each key."""
    gone = deleted if deleted is not None else F.lit(False)
    return table.select(key.alias("key"), epoch.cast("long").alias("epoch"), seq.cast("long").alias("seq"), F.when(gone, 1).otherwise(0).cast("byte").alias("vtype"),
        F.when(~gone, data.cast("string")).alias("data"), (ts if ts is not None else F.lit(None)).cast("timestamp_ntz").alias("ts"))


def padded(prefix: str, number: str) -> Column:
    """A key such as user_0000000042, whose order is the number's from 0 to ten digits; others as printf's %010d has them."""
    text = F.col(number).cast("string")
    digits = F.ltrim(text, F.lit("-"))
    fill = lambda width: F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))
    return F.when(text.startswith("-"), F.concat(F.lit(f"{prefix}-"), fill(9))).otherwise(F.concat(F.lit(prefix), fill(10)))


def events_log(events: DataFrame) -> DataFrame:
    """Users' last events; an error deletes the user. A thousand events are an epoch."""
    return as_log(events, padded("user_", "user_id"), F.expr("event_id div 1000"), F.col("event_id"), F.col("event_type"), F.col("event_type") == "error", F.col("ts"))


def orders_log(orders: DataFrame) -> DataFrame:
    return as_log(orders, padded("order_", "o_orderkey"), F.lit(0), F.col("o_orderkey"), F.col("o_orderstatus"))


def documents_log(documents: DataFrame) -> DataFrame:
    return as_log(documents, padded("doc_", "doc_id"), F.lit(0), F.col("doc_id"), F.col("text"))
