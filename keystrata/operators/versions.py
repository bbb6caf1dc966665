"""Reads of a versioned log as plans over DataFrames.

Every function takes a log (``keystrata.schema.LOG``) and returns a DataFrame; nothing runs before the
caller asks, but for ``multi_scan``, which looks at the ranges to plan. Predicates on the key are put below the choice of the newest version, so they reach the scan;
tombstones are filtered above it, for below they would bring older versions back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.keys import in_range, is_tombstone, live_value

#: Ranges that each row is compared with, one by one; ranges that are broadcast, cut at boundaries; and how many of these.
PLAIN_RANGES, BROADCAST_RANGES, BOUNDARIES = 32, 10_000, 96
#: Bytes up to which a table of keys is broadcast, by the size that Spark's statistics give it.
BROADCAST_BYTES = 32 << 20


def latest(log: DataFrame) -> DataFrame:
    """The newest version of each key: the row with the greatest (epoch, seq), tombstones included."""
    newest = F.max_by(F.struct("vtype", "data", "ts", "epoch", "seq"), F.struct("epoch", "seq"))
    return log.groupBy("key").agg(newest.alias("m")).select("key", "m.epoch", "m.seq", "m.vtype", "m.data", "m.ts")


def live(log: DataFrame) -> DataFrame:
    """key and value of the newest versions that are not tombstones."""
    return latest(log).where(~is_tombstone()).select("key", F.col("data").alias("value"))


def get(log: DataFrame, key: str) -> DataFrame:
    """key and value of one key; a row with null for a tombstone, no row for a key that never was."""
    return latest(log.where(F.col("key") == F.lit(key))).select("key", live_value().alias("value"))


def scan(log: DataFrame, start: str | None = None, end: str | None = None, include_tombstones: bool = True) -> DataFrame:
    """key and value for start <= key < end, ascending. Deleted keys have null, or are left out."""
    newest = latest(log.where(in_range(start, end)))
    if not include_tombstones:
        newest = newest.where(~is_tombstone())
    return newest.select("key", live_value().alias("value")).orderBy("key")


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """key and value of each distinct key of ``keys``; null for missing and deleted ones.

    The log's versions are first reduced to the keys asked for, so what is shuffled follows the question.
    """
    wanted = keys.select("key").distinct()
    asked = F.broadcast(wanted) if small(wanted) else wanted
    found = latest(log.join(asked, "key", "left_semi")).select("key", live_value().alias("value"))
    return wanted.join(found, "key", "left")


def small(table: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether Spark's statistics, taken without running anything, put a table at ``most`` bytes or fewer."""
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most


def hull(ranges: DataFrame) -> tuple[str | None, str | None]:
    """The least lo and the greatest hi of the ranges that hold something; None for none."""
    return tuple(ranges.where("lo < hi").agg(F.min("lo"), F.max("hi")).first())


def multi_scan(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """lo, hi, key and value for every key of each range lo <= key < hi of ``ranges``; tombstones have null.

    Rows outside all ranges are dropped before the newest versions are chosen: by a filter that reaches the
    scan for few ranges, and for more by the span of all ranges and a join with the ranges cut at boundaries.
    """
    asked = ranges.select("lo", "hi").where("lo < hi").distinct()
    inside = (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi"))
    value = lambda rows: latest(rows).select("key", live_value().alias("value"))
    first = asked.limit(PLAIN_RANGES + 1).collect()
    if len(first) <= PLAIN_RANGES:
        wanted = F.lit(False)
        for r in first:
            wanted = wanted | in_range(r.lo, r.hi)
        return value(log.where(wanted)).join(F.broadcast(asked), inside).select("lo", "hi", "key", "value")
    n, low, high = asked.agg(F.count("*"), F.min("lo"), F.max("hi")).first()
    log = log.where(in_range(low, high))
    # Many ranges: both sides are cut at the same boundaries, which makes the join one of equal numbers. Ranges that
    # are few enough to broadcast are cut evenly themselves; else the rows are, for these are then shuffled by part.
    few = n <= BROADCAST_RANGES
    boundaries = BOUNDARIES if few else max(BOUNDARIES, min(1024, 3 * int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    points = asked.select(F.col("lo").alias("key")) if few else log.select("key")
    rows = points.orderBy(F.xxhash64("key")).limit(20 * boundaries).orderBy("key").collect()
    bounds = F.array(*[F.lit(rows[i * len(rows) // boundaries].key) for i in range(boundaries)]) if rows else F.array().cast("array<string>")
    part = lambda key: F.size(F.filter(bounds, lambda b: b <= key))
    cut = asked.withColumn("part", F.explode(F.sequence(part(F.col("lo")), part(F.col("hi")))))
    if few:
        cut = F.broadcast(cut)
        held = (F.col("_part") == F.col("_of")) & (F.col("key") >= F.col("_lo")) & (F.col("key") < F.col("_hi"))
        log = log.withColumn("_part", part(F.col("key"))).join(F.broadcast(cut.toDF("_lo", "_hi", "_of")), held, "left_semi").drop("_part")
    return value(log).withColumn("part", part(F.col("key"))).join(cut, "part").where(inside).select("lo", "hi", "key", "value")


def count_ranges(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """lo, hi and n_keys (deleted keys count) of every range, empty ones included."""
    counts = multi_scan(log, ranges).groupBy("lo", "hi").agg(F.count("*").alias("n_keys"))
    return ranges.select("lo", "hi").distinct().join(counts, ["lo", "hi"], "left").select("lo", "hi", F.coalesce("n_keys", F.lit(0)).cast("long").alias("n_keys"))


def has_key(log: DataFrame, key: str) -> DataFrame:
    """present: whether any version of the key exists, tombstones included."""
    return log.where(F.col("key") == F.lit(key)).select(F.lit(1).alias("x")).limit(1).agg((F.count("*") > 0).alias("present"))


def has_keys_in_range(log: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """present: whether any version of any key of the range exists, tombstones included."""
    return log.where(in_range(start, end)).select(F.lit(1).alias("x")).limit(1).agg((F.count("*") > 0).alias("present"))


def as_of(log: DataFrame, epoch: int) -> DataFrame:
    """The log as it was when ``epoch`` had been committed."""
    return log.where(F.col("epoch") <= epoch)


def read_at(log: DataFrame, reads: DataFrame) -> DataFrame:
    """``reads`` (key, epoch, seq, ...) with value: of the newest version at or before each, null for deleted and missing keys.

    Within an epoch versions and reads are taken in order; what an epoch begins with is the newest version of
    the key's earlier epochs, one row for each. So a key with very many rows is split by its epochs.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("key", "epoch").orderBy("seq", F.col("_read").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    asked = reads.select("key", "epoch", "seq", F.struct(*[reads[c] for c in reads.columns]).alias("_read"))
    rows = log.select("key", "epoch", "seq", F.struct("vtype", "data").alias("m")).unionByName(asked, allowMissingColumns=True)
    here = rows.withColumn("_last", F.last("m", ignorenulls=True).over(order)).where("_read IS NOT NULL")
    ends = log.groupBy("key", "epoch").agg(F.max_by(F.struct("vtype", "data"), F.col("seq")).alias("m"))
    ends = ends.unionByName(asked.select("key", "epoch").distinct(), allowMissingColumns=True).groupBy("key", "epoch").agg(F.first("m", ignorenulls=True).alias("m"))
    earlier = Window.partitionBy("key").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.withColumn("_first", F.last("m", ignorenulls=True).over(earlier)).select(F.col("key").alias("_key"), F.col("epoch").alias("_epoch"), "_first")
    joined = here.join(begins, (F.col("key") == F.col("_key")) & (F.col("epoch") == F.col("_epoch")), "left")
    m = F.coalesce("_last", "_first")
    return joined.select("_read.*", F.when(m["vtype"] == 0, m["data"]).alias("value"))


def flushed(log: DataFrame) -> DataFrame:
    """The newest version of each key within each epoch, as flushing one sorted map for each would write."""
    newest = F.max_by(F.struct("seq", "vtype", "data", "ts"), F.col("seq"))
    return log.groupBy("epoch", "key").agg(newest.alias("m")).select("key", "epoch", "m.seq", "m.vtype", "m.data", "m.ts")


def compacted(log: DataFrame, drop_tombstones: bool = True) -> DataFrame:
    """The newest versions, with their own (epoch, seq). Tombstones may go only if ``log`` holds every older run."""
    newest = latest(log)
    return newest.where(~is_tombstone()) if drop_tombstones else newest


def merged(*runs: DataFrame, include_tombstones: bool = True) -> DataFrame:
    """key and value over several runs, newest version first of all by (epoch, seq), ascending by key."""
    union = runs[0]
    for run in runs[1:]:
        union = union.unionByName(run)
    return scan(union, include_tombstones=include_tombstones)


def appended(log: DataFrame, changes: DataFrame, epoch: int, position: Column, deletes: Column | None = None) -> DataFrame:
    """``log`` with ``changes`` (key, value) as one epoch; of equal keys the greatest ``position`` counts."""
    gone = F.coalesce(deletes, F.lit(False)) if deletes is not None else F.lit(False)
    rows = changes.select("key", F.lit(epoch).cast("long").alias("epoch"), position.cast("long").alias("seq"), F.when(gone, 1).otherwise(0).cast("byte").alias("vtype"), F.when(~gone, F.col("value")).alias("data"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    return log.unionByName(rows)
