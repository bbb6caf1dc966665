"""Queries over the driver's tables, one or more for each operator, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions import stats
from keystrata.functions.keys import entry_bytes, in_range, is_tombstone, live_value, prefix_range
from keystrata.operators import versions as V
from keystrata.sources.adapters import documents_log, events_log, orders_log, padded

LO, HI, KEY = "user_0000000003", "user_0000000020", "user_0000000008"

_SQL = {
    "log": """log AS (SELECT printf('user_%010d', user_id) AS key, event_id // 1000 AS epoch, event_id AS seq,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS vtype, CASE WHEN event_type <> 'error' THEN event_type END AS data, ts FROM events)""",
    "latest": """latest AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY epoch DESC, seq DESC) AS r FROM log) WHERE r = 1)""",
}
_WITH = f"WITH {_SQL['log']}, {_SQL['latest']} "
_R = f"key >= '{LO}' AND key < '{HI}'"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return events_log(spark.read.parquet(f"{d}/events.parquet"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return orders_log(spark.read.parquet(f"{d}/orders.parquet"))


@query(f"{_WITH} SELECT key, data AS value FROM latest WHERE key = '{KEY}'")
def point_get(spark, d):
    return V.get(_events(spark, d), KEY)


@query(f"{_WITH} SELECT key, data AS value FROM latest WHERE {_R}")
def range_scan(spark, d):
    return V.scan(_events(spark, d), LO, HI)


@query(f"{_WITH} SELECT key, data AS value FROM latest WHERE {_R} AND vtype = 0")
def range_scan_live(spark, d):
    return V.scan(_events(spark, d), LO, HI, include_tombstones=False)


@query(f"{_WITH} SELECT key, data AS value FROM latest WHERE key >= '{HI}'")
def scan_open_end(spark, d):
    return V.scan(_events(spark, d), HI, None)


@query(f"{_WITH} SELECT key, data AS value FROM latest WHERE key < '{LO}'")
def scan_open_start(spark, d):
    return V.scan(_events(spark, d), None, LO)


@query(f"{_WITH} SELECT key, data AS value FROM latest WHERE key >= '{HI}' AND key < '{LO}'")
def scan_inverted(spark, d):
    return V.scan(_events(spark, d), HI, LO)


@query(f"{_WITH} SELECT key, epoch, seq, vtype = 1 AS deleted FROM latest")
def newest_versions(spark, d):
    return V.latest(_events(spark, d)).select("key", "epoch", "seq", is_tombstone().alias("deleted"))


@query(f"{_WITH} SELECT key, data AS value FROM latest WHERE vtype = 0")
def compact(spark, d):
    return V.compacted(_events(spark, d)).select("key", F.col("data").alias("value"))


@query(f"""WITH {_SQL['log']}, {_SQL['latest']}, tail AS (SELECT * FROM log WHERE epoch >= 5),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY epoch DESC, seq DESC) AS r FROM tail) WHERE r = 1)
SELECT key, data AS value, vtype FROM merged""")
def compact_partial(spark, d):
    """A compaction that leaves older runs out must keep tombstones."""
    log = _events(spark, d)
    return V.compacted(log.where("epoch >= 5"), drop_tombstones=False).select("key", F.col("data").alias("value"), F.col("vtype").cast("int").alias("vtype"))


@query(f"""{_WITH}, live AS (SELECT key, data AS value FROM latest WHERE vtype = 0)
SELECT 'before' AS side, key, value FROM live UNION ALL SELECT 'after', key, value FROM live""")
def compaction_equivalence(spark, d):
    """Live rows before and after a compaction are the same, and those that SQL finds."""
    log = _events(spark, d)
    before, after = V.live(log), V.live(V.compacted(log))
    return before.select(F.lit("before").alias("side"), "*").unionAll(after.select(F.lit("after").alias("side"), "*"))


@query(f"WITH {_SQL['log']} SELECT count(*) > 0 AS present FROM log WHERE key = '{KEY}'")
def has_key(spark, d):
    return V.has_key(_events(spark, d), KEY)


@query(f"WITH {_SQL['log']} SELECT count(*) > 0 AS present FROM log WHERE {_R}")
def has_keys_in_range(spark, d):
    return V.has_keys_in_range(_events(spark, d), LO, HI)


@query(f"WITH {_SQL['log']}, {_SQL['latest'].replace('FROM log)', 'FROM log WHERE epoch <= 4)')} SELECT key, data AS value FROM latest")
def snapshot_as_of(spark, d):
    return V.scan(V.as_of(_events(spark, d), 4))


@query(f"WITH {_SQL['log']} SELECT epoch, min(key) AS min_key, max(key) AS max_key, count(*) AS n_entries, count(*) FILTER (WHERE vtype = 1) AS n_tombstones FROM log GROUP BY epoch")
def run_stats(spark, d):
    return stats.run_stats(_events(spark, d))


@query(f"""WITH {_SQL['log']} SELECT key, epoch, seq, data AS value FROM
(SELECT *, row_number() OVER (PARTITION BY epoch, key ORDER BY seq DESC) AS r FROM log) WHERE r = 1""")
def flush_runs(spark, d):
    return V.flushed(_events(spark, d)).select("key", "epoch", "seq", F.col("data").alias("value"))


@query(f"{_WITH} SELECT key, CAST(strlen(key) + 64 + 35 + coalesce(strlen(data), 0) AS BIGINT) AS size_bytes FROM latest")
def memtable_size(spark, d):
    return stats.sorted_map_size(_events(spark, d))


@query(f"{_WITH} SELECT (SELECT count(*) FROM log) AS log_rows, count(*) AS live_rows, (SELECT count(*) FROM log) / count(*) AS amplification FROM latest WHERE vtype = 0")
def space_amplification(spark, d):
    return stats.space_amplification(_events(spark, d))


@query(f"""{_WITH}, keys AS (SELECT DISTINCT printf('user_%010d', o_custkey) AS key FROM orders)
SELECT keys.key, data AS value FROM keys LEFT JOIN latest ON keys.key = latest.key""")
def multi_get(spark, d):
    keys = spark.read.parquet(f"{d}/orders.parquet").select(padded("user_", "o_custkey").alias("key"))
    return V.multi_get(_events(spark, d), keys)


@query(f"""{_WITH}, keys AS (SELECT DISTINCT printf('user_%010d', o_custkey) AS key FROM orders)
SELECT count(*) AS n_keys, count(data) AS n_hits, count(data) / count(*) AS hit_rate FROM keys LEFT JOIN latest ON keys.key = latest.key""")
def read_hit_rate(spark, d):
    return stats.hit_rate(multi_get(spark, d))


_RANGES = "ranges AS (SELECT printf('user_%010d', n_nationkey * 7) AS lo, printf('user_%010d', n_nationkey * 7 + 10) AS hi FROM nation)"


def _ranges(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") * 7).alias("a"), (F.col("n_nationkey") * 7 + 10).alias("b"))
    return nation.select(padded("user_", "a").alias("lo"), padded("user_", "b").alias("hi"))


@query(f"{_WITH}, {_RANGES} SELECT lo, hi, count(key) AS n_keys FROM ranges LEFT JOIN latest ON key >= lo AND key < hi GROUP BY lo, hi")
def multi_range(spark, d):
    return V.count_ranges(_events(spark, d), _ranges(spark, d))


@query(f"{_WITH}, {_RANGES} SELECT lo, hi, key, data AS value FROM ranges JOIN latest ON key >= lo AND key < hi")
def multi_range_rows(spark, d):
    return V.multi_scan(_events(spark, d), _ranges(spark, d))


_GONE = "user_0000000010"


@query(f"{_WITH} SELECT key, CASE WHEN key >= '{_GONE}' THEN data END AS value FROM latest")
def delete_range_then_read(spark, d):
    log = _events(spark, d)
    gone = V.latest(log.where(in_range(None, _GONE))).select("key", F.lit(None).cast("string").alias("value"))
    return V.scan(V.appended(log, gone, 999_999, F.lit(0), F.lit(True)))


@query(f"""{_WITH}, puts AS (SELECT printf('user_%010d', c_custkey) AS key, max_by(c_mktsegment, c_custkey) AS value FROM customer GROUP BY 1)
SELECT coalesce(l.key, p.key) AS key, CASE WHEN p.key IS NOT NULL THEN p.value ELSE l.data END AS value FROM latest l FULL JOIN puts p ON l.key = p.key""")
def put_upsert(spark, d):
    puts = spark.read.parquet(f"{d}/customer.parquet").select(padded("user_", "c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), F.col("c_custkey").alias("n"))
    return V.scan(V.appended(_events(spark, d), puts, 999_999, F.col("n")))


@query("""WITH b AS (SELECT printf('user_%010d', user_id) AS key, event_type AS value, event_id AS pos FROM events)
SELECT key, max_by(value, pos) AS value FROM b GROUP BY key""")
def batch_put_last_wins(spark, d):
    batch = spark.read.parquet(f"{d}/events.parquet").select(padded("user_", "user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("pos"))
    empty = _events(spark, d).limit(0)
    return V.scan(V.appended(empty, batch, 0, F.col("pos")))


@query(f"""WITH {_SQL['log']}, {_SQL['latest']}
SELECT key, data AS value FROM latest""")
def merge_runs(spark, d):
    """Three runs with the same keys, merged newest first."""
    log = _events(spark, d)
    parts = [V.flushed(log.where(c)) for c in ("epoch % 3 = 0", "epoch % 3 = 1", "epoch % 3 = 2")]
    return V.merged(*parts)


@query(f"""WITH {_SQL['log']}, {_SQL['latest']} SELECT key, data AS value FROM latest WHERE vtype = 0""")
def merge_runs_live(spark, d):
    log = _events(spark, d)
    return V.merged(V.flushed(log.where("epoch < 5")), V.flushed(log.where("epoch >= 5")), include_tombstones=False)


@query("SELECT printf('order_%010d', o_orderkey) AS key, o_orderstatus AS value FROM orders WHERE starts_with(printf('order_%010d', o_orderkey), 'order_00000001')")
def prefix_scan(spark, d):
    return V.scan(_orders(spark, d), *prefix_range("order_00000001"))


@query("SELECT printf('doc_%010d', doc_id) AS key, text AS value FROM documents WHERE doc_id >= 100 AND doc_id < 200")
def document_range(spark, d):
    log = documents_log(spark.read.parquet(f"{d}/documents.parquet"))
    return V.scan(log, "doc_0000000100", "doc_0000000200")


@query("SELECT min(k) AS min_key, max(k) AS max_key, count(*) AS n_keys, CAST(sum(strlen(k) + 64 + 35 + strlen(o_orderstatus)) AS BIGINT) AS size_bytes FROM (SELECT printf('order_%010d', o_orderkey) AS k, o_orderstatus FROM orders)")
def table_summary(spark, d):
    log = _orders(spark, d)
    return log.agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_keys"), F.sum(entry_bytes()).cast("long").alias("size_bytes"))


@query(f"{_WITH} SELECT vtype = 1 AS deleted, count(*) AS n_keys, count(data) AS n_values FROM latest GROUP BY 1")
def tombstone_counts(spark, d):
    newest = V.latest(_events(spark, d)).select(is_tombstone().alias("deleted"), live_value().alias("value"))
    return newest.groupBy("deleted").agg(F.count("*").alias("n_keys"), F.count("value").alias("n_values"))


@query(f"""WITH {_SQL['log']}, seen AS (SELECT key, seq, vtype, data, seq % 10 < 7 AS reads,
  max(CASE WHEN seq % 10 >= 7 THEN seq END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM log)
SELECT s.key, s.seq, l.data AS value FROM seen s LEFT JOIN log l ON l.key = s.key AND l.seq = s.before WHERE s.reads""")
def mixed_read_write(spark, d):
    """Seven reads to three writes, in one order: each read finds what was written before it."""
    log = _events(spark, d)
    reads = log.where("seq % 10 < 7").select("key", "epoch", "seq")
    return V.read_at(log.where("seq % 10 >= 7"), reads).select("key", "seq", "value")


@query("""WITH t AS (SELECT n_nationkey * 1.5 AS ms FROM nation), s AS (SELECT list_sort(list(ms)) AS l FROM t)
SELECT CAST(l[1] AS DOUBLE) AS min, CAST(l[len(l)] AS DOUBLE) AS max, CAST(list_avg(l) AS DOUBLE) AS mean, CAST(list_median(l) AS DOUBLE) AS median,
  CAST(l[CAST(floor(len(l) * 0.95) AS BIGINT) + 1] AS DOUBLE) AS p95, CAST(l[CAST(floor(len(l) * 0.99) AS BIGINT) + 1] AS DOUBLE) AS p99 FROM s""")
def latency_summary(spark, d):
    """The summary of 25 timings."""
    seconds = [r.n_nationkey * 1.5 / 1000 for r in spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey").collect()]
    found = {k: round(v, 9) for k, v in stats.latency_summary(seconds).items()}
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} double" for k in found))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
