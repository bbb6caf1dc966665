"""Queries through binary files and the life of a store, each with SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.keys import prefix_range
from keystrata.http_api import handle
from keystrata.operators import versions as V
from keystrata.plans.catalogue import _SQL, _WITH, HI, KEY, LO
from keystrata.plans.store import Store
from keystrata.plans.store_queries import _THIRDS, _changes, _filled, _folder
from keystrata.schema import StoreConfig
from keystrata.sources.adapters import events_log, padded
from keystrata.sources.binary import discover, load, save_files
from keystrata.sources.codec import TableFile, WALCorruptionError, read_wal
from keystrata.sources.migrate import read_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _uri(folder: str) -> str:
    return folder if "://" in folder else f"file://{folder}"


def _saved(spark: SparkSession, d: str, kind: str) -> tuple[str, list[str]]:
    folder = _uri(_folder(spark, kind))
    return folder, save_files(events_log(spark.read.parquet(f"{d}/events.parquet")), folder, kind)


def _opened(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store, name


@query(f"{_WITH} SELECT key, data AS value FROM latest")
def wal_scan(spark, d):
    """Log files, one for each epoch, read back as a log."""
    folder, _ = _saved(spark, d, "wal")
    return V.scan(load(spark, "wal", folder))


@query(f"WITH {_SQL['log']} SELECT key, epoch, seq, data AS value FROM log WHERE key >= '{LO}' AND key < '{HI}'")
def wal_range(spark, d):
    folder, _ = _saved(spark, d, "wal")
    return load(spark, "wal", folder, LO, HI).select("key", "epoch", "seq", F.col("data").alias("value"))


@query(f"{_WITH} SELECT key, data AS value FROM latest")
def wal_recovery(spark, d):
    """What a crash has torn at the end of the last log is not read; all before it is."""
    folder, paths = _saved(spark, d, "wal")
    for path in paths[-1:]:
        store, name = _opened(path)
        with store.open_input_file(name) as file:
            whole = file.read()
        with store.open_output_stream(name) as out:
            out.write(whole + whole[:17])
    return V.scan(load(spark, "wal", folder))


@query("SELECT TRUE AS detected, CAST(0 AS BIGINT) AS at_offset")
def wal_corruption(spark, d):
    """A changed byte in the first entry of a log is an error that names its offset."""
    _, paths = _saved(spark, d, "wal")
    store, name = _opened(paths[0])
    with store.open_input_file(name) as file:
        data = bytearray(file.read())
    data[20] ^= 255
    with store.open_output_stream(name) as out:
        out.write(bytes(data))
    found = (False, -1)
    try:
        with store.open_input_stream(name) as stream:
            list(read_wal(stream))
    except WALCorruptionError as error:
        found = (True, error.entry_offset)
    return spark.createDataFrame([found], "detected boolean, at_offset long")


_FLUSHED = "flushed AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY epoch, key ORDER BY seq DESC) AS r FROM log) WHERE r = 1)"


@query(f"WITH {_SQL['log']}, {_FLUSHED} SELECT key, epoch, vtype = 1 AS deleted, data AS value FROM flushed")
def sst_scan(spark, d):
    """Sorted tables, one for each epoch, through their index."""
    folder, _ = _saved(spark, d, "sst")
    return load(spark, "sst", folder).select("key", "epoch", (F.col("vtype") == 1).alias("deleted"), F.col("data").alias("value"))


@query(f"{_WITH} SELECT key, data AS value FROM latest WHERE key = '{KEY}'")
def sst_point_get(spark, d):
    folder, _ = _saved(spark, d, "sst")
    return V.get(load(spark, "sst", folder, KEY, KEY + "\0"), KEY)


@query(f"{_WITH} SELECT key, data AS value FROM latest WHERE key >= '{LO}' AND key < '{HI}'")
def sst_range(spark, d):
    folder, _ = _saved(spark, d, "sst")
    return V.scan(load(spark, "sst", folder, LO, HI), LO, HI)


@query(f"WITH {_SQL['log']} SELECT count(DISTINCT key) AS n_keys, bool_or(key = '{KEY}') AS has_key, bool_or(key >= '{LO}' AND key < '{HI}') AS has_range FROM log WHERE epoch = (SELECT max(epoch) FROM log)")
def sst_index(spark, d):
    """What the index of the newest table knows without a look at its entries."""
    _, paths = _saved(spark, d, "sst")
    store, name = _opened(paths[-1])
    with store.open_input_file(name) as file:
        table = TableFile(file, file.size())
        return spark.createDataFrame([(len(table.keys), table.has(KEY), table.has_keys_in_range(LO, HI))], "n_keys long, has_key boolean, has_range boolean")


@query(f"WITH {_SQL['log']} SELECT epoch, row_number() OVER (ORDER BY epoch) AS place FROM (SELECT DISTINCT epoch FROM log)")
def run_discovery(spark, d):
    """Files of a folder by the numbers in their names; what has none comes last."""
    folder, _ = _saved(spark, d, "sst")
    found = sorted((epoch for epoch, _ in discover(folder, ".sst")), key=lambda epoch: (epoch is None, epoch or 0))
    return spark.createDataFrame([(epoch, n) for n, epoch in enumerate(found, 1)], "epoch long, place long")


@query(f"""WITH {_SQL['log']}, {_SQL['latest']} SELECT key, data AS value FROM latest""")
def folder_adopted(spark, d):
    """Older epochs as tables and newer ones as logs, adopted by a store."""
    folder, log = _uri(_folder(spark, "adopted")), events_log(spark.read.parquet(f"{d}/events.parquet"))
    middle = (log.agg(F.max("epoch")).first()[0] or 0) // 2
    save_files(log.where(F.coalesce(F.col("epoch") <= middle, F.lit(True))), f"{folder}/sstables", "sst")
    save_files(log.where(F.col("epoch") > middle), f"{folder}/wal", "wal")
    store = Store.open(spark, _folder(spark, "adopting"))
    store.append_log(read_folder(spark, folder))
    return store.scan()


@query(f"WITH {_THIRDS} SELECT key, data AS value FROM newest")
def store_recovery(spark, d):
    """Reopened beside what writers left who died: a run that no version names, and a version that was never finished."""
    store = _filled(spark, d, "recovery")
    store.files.create("runs/commit-of-a-dead-writer/part-0.parquet", "torn")
    store.files.create("manifest/unfinished-0", '{"version": 4, "ru')
    return Store.open(spark, store.root).scan()


@query(f"""WITH {_THIRDS}, keys AS (SELECT DISTINCT printf('user_%010d', o_custkey) AS key FROM orders)
SELECT keys.key, data AS value FROM keys LEFT JOIN newest ON keys.key = newest.key""")
def store_multi_get(spark, d):
    """Many keys from a compacted store."""
    store = _filled(spark, d, "multi_get")
    store.compact()
    return store.multi_get(spark.read.parquet(f"{d}/orders.parquet").select(padded("user_", "o_custkey").alias("key")))


_NATIONS = "ranges AS (SELECT printf('user_%010d', n_nationkey * 7) AS lo, printf('user_%010d', n_nationkey * 7 + 10) AS hi FROM nation)"


@query(f"WITH {_THIRDS}, {_NATIONS} SELECT lo, hi, key, data AS value FROM ranges JOIN newest ON key >= lo AND key < hi WHERE vtype = 0")
def store_multi_scan(spark, d):
    """Many ranges from a compacted store."""
    store = _filled(spark, d, "multi_scan")
    store.compact()
    nation = spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") * 7).alias("a"), (F.col("n_nationkey") * 7 + 10).alias("b"))
    return store.multi_scan(nation.select(padded("user_", "a").alias("lo"), padded("user_", "b").alias("hi")))


@query("""WITH c AS (SELECT printf('user_%010d', c_custkey) AS key, c_custkey FROM customer),
ranges AS (SELECT printf('user_%010d', c_custkey) AS lo, printf('user_%010d', c_custkey + 3) AS hi FROM customer)
SELECT lo, hi, key, CAST(c_custkey AS VARCHAR) AS value FROM ranges JOIN c ON key >= lo AND key < hi""")
def multi_range_many(spark, d):
    """As many ranges as customers, cut at common boundaries."""
    customer = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", (F.col("c_custkey") + 3).alias("b"))
    log = V.appended(events_log(spark.read.parquet(f"{d}/events.parquet")).limit(0), customer.select(padded("user_", "c_custkey").alias("key"), F.col("c_custkey").cast("string").alias("value")), 0, F.lit(0))
    return V.multi_scan(log, customer.select(padded("user_", "c_custkey").alias("lo"), padded("user_", "b").alias("hi")))


@query(f"WITH {_THIRDS} SELECT key, CASE WHEN key >= '{LO}' AND key < '{HI}' THEN NULL ELSE data END AS value FROM newest")
def store_delete_range(spark, d):
    store = _filled(spark, d, "delete_range")
    store.delete_range(LO, HI)
    return store.scan()


@query("""WITH b AS (SELECT n_nationkey, 'k' || (n_nationkey % 7) AS key, n_name FROM nation)
SELECT key, max_by(n_name, n_nationkey) AS value FROM b GROUP BY key""")
def batch_writes(spark, d):
    """Batches of ten, each one commit; later ones win."""
    store = Store.open(spark, _folder(spark, "batches"))
    rows = sorted((r.n_nationkey, r.n_name) for r in spark.read.parquet(f"{d}/nation.parquet").collect())
    for at in range(0, len(rows), 10):
        store.batch_put([(f"k{n % 7}", name) for n, name in rows[at : at + 10]])
    return store.scan()


@query(f"""WITH {_THIRDS} SELECT 'before' AS at, CAST(3 AS BIGINT) AS runs, count(*) AS entries, count(*) FILTER (WHERE vtype = 1) AS tombstones FROM part
UNION ALL SELECT 'flushed', 1, count(*), count(*) FILTER (WHERE vtype = 1) FROM newest
UNION ALL SELECT 'after', 1, count(*) FILTER (WHERE vtype = 0), 0 FROM newest""")
def compaction_effect(spark, d):
    """Runs, entries and tombstones of a store before and after flush and compaction."""
    store, seen = _filled(spark, d, "effect"), []
    for at, step in (("before", None), ("flushed", store.flush), ("after", store.compact)):
        if step:
            step()
        if at == "after":
            store.put("zzz", "")  # a second run, so that there is something to compact
            store.compact()
            store.delete("zzz")
            store.compact()
        s = store.stats()
        seen.append((at, s["runs"], s["entries"], s["tombstones"]))
    return spark.createDataFrame(seen, "at string, runs long, entries long, tombstones long")


@query(f"""WITH {_THIRDS}, runs AS (SELECT epoch, min(key) AS lo, max(key) AS hi FROM part GROUP BY epoch)
SELECT q.hi AS hi, count(*) FILTER (WHERE lo < q.hi AND runs.hi >= '') AS opened FROM runs, (VALUES ('{LO}'), ('user_'), ('v')) q(hi) GROUP BY q.hi""")
def runs_rejected(spark, d):
    """How many runs their least and greatest keys let be opened for ranges that end at three keys."""
    runs = _filled(spark, d, "rejected").manifest().runs
    return spark.createDataFrame([(hi, sum(r.may_hold("", hi) for r in runs)) for hi in (LO, "user_", "v")], "hi string, opened long")


@query("""SELECT * FROM (VALUES ('memtable_threshold', '0', FALSE), ('memtable_threshold', '1073741824', TRUE), ('memtable_threshold', '1073741825', FALSE), ('fsync_interval_ms', '-1', FALSE), ('fsync_interval_ms', '10000', TRUE),
('fsync_interval_ms', '10001', FALSE), ('compaction_threshold', '1', FALSE), ('compaction_threshold', '2', TRUE), ('compaction_interval_s', '0', FALSE), ('compaction_interval_s', '1', TRUE)) v(setting, value, accepted)""")
def config_limits(spark, d):
    cases = [("memtable_threshold", 0), ("memtable_threshold", 1 << 30), ("memtable_threshold", (1 << 30) + 1), ("fsync_interval_ms", -1), ("fsync_interval_ms", 10_000), ("fsync_interval_ms", 10_001),
        ("compaction_threshold", 1), ("compaction_threshold", 2), ("compaction_interval_s", 0), ("compaction_interval_s", 1)]

    def accepted(setting: str, value: int) -> bool:
        try:
            StoreConfig(**{setting: value})
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(s, str(v), accepted(s, v)) for s, v in cases], "setting string, value string, accepted boolean")


@query("""WITH n AS (SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation)
SELECT 'PUT' AS verb, key, 200 AS status, NULL AS value FROM n UNION ALL SELECT 'GET', key, 200, value FROM n UNION ALL SELECT 'RANGE', key, 200, value FROM n WHERE key >= 'C' AND key < 'J'
UNION ALL SELECT 'DELETE', key, 200, NULL FROM n WHERE key < 'B' UNION ALL SELECT 'GET again', key, 200, CASE WHEN key >= 'B' THEN value END FROM n WHERE key < 'C'""")
def http_life(spark, d):
    """The verbs over HTTP's request function: a batch, single keys, a range, deletions."""
    import json
    from urllib.parse import quote

    store, seen = Store.open(spark, _folder(spark, "http")), []
    nations = sorted((r.n_name, str(r.n_regionkey)) for r in spark.read.parquet(f"{d}/nation.parquet").collect())
    status, _ = handle(store, "POST", "/keys/batch", json.dumps({"keys": [k for k, _ in nations], "values": [v for _, v in nations]}))
    seen += [("PUT", k, status, None) for k, _ in nations]
    values = {r.key: r.value for r in store.scan().collect()}  # one job for what single requests would find one by one
    first = handle(store, "GET", f"/keys?key={quote(nations[0][0])}")
    seen += [("GET", k, first[0], first[1]["value"] if k == nations[0][0] else values[k]) for k, _ in nations]
    status, found = handle(store, "GET", "/keys/range?start_key=C&end_key=J")
    seen += [("RANGE", r["key"], status, r["value"]) for r in found["results"]]
    seen += [("DELETE", k, handle(store, "DELETE", f"/keys?key={quote(k)}")[0], None) for k, _ in nations if k < "B"]
    again = [(k, handle(store, "GET", f"/keys?key={quote(k)}")) for k, _ in nations if k < "C"]
    seen += [("GET again", k, status, answer["value"]) for k, (status, answer) in again]
    return spark.createDataFrame(seen, "verb string, key string, status int, value string")


@query("SELECT * FROM (VALUES ('PUT', '/keys', 400), ('GET', '/keys', 400), ('GET', '/keys/range', 400), ('POST', '/keys/batch', 400), ('DELETE', '/keys', 400), ('GET', '/nope', 404), ('POST', '/keys', 404)) v(method, target, status)")
def http_refusals(spark, d):
    store = Store.open(spark, _folder(spark, "refusals"))
    cases = [("PUT", "/keys"), ("GET", "/keys"), ("GET", "/keys/range"), ("POST", "/keys/batch"), ("DELETE", "/keys"), ("GET", "/nope"), ("POST", "/keys")]
    return spark.createDataFrame([(m, t, handle(store, m, t)[0]) for m, t in cases], "method string, target string, status int")


@query(f"WITH {_THIRDS} SELECT key, data AS value FROM part WHERE vtype = 0")
def store_tail(spark, d):
    """The commits of a store as a stream, in spite of a flush between them."""
    from keystrata.streaming.ingest import tail

    root = _folder(spark, "tail")
    store = Store.open(spark, f"{root}/store")
    for part in ("event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2"):
        store.write(_changes(spark, d).where(part), order_by="event_id", deletes=F.col("gone"))
        if part.endswith("1"):
            store.flush()
    writer = tail(store).where("vtype = 0").select("key", F.col("data").alias("value")).writeStream.option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).format("parquet").start(f"{root}/out").awaitTermination()
    return spark.read.schema("key string, value string").parquet(f"{root}/out")


@query("SELECT * FROM (VALUES ('open', TRUE), ('in block', TRUE), ('closed twice', TRUE), ('write after', FALSE), ('read after', TRUE)) v(step, done)")
def store_life(spark, d):
    """Open, use as a block, close, close again; writes are refused from then on, reads are not."""
    seen = []
    with Store.open(spark, _folder(spark, "life")) as store:
        seen.append(("open", True))
        seen.append(("in block", store.put("k", "v")))
    store.close()
    seen.append(("closed twice", True))
    try:
        seen.append(("write after", store.put("k", "w")))
    except RuntimeError:
        seen.append(("write after", False))
    seen.append(("read after", store.get("k") == "v"))
    return spark.createDataFrame(seen, "step string, done boolean")


@query("SELECT printf('doc_%010d', doc_id) AS key, 'n' || doc_id AS value FROM documents WHERE doc_id >= 100 AND doc_id < 200")
def sst_prefix(spark, d):
    """A prefix of keys from sorted tables."""
    folder, wanted = _uri(_folder(spark, "prefix")), prefix_range("doc_00000001")
    docs = spark.read.parquet(f"{d}/documents.parquet").select(padded("doc_", "doc_id").alias("key"), F.expr("doc_id div 50").alias("epoch"), F.col("doc_id").alias("seq"), F.lit(0).cast("byte").alias("vtype"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("data"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    save_files(docs, folder, "sst")
    return V.scan(load(spark, "sst", folder, *wanted), *wanted)


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
