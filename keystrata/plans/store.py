"""A durable store: commits append immutable sorted runs, reads plan over the runs of one version.

A commit is a new run and a new manifest version; it is durable and visible as a whole, or not at all.
``flush`` merges the runs of single commits, ``compact`` merges all runs and drops tombstones. Both keep
each row's own (epoch, seq), so no maintenance can make an old version look new. Files of a version stay
until ``vacuum``, so open readers keep their snapshot.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.keys import in_range, is_tombstone, live_value
from keystrata.operators import versions
from keystrata.plans.manifest import Conflict, Files, Manifest, Manifests, Run
from keystrata.schema import LOG, REGULAR, TOMBSTONE, StoreConfig, checked_location

ATTEMPTS = 20


class Store:
    """One namespace of string keys and values in one folder."""

    def __init__(self, spark: SparkSession, storage_dir: str, config: StoreConfig | None = None, **settings):
        self.spark, self.config = spark, config or StoreConfig(**settings)
        self.root = checked_location(storage_dir)
        self.files = Files(spark, self.root)
        self.manifests = Manifests(self.files)
        self._open, self._last_compaction, self._synced = True, time.monotonic(), 0.0
        self._stopped, self._maintainer = threading.Event(), None
        self.queries: list = []

    @classmethod
    def open(cls, spark: SparkSession, storage_dir: str, **settings) -> Store:
        """Opens or creates a store. What no manifest names was never committed and is not read."""
        return cls(spark, storage_dir, StoreConfig(**{"fsync_interval_ms": 1000} | settings))

    def close(self) -> None:
        """Stops the streaming queries that feed the store and its maintenance; commits are durable already. May be called again."""
        for query in self.queries:
            query.stop()
        self._stopped.set()
        if self._maintainer:
            self._maintainer.join()
        self._open = False

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    # Writing

    def put(self, key: str, value: str) -> bool:
        """Sets one key."""
        return self.batch_put([(key, value)])[0]

    def delete(self, key: str) -> bool:
        """Deletes a key by a tombstone, whether or not it exists."""
        self._commit_rows([(key, None, TOMBSTONE)])
        return True

    def batch_put(self, pairs: Sequence[tuple[str, str]]) -> list[bool]:
        """Sets many keys in one atomic commit; of equal keys the last counts. An empty batch commits nothing."""
        if pairs:
            self._commit_rows([(k, v, REGULAR) for k, v in pairs])
        return [True] * len(pairs)

    def batch_delete(self, keys: Iterable[str]) -> None:
        if rows := [(k, None, TOMBSTONE) for k in keys]:
            self._commit_rows(rows)

    def delete_range(self, start: str | None, end: str | None) -> bool:
        """Deletes every key of start <= key < end that is there, as one commit. False if there is none."""
        gone = self.latest(start, end).where(~is_tombstone()).select("key", F.lit(None).cast("string").alias("value"))
        before = self.manifests.current().version
        return bool(gone.take(1)) and self.write(gone, order_by=F.lit(0), deletes=F.lit(True)) and self.manifests.current().version > before

    def _commit_rows(self, rows: list[tuple]) -> None:
        for key, value, vtype in rows:
            if not isinstance(key, str) or (vtype == REGULAR and not isinstance(value, str)):
                raise TypeError(f"keys and values are strings, got {key!r}: {value!r}")
        numbered = [(k, i, t, v) for i, (k, v, t) in enumerate(rows)]
        frame = self.spark.createDataFrame(numbered, "key string, seq long, vtype byte, data string").coalesce(1)
        self._commit(frame.withColumn("ts", F.localtimestamp()))

    def write(self, changes: DataFrame, order_by: Column | str | None = None, deletes: Column | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Commits a DataFrame (key, value) as one epoch, in parallel; rows where ``deletes`` holds are deletions.

        Of equal keys the one with the greatest ``order_by`` (whole numbers) counts, else the last as read.
        ``batch`` names a batch of a streaming query: one that is committed already is left out.
        """
        gone = F.coalesce(deletes, F.lit(False)) if deletes is not None else F.lit(False)
        order = F.monotonically_increasing_id() if order_by is None else F.col(order_by) if isinstance(order_by, str) else order_by
        rows = changes.select("key", order.cast("long").alias("seq"), F.when(gone, TOMBSTONE).otherwise(REGULAR).cast("byte").alias("vtype"), F.when(~gone, F.col("value")).alias("data"), F.localtimestamp().alias("ts"))
        return self._commit(rows, batch)

    def append_log(self, log: DataFrame) -> None:
        """Adopts a log from elsewhere as one commit: its own order is kept as this commit's order."""
        ranked = log.select("key", F.struct("epoch", "seq").alias("o"), "vtype", "data", "ts")
        newest = ranked.groupBy("key").agg(F.max_by(F.struct("vtype", "data", "ts"), F.col("o")).alias("m")).select("key", F.lit(0).cast("long").alias("seq"), "m.vtype", "m.data", "m.ts")
        self._commit(newest)

    def _commit(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """A commit writes what it is given where it is, each file sorted; flush and compaction deal rows out by ranges of keys."""
        self._check_open()
        for _ in range(ATTEMPTS):
            base = self.manifests.current()
            if batch and base.batches.get(batch[0], -1) >= batch[1]:
                return False
            run = self._write_run(rows.withColumn("epoch", F.lit(base.next_epoch).cast("long")), "commit", spread=False)
            batches = base.batches | ({batch[0]: batch[1]} if batch else {})
            try:
                self._publish(base.after(next_epoch=base.next_epoch + 1, runs=(*base.runs, *([run] if run.n_entries else [])), batches=batches))
            except Conflict:
                self.files.delete(run.path)
                continue
            self._maybe_maintain()
            return True
        raise RuntimeError("too many writers at once")

    def _publish(self, manifest: Manifest) -> None:
        """Publishes a version, forced to disk once ``fsync_interval_ms`` has passed since that was last done.

        The files of runs are as durable as the file system makes a file that was closed.
        """
        sync = (time.monotonic() - self._synced) * 1000 >= self.config.fsync_interval_ms
        self.manifests.publish(manifest, sync)
        if sync:
            self._synced = time.monotonic()

    def _write_run(self, rows: DataFrame, kind: str, spread: bool, unique: bool = False) -> Run:
        """Writes rows as a run sorted by key; its statistics are gathered while it is written."""
        path, seen = f"runs/{kind}-{uuid.uuid4().hex}", Observation()
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in LOG])
        rows = rows.repartitionByRange("key").sortWithinPartitions("key", "epoch", "seq") if spread else rows.sortWithinPartitions("key", "epoch", "seq")
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("epoch").alias("e0"), F.max("epoch").alias("e1"), F.count(F.when(is_tombstone(), 1)).alias("dead"))
        rows.write.option("parquet.bloom.filter.enabled#key", "true").option("compression", "zstd").parquet(f"{self.root}/{path}")
        s = seen.get
        return Run(path, kind, s["e0"] or 0, s["e1"] or 0, s["lo"], s["hi"], s["n"], s["dead"], self.files.size(path), unique)

    # Reading

    def manifest(self, version: int | None = None) -> Manifest:
        return self.manifests.current() if version is None else self.manifests.at(version)

    def log(self, start: str | None = None, end: str | None = None, version: int | None = None, closed: bool = False) -> DataFrame:
        """The rows of the runs that may hold keys of the range, as of a version; runs beyond it are not opened."""
        runs = [r for r in self.manifest(version).runs if r.may_hold(start, end, closed)]
        return self._read(runs)

    def _read(self, runs: Sequence[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*[f"{self.root}/{r.path}" for r in runs])

    def latest(self, start: str | None = None, end: str | None = None, version: int | None = None, closed: bool = False) -> DataFrame:
        """The newest versions. One run without repeated keys is that already and is read without a shuffle."""
        runs = [r for r in self.manifest(version).runs if r.may_hold(start, end, closed)]
        rows = self._read(runs)
        if start is not None and start == end and closed:
            rows = rows.where(F.col("key") == F.lit(start))
        else:
            rows = rows.where(in_range(start, end))
        return rows if len(runs) == 1 and runs[0].unique else versions.latest(rows)

    def get(self, key: str, version: int | None = None) -> str | None:
        """The value of a key; None for missing and deleted ones."""
        found = self.latest(key, key, version, closed=True).select(live_value().alias("value")).first()
        return found.value if found else None

    def scan(self, start: str | None = None, end: str | None = None, include_tombstones: bool = True, version: int | None = None) -> DataFrame:
        """key and value of start <= key < end, ascending; see ``versions.scan``."""
        rows = self.latest(start, end, version)
        return (rows if include_tombstones else rows.where(~is_tombstone())).select("key", live_value().alias("value")).orderBy("key")

    def get_range(self, start: str, end: str, include_tombstones: bool = True) -> list[tuple[str, str | None]]:
        """``scan`` brought to the caller, for ranges that fit there."""
        return [(r.key, r.value) for r in self.scan(start, end, include_tombstones).collect()]

    def multi_get(self, keys: DataFrame | Iterable[str]) -> DataFrame:
        """key and value of every distinct key asked for."""
        few = None
        if not isinstance(keys, DataFrame):
            keys = list(keys)
            few = sum(map(len, keys)) <= versions.BROADCAST_BYTES
            keys = self.spark.createDataFrame([(k,) for k in keys], "key string")
        runs = self.manifest().runs
        if len(runs) == 1 and runs[0].unique:
            rows, keys = self._read(runs).select("key", live_value().alias("value")), keys.select("key").distinct()
            # Few keys go to where the run is: it is not shuffled, and its other rows end at the scan.
            hits = rows.join(F.broadcast(keys), "key") if few or few is None and versions.small(keys) else rows
            return keys.join(hits, "key", "left")
        return versions.multi_get(self.log(), keys)

    def multi_scan(self, ranges: DataFrame) -> DataFrame:
        """lo, hi, key and value of every key of each range; runs beyond all ranges are not opened."""
        low, high = versions.hull(ranges)
        return versions.multi_scan(self.log(low, high), ranges) if low is not None else versions.multi_scan(self._read([]), ranges)

    def has(self, key: str) -> bool:
        """Whether any version of a key is stored, tombstones included."""
        return bool(self.log(key, key, closed=True).where(F.col("key") == F.lit(key)).take(1))

    def has_keys_in_range(self, start: str | None, end: str | None) -> bool:
        return bool(self.log(start, end).where(in_range(start, end)).take(1))

    # Maintenance

    def flush(self) -> bool:
        """Merges the runs of single commits into one run, tombstones and order kept. False if there is nothing to merge."""
        return self._merge("flush", lambda runs: [r for r in runs if r.kind == "commit"], 1)

    def compact(self) -> bool:
        """Merges all runs into one without tombstones. False if there are fewer runs than two."""
        done = self._merge("compact", list, 2)
        self._last_compaction = time.monotonic()
        return done

    def _merge(self, kind: str, choose: Callable, least: int) -> bool:
        self._check_open()
        base = self.manifests.current()
        inputs = choose(base.runs)
        if len(inputs) < least:
            return False
        rows = versions.compacted(self._read(inputs), drop_tombstones=len(inputs) == len(base.runs) and kind == "compact")
        run = self._write_run(rows, kind, spread=sum(r.n_bytes for r in inputs) > 32 << 20, unique=True)
        names = {r.path for r in inputs}
        for _ in range(ATTEMPTS):
            now = self.manifests.current()
            if not names <= {r.path for r in now.runs}:
                break
            try:
                self._publish(now.after(runs=(*([run] if run.n_entries else []), *[r for r in now.runs if r.path not in names])))
                return True
            except Conflict:
                continue
        self.files.delete(run.path)
        return False

    def _maybe_maintain(self) -> None:
        """Flushes once the runs of single commits are too large or too many together."""
        commits = [r for r in self.manifests.current().runs if r.kind == "commit"]
        if sum(r.n_bytes for r in commits) >= self.config.memtable_threshold or len(commits) >= self.config.max_commit_runs:
            self.flush()

    def start_maintenance(self) -> None:
        """Calls ``maintain`` at every compaction interval, in a thread of its own, until the store is closed."""
        self._check_open()

        def run() -> None:
            while not self._stopped.wait(self.config.compaction_interval_s):
                self.maintain()

        if self._maintainer is None and self.config.compaction_enabled:
            self._maintainer = threading.Thread(target=run, name="keystrata-maintenance", daemon=True)
            self._maintainer.start()

    def maintain(self, force: bool = False) -> bool:
        """Compacts if it is enabled, due by its interval (or ``force``), and there are enough runs."""
        due = force or time.monotonic() - self._last_compaction >= self.config.compaction_interval_s
        if self.config.compaction_enabled and due and len(self.manifests.current().runs) >= self.config.compaction_threshold:
            return self.compact()
        return False

    def vacuum(self, keep_versions: int = 1, min_age_s: float = 6 * 3600.0) -> int:
        """Deletes old manifest versions and the runs that none of the rest names; returns how many runs.

        Runs younger than ``min_age_s`` are spared, for their commit may be under way: the time must be longer
        than any commit takes. A reader of an older version, or a ``tail`` behind it, fails from then on.
        """
        kept = self.manifests.forget(max(1, keep_versions))
        used = {r.path for v in kept for r in self._runs_of(v)}
        gone = 0
        for name in self.files.names("runs"):
            if f"runs/{name}" not in used and self.files.age_s(f"runs/{name}") >= min_age_s:
                self.files.delete(f"runs/{name}")
                gone += 1
        for name in self.files.names("manifest"):
            if name.startswith("unfinished-") and self.files.age_s(f"manifest/{name}") >= min_age_s:
                self.files.delete(f"manifest/{name}")
        return gone

    def _runs_of(self, version: int) -> tuple[Run, ...]:
        try:
            return self.manifests.at(version).runs
        except ValueError:
            return ()

    def stats(self) -> dict[str, int]:
        """Runs, rows, tombstones and bytes of the current version, from the manifest alone."""
        runs = self.manifests.current().runs
        return {"runs": len(runs), "entries": sum(r.n_entries for r in runs), "tombstones": sum(r.n_tombstones for r in runs), "bytes": sum(r.n_bytes for r in runs)}

    def disk(self) -> dict[str, tuple[int, int]]:
        """Number and bytes on disk by what they are: runs of each kind, manifests, and files that no current version names."""
        found: dict[str, tuple[int, int]] = {}
        current = {r.path: r.kind for r in self.manifests.current().runs}
        for folder in ("runs", "manifest"):
            for name in self.files.names(folder):
                if not name.startswith("."):
                    kind = "manifests" if folder == "manifest" else current.get(f"runs/{name}", "others")
                    n, size = found.get(kind, (0, 0))
                    found[kind] = (n + 1, size + self.files.size(f"{folder}/{name}"))
        return found

    def save_bucketed(self, table: str, buckets: int = 64) -> DataFrame:
        """The newest versions as a table bucketed and sorted by key: later reads by key need no exchange."""
        self.latest().write.mode("overwrite").bucketBy(buckets, "key").sortBy("key").saveAsTable(table)
        return self.spark.table(table)

    def _check_open(self) -> None:
        if not self._open:
            raise RuntimeError("store is closed")
