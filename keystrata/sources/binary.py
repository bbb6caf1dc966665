"""Spark data sources for binary logs (``wal``) and sorted tables (``sst``).

``spark.read.format("wal").load(paths or globs, separated by commas)``. A partition has files
that follow each other, up to ``PARTITION`` bytes or one longer file; a file's epoch is the number in its
name (below zero where the name begins with a minus), null for the name ``none``, else its place in the sorted list. Options ``start`` and ``end`` give
start <= key < end alone, in any session; ``load`` sets them. With the option ``pushdown`` "true",
comparisons of ``key`` with constants are also used to skip entries and are handed back to Spark, which checks
them again: for sessions with ``spark.sql.python.filterPushdown.enabled``, since Spark refuses a reader that
takes filters in others. Paths are opened through pyarrow's filesystems, so any store that these know will do.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from keystrata.schema import LOG
from keystrata.sources.codec import TableFile, Version, read_wal, write_table, write_wal

#: Bytes of a partition's files at most, and so few that there are some ``PARTITIONS``, but ``LEAST`` at least; what opening a file counts as.
PARTITION, PARTITIONS, LEAST, OPENED = 16 << 20, 64, 1 << 20, 1 << 16
BATCH_ROWS, BATCH_BYTES, BUFFER = 10_000, 4 << 20, 1 << 18
#: The name of the file that holds the rows without an epoch.
UNNUMBERED = "none"
#: ``LOG`` with columns that may be null, as tables make it whose rows lack a key or a number; and as Arrow has it.
ROWS = T.StructType([T.StructField(f.name, f.dataType) for f in LOG])
ARROW = pa.schema([("key", pa.string()), ("epoch", pa.int64()), ("seq", pa.int64()), ("vtype", pa.int8()), ("data", pa.string()), ("ts", pa.timestamp("us"))])


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _found(paths: str, suffix: str) -> list[tuple[int | None, str, int]]:
    """(epoch, path, bytes) of ``discover``'s files."""
    from pyarrow import fs

    found = []
    for path in paths.split(","):
        store, name = _store(path.strip())
        info = store.get_file_info(name)
        if info.type == fs.FileType.Directory:
            inside = store.get_file_info(fs.FileSelector(name))
            scheme = path[: path.index("://") + 3] if "://" in path else ""
            found += [(scheme + x.path, x.size or 0) for x in inside if x.path.endswith(suffix)]
        else:
            found.append((path.strip(), info.size or 0))
    unnumbered = f"{UNNUMBERED}{suffix}"
    name = lambda p: p.rsplit("/", 1)[-1]
    number = lambda p: [int(x) for x in re.findall(r"^-?\d+|\d+", name(p))]
    found.sort(key=lambda x: (name(x[0]) != unnumbered, number(x[0]), x[0]))
    return [(None if name(p) == unnumbered else (number(p) or [i])[0], p, size) for i, (p, size) in enumerate(found)]


def discover(paths: str, suffix: str) -> list[tuple[int | None, str]]:
    """(epoch, path) of the files with ``suffix`` in the named folders, or of the named files, in numeric order; what has no epoch first."""
    return [(epoch, path) for epoch, path, _ in _found(paths, suffix)]


class FilesPartition(InputPartition):
    """(epoch, path) of files that one task reads."""

    def __init__(self, files: list[tuple[int | None, str]]):
        super().__init__(tuple(files))


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class _Reader(DataSourceReader):
    suffix = ""

    def __init__(self, options: dict):
        self.paths, self.start, self.end = options["path"], options.get("start"), options.get("end")

    def partitions(self) -> list[InputPartition]:
        files = [(epoch, path, size + OPENED) for epoch, path, size in _found(self.paths, self.suffix)]
        most = min(PARTITION, max(LEAST, sum(size for *_, size in files) // PARTITIONS))
        dealt, held = [], 0
        for epoch, path, size in files:
            if not dealt or held + size > most:
                dealt.append([])
                held = 0
            dealt[-1].append((epoch, path))
            held += size
        return [FilesPartition(x) for x in dealt or [[]]]

    def read(self, partition: FilesPartition) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for epoch, path in partition.value:
            for v in self.versions(*_store(path)):
                rows.append((v.key, epoch, v.seq, v.vtype, v.data, v.ts))
                held += len(v.key or "") + len(v.data or "")
                if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                    yield _columns(rows)
                    rows, held = [], 0
        if rows:
            yield _columns(rows)

    def _wanted(self, key: str | None) -> bool:
        if key is None:
            return self.start is None and self.end is None
        return (self.start is None or key >= self.start) and (self.end is None or key < self.end)


class WalReader(_Reader):
    suffix = ".wal"

    def versions(self, store, name: str) -> Iterator[Version]:
        with store.open_input_stream(name) as stream, io.BufferedReader(stream, BUFFER) as buffered:
            yield from read_wal(buffered, self._wanted)


class TableReader(_Reader):
    suffix = ".sst"

    def versions(self, store, name: str) -> Iterator[Version]:
        with store.open_input_file(name) as stream:
            yield from TableFile(stream, stream.size()).scan(self.start, self.end)


class _Pushed(_Reader):
    """Narrows the range by comparisons of ``key``; the least key after one is it and a zero."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if getattr(f, "attribute", None) == ("key",) and isinstance(getattr(f, "value", None), str):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    start = f.value + "\0" * isinstance(f, GreaterThan)
                    self.start = start if self.start is None else max(self.start, start)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = f.value + "\0" * (not isinstance(f, LessThan))
                    self.end = end if self.end is None else min(self.end, end)
            yield f


class PushedWalReader(_Pushed, WalReader):
    pass


class PushedTableReader(_Pushed, TableReader):
    pass


def _pushed(options: dict) -> bool:
    return options.get("pushdown", "false").lower() == "true"


class WalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wal"

    def schema(self):
        return ROWS

    def reader(self, schema) -> WalReader:
        return (PushedWalReader if _pushed(self.options) else WalReader)(self.options)


class TableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sst"

    def schema(self):
        return ROWS

    def reader(self, schema) -> TableReader:
        return (PushedTableReader if _pushed(self.options) else TableReader)(self.options)


def register(spark) -> None:
    """Makes the formats ``wal`` and ``sst`` known to a session."""
    spark.dataSource.register(WalSource)
    spark.dataSource.register(TableSource)


def load(spark, kind: str, paths: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The log in files of ``kind`` (``wal`` or ``sst``), or its part with start <= key < end."""
    register(spark)
    return spark.read.format(kind).options(**{k: v for k, v in (("start", start), ("end", end)) if v is not None}).load(paths)


def save_files(log: DataFrame, folder: str, kind: str) -> list[str]:
    """Writes ``log`` to ``folder``, a file for each epoch: ``wal``, rows in order, or ``sst``, newest versions by key.

    Files are written where the rows are, an epoch in one task, which is what one file holds. Each has its
    name only once it is whole, so a task that is run again does no harm. Returns the paths by epoch, null first;
    the folder is there even if there are none.
    """
    store, name = _store(folder)
    store.create_dir(name)

    def save(key: tuple, rows: pa.Table) -> pa.Table:
        epoch = key[0].as_py()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("seq", "ascending")], null_placement="at_start"))
        keys, data, vtypes, seqs = (rows[c].to_pylist() for c in ("key", "data", "vtype", "seq"))
        versions = [Version(k, d, v, t or datetime(1970, 1, 1), s) for k, d, v, t, s in zip(keys, data, vtypes, rows["ts"].to_numpy().astype("datetime64[us]").tolist(), seqs, strict=True)]
        if kind == "sst":
            versions = sorted({v.key: v for v in versions}.values(), key=lambda v: (v.key is not None, v.key or ""))
        path = f"{folder}/{UNNUMBERED if epoch is None else f'{epoch:06d}'}.{kind}"
        store, name = _store(path)
        unfinished = f"{name}.{uuid.uuid4().hex}.unfinished"
        with store.open_output_stream(unfinished, buffer_size=BUFFER) as out:
            (write_wal if kind == "wal" else write_table)(out, versions)
        store.move(unfinished, name)
        return pa.table({"epoch": pa.array([epoch], pa.int64()), "path": [path]})

    saved = log.groupBy("epoch").applyInArrow(save, "epoch long, path string").collect()
    return [r.path for r in sorted(saved, key=lambda r: (r.epoch is not None, r.epoch or 0))]


def wal_bytes(versions) -> bytes:
    """A log file's bytes."""
    out = io.BytesIO()
    write_wal(out, versions)
    return out.getvalue()


def table_bytes(versions) -> bytes:
    """A sorted table's bytes."""
    out = io.BytesIO()
    write_table(out, versions)
    return out.getvalue()
