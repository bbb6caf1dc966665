"""A store's commits as a streaming source: offsets are versions of the manifest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from keystrata.plans.manifest import Manifest
from keystrata.schema import LOG

KINDS = pa.schema([("key", pa.string()), ("epoch", pa.int64()), ("seq", pa.int64()), ("vtype", pa.int8()), ("data", pa.string()), ("ts", pa.timestamp("us"))])


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class TailReader(DataSourceStreamReader):
    """Versions are read one by one, for a flush may have merged a commit's run by the time it is read."""

    def __init__(self, root: str):
        self.root = root

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def _names(self, folder: str) -> list[str]:
        from pyarrow import fs

        store, root = self._store()
        return sorted(x.base_name for x in store.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True)))

    def _versions(self) -> list[int]:
        return [int(n[2:-5]) for n in self._names("manifest") if n.startswith("v-") and n.endswith(".json")]

    def _at(self, version: int) -> Manifest:
        store, root = self._store()
        try:
            with store.open_input_file(f"{root}/manifest/v-{version:012d}.json") as file:
                return Manifest.from_json(file.read().decode())
        except FileNotFoundError:
            raise RuntimeError(f"version {version} of {self.root} is gone: vacuum has passed this stream") from None

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        for version in reversed(self._versions()):
            try:
                return {"version": self._at(version).version}
            except ValueError:
                continue
        return {"version": 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = start["version"], end["version"]
        if first == last:
            return []
        runs = []
        if first == 0:  # the oldest version kept, as a whole
            first = min(v for v in self._versions() if v <= last)
            runs += self._at(first).runs
        known = {r.path for r in self._at(first).runs}
        for version in range(first + 1, last + 1):
            now = self._at(version).runs
            runs += [r for r in now if r.kind == "commit" and r.path not in known]
            known = {r.path for r in now}
        return [File(f"{r.path}/{name}") for r in runs for name in self._names(r.path) if name.endswith(".parquet")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        store, root = self._store()
        with store.open_input_file(f"{root}/{partition.value}") as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=KINDS.names):
                yield pa.RecordBatch.from_arrays([batch.column(n).cast(t) for n, t in zip(KINDS.names, KINDS.types, strict=True)], schema=KINDS)


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keystrata_tail"

    def schema(self):
        return LOG

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])
