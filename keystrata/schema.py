"""The log's schema, and the limits of a store's settings."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import types as T

REGULAR, TOMBSTONE = 0, 1

#: One row for each version of a key. ``(epoch, seq)`` orders versions; ``ts`` only informs.
LOG = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("epoch", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("vtype", T.ByteType(), False),
    T.StructField("data", T.StringType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
])
KV = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), True)])

MIB = 1 << 20


@dataclass(frozen=True)
class StoreConfig:
    """Settings of a store; values out of range raise ValueError.

    memtable_threshold: bytes, and max_commit_runs: number, of commits' runs at which they are flushed into one.
    fsync_interval_ms: published versions are forced to disk at most that often; 0 forces each.
    compaction_threshold, compaction_interval_s: runs, and seconds, from which on ``maintain`` compacts.
    """

    memtable_threshold: int = 128 * MIB
    fsync_interval_ms: int = 0
    compaction_threshold: int = 2
    compaction_interval_s: float = 10.0
    compaction_enabled: bool = True
    max_commit_runs: int = 32

    def __post_init__(self) -> None:
        if not 0 < self.memtable_threshold <= 1024 * MIB:
            raise ValueError(f"memtable_threshold: {self.memtable_threshold} bytes, where 1 to {1024 * MIB} will do")
        if not 0 <= self.fsync_interval_ms <= 10_000:
            raise ValueError(f"fsync_interval_ms: {self.fsync_interval_ms}, where 0 to 10000 will do")
        # These two messages, which callers look for.
        if self.compaction_threshold < 2:
            raise ValueError(f"compaction_threshold must be >= 2, got {self.compaction_threshold}")
        if self.compaction_interval_s <= 0:
            raise ValueError(f"compaction_interval_s must be positive, got {self.compaction_interval_s}")
        if self.max_commit_runs < 2:
            raise ValueError(f"max_commit_runs: {self.max_commit_runs}, where 2 or more will do")


def checked_location(location: str) -> str:
    """A storage location as a URI; a local one must be writable or creatable."""
    if not location or not location.strip():
        raise ValueError("a store needs a folder, storage_dir is blank")
    if "://" in location:
        return location.rstrip("/")
    path = os.path.abspath(location)
    probe = path if os.path.exists(path) else os.path.dirname(path)
    while not os.path.exists(probe):
        probe = os.path.dirname(probe)
    if not os.access(probe, os.W_OK):
        raise PermissionError(f"no permission to write in {path}, which storage_dir names")
    return f"file://{path}"
