"""The binary records of write-ahead logs and sorted tables. All integers are big-endian, ``seq`` is signed.

Fixed formats::

    value   type:1  ts_length:4  ts (ISO 8601)  data_length:4  data
    entry   seq:8  key_length:4  key  value_length:4  value  [0:1]   (the last where there is no seq)
    frame   length:4  entry  crc32(entry):4                      (a log is frames, one after the other)
    table   (key_length:4 key value_length:4 value)*  index  index_offset:8
    index   n:4  (key_length:4 key offset:8)*

A regular value without bytes is the empty string; a tombstone has no data. The length ``NONE``, with nothing
behind it, is a key or a regular value's data that is null; in a table the null key comes first.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from typing import BinaryIO, NamedTuple

from keystrata.schema import REGULAR, TOMBSTONE


NONE = 0xFFFFFFFF


class Version(NamedTuple):
    """One version of a key as files hold it."""

    key: str | None
    data: str | None
    vtype: int
    ts: datetime
    seq: int | None = 0


class WALCorruptionError(Exception):
    """A frame's checksum differs from that of its bytes."""

    def __init__(self, expected: int, actual: int, entry_offset: int):
        # Fixed value: the message, which callers look for.
        super().__init__(f"WAL corruption detected at offset {entry_offset}: expected CRC32 0x{expected:08x}, got 0x{actual:08x}")
        self.expected, self.actual, self.entry_offset = expected, actual, entry_offset

    def __reduce__(self):
        return WALCorruptionError, (self.expected, self.actual, self.entry_offset)


def _sized(text: str | None) -> bytes:
    if text is None:
        return struct.pack(">I", NONE)
    data = text.encode()
    return struct.pack(">I", len(data)) + data


def _take(data: bytes, at: int) -> tuple[bytes, int]:
    """The bytes behind a length at ``at``, and where they end."""
    end = at + 4 + struct.unpack_from(">I", data, at)[0]
    return data[at + 4 : end], end


def _take_text(data: bytes, at: int) -> tuple[str | None, int]:
    if struct.unpack_from(">I", data, at)[0] == NONE:
        return None, at + 4
    taken, at = _take(data, at)
    return taken.decode(), at


def pack_value(version: Version) -> bytes:
    data = "" if version.vtype == TOMBSTONE else version.data
    return bytes([version.vtype]) + _sized(version.ts.isoformat()) + _sized(data)


def unpack_value(key: str | None, packed: bytes, seq: int | None = 0) -> Version:
    vtype = packed[0]
    if vtype not in (REGULAR, TOMBSTONE):
        raise ValueError(f"unknown value type {vtype}")
    ts, at = _take(packed, 1)
    data, _ = _take_text(packed, at)
    return Version(key, None if vtype == TOMBSTONE else data, vtype, datetime.fromisoformat(ts.decode()), seq)


def pack_entry(version: Version) -> bytes:
    value = pack_value(version)
    return struct.pack(">q", version.seq or 0) + _sized(version.key) + struct.pack(">I", len(value)) + value + b"\0" * (version.seq is None)


def entry_key(packed: bytes) -> str | None:
    return _take_text(packed, 8)[0]


def unpack_entry(packed: bytes) -> Version:
    key, at = _take_text(packed, 8)
    value, end = _take(packed, at)
    return unpack_value(key, value, struct.unpack_from(">q", packed)[0] if end == len(packed) else None)


def write_wal(stream: BinaryIO, versions: Iterable[Version]) -> int:
    """Appends a frame for each version; returns how many."""
    n = 0
    for version in versions:
        entry = pack_entry(version)
        stream.write(struct.pack(">I", len(entry)) + entry + struct.pack(">I", zlib.crc32(entry)))
        n += 1
    return n


def wal_entries(stream: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(offset behind the frame, packed entry) up to the end or a torn tail; a wrong checksum raises WALCorruptionError with its offset."""
    offset = 0
    while len(head := stream.read(4)) == 4:
        (size,) = struct.unpack(">I", head)
        body = stream.read(size + 4)
        if len(body) < size + 4:
            return
        entry, (expected,) = body[:size], struct.unpack_from(">I", body, size)
        if (actual := zlib.crc32(entry)) != expected:
            raise WALCorruptionError(expected, actual, offset)
        offset += 8 + size
        yield offset, entry


def wal_frames(stream: BinaryIO) -> Iterator[tuple[int, Version]]:
    """``wal_entries``, unpacked."""
    return ((offset, unpack_entry(entry)) for offset, entry in wal_entries(stream))


def read_wal(stream: BinaryIO, wanted: Callable[[str | None], bool] | None = None) -> Iterator[Version]:
    """The entries of ``wal_frames``, or those with ``wanted`` keys."""
    return (unpack_entry(entry) for _, entry in wal_entries(stream) if wanted is None or wanted(entry_key(entry)))


def next_seq(stream: BinaryIO) -> int:
    """The number after the greatest of a log, 0 for an empty one."""
    return max((v.seq for v in read_wal(stream) if v.seq is not None), default=-1) + 1


def write_table(stream: BinaryIO, versions: Iterable[Version]) -> int:
    """A sorted table of versions in ascending order of distinct keys; returns how many."""
    index, offset, last = [], 0, None
    for version in versions:
        if index and (version.key is None or last is not None and version.key <= last):
            raise ValueError("keys must ascend")
        key, value = _sized(version.key), pack_value(version)
        record = key + struct.pack(">I", len(value)) + value
        index.append(key + struct.pack(">Q", offset))
        stream.write(record)
        offset, last = offset + len(record), version.key
    stream.write(struct.pack(">I", len(index)) + b"".join(index) + struct.pack(">Q", offset))
    return len(index)


class TableFile:
    """Reads a sorted table from a seekable stream of ``size`` bytes through its index, in blocks of ``BLOCK`` bytes or a longer record."""

    BLOCK = 1 << 18

    def __init__(self, stream: BinaryIO, size: int):
        self.stream, self.block, self.begin = stream, b"", 0
        stream.seek(size - 8)
        (self.end,) = struct.unpack(">Q", stream.read(8))
        stream.seek(self.end)
        index = stream.read(size - 8 - self.end)
        self.offsets: dict[str | None, int] = {}
        at = 4
        for _ in range(struct.unpack_from(">I", index)[0]):
            key, at = _take_text(index, at)
            (self.offsets[key],) = struct.unpack_from(">Q", index, at)
            at += 8
        self.keys = sorted(key for key in self.offsets if key is not None)

    def has(self, key: str | None) -> bool:
        """Whether the table holds the key, if only as a tombstone; an empty table holds none."""
        return key in self.offsets

    def has_keys_in_range(self, start: str, end: str) -> bool:
        return next(self._between(start, end), None) is not None

    def _between(self, start: str | None, end: str | None) -> Iterator[str | None]:
        """Keys of the range; the null key is in none but the whole."""
        from bisect import bisect_left

        if start is None and end is None and None in self.offsets:
            yield None
        at = 0 if start is None else bisect_left(self.keys, start)
        while at < len(self.keys) and (end is None or self.keys[at] < end):
            yield self.keys[at]
            at += 1

    def _read(self, offset: int, size: int) -> bytes:
        """``size`` bytes at ``offset``, of the block that was read last if it has them."""
        at = offset - self.begin
        if at < 0 or at + size > len(self.block):
            self.stream.seek(offset)
            self.block, self.begin, at = self.stream.read(max(size, min(self.BLOCK, self.end - offset))), offset, 0
        return self.block[at : at + size]

    def _take(self, offset: int) -> tuple[bytes | None, int]:
        (size,) = struct.unpack(">I", self._read(offset, 4))
        if size == NONE:
            return None, offset + 4
        return self._read(offset + 4, size), offset + 4 + size

    def get(self, key: str | None) -> Version | None:
        if key not in self.offsets:
            return None
        found, at = self._take(self.offsets[key])
        if found != (None if key is None else key.encode()):
            raise ValueError(f"index points to {found!r} for {key!r}")
        value, _ = self._take(at)
        assert value is not None
        return unpack_value(key, value)

    def scan(self, start: str | None = None, end: str | None = None) -> Iterator[Version]:
        for key in self._between(start, end):
            version = self.get(key)
            assert version is not None
            yield version
