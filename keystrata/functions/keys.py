"""Column expressions over keys, versions and entry sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.schema import REGULAR, TOMBSTONE

#: Bytes that the sorted map's size estimate adds to key and value, and the header of a stored value
#: (type 1, two lengths of 4, ISO timestamp of 26).
ENTRY_OVERHEAD, VALUE_HEADER = 64, 35


def in_range(start: str | None = None, end: str | None = None, key: str | Column = "key") -> Column:
    """start <= key < end; None leaves a side open. Empty and inverted ranges hold nothing."""
    key = F.col(key) if isinstance(key, str) else key
    condition = F.lit(True)
    if start is not None:
        condition = key >= F.lit(start)
    if end is not None:
        condition = condition & (key < F.lit(end)) if start is not None else key < F.lit(end)
    return condition


def prefix_range(prefix: str) -> tuple[str, str | None]:
    """The half-open range of keys that begin with ``prefix``."""
    for i in range(len(prefix) - 1, -1, -1):
        if (code := ord(prefix[i])) < 0x10FFFF:
            following = code + 1 if not 0xD800 <= code + 1 <= 0xDFFF else 0xE000
            return prefix, prefix[:i] + chr(following)
    return prefix, None


def is_tombstone(vtype: str = "vtype") -> Column:
    return F.col(vtype) == TOMBSTONE


def live_value(vtype: str = "vtype", data: str = "data") -> Column:
    """The value of a version: null for tombstones."""
    return F.when(F.col(vtype) == REGULAR, F.col(data))


def entry_bytes(key: str = "key", data: str = "data") -> Column:
    """Estimated bytes of an entry in the sorted map."""
    return (F.octet_length(key) + ENTRY_OVERHEAD + VALUE_HEADER + F.coalesce(F.octet_length(data), F.lit(0))).cast("long")
