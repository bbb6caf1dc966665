"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their identifier::

    block*   entries, zstd-compressed: varint shared, varint rest, varint size, rest of the key, value; then crc32 of the block
    index    per block: key length and first key, offset, length, entries
    bloom    bits of a Bloom filter over the keys
    footer   FOOTER: offsets and lengths of index and bloom, documents, tokens, hashes, bytes of an id, magic

Keys are nine bytes that sort as the identifiers do: 0 for null, else 1 and the big-endian number with its
sign bit flipped. A key shares a prefix with the one before it, save at a block's start. A value is the
document's start among the shard's ids (8 bytes) and its ids, little-endian and unsigned, of 2 bytes where
the vocabulary allows it, else of 4. Readers give ids of 4 bytes.

A task closes a shard that reaches ``SHARD_BYTES`` and begins the next, so shards are bounded whatever the
number of documents. Null identifiers come first, null and empty texts have the end id alone, rows that repeat an identifier
are all kept, one after the other in the order of their texts' hashes; a very long text is one entry of a
block of its own; columns other than doc_id and text are not read; an empty table gives no shard.
Shards have a name of their own for each attempt of a task, and only those that a finished task reports
count, so lost executors and repeated attempts leave no trace in the result; what they left is deleted.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.scratch import bound_batches
from keystrata.llm.words import Chunks, id_bytes, per_worker

FOOTER = "<QQQQQQII8s"
MAGIC = b"KSTRSST3"
BLOCK_BYTES, SHARD_BYTES = 64 << 10, 256 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n, at


def _bloom_places(key: bytes, bits: int, hashes: int) -> Iterator[int]:
    h = xxhash.xxh3_64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1  # the halves of one hash are independent
    return ((a + i * b) % bits for i in range(hashes))


class ShardWriter:
    """Writes ascending keys to a binary stream; what it holds is one block, the sparse index and the keys, packed."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES, width: int = 4):
        self.out, self.block_bytes, self.width, self.pack = out, block_bytes, width, zstandard.ZstdCompressor(level=1)
        self.block, self.entries, self.first, self.last = bytearray(), 0, b"", b""
        self.index, self.keys, self.documents, self.at, self.tokens = bytearray(), bytearray(), 0, 0, 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.documents and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.entries:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        stored = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if self.width == 2 else ids
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(stored) + 8) + key[shared:] + struct.pack("<Q", self.tokens) + stored
        self.entries, self.last, self.tokens = self.entries + 1, key, self.tokens + len(ids) // 4
        self.keys += struct.pack("<H", len(key)) + key
        self.documents += 1
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            data = self.pack.compress(bytes(self.block))
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            self.index += struct.pack("<H", len(self.first)) + self.first + struct.pack("<QII", self.at, len(data), self.entries)
            self.at, self.block, self.entries = self.at + len(data), bytearray(), 0

    def close(self) -> None:
        self._flush()
        bits = max(64, self.documents * BLOOM_BITS + 7 & ~7)
        bloom, at = bytearray(bits // 8), 0
        while at < len(self.keys):
            (size,) = struct.unpack_from("<H", self.keys, at)
            for place in _bloom_places(bytes(self.keys[at + 2 : at + 2 + size]), bits, BLOOM_HASHES):
                bloom[place >> 3] |= 1 << (place & 7)
            at += 2 + size
        self.out.write(bytes(self.index))
        self.out.write(bytes(bloom))
        self.out.write(struct.pack(FOOTER, self.at, len(self.index), self.at + len(self.index), len(bloom), self.documents, self.tokens, BLOOM_HASHES, self.width, MAGIC))


class ShardReader:
    """Random and sequential reads from a seekable binary file of ``size`` bytes."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - struct.calcsize(FOOTER))
        at, length, bloom_at, bloom_length, self.documents, self.tokens, self.hashes, self.width, magic = struct.unpack(FOOTER, file.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(at)
        data = file.read(length)
        self.firsts, self.blocks, i = [], [], 0
        while i < len(data):
            (k,) = struct.unpack_from("<H", data, i)
            self.firsts.append(data[i + 2 : i + 2 + k])
            self.blocks.append(struct.unpack_from("<QII", data, i + 2 + k))
            i += 2 + k + 16
        file.seek(bloom_at)
        self.bloom = file.read(bloom_length)

    def _block(self, n: int) -> Iterator[tuple[bytes, int, bytes]]:
        at, length, entries = self.blocks[n]
        self.file.seek(at)
        data = self.file.read(length)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {n} is damaged")
        data = zstandard.ZstdDecompressor().decompress(data[:-4])
        i, key = 0, b""
        for _ in range(entries):
            shared, i = _read_varint(data, i)
            rest, i = _read_varint(data, i)
            size, i = _read_varint(data, i)
            key = key[:shared] + data[i : i + rest]
            (start,) = struct.unpack_from("<Q", data, i + rest)
            ids = data[i + rest + 8 : i + rest + size]
            yield key, start, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if self.width == 2 else ids
            i += rest + size

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        for n in range(len(self.blocks)):
            yield from self._block(n)

    def get(self, key: bytes) -> list[tuple[int, bytes]]:
        """(start, ids) of each document with this key: Bloom filter, binary search in the index, one block or few."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, 8 * len(self.bloom), self.hashes)):
            return []
        found, n = [], max(0, bisect.bisect_left(self.firsts, key) - 1)
        while n < len(self.blocks) and self.firsts[n] <= key:
            found += [(start, ids) for k, start, ids in self._block(n) if k == key]
            n += 1
        return found


def open_shard(path: str) -> ShardReader:
    store, name = fs.FileSystem.from_uri(path)
    return ShardReader(store.open_input_file(name), store.get_file_info(name).size)


SHARDS = "shard int, part int, path string, first binary, last binary, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1) -> list[dict]:
    """Writes ``docs`` (doc_id, text) to shards in ``folder``, a URI that all executors reach; a row for each shard, in order.

    Documents are dealt by ranges of (identifier, hash of the text), so an identifier with many rows is dealt out too.
    """
    bound_batches(docs.sparkSession)

    kinds = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = per_worker(f"ids:{tokenizer}", lambda: Chunks(tokenizer, False, id_bytes, b"".join))
        width = 2 if max(chunks.tokenizer.get_vocab_size(with_added_tokens=True), end_id) < 65536 else 4
        end, out, path, first, part, number = id_bytes([end_id]), None, "", b"", 0, TaskContext.get().partitionId()

        def closed() -> pa.RecordBatch:
            out.close()
            stream.close()
            return pa.RecordBatch.from_pylist([{"shard": number, "part": part, "path": path, "first": first, "last": out.last, "n_docs": out.documents, "n_tokens": out.tokens}], kinds)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is not None and out.at >= SHARD_BYTES:
                    yield closed()
                    out, part = None, part + 1
                if out is None:
                    path = f"{folder}/shard-{number:06d}-{part:04d}-{uuid.uuid4().hex}.sst"
                    store, name = fs.FileSystem.from_uri(path)
                    store.create_dir(name.rpartition("/")[0])
                    stream, first = store.open_output_stream(name), key_of(doc_id)
                    out = ShardWriter(stream, BLOCK_BYTES, width)
                out.add(key_of(doc_id), chunks(text) + end)
        if out is not None:
            yield closed()

    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    written = dealt.mapInArrow(shards, SHARDS).collect()  # a row for each shard; sorting these in Spark would run the writers twice
    _drop_others(folder, {row.path for row in written})
    return [row.asDict() for row in sorted(written, key=lambda row: (row.shard, row.part))]


def _drop_others(folder: str, reported: set[str]) -> None:
    """Deletes shards of attempts that no finished task has reported."""
    store, name = fs.FileSystem.from_uri(folder)
    kept = {x.rpartition("/")[2] for x in reported}
    for file in store.get_file_info(fs.FileSelector(name, allow_not_found=True)):
        if file.base_name.endswith(".sst") and file.base_name not in kept:
            store.delete_file(file.path)


def read_shards(spark: SparkSession, shards: list[dict], digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary) of each document; ``start`` counts the ids of all documents before it.

    With ``digest`` the unsigned crc32 of the ids, ids_crc32, stands for the ids.
    """
    rows, base = [], 0
    for shard in shards:
        rows.append((shard["path"], base))
        base += shard["n_tokens"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()]
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out, size = [], 0
                for key, start, ids in open_shard(path):
                    out.append((id_of(key), base + start, len(ids) // 4, zlib.crc32(ids) if digest else ids))
                    size += len(ids)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return spark.createDataFrame(rows, "path string, base long").mapInArrow(documents, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def lookup(shards: list[dict], doc_id: int | None) -> list[bytes]:
    """The ids of the documents with this identifier: binary search among shards, then within them."""
    key = key_of(doc_id)
    at = bisect.bisect_left([bytes(s["last"]) for s in shards], key)
    found: list[bytes] = []
    while at < len(shards) and bytes(shards[at]["first"]) <= key:
        found += [ids for _, ids in open_shard(shards[at]["path"]).get(key)]
        at += 1
    return found


def save_manifest(shards: list[dict], folder: str) -> None:
    """The list of shards as JSON, for readers outside Spark."""
    store, name = fs.FileSystem.from_uri(f"{folder}/manifest.json")
    with store.open_output_stream(name) as out:
        out.write(json.dumps([s | {"first": bytes(s["first"]).hex(), "last": bytes(s["last"]).hex()} for s in shards]).encode())
