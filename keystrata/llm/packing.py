"""Best-fit packing planned over the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut, into full pieces
behind a first piece that may be shorter. The plan is best-fit decreasing over counts: bins with equal
room are one entry, so planning takes a number of steps bounded by the capacity and not by documents.
Pieces then take the planned slots by joining on their rank within their length. Ranks are counted within
parts of each length, of about ``PART_ROWS`` pieces, and carried on from part to part, so that no length
lands in one task. Parts go by a number drawn once, when the pieces are written, so rows that are alike are
dealt out too.

Null and empty texts are a document of the end id alone; very long ones are cut like any that is longer than
a sequence. Repeated rows are packed one by one; a null identifier stays null. Columns other than doc_id and
text are not read. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.scratch import bound_batches, write
from keystrata.llm.words import Chunks, id_bytes, per_worker

PART_ROWS = 250_000
#: Chunks whose ids a worker keeps, in each of two generations; fewer take less memory and more time.
HELD = 350_000


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for ``histogram`` (length: count) as rows (length, from_rank, to_rank, first_bin, per_bin, offset).

    The piece of rank r (from 0) within its length, from_rank <= r < to_rank, goes to bin first_bin + (r -
    from_rank) // per_bin, at offset + (r - from_rank) % per_bin * length.
    """
    slots, bins = [], 0
    rooms: list[int] = []  # ascending rooms that some bin has
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first bin, bins)

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            if full < n and left:
                slots.append((length, rank, rank + left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, n - full)
    return slots


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, held: int = HELD) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32."""
    bound_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = per_worker(f"pieces:{tokenizer}:{held}", lambda: Chunks(tokenizer, True, id_bytes, b"".join, limit=held))
        end = id_bytes([end_id])
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = chunks(text) + end
                total = len(ids) // 4
                cuts = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for n in range(len(cuts) - 1):
                    part = ids[4 * cuts[n] : 4 * cuts[n + 1]]
                    for column, value in zip(out, (doc_id, n, cuts[n], len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, held: int = HELD) -> DataFrame:
    """``pieces`` with sequence_id and offset: the place of each in as few sequences as best fit finds.

    What the driver gathers and broadcasts is the histogram, its parts and the plan: at most ``capacity``
    counts, one for each ``PART_ROWS`` pieces, and a few slots for each length.
    """
    spark = docs.sparkSession
    cut = write(pieces(docs, tokenizer, capacity, end_id, held).withColumn("drawn", (F.rand(17) * 2.0**31).cast("long")), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    dealt = spark.createDataFrame([(length, -(-n // PART_ROWS)) for length, n in histogram.items()], "of long, parts long")
    cut = cut.join(F.broadcast(dealt), F.col("length") == F.col("of")).withColumn("part", F.col("drawn") % F.col("parts")).drop("of", "parts")
    before, so_far = [], 0
    for length, part, n in sorted((r.length, r.part, r.n) for r in cut.groupBy("length", "part").agg(F.count("*").alias("n")).collect()):
        so_far = so_far if before and before[-1][0] == length else 0
        before.append((length, part, so_far))
        so_far += n
    parts = spark.createDataFrame(before, "length long, part long, before long")
    slots = spark.createDataFrame(plan(histogram, capacity), "of long, from_rank long, to_rank long, first_bin long, per_bin long, at long")
    within = Window.partitionBy("length", "part").orderBy("drawn", "doc_id", "piece")
    ranked = cut.withColumn("nth", F.row_number().over(within) - 1).join(F.broadcast(parts), ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before"))
    joined = ranked.join(F.broadcast(slots), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    place = F.col("rank") - F.col("from_rank")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_bin") + F.expr("(rank - from_rank) div per_bin")).alias("sequence_id"), (F.col("at") + place % F.col("per_bin") * F.col("length")).alias("offset"))
