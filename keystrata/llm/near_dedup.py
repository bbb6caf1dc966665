"""Near-duplicates by SetSketch registers, banded, estimated by joint likelihood and verified on full sets.

1. A text is the set of its shingles, ``size`` words each. Each of ``REGISTERS`` registers is the least of exponential
   values that the shingles draw, on a scale of powers of ``BASE``, cut off at ``LIMIT``: registers of a
   union are the larger of the registers, and equal with a probability that grows with the similarity.
2. Texts with equal words are one class, whose name is a 64-bit hash of its words. Only classes go on.
3. Bands of registers are the buckets, as many registers in one as let a pair at the similarity sought miss
   all bands with a probability under ``MISS`` (four at 80 percent).
4. Every bucket's members are compared with its pivot: in buckets of up to ``CROWD`` members the one with the
   least name, in larger ones the one with fewest shingles of its own, those that no other member of a
   crowded bucket has. A member with too many of its own for any link stays out of crowded buckets. Links
   join classes to components (large and small stars, no component in one task).
5. Buckets that lie within one component are done. In the others, members of different components are all
   compared, so no link that could join two components is left out. In buckets of up to ``CROWD`` members
   these are pairs, without those already tried. Larger ones are dealt into blocks of bounded size, the
   bucket's largest component apart from the rest; two blocks, not both of the largest component, are a
   cell, named by their numbers, whose sets are compared as one product of matrices and which yields a row
   for each two components that it joins and no pairs.
6. A pair is compared by the likelihood of its registers first: 6.8 deviations below the similarity sought it
   is let go. The others, and all in cells, are decided on the full sets.

A document without words has no shingles, is linked with nothing and is a component of its own. With
fewer words than a shingle the whole sequence is the one shingle; very long texts are sets like any other.
Each row belongs to the class of its text, so rows that repeat a doc_id with other texts are told apart. A
component's id is its least doc_id; a null doc_id has its component's, or null where that has no other.
Columns other than doc_id and text are not read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.scratch import Tables, bound_batches, few, write
from keystrata.llm.words import release, spaced_bytes

REGISTERS, MISS = 128, 1e-7
BASE, LIMIT, RATE = 1.001, 65534, 20.0
CROWD, BLOCK, BLOCK_BYTES = 24, 512, 1 << 20


def band_rows(percent: int) -> int:
    """Registers in a band: the most that let a pair at ``percent`` miss all bands with a probability under MISS."""
    j = percent / 100
    found = [r for r in range(1, 17) if j <= 1 and (1 - j**r) ** (REGISTERS // r) <= MISS]
    if not found:
        raise ValueError(f"{REGISTERS} registers can't find pairs at {percent} percent")
    return found[-1]


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_FACTORS = _mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
_OFFSETS = _mix(np.arange(10_001, 10_001 + REGISTERS, dtype=np.uint64))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of ``words``, ascending."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of hashes, as 16-bit registers."""
    least = np.full(REGISTERS, ~np.uint64(0))
    for at in range(0, len(hashes), 256):
        np.minimum(least, (hashes[at : at + 256] * _FACTORS[:, None] + _OFFSETS[:, None]).min(axis=1), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(value, 1e-300)) / np.log(BASE)) + LIMIT // 2, 0, LIMIT + 1).astype("<u2")


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarities of greatest likelihood, on a grid of 0.01, from registers (rows) and set sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = REGISTERS - more - less
    u = (n_a / (n_a + n_b))[:, None]
    j = np.minimum(np.linspace(0, 1, 101)[None, :], np.minimum(u, 1 - u) / np.maximum(u, 1 - u))
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - (1 - u) * j), p((1 - u) - u * j)
    fit = more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + same * np.log(np.maximum(1 - up - down, 1e-12))
    return j[np.arange(len(j)), fit.argmax(axis=1)]


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, words (hash of the word sequence, null without words), n_shingles, registers."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            names, sizes, regs = [], [], []
            for text in batch.column(2).to_pylist():
                words = spaced_bytes(text)
                hashes = shingle_hashes(words, size)
                names.append(int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True) if words else None)
                sizes.append(len(hashes))
                regs.append(registers(hashes).tobytes() if words else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary())],
                ["doc_id", "text_hash", "words", "n_shingles", "registers"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return keyed.mapInArrow(sketch, "doc_id long, text_hash long, words long, n_shingles long, registers binary")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """id and the packed shingle set of texts (id, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [shingle_hashes(spaced_bytes(text), size).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "shingles"])

    return texts.mapInArrow(sets, "id long, shingles binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union: by their registers first, then on full sets."""
    j = percent / 100
    doubt = j - 6.8 * (j * (1 - j) / REGISTERS) ** 0.5

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (4, 5))
            good = (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent) & (likely(ra, rb, na, nb) >= doubt)
            for n in np.flatnonzero(good):
                x, y = (np.frombuffer(batch.column(i)[n].as_buffer(), np.uint64) for i in (6, 7))
                union = len(np.union1d(x, y))
                good[n] = 100 * (len(x) + len(y) - union) >= percent * union
            yield batch.select([0, 1]).filter(pa.array(good))

    kept = ["id", "n_shingles", "registers", "shingles"]
    joined = pairs.join(sets.select(kept).toDF("a", "na", "ra", "sa"), "a").join(sets.select(kept).toDF("b", "nb", "rb", "sb"), "b")
    return joined.select("a", "b", "na", "nb", "ra", "rb", "sa", "sb").mapInArrow(linked, "a long, b long")


def joined_components(one: tuple[list[np.ndarray], np.ndarray], other: tuple[list[np.ndarray], np.ndarray], percent: int) -> np.ndarray:
    """Pairs of different components (rows, ascending) that a set of ``one`` and one of ``other`` link.

    Each side has its sets and their components; intersections are products of 0-1 matrices.
    """
    (left, first), (right, second) = one, other
    sizes = np.array([len(x) for x in [*left, *right]])
    shingle, member = np.concatenate([*left, *right]), np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(shingle, kind="stable")
    shingle, member = shingle[order], member[order]
    column = np.cumsum(np.r_[0, shingle[1:] != shingle[:-1]])
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, column[-1] + 1, 4096):
        a, b = np.searchsorted(column, (start, start + 4096))
        part = np.zeros((len(sizes), 4096), np.float32)
        part[member[a:b], column[a:b] - start] = 1
        both += part[: len(left)] @ part[len(left) :].T
    union = sizes[: len(left), None] + sizes[None, len(left) :] - both
    x, y = np.nonzero((100 * both >= percent * union) & (first[:, None] != second[None, :]))
    return np.unique(np.sort(np.column_stack([first[x], second[y]]), axis=1), axis=0)


def _crossed(members: DataFrame, sets: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Components (a, b) with a link between them inside crowded buckets (bucket, id, n_shingles, component)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row in batch.to_pylist():
                sides = [([np.frombuffer(x, np.uint64) for x in row[f"sets_{s}"]], np.array(row[f"components_{s}"])) for s in "xy"]
                found = joined_components(*sides, percent)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    largest = members.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "component")).getField("component").alias("largest"))
    sided = members.join(tables.write(largest, "largest"), "bucket").withColumn("rest", F.col("component") != F.col("largest"))
    blocks = F.ceil(F.greatest(F.sum("n_shingles") * 8 / BLOCK_BYTES, F.count("*") / BLOCK)).cast("int")
    dealt = sided.join(tables.write(sided.groupBy("bucket", "rest").agg(blocks.alias("blocks")), "counts"), ["bucket", "rest"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packed = dealt.join(sets.select("id", "shingles"), "id").groupBy("bucket", "rest", "block").agg(F.collect_list(F.struct("component", "shingles")).alias("held"))
    packed = tables.write(packed.select("bucket", "rest", "block", F.col("held.component").alias("components"), F.col("held.shingles").alias("sets")), "blocks")
    names = packed.select("bucket", "rest", "block")
    x, y = names.where("rest").toDF("bucket", "rest_x", "block_x"), names.toDF("of", "rest_y", "block_y")
    cells = x.join(y, (x["bucket"] == y["of"]) & (~F.col("rest_y") | (F.col("block_x") <= F.col("block_y")))).drop("of")
    for side in "xy":
        cells = cells.join(packed.toDF("bucket", f"rest_{side}", f"block_{side}", f"components_{side}", f"sets_{side}"), ["bucket", f"rest_{side}", f"block_{side}"])
    return cells.select("components_x", "sets_x", "components_y", "sets_y").mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """id, component of every node of ``edges`` (a, b): the least id that it reaches.

    Alternates large stars and small stars; each step is a least neighbour for every node and a join, so
    no node's neighbours are ever collected. Every step is written to the shared folder.
    """
    state = lambda of: of.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = tables.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = state(edges)
    while seen[0]:
        both = edges.unionAll(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = tables.write(small, "edges")
        before, seen = seen, state(edges)
        if seen == before:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _classed(docs: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, words, n_shingles) of ``docs``, and of each class: words, root (of its component), component_id."""
    spark, rows_of_band = docs.sparkSession, band_rows(percent)
    bound_batches(spark)
    rows = write(_sketched(docs, size), "sketches")
    with Tables(spark) as tables:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash"))
        classes = rows.where("words IS NOT NULL").groupBy("words").agg(first.alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
        classes = tables.write(classes.select(F.col("words").alias("id"), "first.doc_id", "first.text_hash", "n_shingles", "registers"), "classes")

        bands = [F.xxhash64(F.lit(k), F.substring("registers", 2 * rows_of_band * k + 1, 2 * rows_of_band)) for k in range(REGISTERS // rows_of_band)]
        member = classes.select("id", "n_shingles", F.explode(F.array(*bands)).alias("bucket"))
        bucket = member.groupBy("bucket").agg(F.count("*").alias("members"), F.min("id").alias("pivot")).where("members > 1")
        # Sums by bucket are written before they are joined, so that a join can split a bucket with very many members.
        member = tables.write(member.join(tables.write(bucket, "buckets"), "bucket"), "members")

        known = tables.write(classes.join(member.select("id").distinct(), "id", "left_semi"), "known")
        wanted = few(known.select("id", F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text")))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("hash"), "text")
        texts = texts.join(wanted, F.equal_null("doc", "of_doc") & (F.col("hash") == F.col("of_text"))).select("id", "text")
        made = _sets(texts, size).groupBy("id").agg(F.first("shingles").alias("shingles"))
        sets = tables.write(made.join(known.select("id", "n_shingles", "registers"), "id"), "sets")

        crowded = member.where(F.col("members") > CROWD).drop("pivot")
        inside = _unpacked(sets.join(crowded.select("id").distinct(), "id", "left_semi").select("id", "shingles"))
        own = inside.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count("*").alias("own"))
        crowded = crowded.join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0))).where(F.col("own") * 100 <= F.col("n_shingles") * (100 - percent))
        crowded = tables.write(crowded, "crowded")
        small = member.where(F.col("members") <= CROWD)

        pivot = crowded.groupBy("bucket").agg(F.min(F.struct("own", "id", "n_shingles")).alias("p")).select("bucket", F.col("p.id").alias("pivot"), F.col("p.own").alias("p_own"), F.col("p.n_shingles").alias("p_n"))
        pivot = tables.write(pivot, "pivots")
        # What is one's own is in the union and not in the intersection.
        hope = F.least(F.col("n_shingles") - F.col("own"), F.col("p_n") - F.col("p_own")) * 100 >= F.greatest(F.col("n_shingles") + F.col("p_own"), F.col("p_n") + F.col("own")) * percent
        star = small.select("id", "pivot").unionAll(crowded.join(pivot, "bucket").where(hope).select("id", "pivot")).where("id <> pivot")
        star = tables.write(star.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), "star")
        found = components(_linked(star, sets, percent), tables)

        part = small.select("bucket", "id", "n_shingles", "members").unionAll(crowded.select("bucket", "id", "n_shingles", "members"))
        part = tables.write(part.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "parts")
        mixed = part.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
        open_ = tables.write(part.join(tables.write(mixed, "mixed"), "bucket", "left_semi"), "open")
        rest = open_.where(F.col("members") <= CROWD).select("bucket", "id", "n_shingles", "component")
        x, y = rest.toDF("bucket", "a", "na", "ca"), rest.toDF("of", "b", "nb", "cb")
        near = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
        rest = x.join(y, (x["bucket"] == y["of"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near).select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
        more = _linked(rest, sets, percent)
        crowd = open_.where(F.col("members") > CROWD).select("bucket", "id", "n_shingles", "component")
        if crowd.take(1):
            more = more.unionAll(_crossed(crowd, sets, percent, tables))
        more = tables.write(more, "more")
        if more.take(1):
            found = components(found.toDF("a", "b").unionAll(more), tables)

        joined = tables.write(classes.select("id", "doc_id").join(found.where("id <> component").unionAll(found.select("component", "component").distinct()), "id"), "joined")
        least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = joined.select("id", "component").join(least, "component")
        labelled = classes.select("id", "doc_id").join(named, "id", "left").select(F.col("id").alias("words"), F.coalesce("component", "id").alias("root"), F.coalesce("component_id", "doc_id").alias("component_id"))
        labelled = write(labelled, "labelled")
    return rows.select("doc_id", "text_hash", "words", "n_shingles"), labelled


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    rows, classes = _classed(docs, percent, size)
    component = F.coalesce("component_id", "doc_id")
    return rows.join(classes, "words", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.equal_null("doc_id", component).alias("kept"))


def representatives(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """One row of ``docs``, with all its columns, of each component; rows without words are components each.

    The row with the component's least doc_id stays. Where rows repeat that, the least hash of a text decides,
    then any of equal rows; without any doc_id, any row.
    """
    with Tables(docs.sparkSession) as tables:
        rows, classes = _classed(docs, percent, size)
        named = tables.write(rows.where("words IS NOT NULL").join(classes, "words").select("doc_id", "text_hash", "root", "component_id"), "named")
        first = named.where(F.equal_null("doc_id", "component_id")).groupBy("root").agg(F.count("*").alias("n"), F.min("text_hash").alias("text_hash"), F.first("doc_id").alias("doc_id"))
        first = tables.write(first, "first")
        names = ["_of_doc", "_of_text", "_root"]
        several = write(first.where("n > 1").select("doc_id", "text_hash", "root").toDF(*names), "several")
        single = first.where("n = 1").select("doc_id", "text_hash")
        other = named.select("doc_id", "text_hash").distinct().join(single, F.equal_null(named["doc_id"], single["doc_id"]) & (named["text_hash"] == single["text_hash"]), "left_anti")
        dropped = write(other.toDF(*names[:2]), "dropped")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_of_doc")) & (F.xxhash64(docs["text"]) == F.col("_of_text"))
    kept = docs.join(few(dropped), same, "left_anti")
    if not several.take(1):
        return kept
    whole = F.first(F.struct(*[docs[c] for c in docs.columns])).alias("_row")
    return kept.unionAll(docs.join(few(several), same).groupBy("_root").agg(whole).select("_row.*"))


def _unpacked(sets: DataFrame) -> DataFrame:
    """id and shingle, a row for each element of the packed sets."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [np.frombuffer(packed, np.int64) for packed in batch.column(1).to_pylist()]
            if found:
                ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(found))], ["id", "shingle"])

    return sets.mapInArrow(unpack, "id long, shingle long")
