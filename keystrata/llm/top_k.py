"""Exact top-k by inner product with a KD-tree for each shard.

Vectors are whole numbers: floor(256 x) of each component. Median splits of a bounded sample cut space into
cells, and cells into shards of bounded size, by the hash of the identifier where a cell has too many (a
vector that very many rows repeat). Each shard gets a tree of median splits whose boxes are as tight as their
points, written once to the shared folder beside the block of the shard's own queries.

A query goes through a tree best-first, by the greatest inner product that a box allows, and ends where that
is below its kth best score so far. The first tree it meets is its own shard's, where its neighbours are;
the kth score from there goes with the query to all others, and shards whose box is below it are skipped
without opening their trees. Cells (block of queries, shard) are rows of two names; vectors are never copied
for them, and each task reads a tree once for all the blocks it holds against it.

Scores are exact: sums of products are taken in 53 bits where these suffice, else in 64, else in Python's
integers. A score to be returned that has more than 64 bits, or a component over 1e305, is an error.

Vectors that are null, or hold null or non-finite components, take no part. Vectors of different lengths are
never compared; vectors without components score 0. Rows that repeat a vec_id with the same vector are one
row, and a query is never compared with its own vec_id. Null identifiers take no part. An empty table gives
no rows. Equal scores go to smaller vec_ids. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.scratch import Tables, bound_batches, new_path, write
from keystrata.llm.words import release

LEAF, SHARD_ROWS, SHARD_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 128, 16_384, 16 << 20, 20_000, 64 << 20
LARGEST = 1e305


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component, as doubles that are whole; null if a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))

    def whole(x: Column) -> Column:
        y = x.cast("double") * 256
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # from 2^53 on every double is whole

    return F.when(F.coalesce(finite, F.lit(False)), F.transform(vector, whole))


def exact(vectors: np.ndarray, most: float) -> np.ndarray:
    """Whole doubles as numbers in which sums of products that come to ``most`` at most are exact."""
    if most < 2.0**53:
        return vectors
    if most < 2.0**62:
        return vectors.astype(np.int64)
    return np.array([int(x) for x in vectors.ravel()], dtype=object).reshape(vectors.shape)


class Tree:
    """Median splits of whole-numbered points (rows) down to ``leaf``, with tight boxes. Points are kept leaf by leaf."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.nodes: list[list] = []  # low, high, left, right, first row, end
        order = np.arange(len(points))
        todo = [(0, len(points), None, 0)]
        while todo:
            first, end, parent, side = todo.pop()
            rows = order[first:end]
            own = points[rows]
            low, high = own.min(axis=0), own.max(axis=0)
            if parent is not None:
                self.nodes[parent][2 + side] = len(self.nodes)
            self.nodes.append([low, high, -1, -1, first, end])
            if end - first > leaf and (high > low).any():
                rows = rows[np.argsort(own[:, int((high - low).argmax())], kind="stable")]
                order[first:end] = rows
                half = (first + end) // 2
                todo += [(first, half, len(self.nodes) - 1, 0), (half, end, len(self.nodes) - 1, 1)]
        self.points, self.ids, self.largest = points[order], ids[order], float(np.abs(points).max(initial=0))
        self.low, self.high = (np.array([x[i] for x in self.nodes]) for i in (0, 1))
        self.nodes = [tuple(x[2:]) for x in self.nodes]

    def state(self) -> tuple:
        return self.points, self.ids, self.largest, self.low, self.high, self.nodes

    @classmethod
    def restored(cls, state: tuple) -> Tree:
        tree = cls.__new__(cls)
        tree.points, tree.ids, tree.largest, tree.low, tree.high, tree.nodes = state
        return tree

    def search(self, query: np.ndarray, own: int, k: int, least: int | None, best: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
        """(score, id) of the best ``k`` other points with a score of at least ``least``, best first.

        ``query`` is whole doubles; ``best`` holds finds in other trees, which count towards the ``k``.
        """
        best = list(best or [])
        bounds = greatest(query[None], self.low, self.high)[0]
        most = self.largest * float(np.abs(query).max(initial=0)) * len(query)
        real = exact(query, most)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if least is not None and -bound < least:
                break
            left, right, first, end = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if least is None or bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            scores = exact(self.points[first:end], most) @ real
            good = self.ids[first:end] != own
            if least is not None:
                good &= scores >= least
            if good.any():
                best = sorted([*best, *zip(map(int, scores[good]), self.ids[first:end][good].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
                if len(best) == k:
                    least = best[-1][0] if least is None else max(least, best[-1][0])
        return best


def greatest(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """By query and box (rows): no point of the box has a greater inner product with the query."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        bound = plus @ high.T + minus @ low.T
        slack = plus @ np.abs(high).T - minus @ np.abs(low).T
        return np.nan_to_num(bound + slack * 1e-9 + 1e-6, nan=np.inf, posinf=np.inf, neginf=np.inf)


class Cells:
    """Median splits of a sample down to ``leaf`` points: a number for each vector."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.splits: list[tuple[int, float, int, int]] = []  # component, bound, what lies up to it, what above: a split, or a cell as -1 - its number
        self.cells = 0
        self._split(points, leaf)

    def _split(self, points: np.ndarray, leaf: int) -> int:
        spread = np.ptp(points, axis=0) if points.size else np.zeros(1)
        at = int(spread.argmax())
        bound = float(np.median(points[:, at])) if points.size else 0.0
        low = points[:, at] <= bound if points.size else np.empty(0, bool)
        if len(points) <= leaf or spread[at] == 0 or low.all():
            self.cells += 1
            return -self.cells
        here = len(self.splits)
        self.splits.append((0, 0.0, 0, 0))
        self.splits[here] = (at, bound, self._split(points[low], leaf), self._split(points[~low], leaf))
        return here

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))] if self.splits else []
        while todo:
            node, rows = todo.pop()
            at, bound, left, right = self.splits[node]
            low = points[rows, at] <= bound
            for child, part in ((left, rows[low]), (right, rows[~low])):
                if child < 0:
                    out[part] = -1 - child
                elif len(part):
                    todo.append((child, part))
        return out


def _save(path: str, value: object) -> None:
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0])
    with store.open_output_stream(name) as out:
        out.write(pickle.dumps(value, protocol=5))


def _load(path: str) -> object:
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file:
        return pickle.loads(file.read())


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _deal(vectors: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """``vectors`` (vec_id, v, width) with the number of their cell among those of their width."""
    shipped = vectors.sparkSession.sparkContext.broadcast(cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            widths, cell = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for width in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == width)
                if width in shipped.value:
                    cell[rows] = shipped.value[width](_matrix(batch.column(1).take(pa.array(rows)), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return vectors.mapInArrow(deal, "vec_id long, v array<double>, width int, cell int")


def top_k(table: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the best ``k`` of each row whose vec_id is divisible by ``every``."""
    spark = table.sparkSession
    bound_batches(spark)
    folder = new_path(spark, "trees")
    with Tables(spark) as tables:
        vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").distinct()
        vectors = tables.write(vectors.withColumn("width", F.size("v")), "vectors")
        largest = F.max(F.array_max(F.transform("v", F.abs)))
        sizes = {r.width: r for r in vectors.groupBy("width").agg(F.count("*").alias("n"), largest.alias("largest")).collect()}
        if any((r.largest or 0) > LARGEST * 256 for r in sizes.values()):
            raise ValueError(f"a component of embedding is over {LARGEST}")
        rows = sum(r.n for r in sizes.values())
        shard_rows = {w: max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * w + 8), max(1024, rows // (2 * spark.sparkContext.defaultParallelism)))) for w in sizes}
        drawn = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(sizes, default=0) + 8) + 1)
        sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(drawn).toArrow()
        held = sample.column("width").to_numpy()
        cells = {}
        for w in np.unique(held).tolist():
            points = _matrix(sample.column("v").take(pa.array(np.flatnonzero(held == w))), w)
            cells[w] = Cells(points, max(1, len(points) * shard_rows[w] // sizes[w].n))

        # A number for each shard: cells of more rows than a shard holds are several shards.
        dealt = tables.write(_deal(vectors, cells), "dealt")
        numbers, count = [], 0
        for r in sorted(dealt.groupBy("width", "cell").agg(F.count("*").alias("n")).collect()):
            parts = -(-r.n // (2 * shard_rows[r.width]))
            numbers.append((r.width, r.cell, parts, count))
            count += parts
        numbered = F.broadcast(spark.createDataFrame(numbers, "width int, cell int, parts int, first int"))  # three numbers a cell
        of_width = {w: [n for n in numbers if n[0] == w] for w in sizes}
        ranges = F.broadcast(spark.createDataFrame([(w, of[0][3], of[-1][3] + of[-1][2] - 1) for w, of in of_width.items() if of], "width int, begin int, last int"))

        box = pa.list_(pa.float64())

        def build(key: tuple, group: pa.Table) -> pa.Table:
            width, number = key[0].as_py(), key[1].as_py()
            points, ids = _matrix(group.column("v"), width), group.column("vec_id").to_numpy()
            tree = Tree(points, ids)
            asked = np.flatnonzero(ids % every == 0)
            best = [tree.search(points[n], int(ids[n]), k, None) for n in asked]
            path = f"{folder}/{number}-{uuid.uuid4().hex}"
            _save(f"{path}.tree", tree.state())
            if len(asked):
                _save(f"{path}.block", (ids[asked], points[asked], best))
            return pa.table({"width": pa.array([width], pa.int32()), "shard": pa.array([number], pa.int32()), "path": [path], "queries": pa.array([len(asked)], pa.int32()), "low": pa.array([tree.low[0].tolist()], box), "high": pa.array([tree.high[0].tolist()], box)})

        of_shard = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")
        grouped = dealt.join(numbered, ["width", "cell"]).select("vec_id", "v", "width", of_shard.alias("shard")).groupBy("width", "shard")
        shards = write(grouped.applyInArrow(build, "width int, shard int, path string, queries int, low array<double>, high array<double>"), "shards")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        opened, tree = "", None
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for block, path, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked, queries, best = _load(f"{block}.block")
                if block == path:
                    found += [(own, i, score) for own, finds in zip(asked.tolist(), best, strict=True) for score, i in finds]
                    continue
                least = np.array([x[-1][0] if len(x) == k else -np.inf for x in best], float)
                hope = greatest(queries, np.array(low)[None], np.array(high)[None])[:, 0]
                for n in np.flatnonzero(hope >= least - np.abs(least) * 1e-9):
                    if opened != path:
                        opened, tree = path, Tree.restored(_load(f"{path}.tree"))
                    own, known = int(asked[n]), set(best[n])
                    found += [(own, i, score) for score, i in tree.search(queries[n], own, k, best[n][-1][0] if len(best[n]) == k else None, best[n]) if (score, i) not in known]
            if any(not -(2**63) <= score < 2**63 for _, _, score in found):
                raise OverflowError("a score has more than 64 bits")
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], pa.int64()) for n in range(3)], ["query_id", "vec_id", "score"])

    blocks = shards.where("queries > 0").join(ranges, "width").select(F.col("path").alias("block"), F.explode(F.sequence("begin", "last")).alias("shard"))
    cells_ = blocks.join(shards.select("shard", "path", "low", "high"), "shard")
    # A tree's cells stand together; a tree with very many of them is dealt to several tasks.
    parallel = spark.sparkContext.defaultParallelism
    cells_ = cells_.repartition(max(2 * parallel, min(4 * count, 20 * parallel)), "path", F.pmod(F.xxhash64("block"), F.lit(4))).sortWithinPartitions("path")
    found = cells_.select("block", "path", "low", "high").mapInArrow(compare, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
