import math

import numpy as np
import pytest

from keystrata.llm import top_k as K
from tests.llm.conftest import records

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, score long"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in vectors], SCHEMA)


def brute(vectors, k=5, every=50):
    whole = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [math.floor(256 * float(np.float32(x))) for x in v]
    out = []
    for i, q in whole.items():
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole.items() if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in records(df))


def test_equals_brute_force_with_ties_and_odd_rows(spark, monkeypatch):
    pick = np.random.default_rng(4)
    vectors = [(i, pick.normal(size=12).round(2).tolist()) for i in range(700)]
    same = vectors[3][1]
    vectors += [(1000 + i, same) for i in range(250)]
    vectors += [(2000, None), (2050, [None] * 12), (2100, [math.inf] + [0.0] * 11), (2150, [math.nan] * 12), (None, same), (2200, [1.0, 2.0]), (2250, [0.5, -1.0]), (2300, []), (50, vectors[50][1]), (1000, same)]
    df = table(spark, vectors)
    assert found(K.top_k(df)) == brute(vectors)
    monkeypatch.setattr(K, "SHARD_ROWS", 60)
    monkeypatch.setattr(K, "LEAF", 8)
    assert found(K.top_k(df)) == brute(vectors)


def test_few_and_no_rows(spark):
    assert found(K.top_k(table(spark, [(0, [1.0]), (1, [2.0])]))) == [(0, 1, 1, 256 * 512)]
    assert found(K.top_k(table(spark, [(0, [1.0])]))) == []
    assert found(K.top_k(spark.createDataFrame([], SCHEMA))) == []


def test_tree_prunes_and_is_exact():
    pick = np.random.default_rng(1)
    points = pick.integers(-99, 99, (3000, 3)).astype(float)
    ids = np.arange(3000)
    tree = K.Tree(points, ids, leaf=32)
    q = points[7]
    order = sorted((-s, i) for s, i in zip((points @ q).tolist(), ids.tolist(), strict=True) if i != 7)[:5]
    visited = []
    plain = tree.points

    class Counting:
        def __getitem__(self, rows):
            visited.append(rows.stop - rows.start)
            return plain[rows]

    tree.points = Counting()
    assert tree.search(q, 7, 5, None) == [(-s, i) for s, i in order]
    assert sum(visited) < 1500
    visited.clear()
    assert tree.search(q, 7, 5, int(-order[0][0]) + 1) == []
    assert sum(visited) < 200


def test_large_components_are_exact_and_too_large_scores_an_error(spark):
    big = [(0, [2.0**21, 1.0, -3.0]), (50, [2.0**21 + 1, 5.0, 2.0**20]), (1, [2.0**21 + 2, 7.0, 1.0]), (2, [2.0**21, 2.0, 1.0])]
    doubles = "vec_id long, embedding array<double>"
    assert found(K.top_k(spark.createDataFrame(big, doubles))) == brute([(i, v) for i, v in big])
    far = [(0, [2.0**30] * 4), (1, [2.0**30] * 4), (2, [1.0] * 4)]
    with pytest.raises(Exception, match="more than 64 bits"):
        records(K.top_k(spark.createDataFrame(far, doubles)))
    cancelled = [(0, [2.0**60, 1.0]), (1, [0.0, 3.0]), (2, [0.0, -7.0])]
    assert found(K.top_k(spark.createDataFrame(cancelled, doubles))) == [(0, 1, 1, 3 * 65536), (0, 2, 2, -7 * 65536)]
    with pytest.raises(ValueError, match="over"):
        K.top_k(spark.createDataFrame([(0, [1e307])], doubles))


def test_shards_are_regions_of_space_and_one_vector_may_fill_several(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD_ROWS", 100)
    pick = np.random.default_rng(5)
    points = pick.normal(size=(1000, 2))
    cells = K.Cells(points, 100)
    number = cells(points)
    counts = np.bincount(number)
    assert len(counts) == cells.cells and counts.max() <= 130 and counts.min() >= 50
    boxes = [(points[number == c].min(axis=0), points[number == c].max(axis=0)) for c in range(cells.cells)]
    assert sum(float(np.prod(b - a)) for a, b in boxes) < float(np.prod(np.ptp(points, axis=0)))
    vectors = [(i, [0.5, 0.25]) for i in range(900)] + [(i, [0.1, float(i)]) for i in range(900, 960)]
    assert found(K.top_k(table(spark, vectors))) == brute(vectors)
