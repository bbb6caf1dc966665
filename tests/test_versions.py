import pytest

from keystrata.functions.keys import prefix_range
from keystrata.functions.stats import latency_summary, run_stats, sorted_map_size, space_amplification
from keystrata.operators import versions as V
from tests.conftest import rows


def test_newest_wins_by_epoch_then_seq(log):
    df = log(("k", 1, 0, "new"), ("k", 0, 9, "old"), ("k", 1, 1, "newer"), ("other", 0, 0, "x"))
    assert rows(V.scan(df)) == [("k", "newer"), ("other", "x")]


def test_range_is_half_open_and_sorted(log):
    df = log(*[(f"key{i:02d}", 0, i, f"value{i}") for i in range(10)])
    assert [k for k, _ in rows(V.scan(df, "key03", "key07"))] == ["key03", "key04", "key05", "key06"]


@pytest.mark.parametrize(("keys", "start", "end", "found"), [
    (["aaa", "zzz"], "bbb", "ccc", []), (["aaa", "bbb", "ccc"], "bbb", "ccc", ["bbb"]), (["a", "b", "c", "d"], "b", "d", ["b", "c"]), (["a"], "a", "a", []), (["a", "b"], "b", "a", []), ([], "a", "b", []),
])
def test_range_edges(log, keys, start, end, found):
    assert [k for k, _ in rows(V.scan(log(*[(k, 0, i, "v") for i, k in enumerate(keys)]), start, end))] == found


def test_tombstones_are_rows_with_null_or_left_out(log):
    df = log(*[(f"key{i}", 0, i, "v") for i in range(5)], ("key1", 0, 5, None), ("key3", 0, 6, None))
    assert rows(V.scan(df, "key0", "key5")) == [("key0", "v"), ("key1", None), ("key2", "v"), ("key3", None), ("key4", "v")]
    assert [k for k, _ in rows(V.scan(df, include_tombstones=False))] == ["key0", "key2", "key4"]


def test_get_missing_deleted_and_empty_values(log):
    df = log(("a", 0, 0, ""), ("b", 0, 1, "x"), ("b", 1, 0, None))
    assert rows(V.get(df, "a")) == [("a", "")]
    assert rows(V.get(df, "b")) == [("b", None)]
    assert rows(V.get(df, "c")) == []


def test_order_of_keys_is_by_code_point(log):
    keys = ["", "A", "a", "é", "～", "\U0001f600"]
    assert [k for k, _ in rows(V.scan(log(*[(k, 0, i, k) for i, k in enumerate(reversed(keys))])))] == keys


def test_physical_presence_counts_tombstones(log):
    df = log(("a", 0, 0, None))
    assert rows(V.has_key(df, "a")) == [(True,)]
    assert rows(V.has_key(df, "b")) == [(False,)]
    assert rows(V.has_keys_in_range(df, "a", "b")) == [(True,)]
    assert rows(V.has_keys_in_range(df, "b", None)) == [(False,)]


def test_compaction_keeps_order_and_drops_tombstones(log):
    df = log(("key1", 0, 0, "old"), ("key2", 0, 1, "v"), ("key1", 1, 0, "new"), ("key2", 1, 1, None))
    assert [(r.key, r.epoch, r.seq, r.data) for r in V.compacted(df).collect()] == [("key1", 1, 0, "new")]
    assert len(rows(V.compacted(df, drop_tombstones=False))) == 2


def test_overlapping_runs(log):
    old = log(*[(f"key{i:05d}", 0, i, f"value1_{i}") for i in range(1000)])
    new = log(*[(f"key{i:05d}", 1, i, f"value2_{i}") for i in range(500)])
    found = dict(rows(V.merged(old, new)))
    assert len(found) == 1000
    assert found["key00499"] == "value2_499"
    assert found["key00500"] == "value1_500"


def test_multi_get(log, spark):
    df = log(("a", 0, 0, "1"), ("b", 0, 1, "2"), ("b", 0, 2, None))
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "key string")
    assert sorted(rows(V.multi_get(df, asked)), key=str) == [("a", "1"), ("b", None), ("c", None)]


def test_multi_scan_by_boundaries_equals_broadcast(log, spark, monkeypatch):
    df = log(*[(f"k{i:04d}", 0, i, str(i)) for i in range(300)])
    ranges = spark.createDataFrame([(f"k{a:04d}", f"k{a + n:04d}") for a, n in [(0, 5), (3, 150), (290, 50), (7, 0), (9, -3)]] + [("k0299", "z"), ("", "k0002")], "lo string, hi string")
    broadcast = sorted(rows(V.multi_scan(df, ranges)))
    for bound in ("PLAIN_RANGES", "BROADCAST_RANGES"):
        monkeypatch.setattr(V, bound, 1)
        assert sorted(rows(V.multi_scan(df, ranges))) == broadcast
    counts = {(lo, hi): n for lo, hi, n in rows(V.count_ranges(df, ranges))}
    assert counts["k0003", "k0153"] == 150
    assert counts["k0007", "k0007"] == 0


def test_pushdown_reaches_the_scan_and_nothing_else_is_read(log, tmp_path, spark):
    from keystrata.schema import LOG

    log(*[(f"k{i}", 0, i, "v") for i in range(10)]).write.parquet(str(tmp_path / "run"))
    df = V.scan(spark.read.schema(LOG).parquet(str(tmp_path / "run")), "k3", "k5")
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(key,k3)" in plan and "LessThan(key,k5)" in plan


def test_flushed_keeps_one_version_per_epoch(log):
    df = log(("a", 0, 0, "1"), ("a", 0, 1, "2"), ("a", 1, 0, None))
    assert sorted((r.epoch, r.data) for r in V.flushed(df).collect()) == [(0, "2"), (1, None)]


def test_statistics(log):
    df = log(("a", 0, 0, "12"), ("b", 0, 1, "3"), ("a", 1, 0, None))
    assert sorted(rows(run_stats(df))) == [(0, "a", "b", 2, 0), (1, "a", "a", 1, 1)]
    assert sorted(rows(sorted_map_size(df))) == [("a", 100), ("b", 101)]
    assert rows(space_amplification(df)) == [(3, 1, 3.0)]


def test_latency_summary():
    s = latency_summary([i / 1000 for i in range(1, 101)])
    assert (s["min"], s["max"], s["median"]) == (1.0, 100.0, 50.5)
    assert s["p95"] == 96.0
    assert latency_summary([]) == {}


@pytest.mark.parametrize(("prefix", "end"), [("ab", "ac"), ("a\U0010ffff", "b"), ("퟿", ""), ("", None), ("\U0010ffff", None)])
def test_prefix_range(prefix, end):
    assert prefix_range(prefix) == (prefix, end)
