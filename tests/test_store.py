import random
import re
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from keystrata.plans.manifest import Conflict
from keystrata.plans.store import Store
from keystrata.schema import StoreConfig


@pytest.mark.parametrize(("settings", "message"), [
    ({"memtable_threshold": 0}, "memtable_threshold"), ({"memtable_threshold": 2 << 30}, "memtable_threshold"), ({"fsync_interval_ms": -1}, "fsync_interval_ms"),
    ({"fsync_interval_ms": 10_001}, "10000"), ({"max_commit_runs": 1}, "max_commit_runs"), ({"compaction_threshold": 1}, "compaction_threshold must be >= 2"), ({"compaction_interval_s": 0}, "compaction_interval_s must be positive"),
])
def test_settings_are_checked(settings, message):
    with pytest.raises(ValueError, match=message):
        StoreConfig(**settings)


@pytest.mark.parametrize("folder", ["", "  "])
def test_blank_folder(spark, folder):
    with pytest.raises(ValueError, match="blank"):
        Store(spark, folder)


def test_verbs(store):
    assert store.get("key1") is None
    assert store.put("key1", "value1") and store.put("key1", "value2")
    assert store.get("key1") == "value2"
    assert store.delete("key1") and store.delete("never")
    assert store.get("key1") is None and store.has("key1") and store.has("never") and not store.has("x")
    assert store.batch_put([]) == []
    assert store.batch_put([("key", "value1"), ("key", "value2"), ("key", "value3"), ("", "empty key"), ("e", "")]) == [True] * 5
    assert store.get("key") == "value3" and store.get("") == "empty key" and store.get("e") == ""
    assert store.get_range("", "key2") == [("", "empty key"), ("e", ""), ("key", "value3"), ("key1", None)]
    assert store.get_range("", "key2", include_tombstones=False)[-1] == ("key", "value3")
    assert store.has_keys_in_range("n", "o") and not store.has_keys_in_range("o", "p")
    assert store.manifest().next_epoch == 5


def test_odd_keys_and_values_survive(spark, store):
    odd = [("k\t\n /\\\"'", "v\n"), ("키🔑", "値💎"), ("k" * 10_000, "x" * 100_000)]
    store.batch_put(odd)
    store.flush()
    again = Store.open(spark, store.root)
    for key, value in odd:
        assert again.get(key) == value


def test_wrong_types_change_nothing(store):
    with pytest.raises(TypeError):
        store.put("k", 5)
    assert store.manifest().version == 0


def test_maintenance_never_changes_what_is_read(spark, store):
    store.batch_put([(f"key{i}", "old") for i in range(10)])
    store.flush()
    store.batch_put([(f"key{i}", "new") for i in range(0, 10, 2)])
    store.delete("key3")
    live = store.get_range("", "z", include_tombstones=False)
    assert store.flush() and store.get_range("", "z", include_tombstones=False) == live
    assert store.compact() and store.get_range("", "z") == live
    assert store.stats()["runs"] == 1 and store.stats()["tombstones"] == 0
    assert not store.compact()
    assert Store.open(spark, store.root).get_range("", "z") == live
    assert store.vacuum(min_age_s=0) == 5 and store.get_range("", "z") == live


def test_a_flush_keeps_tombstones_that_older_runs_need(store):
    store.put("k", "old")
    store.compact()
    store.flush()
    store.delete("k")
    store.put("x", "y")
    store.flush()
    assert store.get("k") is None and store.stats()["tombstones"] == 1


def test_everything_deleted_compacts_to_nothing(store):
    store.batch_put([("a", "1"), ("b", "2")])
    store.batch_delete(["a", "b"])
    store.compact()
    assert store.get_range("", "z") == [] and store.stats()["runs"] == 0


def test_snapshots_and_uncommitted_files(spark, store):
    store.put("k", "1")
    version = store.manifest().version
    store.put("k", "2")
    assert store.get("k", version=version) == "1"
    store.files.create("runs/stray/part-0.parquet", "junk")
    store.files.create(f"manifest/v-{store.manifest().version + 1:012d}.json", '{"version": 9, "ru')
    again = Store.open(spark, store.root)
    assert again.get("k") == "2"
    again.put("k", "3")
    assert again.get("k") == "3"
    again.vacuum(keep_versions=1, min_age_s=0)
    assert again.files.names("runs/stray") == [] and again.get("k") == "3"


def test_two_writers_both_count(spark, store):
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda w: store.batch_put([(f"writer{w}_key{i}", str(i)) for i in range(20)]), range(3)))
    assert len(store.get_range("w", "x")) == 60
    assert store.manifest().next_epoch == 3


def test_publishing_a_taken_version_conflicts(store):
    base = store.manifest()
    store.put("k", "v")
    with pytest.raises(Conflict):
        store.manifests.publish(base.after())


def test_thresholds(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), memtable_threshold=1, compaction_interval_s=0.01)
    for i in range(3):
        store.put("k", str(i))
    assert all(r.kind == "flush" for r in store.manifest().runs)
    time.sleep(0.02)
    assert store.maintain() and store.stats()["runs"] == 1 and store.get("k") == "2"
    assert not Store(spark, store.root, compaction_enabled=False).maintain(force=True)


def test_closed_store_refuses_writes(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as store:
        store.put("k", "v")
    store.close()
    with pytest.raises(RuntimeError, match="closed"):
        store.put("k", "w")
    assert store.get("k") == "v"


def test_frames_are_committed_in_order(spark, store):
    frame = spark.range(1000).select(F.format_string("k%03d", F.col("id") % 100).alias("key"), F.col("id").cast("string").alias("value"), "id")
    store.write(frame, order_by="id")
    assert store.get("k007") == "907"
    store.write(frame.where("id < 5"), deletes=F.lit(True))
    assert store.scan("k000", "k006").collect()[-1].value == "905"
    keys = spark.createDataFrame([("k007",), ("k001",), ("zz",)], "key string")
    for _ in range(2):
        assert {r.key: r.value for r in store.multi_get(keys).collect()} == {"k007": "907", "k001": None, "zz": None}
        store.compact()


def test_runs_outside_the_range_are_not_opened(store):
    store.put("a", "1")
    store.put("z", "2")
    assert len(store.log("b", "zz").inputFiles()) == 1
    assert store.log("m", "n").count() == 0


def test_bucketed_table_needs_no_exchange(spark, store):
    store.batch_put([(f"k{i}", "v") for i in range(50)])
    table = store.save_bucketed("bucketed_keys", 4)
    from keystrata.operators.versions import latest

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = latest(table)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.sql("DROP TABLE bucketed_keys")
    assert "Exchange" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_random_operations_against_a_dict(spark, tmp_path, seed):
    rnd, model = random.Random(seed), {}
    store = Store.open(spark, str(tmp_path / "s"))
    for step in range(14):
        op = rnd.choice(["batch", "batch", "delete", "put", "flush", "compact", "reopen", "vacuum"])
        if op == "batch":
            pairs = [(f"k{rnd.randrange(12):02d}", rnd.choice(["", "é", str(step)])) for _ in range(rnd.randrange(1, 8))]
            store.batch_put(pairs)
            model.update(pairs)
        elif op == "put":
            store.put("k05", str(step))
            model["k05"] = str(step)
        elif op == "delete":
            key = f"k{rnd.randrange(12):02d}"
            store.delete(key)
            model.pop(key, None)
        elif op == "reopen":
            store.close()
            store = Store.open(spark, store.root)
        else:
            getattr(store, op)(**({"min_age_s": 0} if op == "vacuum" else {}))
    assert store.get_range("", "z", include_tombstones=False) == sorted(model.items())
    assert store.get_range("k03", "k07", include_tombstones=False) == sorted((k, v) for k, v in model.items() if "k03" <= k < "k07")
    for key in ("k00", "k05", "k11", "none"):
        assert store.get(key) == model.get(key)


def test_a_slow_writer_is_not_passed_over(spark, store, monkeypatch):
    """A has written its version and not yet published it when B comes: neither write is lost."""
    other, move, began = Store.open(spark, store.root), store.files.move_new, []

    def slow(name, to):
        if not began:
            began.append(to)
            assert other.put("b", "B")
        return move(name, to)

    monkeypatch.setattr(store.files, "move_new", slow)
    assert store.put("a", "A")
    assert store.get("a") == other.get("a") == "A" and store.get("b") == "B"
    assert [v for v in store.manifests._numbers()] == [2, 1]


def test_a_visible_version_is_whole(store, monkeypatch):
    """A writer that dies before it publishes leaves nothing that is read, and no number taken."""
    store.put("k", "1")
    monkeypatch.setattr(store.files, "move_new", lambda *_: (_ for _ in ()).throw(OSError("dead")))
    with pytest.raises(OSError, match="dead"):
        store.put("k", "2")
    monkeypatch.undo()
    assert store.get("k") == "1" and store.manifest().version == 1
    store.put("k", "3")
    assert store.get("k") == "3" and store.manifest().version == 2
    assert any(n.startswith("unfinished-") for n in store.files.names("manifest"))
    store.vacuum(min_age_s=0)
    assert [n for n in store.files.names("manifest") if not n.endswith(".crc")] == ["v-000000000002.json"]


def test_vacuum_spares_what_may_be_under_way(store):
    store.put("k", "1")
    store.put("k", "2")
    store.compact()
    assert store.vacuum() == 0 and store.vacuum(min_age_s=0) == 2


def test_versions_are_synced_by_their_interval(spark, tmp_path, monkeypatch):
    for interval, wanted in ((0, [True, True]), (10_000, [True, False])):
        store, seen = Store(spark, str(tmp_path / str(interval)), fsync_interval_ms=interval), []
        publish = store.manifests.publish
        monkeypatch.setattr(store.manifests, "publish", lambda m, sync=False, publish=publish, seen=seen: seen.append(sync) or publish(m, sync))
        store._synced = -1e9
        store.put("a", "1")
        store.put("a", "2")
        assert seen == wanted


def test_the_number_of_commits_runs_is_bounded(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), max_commit_runs=3)
    for i in range(7):
        store.put(f"k{i}", str(i))
    assert store.stats()["runs"] <= 5 and sum(r.kind == "commit" for r in store.manifest().runs) < 3
    assert len(store.get_range("k", "l")) == 7


def test_maintenance_in_the_background(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), compaction_interval_s=0.05) as store:
        store.put("a", "1")
        store.put("a", "2")
        store.start_maintenance()
        for _ in range(100):
            if store.stats()["runs"] == 1:
                break
            time.sleep(0.1)
        assert store.stats()["runs"] == 1 and store.get("a") == "2"
    assert not store._maintainer.is_alive()


def test_ranges_are_deleted_as_one_commit(store):
    store.batch_put([(f"k{i}", "v") for i in range(6)])
    assert store.delete_range("k1", "k4") and not store.delete_range("k1", "k4") and not store.delete_range("x", "y")
    assert [k for k, _ in store.get_range("", "z", include_tombstones=False)] == ["k0", "k4", "k5"]
    assert store.manifest().next_epoch == 2


def ancestors(plan, node):
    """The nodes above the first ``node`` of a printed plan, nearest first."""
    lines = [(len(re.match(r"[\s:+|*-]*(?:\(\d+\) )?", x)[0]), re.sub(r"^[\s:+|*-]*(?:\(\d+\) )?", "", x)) for x in plan.splitlines()]
    at = next(i for i, (_, name) in enumerate(lines) if name.startswith(node))
    depth, found = lines[at][0], []
    for d, name in reversed(lines[:at]):
        if d < depth:
            depth = d
            found.append(name)
    return found


def test_a_compacted_run_is_not_shuffled_for_few_keys(spark, store):
    store.write(spark.range(5000).select(F.format_string("k%05d", "id").alias("key"), F.lit("v" * 50).alias("value")))
    store.put("k00007", "new")
    store.compact()
    found = store.multi_get([*(f"k{i:05d}" for i in range(0, 6000, 100)), "k00007"])
    above = ancestors(found._jdf.queryExecution().executedPlan().toString(), "FileScan")
    assert "Exchange" not in " ".join(above[: [x.startswith("BroadcastHashJoin") for x in above].index(True)])
    values = {r.key: r.value for r in found.collect()}
    assert len(values) == 61 and values["k00007"] == "new" and values["k05500"] is None and values["k00100"] == "v" * 50


def test_few_ranges_reach_the_scan_and_outer_runs_are_not_opened(spark, store):
    store.write(spark.range(1000).select(F.format_string("k%04d", "id").alias("key"), F.lit("v").alias("value")))
    store.put("z", "far")
    ranges = spark.createDataFrame([("k0010", "k0013"), ("k0500", "k0502"), ("k9", "k1")], "lo string, hi string")
    found = store.multi_scan(ranges)
    assert "PushedFilters: [" in found._jdf.queryExecution().executedPlan().toString() and len(found.inputFiles()) < len(store.log().inputFiles())
    assert sorted((r.lo, r.key) for r in found.collect()) == [("k0010", "k0010"), ("k0010", "k0011"), ("k0010", "k0012"), ("k0500", "k0500"), ("k0500", "k0501")]
    assert store.multi_scan(ranges.where("lo > hi")).count() == 0


def test_disk_by_kind(store):
    store.put("a", "1")
    store.put("a", "2")
    assert {k: n for k, (n, _) in store.disk().items()} == {"commit": 2, "manifests": 2}
    store.compact()
    found = store.disk()
    assert {k: n for k, (n, _) in found.items()} == {"compact": 1, "others": 2, "manifests": 3} and all(size > 0 for _, size in found.values())
    assert found["compact"][1] == store.stats()["bytes"]
    store.vacuum(min_age_s=0)
    assert set(store.disk()) == {"compact", "manifests"}
