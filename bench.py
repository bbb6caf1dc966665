"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores. Each query runs once to
warm up and then three times; its figure is the least. ``rates`` has set-at-a-time throughput in rows, keys
or ranges a second, to hold against the reference's operations a second.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = ["point_get", "range_scan", "compact", "snapshot_as_of", "flush_runs", "multi_get", "multi_range", "delete_range_then_read", "merge_runs"]


def main() -> None:
    from pyspark.sql import functions as F

    from keystrata.operators import versions as V
    from keystrata.plans import catalogue
    from keystrata.plans.store import Store
    from keystrata.session import local_session

    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory() as folder:
        spark = local_session(cpus, int(cpus), **{"spark.checkpoint.dir": f"file://{folder}/shared"})

        def timed(run, repeats: int = 3) -> float:
            run()
            took = []
            for _ in range(repeats):
                began = time.perf_counter()
                run()
                took.append(time.perf_counter() - began)
            return round(min(took), 4)

        sink = lambda df: df.write.format("noop").mode("overwrite").save()
        queries = {name: timed(lambda q=catalogue.queries()[name]: sink(q(spark, data))) for name in HEADLINE}

        n = 200_000
        pairs = spark.range(n).select(F.format_string("key_%010d", "id").alias("key"), F.lpad(F.col("id").cast("string"), 200, "x").alias("value"), "id")
        shuffled = pairs.repartition(int(cpus), F.xxhash64("id"))
        store = Store.open(spark, f"{folder}/store", compaction_enabled=False)
        rates, took = {}, {}
        took["write_200k"] = timed(lambda: store.write(pairs, order_by="id"), 2)
        took["random_write_200k"] = timed(lambda: store.write(shuffled, order_by="id"), 2)
        began = time.perf_counter()
        rows = store.stats()["entries"]
        store.compact()
        took["compact_store"] = round(time.perf_counter() - began, 4)
        batches = spark.range(500 * 100).select(F.format_string("batch_%010d", "id").alias("key"), F.lpad(F.col("id").cast("string"), 100, "x").alias("value"), "id")
        apart = Store.open(spark, f"{folder}/batches", compaction_enabled=False)
        took["batch_write_500x100"] = timed(lambda: apart.write(batches, order_by="id"), 2)
        reads = V.appended(apart.log().limit(0), pairs, 0, F.col("id"))
        writes, reads = reads.where("seq % 10 >= 7"), reads.where("seq % 10 < 7").select("key", "epoch", "seq")
        took["mixed_70_reads_200k"] = timed(lambda: sink(V.read_at(writes, reads)), 2)
        keys = spark.range(50_000).select(F.format_string("key_%010d", F.pmod(F.xxhash64("id"), F.lit(n))).alias("key"))
        took["multi_get_50k"] = timed(lambda: sink(store.multi_get(keys)))
        every = spark.range(n).select(F.format_string("key_%010d", F.pmod(F.xxhash64("id"), F.lit(n))).alias("key"))
        took["multi_get_200k"] = timed(lambda: sink(store.multi_get(every)))
        many = Store.open(spark, f"{folder}/overlap", compaction_enabled=False)
        for _ in range(5):
            many.write(pairs.where("id < 20000"), order_by="id")
        slice_ = spark.createDataFrame([(f"key_{i * 400:010d}", f"key_{i * 400 + 50:010d}") for i in range(25)], "lo string, hi string")
        took["ranges_before_compaction"] = timed(lambda: sink(many.multi_scan(slice_)))
        took["get_before_compaction"] = timed(lambda: many.get("key_0000012345"))
        sizes = [many.stats()["bytes"]]
        many.compact()
        sizes.append(many.stats()["bytes"])
        took["ranges_after_compaction"] = timed(lambda: sink(many.multi_scan(slice_)))
        took["get_after_compaction"] = timed(lambda: many.get("key_0000012345"))
        starts = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(n - 500)).alias("s"))
        ranges = starts.select(F.format_string("key_%010d", "s").alias("lo"), F.format_string("key_%010d", F.col("s") + 100).alias("hi"))
        took["multi_scan_1000x100"] = timed(lambda: sink(store.multi_scan(ranges)))
        took["store_point_get"] = timed(lambda: store.get("key_0000012345"))
        rates = {"write_rows_s": n / took["write_200k"], "random_write_rows_s": n / took["random_write_200k"], "compact_rows_s": rows / took["compact_store"], "multi_get_keys_s": 50_000 / took["multi_get_50k"], "ranges_s": 1000 / took["multi_scan_1000x100"], "multi_get_200k_keys_s": n / took["multi_get_200k"], "batch_rows_s": 50_000 / took["batch_write_500x100"], "mixed_ops_s": n / took["mixed_70_reads_200k"], "compaction_space_saved_pct": 100 * (1 - sizes[1] / sizes[0])}
        queries |= took
        spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "rates": {k: round(v) for k, v in rates.items()}, "sf": os.path.basename(data.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
