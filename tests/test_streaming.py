from keystrata.schema import LOG
from keystrata.streaming.ingest import ingest, running_latest, tail


def test_ingest_restarts_where_it_was(spark, store, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    frame = lambda *rows: spark.createDataFrame(rows, "key string, value string, n long, gone boolean")
    frame(("a", "1", 0, False), ("b", "2", 1, False), ("a", "3", 2, False)).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("key string, value string, n long, gone boolean").parquet(source)
    ingest(store, stream(), "q", check, order_by="n", deleted="gone").awaitTermination()
    frame(("b", None, 3, True), ("c", "4", 4, False)).coalesce(1).write.mode("append").parquet(source)
    ingest(store, stream(), "q", check, order_by="n", deleted="gone").awaitTermination()
    assert store.get_range("", "z") == [("a", "3"), ("b", None), ("c", "4")]
    assert store.manifest().batches == {"q": 1}


def test_a_batch_that_runs_again_is_committed_once(spark, store):
    frame = spark.createDataFrame([("a", "1")], "key string, value string")
    assert store.write(frame, batch=("q", 0))
    assert not store.write(frame, batch=("q", 0))
    assert store.stats()["entries"] == 1


def test_running_latest(spark, log, tmp_path):
    log(("a", 0, 0, "1"), ("a", 1, 0, None), ("b", 0, 1, "2")).write.parquet(str(tmp_path / "log"))
    query = running_latest(spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("newest").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.key, r.data) for r in spark.table("newest").collect()) == [("a", None), ("b", "2")]


def drained(store, name, check):
    query = tail(store).writeStream.format("parquet").option("path", f"{check}/out").option("checkpointLocation", f"{check}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r.key, r.data or "") for r in store.spark.read.schema(LOG).parquet(f"{check}/out").collect())


def test_tail_follows_the_manifest(spark, store, tmp_path):
    store.put("a", "1")
    store.put("a", "2")
    store.files.create("runs/commit-of-a-writer-that-lost/part-0.parquet", "junk")
    assert drained(store, "t", tmp_path) == [("a", "1"), ("a", "2")]
    store.delete("a")
    store.put("b", "3")
    store.flush()
    store.compact()
    assert drained(store, "t", tmp_path) == [("a", ""), ("a", "1"), ("a", "2"), ("b", "3")]


def test_tail_behind_a_vacuum_fails(spark, store, tmp_path):
    store.put("a", "1")
    drained(store, "t", tmp_path)
    for i in range(3):
        store.put("b", str(i))
    store.vacuum(min_age_s=0)
    try:
        drained(store, "t", tmp_path)
    except Exception as error:
        assert "vacuum" in str(error)
    else:
        raise AssertionError("it should have failed")
