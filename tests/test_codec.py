import io
from datetime import datetime

import pytest
from pyspark.errors import PySparkException

from keystrata.operators import versions as V
from keystrata.sources import binary
from keystrata.sources.codec import TableFile, Version, WALCorruptionError, next_seq, pack_entry, pack_value, read_wal, unpack_entry, unpack_value, write_table
from tests.conftest import rows

TS = datetime(2024, 1, 2, 3, 4, 5, 678)


def entries(n):
    return [Version(f"key{i}", f"val{i}", 0, TS, i) for i in range(n)]


def test_value_layout():
    packed = pack_value(Version("k", "data", 0, TS))
    stamp = b"2024-01-02T03:04:05.000678"
    assert packed == b"\x00" + len(stamp).to_bytes(4, "big") + stamp + b"\x00\x00\x00\x04data"
    assert len(pack_value(Version("k", None, 1, TS))) == 35


@pytest.mark.parametrize("version", [Version("키🔑", "値💎", 0, TS, 7), Version("", "", 0, TS), Version("k", None, 1, TS, 2**40)])
def test_round_trips(version):
    assert unpack_entry(pack_entry(version)) == version
    assert unpack_value(version.key, pack_value(version), version.seq) == version


def test_wal_reads_back_and_goes_on():
    data = binary.wal_bytes(entries(10))
    assert list(read_wal(io.BytesIO(data))) == entries(10)
    assert next_seq(io.BytesIO(data)) == 10 and next_seq(io.BytesIO(b"")) == 0


@pytest.mark.parametrize("cut", [1, 2, 4, 5, 30])
def test_torn_tail_ends_quietly(cut):
    data = binary.wal_bytes(entries(3))
    assert list(read_wal(io.BytesIO(data[:-cut]))) == entries(2)


def test_damage_is_reported_with_its_offset():
    one = len(binary.wal_bytes(entries(1)))
    data = bytearray(binary.wal_bytes(entries(3)))
    data[one + 10] ^= 0xFF
    found = read_wal(io.BytesIO(bytes(data)))
    assert next(found) == entries(1)[0]
    with pytest.raises(WALCorruptionError, match=f"WAL corruption detected at offset {one}: expected CRC32 0x[0-9a-f]{{8}}, got 0x[0-9a-f]{{8}}") as caught:
        next(found)
    assert caught.value.entry_offset == one and caught.value.expected != caught.value.actual


def table(versions):
    data = binary.table_bytes(versions)
    return TableFile(io.BytesIO(data), len(data))


def test_table_reads():
    t = table([Version(f"key{i:05d}", None if i == 9995 else str(i), int(i == 9995), TS) for i in range(10_000)])
    assert [v.key for v in t.scan("key09990", "key10000")] == [f"key{i:05d}" for i in range(9990, 10_000)]
    assert t.get("key00005").data == "5" and t.get("nope") is None
    assert t.get("key09995").vtype == 1 and t.has("key09995") and not t.has("x")
    assert t.has_keys_in_range("key09999", "z") and not t.has_keys_in_range("l", "z")
    assert sum(1 for _ in t.scan()) == 10_000


def test_empty_table():
    t = table([])
    assert not t.has("a") and list(t.scan()) == []


def test_table_wants_ascending_keys():
    with pytest.raises(ValueError, match="ascend"):
        write_table(io.BytesIO(), [Version("b", "", 0, TS), Version("a", "", 0, TS)])


def test_sources(spark, tmp_path):
    binary.register(spark)
    (tmp_path / "wal_0.wal").write_bytes(binary.wal_bytes([Version("a", "1", 0, TS, 0), Version("b", "2", 0, TS, 1)]))
    (tmp_path / "wal_1.wal").write_bytes(binary.wal_bytes([Version("a", None, 1, TS, 0)]))
    (tmp_path / "2.sst").write_bytes(binary.table_bytes([Version("b", "3", 0, TS), Version("c", "", 0, TS)]))
    (tmp_path / "3.sst.tmp").write_bytes(b"junk")
    log = spark.read.format("wal").load(str(tmp_path)).unionByName(spark.read.format("sst").load(f"file://{tmp_path}"))
    assert rows(V.scan(log)) == [("a", None), ("b", "3"), ("c", "")]
    assert rows(V.scan(log, "b", "c")) == [("b", "3")]
    assert rows(V.get(log, "c")) == [("c", "")]


@pytest.fixture(params=["false", "true"])
def pushdown(spark, request):
    setting = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, request.param)
    yield request.param
    spark.conf.set(setting, before)


def test_sources_read_whether_or_not_a_session_pushes_filters(spark, tmp_path, pushdown):
    versions = [Version(k, k, 0, TS, i) for i, k in enumerate(["a", "b", "b\0", "c"])]
    (tmp_path / "0.wal").write_bytes(binary.wal_bytes(versions))
    (tmp_path / "0.sst").write_bytes(binary.table_bytes(versions))
    binary.register(spark)
    for kind in ("wal", "sst"):
        log = spark.read.format(kind).option("pushdown", pushdown).load(str(tmp_path))
        for wanted, keys in (("true", "a,b,b\0,c"), ("key = 'b'", "b"), ("key > 'b'", "b\0,c"), ("key >= 'b'", "b,b\0,c"), ("key < 'b'", "a"), ("key <= 'b'", "a,b")):
            assert ",".join(sorted(r.key for r in log.where(wanted).collect())) == keys


def test_sources_read_a_range(spark, tmp_path, pushdown):
    versions = [Version(k, k, 0, TS, i) for i, k in enumerate(["a", "b", "b\0", "c"])]
    (tmp_path / "0.wal").write_bytes(binary.wal_bytes(versions))
    (tmp_path / "0.sst").write_bytes(binary.table_bytes(versions))
    for kind in ("wal", "sst"):
        for bounds, keys in (((), "a,b,b\0,c"), (("b", "c"), "b,b\0"), (("b\0",), "b\0,c"), ((None, "b"), "a"), (("c", "a"), "")):
            assert ",".join(sorted(r.key for r in binary.load(spark, kind, str(tmp_path), *bounds).collect())) == keys


def test_source_raises_on_damage(spark, tmp_path):
    binary.register(spark)
    data = bytearray(binary.wal_bytes(entries(2)))
    data[10] ^= 1
    (tmp_path / "wal_0.wal").write_bytes(bytes(data))
    with pytest.raises(PySparkException, match="corruption detected at offset 0"):
        spark.read.format("wal").load(str(tmp_path)).collect()


def test_life_of_a_wal_file(tmp_path):
    from keystrata.sources.wal_file import WalFile

    wal = WalFile(str(tmp_path / "wal_0.wal"))
    with pytest.raises(RuntimeError, match="not open"):
        wal.append(entries(1)[0])
    with wal:
        wal.batch_append(entries(10))
        assert wal.seq == 10
    with open(wal.path, "ab") as torn:
        torn.write(b"\0\0")
    with WalFile(wal.path, 1000) as again:
        assert again.seq == 10
        again.append(Version("more", "", 0, TS, again.seq))
        assert [v.key for v in again][-1] == "more" and len(list(again)) == 11
        again.mark_read_only()
        with pytest.raises(RuntimeError, match="read-only"):
            again.append(entries(1)[0])
        again.destroy()
    assert list(again) == []
    with pytest.raises(ValueError, match="sync interval"):
        WalFile("x", 10_001)


def test_a_folder_of_files_is_adopted(spark, tmp_path, store):
    from keystrata.sources.migrate import read_folder

    for sub in ("wal", "sstables"):
        (tmp_path / sub).mkdir()
    (tmp_path / "sstables/1.sst").write_bytes(binary.table_bytes([Version("a", "old", 0, TS), Version("b", "2", 0, TS)]))
    (tmp_path / "sstables/10.sst").write_bytes(binary.table_bytes([Version("a", "newer", 0, TS)]))
    (tmp_path / "sstables/999.sst.tmp").write_bytes(b"junk")
    (tmp_path / "wal/wal_3.wal").write_bytes(binary.wal_bytes([Version("b", None, 1, TS, 0), Version("c", "3", 0, TS, 1)]))
    store.append_log(read_folder(spark, str(tmp_path)))
    assert store.get_range("", "z") == [("a", "newer"), ("b", None), ("c", "3")]
    assert read_folder(spark, str(tmp_path / "nothing")).count() == 0


class _Counted(io.BytesIO):
    reads = 0

    def read(self, *size):
        self.reads += 1
        return super().read(*size)


def test_a_scan_of_a_table_reads_blocks():
    """Four reads for each entry make many small tables slow."""
    stream = _Counted()
    write_table(stream, [Version(f"key{i:05d}", None if i % 7 == 0 else "x" * (i % 50), int(i % 7 == 0), TS) for i in range(10_000)])
    t = TableFile(stream, stream.tell())
    before = stream.reads
    assert [(v.key, v.data) for v in t.scan()] == [(f"key{i:05d}", None if i % 7 == 0 else "x" * (i % 50)) for i in range(10_000)]
    assert stream.reads - before < 20


def test_records_that_cross_blocks_and_records_longer_than_one(monkeypatch):
    monkeypatch.setattr(TableFile, "BLOCK", 64)
    versions = [Version(f"k{i:03d}", "é" * (i * 37 % 200), 0, TS) for i in range(100)]
    t = table(versions)
    assert list(t.scan()) == versions
    assert [t.get(v.key) for v in reversed(versions)] == versions[::-1]


def test_small_files_share_partitions(spark, tmp_path):
    """A partition for each file costs a task each; rows keep the epoch of their own file."""
    for i in range(300):
        for kind, made in (("wal", binary.wal_bytes), ("sst", binary.table_bytes)):
            (tmp_path / f"{i}.{kind}").write_bytes(made([Version("a", str(i), 0, TS), Version(f"k{i:03d}", None, 1, TS)] if i else []))
    for kind, reader in (("wal", binary.WalReader), ("sst", binary.TableReader)):
        dealt = [p.value for p in reader({"path": str(tmp_path)}).partitions()]
        assert len(dealt) < 25 and [e for files in dealt for e, _ in files] == list(range(300))
        log = binary.load(spark, kind, str(tmp_path))
        assert sorted((r.key, r.epoch, r.data) for r in log.collect()) == sorted(x for i in range(1, 300) for x in [("a", i, str(i)), (f"k{i:03d}", i, None)])
        assert rows(V.get(log, "a")) == [("a", "299")]


def test_large_files_have_partitions_of_their_own(tmp_path, monkeypatch):
    for name, value in (("LEAST", 100), ("PARTITION", 100), ("OPENED", 0)):
        monkeypatch.setattr(binary, name, value)
    for i, size in enumerate((250, 60, 40, 1, 120, 30)):
        (tmp_path / f"{i}.sst").write_bytes(b"x" * size)
    named = ",".join(str(tmp_path / f"{i}.sst") for i in (5, 3, 4, 0, 1, 2))
    for paths in (str(tmp_path), named, f"file://{tmp_path}"):
        assert [[e for e, _ in p.value] for p in binary.TableReader({"path": paths}).partitions()] == [[0], [1, 2], [3], [4], [5]]


def test_null_is_not_the_empty_string(spark, tmp_path):
    versions = [Version(None, "no key", 0, TS), Version("", "", 0, TS), Version("a", None, 0, TS), Version("b", None, 1, TS)]
    t = table(versions)
    assert list(t.scan()) == versions and t.keys == ["", "a", "b"]
    assert [v.key for v in t.scan("")] == ["", "a", "b"] and [v.key for v in t.scan(None, "b")] == ["", "a"]
    with pytest.raises(ValueError, match="ascend"):
        write_table(io.BytesIO(), [Version("a", "", 0, TS), Version(None, "", 0, TS)])
    (tmp_path / "1.sst").write_bytes(binary.table_bytes(versions))
    (tmp_path / "2.wal").write_bytes(binary.wal_bytes(versions))
    for kind in ("sst", "wal"):
        assert [(r.key, r.data) for r in binary.load(spark, kind, str(tmp_path)).collect()] == [(None, "no key"), ("", ""), ("a", None), ("b", None)]
        assert [r.key for r in binary.load(spark, kind, str(tmp_path), "").collect()] == ["", "a", "b"]


def test_epochs_below_zero_and_no_epoch(tmp_path):
    for name in ("none", "-00002", "-00001", "000000", "1000000", "999999", "wal-3"):
        (tmp_path / f"{name}.sst").write_bytes(b"")
    assert [epoch for epoch, _ in binary.discover(str(tmp_path), ".sst")] == [None, -2, -1, 0, 3, 999_999, 1_000_000]


def test_a_folder_without_files_is_an_empty_log(spark, tmp_path):
    for kind in ("sst", "wal"):
        assert binary.load(spark, kind, str(tmp_path)).collect() == []


def test_logs_hold_numbers_below_zero_and_rows_without_one():
    versions = [Version("a", "1", 0, TS, -(2**63)), Version("b", None, 1, TS, None), Version(None, None, 0, TS, None), Version("c", "", 0, TS, -1)]
    data = binary.wal_bytes(versions)
    assert list(read_wal(io.BytesIO(data))) == versions
    assert list(read_wal(io.BytesIO(data[:-1]))) == versions[:-1]
    assert next_seq(io.BytesIO(data)) == 0 and next_seq(io.BytesIO(binary.wal_bytes([*versions, Version("d", "", 0, TS, 4)]))) == 5
