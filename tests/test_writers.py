"""Several writers and readers of one collection: fencing, order of waiting, rejects, tails, throttle."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from vexel.errors import SnapshotError
from vexel.operators import log as ops
from vexel.sources.snapshot import Collection, Files
from vexel.store import Reader, VectorStore
from vexel.streaming.fold import SnapshotFold


def frame(spark, rows):
    return spark.createDataFrame([(s, op, k, v, None) for s, op, k, v in rows], ops.LOG)


def names(df):
    return sorted(r.id for r in df.select("id").collect())


def stall(store):
    """The writer stops renewing, as if paused, and its lease runs out."""
    store._lease.stop()
    c = store._collection
    c.files.write(f"{c.path}/LEASE", f"{store._lease.token} {time.time() - 1}".encode())


def test_a_writer_that_wakes_too_late_changes_nothing(spark, tmp_path):
    a = VectorStore.open(spark, str(tmp_path), "c", 2)
    a.insert("a", [1, 0])
    a.flush()
    a.insert("kept", [1, 1])
    assert a.sync() == 2
    a.insert("lost", [0, 1])
    a._timer.cancel()  # paused before its window ends
    stall(a)
    b = VectorStore.open(spark, str(tmp_path), "c", 2)
    assert names(b.live()) == ["a", "kept"] and b._lease.epoch == a._lease.epoch + 1
    for act in (a.sync, a.flush, lambda: a._collection.publish(a.live(), 2, a.config, 9, epoch=a._lease.epoch)):
        with pytest.raises(SnapshotError):
            act()
    # even with its checks behind it: a pointer and a tail file of the earlier epoch do not count
    a._collection._point(a._lease.epoch, "v-none")
    a._collection.files.write(f"{a._collection.path}/tail/{a._lease.epoch:010d}-{2:019d}-{3:019d}.json", b'{"seq": 2, "op": "insert", "id": "lost", "vector": [0.0, 1.0]}')
    assert names(Reader(spark, str(tmp_path), "c").live()) == ["a", "kept"]
    b.insert("b", [0, 1])
    b.close()
    assert names(VectorStore.open(spark, str(tmp_path), "c", 2).live()) == ["a", "b", "kept"]


def test_waiting_writers_are_served_in_order(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "c")
    held, served = c.acquire(), []

    def wait(n):
        lease = Collection(spark, str(tmp_path), "c").acquire(timeout=60, every=0.05)
        served.append((n, lease.epoch))
        lease.release()

    threads = []
    for n in range(4):
        threads.append(threading.Thread(target=wait, args=(n,)))
        threads[-1].start()
        time.sleep(0.4)
    c.files.write(f"{c.path}/queue/{0:020d}-{'0' * 32}", str(time.time() - 1).encode())  # one that died waiting
    held.release()
    for t in threads:
        t.join()
    assert served == [(n, held.epoch + 1 + n) for n in range(4)]


def test_two_folds_and_rejected_rows(spark, tmp_path):
    first = SnapshotFold(spark, str(tmp_path), "f", 2, every=9)
    first(frame(spark, [(1, "insert", "a", [1.0, 0.0]), (2, "insert", "short", [1.0]), (3, "insert", "none", None), (4, "remove", "x", None)]), 0)
    assert sorted(tuple(r) for r in first.rejected().select("seq", "id", "got").collect()) == [(2, "short", 1), (3, "none", -1)]
    first.lease.stop()
    first.collection.files.write(f"{first.collection.path}/LEASE", f"{first.lease.token} {time.time() - 1}".encode())
    second = SnapshotFold(spark, str(tmp_path), "f", 2, every=9)
    second(frame(spark, [(5, "insert", "b", [0.0, 1.0])]), 1)
    with pytest.raises(SnapshotError):
        first(frame(spark, [(6, "insert", "late", [0.0, 1.0])]), 1)
    with pytest.raises(SnapshotError):
        first.publish()
    frame(spark, [(7, "insert", "later", [0.0, 1.0])]).write.parquet(f"{first.collection.path}/deltas/{first.lease.epoch:010d}-{2:012d}")
    assert names(second.rows()) == ["a", "b"]
    second.publish()
    assert names(second.rows()) == ["a", "b"] and names(second.rejected()) == ["none", "short"]
    second.close()


def test_readers_see_what_is_committed(spark, tmp_path):
    w = VectorStore.open(spark, str(tmp_path), "c", 2)
    r = Reader(spark, str(tmp_path), "c")
    assert len(r) == 0 and r.position == 0
    w.insert("a", [1, 0])
    w.insert("b", [float("nan"), 0.25])
    at = w.sync()
    assert w._collection.current() is None  # no snapshot yet
    assert r.refresh(at) == 2 and names(r.live()) == ["a", "b"] and [x.id for x in r.search([1, 0], 1).collect()] == ["a"]
    w.remove("a")
    w.insert_many(spark.createDataFrame([("c", [0.0, 1.0], 1), ("d", [1.0, 1.0], 2)], "id string, vector array<float>, n int"), "n")
    assert r.refresh(w.sync()) == 5 and names(r.live()) == ["b", "c", "d"]
    w.flush()
    assert Files(spark).names(f"{w._collection.path}/tail") == [] and r.refresh() == 5 and names(r.live()) == ["b", "c", "d"]
    w.clear()
    w.insert("e", [1, 0])
    assert r.refresh(w.sync()) == 7 and names(r.live()) == ["e"]
    with pytest.raises(TimeoutError):
        r.refresh(99, timeout=0.2)
    w._lease.stop()  # the writer dies without a snapshot
    stall(w)
    again = VectorStore.open(spark, str(tmp_path), "c", 2)
    assert names(again.live()) == ["e"] and again._next == 7
    again.compact()
    assert r.refresh() == 1 and names(r.live()) == ["e"]
    again.close()


def test_one_write_a_window(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("vexel.store.THROTTLE", 0.4)
    w = VectorStore.open(spark, str(tmp_path), "c", 2)
    began = time.monotonic()
    for i in range(300):
        w.insert(f"i{i}", [1, i])
    took = time.monotonic() - began
    time.sleep(0.9)
    files = Files(spark).names(f"{w._collection.path}/tail")
    assert 1 <= len(files) <= took / 0.4 + 2
    assert Reader(spark, str(tmp_path), "c").position == 300
    w.insert("last", [0, 0])
    w.close()
    assert len(Reader(spark, str(tmp_path), "c")) == 301


def test_held_rows_are_written_out_and_folded(spark, monkeypatch):
    monkeypatch.setattr("vexel.store.HELD", 10)
    monkeypatch.setattr("vexel.store.PARTS", 3)
    s = VectorStore(spark, 1)
    for i in range(65):
        s.insert(f"i{i % 7}", [i])
    assert len(s._rows) < 10 and s._parts <= 3
    assert sorted((r.id, r.seq) for r in s.live().collect()) == sorted((f"i{i % 7}", i) for i in range(58, 65))
    s.insert_many(spark.createDataFrame([("z", [1.0])], "id string, vector array<float>").withColumn("n", F.lit(1)), "n")
    assert len(s) == 8 and s._next == 66
