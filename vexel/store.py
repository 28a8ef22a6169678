"""A collection of vectors keyed by string id, and a text collection on top of it."""

from __future__ import annotations

import re
import threading
import time
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.config import Config
from vexel.errors import DimensionMismatchError, SnapshotError
from vexel.functions.distance import score
from vexel.functions.embedding import Embedder
from vexel.operators import log as ops
from vexel.operators import search
from vexel.sources.folders import new_folder, shared_folder
from vexel.sources.snapshot import Collection, Lease, read_snapshot, write_snapshot
from vexel.sources.tail import TAIL, Tail, adopt

AUTO = re.compile(r"^auto-(\d+)$")
#: Request ids whose results are remembered, oldest first out.
REMEMBERED = 256
#: Seconds between two writes of a named collection, at least; rows that the driver holds before they are written out; and
#: such parts before the log is folded.
THROTTLE, HELD, PARTS = 0.25, 5000, 16


class VectorStore:
    """Mutations append to a log; every read is a plan over its live rows. The driver is the single writer.

    Single operations gather in the driver, HELD rows at most, and are then written to the shared folder as a part of the
    log; the log of PARTS such parts is folded to its last operations. In a named collection operations are committed to
    its tail in the background, one file for all of THROTTLE seconds, or at once by ``sync``; other sessions read them
    there (``Reader``), and ``flush`` makes a snapshot of them.
    """

    def __init__(self, spark: SparkSession, dims: int, config: Config | None = None):
        if int(dims) < 0:
            raise ValueError("dims must not be negative")
        self.spark, self._dims, self._config = spark, int(dims), config or Config()
        self._base: DataFrame | None = None
        self._rows: list[tuple] = []
        self._next = 0
        self._collection: Collection | None = None
        self._lease: Lease | None = None
        self._dirty = False
        self._parts = 0
        self._sent = 0  # of _rows, how many the tail has
        self._lock = threading.RLock()
        self._timer: threading.Timer | None = None
        self._failed: Exception | None = None

    @classmethod
    def create(cls, spark: SparkSession, dims: int) -> VectorStore:
        return cls(spark, dims)

    @classmethod
    def with_config(cls, spark: SparkSession, dims: int, config: Config) -> VectorStore:
        return cls(spark, dims, config)

    @property
    def dims(self) -> int:
        return self._dims

    @property
    def config(self) -> Config:
        return self._config

    # the log

    def log(self) -> DataFrame:
        new = self.spark.createDataFrame(self._rows, ops.LOG)
        return new if self._base is None else self._base.unionByName(new)

    def live(self) -> DataFrame:
        return ops.live(self.log())

    def _append(self, op: str, id: str | None = None, vector=None, text: str | None = None) -> None:
        with self._lock:
            if self._failed is not None:
                raise SnapshotError(f"an earlier write failed: {self._failed}") from self._failed
            self._rows.append((self._next, op, id, vector, text))
            self._next += 1
            self._dirty = True
            if self._collection is not None and self._timer is None:
                self._timer = threading.Timer(THROTTLE, self._tick)
                self._timer.daemon = True
                self._timer.start()
            if len(self._rows) >= HELD:
                self._spill()

    def _tick(self) -> None:
        try:
            self.sync()
        except Exception as e:  # told at the next operation
            self._failed = e

    def sync(self) -> int:
        """Commits what is not yet committed; returns the position up to which every reader now sees this store's
        operations. SnapshotError if another writer has taken the collection over."""
        with self._lock:
            if self._timer is not None:
                self._timer.cancel()
                self._timer = None
            if self._collection is not None and self._sent < len(self._rows):
                if self._lease is None:
                    raise SnapshotError("this store no longer holds the collection")
                Tail(self._collection).append(self._lease.epoch, self._rows[self._sent :])
                self._sent = len(self._rows)
            return self._next

    def _spill(self) -> None:
        """The held rows become a part of the log in the shared folder; many parts become one of last operations."""
        self.sync()
        at = new_folder(self.spark)
        self.spark.createDataFrame(self._rows, ops.LOG).write.parquet(at)
        part = self.spark.read.schema(ops.LOG).parquet(at)
        self._grow(part)
        self._rows, self._sent = [], 0

    def _grow(self, part: DataFrame) -> None:
        self._base = part if self._base is None else self._base.unionByName(part)
        self._parts += 1
        if self._parts >= PARTS:
            at = new_folder(self.spark)
            ops.last_operations(self._base).write.parquet(at)
            self._base, self._parts = self.spark.read.schema(ops.LOG).parquet(at), 1

    def insert(self, id: str, vector: list[float], text: str | None = None) -> None:
        """Upsert; the id moves to the end of the insertion order. A rejected vector changes nothing."""
        v = [float(x) for x in vector]
        if len(v) != self._dims:
            raise DimensionMismatchError(self._dims, len(v))
        self._append(ops.INSERT, str(id), v, text)

    def insert_many(self, rows: DataFrame, order: str, strict: bool = True) -> DataFrame | None:
        """Upserts ``rows(id, vector[, text])`` in the order of a numeric column, without passing through the driver.

        strict: all or nothing, raising on a wrong length; else valid rows are taken and the others returned.
        """
        if strict:
            ops.require_dimensions(rows, self._dims)
            good, bad = rows, None
        else:
            good, bad = ops.quarantine(rows, self._dims)
        full = good if "text" in good.columns else good.withColumn("text", F.lit(None).cast("string"))
        new = ops.numbered(full, order, "seq", self._next).select("seq", F.lit(ops.INSERT).alias("op"), F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), "text")
        with self._lock:
            if self._rows:
                self._spill()
            n = good.count()
            end = self._next + n
            if self._collection is not None and self._lease is not None:
                part = Tail(self._collection).append_frame(self._lease.epoch, new, self._next, end)
            else:
                at = new_folder(self.spark)
                new.write.parquet(at)
                part = self.spark.read.schema(ops.LOG).parquet(at)
            self._grow(part)
            self._next = end
            self._dirty = self._dirty or n > 0
        return bad

    def remove(self, id: str) -> bool:
        """True if a live entry was there."""
        had = self.contains(id)
        if had:
            self._append(ops.REMOVE, str(id))
        return had

    def clear(self) -> None:
        with self._lock:
            self._append(ops.CLEAR)
            if self._collection is None:
                self._base, self._rows, self._parts = None, [], 0

    def compact(self) -> None:
        """Rewrites the log as its live rows, renumbered in insertion order; a named collection is published before, so
        that its tail is empty, and after. Positions start anew with the numbers."""
        shared_folder(self.spark)
        with self._lock:
            self.flush()
            kept = ops.compact(self.log()).select("seq", "op", "id", "vector", "text")
            n = len(self)
            self._base, self._rows, self._sent, self._parts, self._next = kept.checkpoint(), [], 0, 1, n
            self._dirty = True
            if self._collection is not None:
                self._publish()

    def contains(self, id: str) -> bool:
        last = ops.latest(self.log().where((F.col("id") == str(id)) | (F.col("op") == ops.CLEAR)))
        return bool(last.where("inserted").limit(1).collect())

    def __contains__(self, id: str) -> bool:
        return self.contains(id)

    def __len__(self) -> int:
        return ops.live_count(self.log()).first()["live"]

    def is_empty(self) -> bool:
        return len(self) == 0

    # search

    def search(self, vector: list[float], k: int) -> DataFrame:
        """``id, seq, distance, rank``; exactly min(k, live) rows."""
        return search.knn(self.live().drop("text"), [float(x) for x in vector], k, self._config.metric, self._dims)

    def search_batch(self, queries: DataFrame, k: int, kernel: str = "native") -> DataFrame:
        ops.require_dimensions(queries, self._dims)
        run = {"native": search.knn_batch, "arrow": search.knn_batch_arrow}[kernel]
        return run(self.live(), queries, k, self._config.metric)

    # snapshots

    def save(self, path: str) -> None:
        write_snapshot(self.live(), path, self._dims, self._config, self._next)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorStore:
        rows, m = read_snapshot(spark, path)
        got = cls(spark, m.dims, m.config)
        got._restore(rows, m.next_seq)
        return got

    def _restore(self, rows: DataFrame, next_seq: int) -> None:
        self._base = rows.select("seq", F.lit(ops.INSERT).alias("op"), "id", "vector", "text")
        self._next, self._dirty = next_seq, False

    @classmethod
    def open(cls, spark: SparkSession, root: str, name: str, dims: int, config: Config | None = None, persist: bool = True, timeout: float = 30.0, fallback: bool = False) -> VectorStore:
        """The named collection: its published snapshot, or an empty one; as its only writer until ``close``.

        ``persist=False`` keeps everything in the session; so does ``fallback`` where another writer holds the
        collection beyond ``timeout`` (``persistent`` tells).
        """
        got = cls(spark, dims, config)
        if persist:
            collection = Collection(spark, root, name)
            try:
                got._lease = collection.acquire(timeout)
                adopt(collection, got._lease.epoch, TAIL)
            except TimeoutError:
                if not fallback:
                    raise
                return got
            got._collection = collection
            try:
                found = got._collection.load()
                if found:
                    rows, m = found
                    got._dims, got._config = m.dims, m.config
                    got._restore(rows, m.next_seq)
                left, end = Tail(got._collection).read(got._next)
            except Exception:
                got._lease.release()
                raise
            if left is not None:  # committed, and not in a snapshot yet
                got._grow(left)
                got._next, got._dirty = end, True
        return got

    @property
    def persistent(self) -> bool:
        return self._collection is not None

    def flush(self) -> bool:
        """Publishes a snapshot if anything changed; SnapshotError if another writer has taken the collection over."""
        with self._lock:
            if self._collection is None or not self._dirty:
                return False
            if self._lease is None:
                raise SnapshotError("this store no longer holds the collection")
            self.sync()
            self._publish()
            return True

    def _publish(self) -> None:
        self._collection.publish(self.live(), self._dims, self._config, self._next, epoch=self._lease.epoch)
        self._restore(*(lambda r: (r[0], r[1].next_seq))(self._collection.load()))
        self._rows, self._sent, self._parts = [], 0, 1
        Tail(self._collection).trim(self._next)

    def close(self) -> None:
        self.flush()
        if self._collection is not None and self._lease is not None:
            self._lease.release()
            self._lease = None


class Reader:
    """A named collection as another session sees it: the published snapshot with what its writer has committed since."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.collection = spark, Collection(spark, root, name)
        self.refresh()

    def refresh(self, at_least: int | None = None, timeout: float = 30.0, every: float = 0.1) -> int:
        """Reads anew; returns the position up to which operations are seen. ``at_least``: waits for that position, which
        a writer's ``sync`` has told, and raises TimeoutError if it does not come."""
        until = time.monotonic() + timeout
        while True:
            found = self.collection.load()
            self.config = found[1].config if found else Config()
            start = found[1].next_seq if found else 0
            tail, self.position = Tail(self.collection).read(start)
            if at_least is None or self.position >= at_least:
                break
            if time.monotonic() >= until:
                raise TimeoutError(f"position {at_least} of {self.collection.path} is not committed")
            time.sleep(every)
        log = self.spark.createDataFrame([], ops.LOG)
        if found:
            log = found[0].select("seq", F.lit(ops.INSERT).alias("op"), "id", "vector", "text")
        self._log = log if tail is None else log.unionByName(tail)
        return self.position

    def live(self) -> DataFrame:
        return ops.live(self._log)

    def search(self, vector: list[float], k: int) -> DataFrame:
        return search.knn(self.live().drop("text"), [float(x) for x in vector], k, self.config.metric)

    def __len__(self) -> int:
        return ops.live_count(self._log).first()["live"]


class TextStore:
    """Texts embedded and searched; ids are given or ``auto-N``."""

    def __init__(self, store: VectorStore, embedder: Embedder):
        if embedder.dims != store.dims:
            raise DimensionMismatchError(store.dims, embedder.dims)
        self.store, self.embedder = store, embedder
        self._auto = next_auto(store.live()) if store._base is not None else 0
        self._done: OrderedDict[str, object] = OrderedDict()

    @classmethod
    def create(cls, spark: SparkSession, embedder: Embedder, config: Config | None = None) -> TextStore:
        return cls(VectorStore(spark, embedder.dims, config), embedder)

    @classmethod
    def open(cls, spark: SparkSession, root: str, name: str, embedder: Embedder, config: Config | None = None, persist: bool = True, timeout: float = 30.0, fallback: bool = True) -> TextStore:
        """The named collection with its texts, in one call; in the session only where another writer keeps it."""
        return cls(VectorStore.open(spark, root, name, embedder.dims, config, persist, timeout, fallback), embedder)

    def _embed(self, text: str) -> list[float]:
        row = self.store.spark.createDataFrame([(text,)], "text string").select(self.embedder.embed(F.col("text")).alias("v")).first()
        return list(row.v)

    def _once(self, request: str | None, run):
        """Results of requests are remembered, so that a retry with the same id doesn't apply again; failures are not."""
        if request is not None and request in self._done:
            return self._done[request]
        got = run()
        if request is not None:
            self._done[request] = got
            while len(self._done) > REMEMBERED:
                self._done.popitem(last=False)
        return got

    def insert(self, text: str, id: str | None = None, request: str | None = None) -> str:
        def run() -> str:
            name = id
            if name is None:
                name = f"auto-{self._auto}"
                self._auto += 1  # a failed embedding uses its number up
            self.store.insert(name, self._embed(text), text)
            return name

        return self._once(request, run)

    def insert_many(self, rows: DataFrame, order: str) -> None:
        """``rows(id, text)``; null ids are numbered on from the store's counter in the order of a numeric column."""
        ready = ingest(rows, self.embedder, order, self._auto)
        self._auto += rows.where("id is null").count()
        self.store.insert_many(ready, order)

    def query(self, text: str, k: int = 5) -> list[dict]:
        v = self._embed(text)
        hits = search.knn(self.store.live(), v, k, self.store.config.metric, self.store.dims)
        return [r.asDict() for r in hits.orderBy("rank").select("id", "text", score(F.col("distance")).alias("score")).collect()]

    def remove(self, id: str, request: str | None = None) -> bool:
        return self._once(request, lambda: self.store.remove(id))

    def size(self) -> int:
        return len(self.store)

    def snapshot(self, path: str) -> None:
        self.store.save(path)

    def flush(self) -> bool:
        return self.store.flush()

    def close(self) -> None:
        self.store.close()


def next_auto(rows: DataFrame) -> int:
    """One more than the largest live ``auto-N``; 0 without any."""
    n = F.regexp_extract("id", r"^auto-(\d+)$", 1)
    top = rows.select(F.max(F.when(n != "", n.cast("long"))).alias("n")).first()
    return 0 if top is None or top.n is None else top.n + 1


def with_auto_ids(rows: DataFrame, order: str, start: int = 0) -> DataFrame:
    """Null ids become ``auto-N`` from ``start`` in order; given ids stay."""
    named = rows.where("id is not null")
    new = ops.numbered(rows.where("id is null"), order, "__n", start)
    return named.unionByName(new.withColumn("id", F.concat(F.lit("auto-"), F.col("__n").cast("string"))).drop("__n"))


def ingest(rows: DataFrame, embedder: Embedder, order: str, start: int = 0) -> DataFrame:
    return with_auto_ids(rows, order, start).withColumn("vector", embedder.embed(F.col("text")))
