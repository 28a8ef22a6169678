"""A stream of log rows folded into published snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vexel.config import Config
from vexel.operators import log as ops
from vexel.sources.snapshot import Collection, Lease
from vexel.sources.tail import adopt, counted

COLUMNS = ("seq", "op", "id", "vector", "text")
#: Time between two writes of a running stream, and batches after which their deltas become a snapshot.
THROTTLE, EVERY = "250 milliseconds", 16


class SnapshotFold:
    """``foreachBatch`` sink: each batch is written as a delta (last operation on each id, last clear); now and then
    all deltas and the published snapshot make the next snapshot.

    Rows may arrive in any order, within a batch and across batches: what is kept of the past is the last operation on
    each id, removes too, with its ``seq``, and the last clear's ``seq``; so whatever the order the greatest ``seq``
    decides. A batch that is replayed after a failure overwrites its own delta, or is skipped if a snapshot holds it.
    Inserts of a wrong length are written beside the delta (``rejected``).

    The sink holds the collection's lease from its first batch until ``close``; deltas carry its epoch. If another sink
    takes the collection over, it adopts the deltas that are there, and what this one writes afterwards fails and does
    not count.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, dims: int, config: Config | None = None, every: int = EVERY):
        self.collection, self.dims, self.config, self.spark, self.every = Collection(spark, root, name), dims, config or Config(), spark, every
        self.lease: Lease | None = None

    def _own(self) -> int:
        """The epoch under which this sink writes."""
        if self.lease is None:
            self.lease = self.collection.acquire()
            adopt(self.collection, self.lease.epoch, "deltas")
        return self.lease.epoch

    def _deltas(self, after: int) -> dict[int, str]:
        """The folders of the batches since ``after``; of one that two epochs wrote, the later."""
        at, out = f"{self.collection.path}/deltas", {}
        for name in counted(self.collection, "deltas"):
            epoch, _, batch = name.partition("-")
            if int(batch) > after:
                out[int(batch)] = f"{at}/{name}"
        return out

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        epoch = self._own()
        found = self.collection.load()
        if found and batch_id <= found[1].upto:
            return
        valid, bad = ops.quarantine(batch.where(F.col("op") == ops.INSERT), self.dims)
        log = valid.unionByName(batch.where(F.col("op") != ops.INSERT)).select(*COLUMNS)
        self.collection.confirm(epoch)
        bad.select(*COLUMNS, "got").write.mode("overwrite").parquet(f"{self.collection.path}/rejected/{batch_id:012d}")
        ops.last_operations(log).write.mode("overwrite").parquet(f"{self.collection.path}/deltas/{epoch:010d}-{batch_id:012d}")
        self.collection.confirm(epoch)
        if len(self._deltas(found[1].upto if found else -1)) >= self.every:
            self.publish()

    def rejected(self) -> DataFrame:
        """Inserts of a wrong length with the length they had (``got``), of all batches so far."""
        at = f"{self.collection.path}/rejected"
        found = [f"{at}/{n}" for n in self.collection.files.names(at) if n.isdigit()]
        schema = f"{ops.LOG}, got int"
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def close(self) -> None:
        if self.lease is not None:
            self.lease.release()
            self.lease = None

    def _log(self) -> tuple[DataFrame, int, int, list[str]]:
        """The kept operations of the snapshot and of later deltas; the next seq, the last batch, the deltas."""
        found = self.collection.load()
        log, top, upto = self.spark.createDataFrame([], ops.LOG), -1, -1
        if found:
            rows, m = found
            top, upto = m.next_seq - 1, m.upto
            log = rows.select("seq", F.lit(ops.INSERT).alias("op"), "id", "vector", "text")
            gone = self.collection.removed().select("seq", F.lit(ops.REMOVE).alias("op"), "id")
            log = log.unionByName(gone, allowMissingColumns=True)
            if m.clear >= 0:
                log = log.unionByName(self.spark.createDataFrame([(m.clear, ops.CLEAR)], "seq long, op string"), allowMissingColumns=True)
        new = self._deltas(upto)
        if new:
            log = log.unionByName(self.spark.read.schema(ops.LOG).parquet(*new.values()))
        return log, top + 1, max([upto, *new]), list(new.values())

    def publish(self) -> None:
        """Makes the deltas since the last snapshot a part of the next one. Deltas go after the pointer has moved."""
        epoch = self._own()
        log, start, upto, deltas = self._log()
        last, clear = log.agg(F.max("seq"), F.max(F.when(F.col("op") == ops.CLEAR, F.col("seq")))).first()
        gone = ops.latest(log).where("not inserted").select("id", "seq")
        self.collection.publish(ops.live(log), self.dims, self.config, max(start, -1 if last is None else last + 1), gone, -1 if clear is None else clear, upto, epoch)
        for d in deltas:
            self.collection.files.delete(d)

    def start(self, stream: DataFrame, checkpoint: str, interval: str | None = None) -> StreamingQuery:
        """Runs over what is available."""
        w = stream.select(*COLUMNS).writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()

    def follow(self, stream: DataFrame, checkpoint: str, interval: str = THROTTLE) -> StreamingQuery:
        """Runs on; ``interval`` is the least time between two writes."""
        return self.start(stream, checkpoint, interval)

    def rows(self) -> DataFrame:
        """Live rows: the published snapshot with the deltas since."""
        return ops.live(self._log()[0])


def dedupe_stream(requests: DataFrame, delay: str, time_col: str = "ts") -> DataFrame:
    """Drops repeated ``req_id`` within a watermark, which bounds the state."""
    return requests.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["req_id"])
