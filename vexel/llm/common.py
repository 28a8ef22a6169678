"""What the operators share: scratch tables, Arrow plumbing, numbering, components."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than these six.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
#: Arrow batches handed to Python are kept below this, whatever the length of texts.
BATCH_BYTES = 8 << 20
#: Ids up to this number (some 16 bytes each in a hash table) may go to every task; more are met by a shuffled join.
SENT = 2_000_000
_shipped: set[str] = set()
_made: list[tuple[str, str]] = []


def prepare(spark: SparkSession) -> None:
    """Once per application: let executors import this package, and bound Arrow batches.

    The package is sent with ``addPyFile`` because executors need not share the driver's folders.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), f"vexel_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset (tests) a temporary one."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
        if not at:
            at = tempfile.mkdtemp(prefix="vexel-")
            spark.sparkContext.setCheckpointDir(at)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/vexel/{label}-{uuid.uuid4().hex}"


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, columns stay prunable."""
    spark = df.sparkSession
    at = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(at)
    _made.append((spark.sparkContext.applicationId, at))
    return spark.read.schema(df.schema).parquet(at)


def made(spark: SparkSession) -> list[str]:
    """Scratch tables of this application, in the order of writing."""
    return [at for app, at in _made if app == spark.sparkContext.applicationId]


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made[:] = [x for x in _made if x[1] != path]


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint`` to the shared folder; Spark removes the files when the plan is garbage."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffles and checkpoints of plans that nobody holds any more.

    It acts when the driver collects garbage, which a driver with little to do seldom does, so that files pile up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def picked(rows: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``on`` is (``left_semi``) or is not (``left_anti``) in ``ids(on)``, a written table.

    Few ids go to every task, and the rows, with whole texts, stay where they are; more than SENT meet them in a shuffle.
    """
    few = ids.limit(SENT + 1).count() <= SENT
    return rows.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), on, how)


def arrow(df: DataFrame, schema: str, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(each, schema)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def offsets_by_part(df: DataFrame, order: list, label: str, size: str | None = None, n: int | None = None) -> DataFrame:
    """``df`` range-sorted by ``order`` with ``__part``, ``__row`` (place in the partition), materialised.

    Needs ``order`` to end in something unique for a reproducible result. No step gathers all rows in a task.
    """
    n = n or parts(df.sparkSession)
    dealt = df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    return table(dealt.sortWithinPartitions(*order), label)


def running_total(df: DataFrame, order: list, value: str, out: str, label: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one in ``order``, without a one-task window.

    Rows are range-partitioned, summed in each partition, and the (partitions many) partition totals carried over;
    these totals are bounded by the number of shuffle partitions, so they may go through the driver.
    """
    spark = df.sparkSession
    dealt = offsets_by_part(df, order, label)
    sums = {r[0]: r[1] or 0 for r in dealt.groupBy("__part").agg(F.sum(value)).collect()}
    before, total = [], 0
    for p in sorted(sums):
        before.append((p, total))
        total += sums[p]
    start = spark.createDataFrame(before or [(0, 0)], "__part int, __before long")
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    got = dealt.withColumn("__in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return got.join(F.broadcast(start), "__part").withColumn(out, F.col("__before") + F.col("__in")).drop("__part", "__before", "__in")


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)`` (any orientation, repeats allowed): ``node, root``, root the least node.

    Alternating large-star and small-star steps. Minima are partial aggregates, neighbours meet them in a sort-merge
    join, which splits skewed keys; so the centre of a star may hold any share of the edges. Nothing is collected.
    """

    def fixed(e: DataFrame) -> DataFrame:
        return cut(e.where("a <> b").distinct())

    def minima(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m"))

    e = fixed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    was = None
    while True:  # stars grow until nothing changes, in about log(size)^2 steps at most
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = minima(both).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(e.join(low, "a").select("a", F.col("m").alias("b")))
        large = large.where("a <> b").distinct()
        least = minima(large)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        e = fixed(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == was:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was = now


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
