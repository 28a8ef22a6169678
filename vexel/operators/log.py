"""The mutation log and what is derived from it.

A log has ``seq`` (unique, ascending, below 2^62), ``op`` (insert, remove, clear), ``id``, ``vector`` and ``text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.errors import DimensionMismatchError
from vexel.sources.folders import shared_folder

LOG = "seq long, op string, id string, vector array<float>, text string"
INSERT, REMOVE, CLEAR = "insert", "remove", "clear"


def since_clear(log: DataFrame) -> DataFrame:
    """Inserts and removes after the last clear. The bound is one row, so the join is a broadcast of one row."""
    last = log.agg(F.max(F.when(F.col("op") == CLEAR, F.col("seq"))).alias("__clear"))
    return log.crossJoin(F.broadcast(last)).where((F.col("op") != CLEAR) & (F.col("__clear").isNull() | (F.col("seq") > F.col("__clear")))).drop("__clear")


def latest(log: DataFrame) -> DataFrame:
    """``id, seq, inserted``: the last operation on each id. A single long is aggregated, so hash aggregation with a
    map-side combine works, and vectors don't move."""
    code = F.shiftleft("seq", 1) + F.when(F.col("op") == INSERT, 1).otherwise(0)
    top = since_clear(log).groupBy("id").agg(F.max(code).alias("c"))
    return top.select("id", F.shiftright("c", 1).alias("seq"), (F.col("c").bitwiseAND(F.lit(1)) == 1).alias("inserted"))


def live(log: DataFrame) -> DataFrame:
    """Live rows ``id, seq, vector, text``: an upsert counts from its latest insert. Vectors meet their winners by seq."""
    winners = latest(log).where("inserted").select("seq")
    return log.where(F.col("op") == INSERT).join(winners, "seq", "left_semi").select("id", "seq", "vector", *(["text"] if "text" in log.columns else []))


def last_operations(log: DataFrame) -> DataFrame:
    """Of a log what later folds can need: the last operation on each id since the last clear, and that clear."""
    top = latest(log).select("seq")
    clear = log.where(F.col("op") == CLEAR).agg(F.max("seq").alias("seq")).where("seq is not null")
    return log.join(top.union(clear), "seq", "left_semi")


def live_count(log: DataFrame) -> DataFrame:
    return latest(log).where("inserted").agg(F.count("*").alias("live")).withColumn("is_empty", F.col("live") == 0)


def tombstones(log: DataFrame) -> DataFrame:
    """How many inserted versions there are since the last clear, how many live, and how many are dead."""
    n = since_clear(log).where(F.col("op") == INSERT).agg(F.count("*").alias("inserted"))
    return n.crossJoin(live_count(log).select("live")).withColumn("dead", F.col("inserted") - F.col("live"))


def contains(log: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes(id)`` with ``contained``."""
    ids = latest(log).where("inserted").select("id", F.lit(True).alias("__in"))
    return probes.join(ids, "id", "left").withColumn("contained", F.coalesce("__in", F.lit(False))).drop("__in")


def remove_results(log: DataFrame) -> DataFrame:
    """For each remove whether it removed something: the id's operation before it, since the clear before it, inserts.

    How many clears lie before a row comes from range partitions of the log and their totals.
    """
    rows = running(log.select("seq", "op", "id"), "seq", F.when(F.col("op") == CLEAR, 1).otherwise(0), "__e").where(F.col("op") != CLEAR)
    before = F.lag("op").over(Window.partitionBy("id", "__e").orderBy("seq"))
    return rows.withColumn("removed", F.coalesce(before == INSERT, F.lit(False))).where(F.col("op") == REMOVE).select("seq", "id", "removed")


def check_dimensions(rows: DataFrame, dims: int, column: str = "vector") -> DataFrame:
    """``rows`` with ``got`` (its length) and ``valid``; a null vector or element is not valid."""
    v = F.col(column)
    got = F.coalesce(F.size(v), F.lit(-1))
    return rows.withColumn("got", F.when(v.isNull(), F.lit(-1)).otherwise(got)).withColumn("valid", (F.col("got") == dims) & ~F.exists(F.coalesce(v, F.array(F.lit(None).cast("float"))), lambda x: x.isNull()))


def require_dimensions(rows: DataFrame, dims: int, column: str = "vector") -> None:
    """Raises on the first offending vector; nothing of a batch is applied then."""
    bad = check_dimensions(rows, dims, column).where(~F.col("valid")).select("got").limit(1).collect()
    if bad:
        raise DimensionMismatchError(dims, bad[0].got)


def quarantine(rows: DataFrame, dims: int, column: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``got``)."""
    checked = check_dimensions(rows, dims, column)
    return checked.where("valid").drop("got", "valid"), checked.where(~F.col("valid")).drop("valid")


def first_requests(rows: DataFrame, req_id: Column | str = "req_id") -> DataFrame:
    """Of the rows with one request id that with the least ``seq``: retries of a request don't apply twice."""
    keyed = rows.withColumn("__req", req_id if isinstance(req_id, Column) else F.col(req_id))
    first = keyed.groupBy("__req").agg(F.min("seq").alias("seq"))
    return keyed.drop("__req").join(first.select("seq"), "seq", "left_semi")


def running(rows: DataFrame, order: str, value: Column, out: str, start: int = 0) -> DataFrame:
    """Adds ``out``: ``start`` and the sum of ``value`` over the rows before this one in ``order``.

    Rows are dealt into range partitions and checkpointed, so that the partitions stay as they are; a partition's total
    (as many numbers as there are partitions) is carried over to those behind it. No window sees more than a partition.
    """
    spark = rows.sparkSession
    shared_folder(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__v", value.cast("long")).repartitionByRange(n, order).withColumn("__p", F.spark_partition_id()).checkpoint()
    at, before = start, []
    for r in sorted(dealt.groupBy("__p").agg(F.sum("__v").alias("v")).collect(), key=lambda r: r["__p"]):
        before.append((r["__p"], at))
        at += r["v"]
    totals = spark.createDataFrame(before, "__p int, __b long")
    w = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("__v").over(w), F.lit(0))
    return dealt.withColumn("__i", inside).join(F.broadcast(totals), "__p").withColumn(out, F.col("__b") + F.col("__i")).drop("__p", "__b", "__i", "__v")


def numbered(rows: DataFrame, order: str, out: str, start: int = 0) -> DataFrame:
    """Dense numbers from ``start`` in the order of ``order``."""
    return running(rows, order, F.lit(1), out, start)


def compact(log: DataFrame) -> DataFrame:
    """A log of only the live rows, renumbered densely in insertion order."""
    rows = live(log)
    cols = [c for c in ("id", "vector", "text") if c in rows.columns]
    return numbered(rows, "seq", "__new").select(F.col("__new").alias("seq"), F.lit(INSERT).alias("op"), *cols)
