"""Collections as a Spark data source: equal to load, pruned, planned; writes appear as a whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from vexel.operators import log as ops
from vexel.sources import datasource
from vexel.sources.snapshot import Collection
from vexel.store import Reader, VectorStore


@pytest.fixture(scope="module")
def src(spark):
    datasource.register(spark)
    return spark


def opened(spark, root):
    return spark.read.format("vexel").option("root", str(root)).option("name", "c")


def rows(df):
    return sorted((r.id, r.seq, tuple(r.vector), r.text) for r in df.collect())


def frame(spark, first, n, dims=2):
    return spark.range(first, first + n, 1, 3).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.col("id").alias("seq"), F.array_repeat(F.col("id").cast("float"), dims).alias("vector"))


def save(df, root, **options):
    df.write.format("vexel").options(root=str(root), name="c", **options).mode("append").save()


def test_read_equals_load(src, tmp_path):
    assert opened(src, tmp_path).load().count() == 0
    s = VectorStore.open(src, str(tmp_path), "c", 2)
    s.insert("a", [1, 2], "text")
    s.insert("b", [float("inf"), -0.0])
    s.insert_many(frame(src, 2, 100).drop("seq").withColumn("n", F.monotonically_increasing_id()), "n")
    s.remove("a")
    s.close()
    loaded, m = Collection(src, str(tmp_path), "c").load()
    got = opened(src, tmp_path).load()
    assert rows(got) == rows(loaded) and m.rows == 101 and got.rdd.getNumPartitions() >= 1
    assert sorted(r.id for r in opened(src, tmp_path).schema("id string").load().collect()) == sorted(r.id for r in loaded.select("id").collect())
    assert got.where("seq > 50").groupBy().count().first()[0] == loaded.where("seq > 50").count()
    with pytest.raises(Exception, match="root and name"):
        src.read.format("vexel").load().count()


def test_writes_appear_as_a_whole_or_not_at_all(src, tmp_path):
    with pytest.raises(Exception, match="dims"):
        save(frame(src, 0, 3), tmp_path)
    save(frame(src, 0, 40), tmp_path, dims="2")
    r = Reader(src, str(tmp_path), "c")
    assert r.position == 40 and len(r) == 40
    bad = frame(src, 40, 30).withColumn("vector", F.when(F.col("seq") == 65, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("vector")))
    for df in (bad, frame(src, 30, 20)):  # a wrong length in one task; numbers that were given out before
        with pytest.raises(Exception, match="dimension mismatch|below the committed"):
            save(df, tmp_path, dims="2")
        assert r.refresh() == 40 and len(r) == 40
        assert not [n for n in os.listdir(f"{tmp_path}/c") if n.startswith("writing")]
    s = VectorStore.open(src, str(tmp_path), "c", 2)
    assert len(s) == 40 and s._next == 40
    s.insert("mine", [0, 0])
    s.close()
    save(frame(src, 41, 5).withColumn("text", F.lit("t")), tmp_path)
    assert r.refresh() == 46 and len(r) == 46 and r.live().where("text = 't'").count() == 5
    with pytest.raises(Exception, match="missing"):
        save(frame(src, 50, 5).drop("vector"), tmp_path)


def test_stream_batches_are_taken_once(src, tmp_path):
    frame(src, 0, 30).write.parquet(f"{tmp_path}/in/a")
    frame(src, 30, 30).write.parquet(f"{tmp_path}/in/b")
    for again in range(2):  # the second time from the start: the same batches come once more
        stream = src.readStream.schema("id string, seq long, vector array<float>").parquet(f"{tmp_path}/in/*")
        q = stream.writeStream.format("vexel").option("root", str(tmp_path)).option("name", "c").option("dims", "2").option("checkpointLocation", f"{tmp_path}/check{again}").trigger(availableNow=True).start()
        q.awaitTermination()
        r = Reader(src, str(tmp_path), "c")
        assert r.position == 60 and len(r) == 60 and ops.live_count(r._log).first().live == 60
