"""Inverted-file search: rows partitioned by cluster, the nearest clusters probed, then all that may hold a nearer row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.config import COSINE, DOT, Config, parse_metric
from vexel.functions.distance import norm
from vexel.operators.search import HIT, best, blocks_of, kind_of, knn_batch, ranked, run, stream
from vexel.sources.folders import ship

#: Rows of a cluster that meet queries together, about.
PART = 4096


class IvfIndex:
    """An inverted file over ``rows(id, seq, vector)``, written at ``path`` with a directory for each cluster.

    Cosine clusters unit vectors. For the dot product no cluster bounds the distance: use the exact plan.
    """

    def __init__(self, table: DataFrame, centres: np.ndarray, radii: np.ndarray, sizes: np.ndarray, config: Config):
        self.table, self.centres, self.radii, self.sizes, self.config = table, centres, radii, sizes, config

    @classmethod
    def build(cls, rows: DataFrame, path: str, config: Config | None = None, clusters: int = 16, rounds: int = 10) -> IvfIndex:
        config = config or Config()
        if parse_metric(config.metric) == DOT:
            raise ValueError("no approximate index for the dot metric; search is exact")
        v = F.col("vector")
        if config.metric == COSINE:
            n = norm(v)
            v = F.transform(v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n))
        ready = rows.withColumn("__f", array_to_vector(F.transform(v, lambda x: x.cast("double"))))
        model = KMeans(k=clusters, seed=config.seed, maxIter=rounds, initMode="random", featuresCol="__f", predictionCol="cluster").fit(ready)
        dealt, centres, spark = model.transform(ready), np.array(model.clusterCenters()), rows.sparkSession
        dealt.drop("__f").repartition("cluster").write.mode("overwrite").partitionBy("cluster").parquet(path)
        at = spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cluster int, centre array<double>")
        squares = F.zip_with(vector_to_array("__f"), "centre", lambda x, y: (x - y) * (x - y))
        far = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
        radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for r in dealt.join(F.broadcast(at), "cluster").groupBy("cluster").agg(F.max(far).alias("r"), F.count("*").alias("n")).collect():
            radii[r.cluster], sizes[r.cluster] = r.r, r.n
        return cls(spark.read.parquet(path), centres, radii, sizes, config)

    def _asked(self, queries: DataFrame, least: int, bounded: bool) -> DataFrame:
        """``qid, q, cluster`` (and ``kth``): the nearest clusters that hold ``least`` rows; or, with the distance ``kth`` of each
        query's k-th hit, all clusters whose rows are not surely farther (triangle bound, with room for the rounding of
        single precision), and every cluster where there is no k-th hit."""
        names = ["qid", "q", *(["kth"] if bounded else [])]
        centres, radii, sizes, cosine = self.centres, self.radii, self.sizes, self.config.metric == COSINE

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                q = np.array(b.column(1).to_pylist(), float)
                if cosine:
                    n = np.sqrt((q * q).sum(axis=1, keepdims=True))
                    q = np.divide(q, n, out=np.zeros_like(q), where=n > 0)
                step = max(1, (4 << 20) // max(1, centres.size))  # few queries at a time: 32 MB of differences
                d = np.concatenate([np.sqrt(((q[a : a + step, None, :] - centres[None]) ** 2).sum(axis=2)) for a in range(0, len(q), step)])
                if bounded:
                    kth = np.array([np.inf if x is None else x for x in b.column(2).to_pylist()], float) * (2 if cosine else 1)
                    room = np.sqrt(np.maximum(kth, 0) * 1.0001 + (1e-4 if cosine else 0))
                    take = ~(d - radii - 1e-6 * (d + radii) > room[:, None])
                else:
                    order = np.argsort(d, axis=1, kind="stable")
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    take = np.zeros(d.shape, bool)
                    np.put_along_axis(take, order, before < least, axis=1)
                i, c = np.nonzero(take)
                i = pa.array(i)
                yield pa.RecordBatch.from_arrays([*(x.take(i) for x in b.columns), pa.array(c.astype(np.int32))], [*names, "cluster"])

        kind = queries.schema["qid"].dataType.simpleString()
        return queries.select("qid", F.col("vector").cast("array<float>").alias("q"), *names[2:]).mapInArrow(each, f"qid {kind}, q array<float>, {'kth double, ' if bounded else ''}cluster int")

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
        """``qid, id, seq, distance, rank`` of the nearest rows, for ``queries(qid, vector)`` with distinct ``qid``.

        The nearest clusters with ``ef_search`` rows together (k at least) give the k-th distance, and with it all
        clusters that may hold a nearer row are probed, so the result is exact; a larger ``ef_search`` makes the bound
        closer, a smaller one the first pass cheaper. ``nprobe`` asks for about as many clusters of mean size instead.
        Queries stay distributed; each meets the clusters' directories in a join on the cluster.
        """
        least = max(k, self.config.ef_search) if nprobe is None else max(1, int(nprobe * self.sizes.mean()))
        found = self._probed(self._asked(queries, least, False), queries, k)
        kth = found.where(F.col("rank") == k).select("qid", F.col("distance").cast("double").alias("kth"))
        return self._probed(self._asked(queries.join(kth, "qid", "left"), least, True), queries, k)

    def _probed(self, asked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """Clusters are cut into parts of about PART rows, and queries into blocks: each part meets those of a block that
        ask its cluster, and keeps k rows a query; see ``search.best``."""
        spark, config = asked.sparkSession, self.config
        ship(spark)
        if k <= 0:
            return ranked(queries.sparkSession.createDataFrame([], f"qid {kind_of(queries)}, {HIT}"), k)
        n, most = blocks_of(queries)
        blocks = 1 if n <= most else -(-n // (most // 2 + 1))
        parts = F.element_at(F.array(*(F.lit(max(1, -(-int(s) // PART))) for s in self.sizes)), F.col("cluster") + 1)
        left = self.table.withColumn("part", F.pmod(F.xxhash64("seq"), parts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = asked.withColumnRenamed("q", "vector").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        keys = ["cluster", "part", "block"]
        return ranked(run(stream(left, right, keys), keys, None, best(k, config.metric, True), f"qid {kind_of(queries)}, {HIT}"), k)

    def exact(self, queries: DataFrame, k: int) -> DataFrame:
        return knn_batch(self.table.select("id", "seq", "vector"), queries, k, self.config.metric)
