"""Requests in a stream: retries, failures, eviction, restarts, and the bound of the state; queries by blocks."""

from collections import OrderedDict

import numpy as np

from vexel.operators import search
from vexel.streaming.requests import SERVED, serve_requests

SCHEMA = "client string, seq long, req_id string, ok boolean"


def plain(rows, keep):
    known, out = {}, []
    for client, seq, req, ok in sorted(rows, key=lambda r: r[1]):
        own = known.setdefault(client, OrderedDict())
        new = req is None or req not in own
        if new and ok and req is not None:
            own[req] = None
            if len(own) > keep:
                own.popitem(last=False)
        out.append((client, seq, req, new, len(own)))
    return sorted(out, key=lambda r: r[1])


def run(spark, at, files, keep):
    """The stream is stopped and started again after each file."""
    for own in files:
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{at}/in")
        q = serve_requests(stream, keep).writeStream.format("parquet").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start(f"{at}/out")
        q.awaitTermination()
    return sorted((tuple(r) for r in spark.read.schema(SERVED).parquet(f"{at}/out").collect()), key=lambda r: r[1])


def test_retries_failures_and_eviction(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"c{rng.choice([0, 0, 0, 1, 2])}", s, None if rng.random() < 0.05 else f"r{rng.integers(12)}", bool(rng.random() < 0.7)) for s in range(400)]
    got = run(spark, tmp_path, [rows[:150], rows[150:151], rows[151:]], 5)
    assert got == plain(rows, 5)
    assert max(r[4] for r in got) == 5 and any(r[3] for r in got) and not all(r[3] for r in got)


def test_memory_stays_bounded(spark, tmp_path):
    rows = [("c", s, f"r{s}", True) for s in range(700)] + [("c", 700, "r699", True), ("c", 701, "r10", True)]
    got = run(spark, tmp_path, [rows[:350], rows[350:]], 256)
    assert max(r[4] for r in got) == 256 and [r[3] for r in got[-2:]] == [False, True]


def test_many_queries_meet_rows_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(f"v{i}", i, rng.standard_normal(4).tolist()) for i in range(150)], "id string, seq long, vector array<float>")
    queries = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(60)], "qid long, vector array<float>")
    pick = lambda df: sorted(map(tuple, df.collect()))
    want = {m: (pick(search.pairs(rows, queries, m)), pick(search.knn_batch(rows, queries, 3, m))) for m in ("cosine", "l2")}
    monkeypatch.setattr(search, "QUERY_ROWS", 8)
    for m, (all_, top) in want.items():
        assert len(all_) == 9000 and pick(search.pairs(rows, queries, m)) == all_ and pick(search.knn_batch(rows, queries, 3, m)) == top
    assert pick(search.knn_batch_arrow(rows, queries, 3)) == want["cosine"][1]


def test_clients_share_states(spark, tmp_path, monkeypatch):
    """Many clients in few states, over restarts; a batch calls the function once a state and not once a client."""
    rng = np.random.default_rng(4)
    rows = [(None if (c := rng.integers(40)) == 0 else f"c{c}", s, f"r{rng.integers(6)}", bool(rng.random() < 0.7)) for s in range(900)]
    for own in (rows[:500], rows[500:]):
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = serve_requests(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), 3, buckets=4)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = sorted((tuple(r) for r in spark.read.schema(SERVED).parquet(f"{tmp_path}/out").collect()), key=lambda r: r[1])
    assert got == plain(rows, 3)


def test_larger_inputs_mean_more_files_not_more_batches_or_larger_tasks(spark, monkeypatch):
    from vexel.plans import queries

    data = "/root/testdata/sf0.001"
    want = {n: sorted(map(tuple, queries.QUERIES[n](spark, data).collect())) for n in ("stream_requests", "stream_fold")}
    made, new = [], queries.new_folder
    monkeypatch.setattr(queries, "new_folder", lambda s: made.append(new(s)) or made[-1])
    monkeypatch.setattr(queries, "FILE_ROWS", 60)
    for name, own in (("stream_requests", "requests"), ("stream_fold", "log")):
        assert sorted(map(tuple, queries.QUERIES[name](spark, data).collect())) == want[name]
        files = [r.n for r in spark.read.parquet(f"{made[-1]}/{own}").groupBy("_metadata.file_path").count().withColumnRenamed("count", "n").collect()]
        assert len(files) > 12 and max(files) < 150
        assert len([f for f in __import__("os").listdir(f"{made[-1]}/checkpoint/offsets") if f.isdigit()]) == 3
