"""Neighbour graphs: choice of links, degrees, layers, descent, beams, and segments under a changing log."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.config import Config
from vexel.operators import graph, search
from vexel.operators import log as ops
from vexel.operators.segments import SegmentIndex

SCHEMA = "id string, seq long, vector array<float>"
METRICS = ["cosine", "dot", "l2"]


def points(n, dims=8, seed=1, copies=0):
    x = np.random.default_rng(seed).standard_normal((n, dims)).astype(np.float32)
    if copies:
        x[-copies:] = x[0]
    return x


def frame(spark, x):
    return spark.createDataFrame([(f"v{i}", i, [float(c) for c in v]) for i, v in enumerate(x)], SCHEMA)


def one_by_one(x, base, candidates, most, metric):
    """The choice as a plain loop."""
    d = lambda a, b: float(graph._apart(x[a : a + 1], x[b : b + 1], metric)[0, 0])
    kept = []
    for c in sorted(set(candidates) - {base}, key=lambda c: (d(base, c), c)):
        if len(kept) < most and all(d(c, r) >= d(base, c) for r in kept):
            kept.append(c)
    return kept


@pytest.mark.parametrize("metric", METRICS)
def test_choice_of_links_equals_a_plain_loop(metric):
    x = graph._ready(points(60, 4, copies=5), metric)
    d = graph._apart(x, x, metric)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :20]
    every = graph._select_all(x, near, np.take_along_axis(d, near, 1), 6, metric)
    for i in range(60):
        want = one_by_one(x, i, near[i].tolist(), 6, metric)
        assert graph.select_neighbours(x, i, near[i], 6, metric).tolist() == want
        assert sorted(every[i].tolist()) == sorted(want)


def in_turn(x, m, width, metric):
    """Links made one node after the other, with exact candidates: the way a sequential build goes."""
    links = [[] for _ in x]
    for i in range(1, len(x)):
        d = graph._apart(x[i : i + 1], x[:i], metric)[0]
        chosen = one_by_one(x, i, np.lexsort((np.arange(i), d))[:width].tolist(), m, metric)
        for c in chosen:
            links[i].append(c)
            links[c].append(i)
            if len(links[c]) > 2 * m:
                links[c] = one_by_one(x, c, links[c], 2 * m, metric)
    return [np.array(c, np.int64) for c in links]


def reached(x, links, q, ef, metric):
    ids, _, n = graph.beam(x, graph._padded(links), q, np.array(graph.entries(links, 0)), ef, metric)
    true = graph._apart(q, x, metric).argmin(axis=1)
    return float((ids[:, 0] == true).mean()), float(n.mean())


@pytest.mark.parametrize("metric", METRICS)
def test_degrees_and_recall_against_a_sequential_build(metric):
    x, q = graph._ready(points(400, 12), metric), graph._ready(points(60, 12, 2), metric)
    links = graph.link(x, 5, 10, 40, metric)
    assert max(map(len, links)) <= 10 and all(i not in c for i, c in enumerate(links))
    for width in (10, 40):
        assert reached(x, links, q, width, metric)[0] >= reached(x, in_turn(x, 5, 40, metric), q, width, metric)[0] - 0.05
    assert reached(x, links, q, 400, metric)[0] == 1


def test_beam_width_buys_recall_for_cost():
    x, q = graph._ready(points(3000, 24), "l2"), graph._ready(points(200, 24, 3), "l2")
    links = graph.link(x, 8, 16, 60, "l2")
    got = [reached(x, links, q, ef, "l2") for ef in (1, 10, 50, 200)]
    assert [n for _, n in got] == sorted(n for _, n in got) and got[0][1] < 300 and got[2][1] < 1500
    assert got[0][0] < got[2][0] and got[2][0] >= 0.9 and got[3][0] >= 0.98


def test_dead_nodes_lead_on_but_are_no_hits():
    x, q = graph._ready(points(500, 8), "l2"), graph._ready(points(40, 8, 3), "l2")
    links = graph._padded(graph.link(x, 6, 12, 40, "l2"))
    live = np.random.default_rng(1).random(500) < 0.1
    ids, d, _ = graph.beam(x, links, q, np.array([0]), 60, "l2", live)
    true = np.where(live, graph._apart(q, x, "l2"), np.inf)
    assert live[ids[ids >= 0]].all() and (ids[:, 0] == true.argmin(axis=1)).mean() >= 0.9
    assert (np.diff(np.where(np.isfinite(d), d, 1e9), axis=1) >= 0).all()


def test_levels_are_drawn_from_ids_alone(spark):
    rows = spark.range(40000)
    a = rows.repartition(7).select("id", graph.level(F.col("id"), Config()).alias("l"))
    b = rows.coalesce(1).select("id", graph.level(F.col("id"), Config()).alias("k"))
    assert a.join(b, "id").where("l <> k").count() == 0
    n = dict(map(tuple, a.groupBy("l").count().collect()))
    reach = [sum(v for k, v in n.items() if k >= layer) for layer in range(4)]
    assert reach[0] == 40000 and abs(reach[1] / 2500 - 1) < 0.1 and abs(reach[2] / 156 - 1) < 0.35
    other = rows.select(graph.level(F.col("id"), Config(seed=5)).alias("l")).where("l > 0").count()
    assert abs(other / 2500 - 1) < 0.1 and max(n) <= graph.TOP


def hits(df):
    return sorted((r.qid, r["rank"], r.id, r.distance) for r in df.collect())


@pytest.mark.parametrize("metric", METRICS)
def test_wide_beam_is_exact_over_many_shards(spark, tmp_path, monkeypatch, metric):
    """Several layers met by joins, shards cut by size, copies, a zero vector; a beam as wide as the rows sees them all."""
    monkeypatch.setattr(graph, "SENT_BYTES", 600)
    rows = frame(spark, np.concatenate([points(500, 6, copies=80), np.zeros((1, 6), np.float32)]))
    config = Config(metric=metric, max_connections=4, ef_search=1000)
    index = graph.GraphIndex.build(rows, str(tmp_path / "g"), config, shard_layer=2, full=40)
    assert len(index.layers.tables) >= 2 and index.table.select("shard", "part").distinct().count() > 8
    assert index.table.groupBy("shard", "part").count().agg(F.max("count")).first()[0] < 80
    queries = rows.where("seq % 20 = 0").selectExpr("seq as qid", "vector")
    assert hits(index.search(queries, 7)) == hits(search.knn_batch(rows, queries, 7, metric))
    deg = index.table.select(F.explode("links").alias("l")).agg(F.max(F.size("l"))).first()[0]
    assert deg <= 8


def test_recall_over_shards_and_measured_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16)) * 2
    x = (centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16))).astype(np.float32)
    rows, queries = frame(spark, x), frame(spark, x[::40] + 0.2).selectExpr("seq as qid", "vector")
    exact = search.knn_batch(rows, queries, 1, "l2")
    index = graph.GraphIndex.build(rows, str(tmp_path / "g"), Config(metric="l2", max_connections=8), shard_layer=3, full=600)
    assert index.table.select("shard", "part").distinct().count() > 4
    assert search.recall(index.search(queries, 1), exact).first().recall >= 0.9
    n = index.measured(queries, 1).agg(F.count("*").alias("n"), F.max("measured").alias("m")).first()
    assert n.n == 100 and n.m < 600


def test_odd_input(spark, tmp_path):
    none = graph.GraphIndex.build(frame(spark, points(0)), str(tmp_path / "none"))
    q = frame(spark, points(3)).selectExpr("seq as qid", "vector")
    assert none.search(q, 3).count() == 0
    one = graph.GraphIndex.build(frame(spark, points(1)), str(tmp_path / "one"))
    assert [r.id for r in one.search(q, 3).collect()] == ["v0"] * 3 and one.search(q, 0).count() == 0
    same = graph.GraphIndex.build(frame(spark, points(300, copies=300)), str(tmp_path / "same"), Config(ef_search=5), full=100)
    assert sorted((r.qid, r.seq) for r in same.search(q, 4).collect()) == [(i, s) for i in range(3) for s in range(4)]


# segments


LOG = "seq long, op string, id string, vector array<float>"


def make_log(n, seed, dims=4, clear=None):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n):
        op = ops.CLEAR if s == clear else ops.REMOVE if rng.random() < 0.25 else ops.INSERT
        rows.append((s, op, None if op == ops.CLEAR else f"i{rng.integers(n // 3)}", [float(c) for c in rng.standard_normal(dims).astype(np.float32)] if op == ops.INSERT else None))
    return rows


@pytest.mark.parametrize(("seed", "clear"), [(1, None), (2, 14), (3, 25)])
def test_any_order_of_a_log_gives_the_exact_plan(spark, tmp_path, seed, clear):
    rows = make_log(36, seed, clear=clear)
    log = spark.createDataFrame([(*r, None) for r in rows], ops.LOG)
    queries = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(points(4, 4, 9))], "qid long, vector array<float>")
    want = hits(search.knn_batch(ops.live(log).select("id", "seq", "vector"), queries, 5))
    order = np.random.default_rng(seed).permutation(36)
    for most, cuts in ((1, (0, 9, 20, 28, 36)), (4, (0, 18, 36))):
        index = SegmentIndex(spark, str(tmp_path / f"s{most}"), 4, most=most)
        for a, b in itertools.pairwise(cuts):
            index.apply(spark.createDataFrame([rows[i] for i in order[a:b]], LOG))
        assert hits(index.search(queries, 5)) == want
        assert sorted((r.id, r.seq) for r in index.live().collect()) == sorted((r.id, r.seq) for r in ops.live(log).collect())
    assert hits(SegmentIndex.open(spark, str(tmp_path / "s4")).search(queries, 5)) == want
    n = index.compact()
    again = search.knn_batch(ops.compact(log).select("id", "seq", "vector"), queries, 5)
    assert n == len(index.live().collect()) and hits(index.search(queries, 5)) == hits(again)
    index.apply(spark.createDataFrame([(n, ops.REMOVE, want[0][2], None)], LOG))
    assert want[0][2] not in {h[2] for h in hits(index.search(queries, 5))} and len(index.live().collect()) == n - 1


def test_segments_merge_and_wrong_lengths_change_nothing(spark, tmp_path):
    index = SegmentIndex(spark, str(tmp_path / "s"), 4, most=2)
    for b in range(5):
        index.apply(spark.createDataFrame([(b * 10 + i, ops.INSERT, f"i{b}-{i}", [float(b), float(i), 1.0, 0.0]) for i in range(10)], LOG))
        assert len(index.segments) <= 3
    before = sorted(r.seq for r in index.live().collect())
    assert before == list(range(50))
    with pytest.raises(ValueError, match="dimension"):
        index.apply(spark.createDataFrame([(60, ops.INSERT, "x", [1.0])], LOG))
    assert sorted(r.seq for r in index.live().collect()) == before
    index.apply(spark.createDataFrame([(70, ops.CLEAR, None, None)], LOG))
    assert index.live().count() == 0 and index.segments == []
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "qid long, vector array<float>")
    assert index.search(q, 3).count() == 0
    index.apply(spark.createDataFrame([(20, ops.INSERT, "late", [1.0] * 4), (80, ops.INSERT, "new", [1.0] * 4)], LOG))
    assert [r.id for r in index.search(q, 3).collect()] == ["new"]


def test_recall_query_searches_once(spark, tmp_path, monkeypatch):
    """One search gives hits and counts; the true neighbours are those of all pairs, which matrix products narrow down."""
    from vexel.plans import queries as plans

    r = np.random.default_rng(21)
    x = r.normal(size=(400, 16)).astype(np.float32)
    x[200:220] = x[:20] + np.float32(1e-3)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    calls, candidates = [], graph.GraphIndex.candidates
    monkeypatch.setattr(graph.GraphIndex, "candidates", lambda *a: calls.append("graph") or candidates(*a))
    monkeypatch.setattr(plans.search, "knn_batch", lambda *a: calls.append("all pairs by the slow kernel"))
    got = {r.qid: r for r in plans.graph_recall(spark, str(tmp_path)).collect()}
    assert calls == ["graph"] and set(got) == set(range(0, 400, 20))
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    d = 1 - y @ y.T
    np.fill_diagonal(d, np.inf)
    assert all(g.found == (g.id == str(d[q].argmin())) and 0 < g.measured_share <= 1.2 for q, g in got.items())
    assert sum(g.found for g in got.values()) >= 18
