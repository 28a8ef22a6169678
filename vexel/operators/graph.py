"""Neighbour graphs: layers drawn from ids, rows dealt to shards by descent through the layers, links in each shard.

The layers above the shards' are tables, each holding a share of the one below. A row, and a query too, goes down them by
joins, from the nearest nodes of one layer to their children in the next, until it meets shards. In a shard, links lead
from every row to a few near ones, chosen so that they point in different directions, and a search follows them with a
beam of ``ef_search`` rows for whole blocks of queries. Hits of all shards are then ranked by the exact kernel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vexel.config import COSINE, DOT, L2, Config, parse_metric
from vexel.functions.distance import distance
from vexel.operators.search import completed, ranked
from vexel.sources.folders import ship

#: Highest layer, as a fixed bound of the draw.
TOP = 16
#: Rows of a shard are about max_connections to this power; one of more than FULL rows is dealt out by a hash.
SHARD_LAYER, FULL = 3, 16384
#: Nodes of a layer that go to every task, in bytes of vectors; layers above this size are met by joins.
SENT_BYTES = 32 << 20
#: Shards that a row enters (its nearest, and the next if about as near) and shards that a query asks, at least.
COPIES, NEAR, ASKED = 2, 1.1, 4
#: Queries of a shard that one task answers, and nodes that a beam expands at a time.
BLOCK, EXPAND = 256, 4


def level(id: Column, config: Config) -> Column:
    """The layer up to which an id reaches: geometric, a share of 1 / max_connections in each next one. Drawn from a
    digest of the id and the seed, so it is the same wherever and whenever the id is dealt."""
    digest = F.md5(F.concat(id.cast("string"), F.lit(f":{config.seed}")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(2.0**52)
    return F.least(F.lit(TOP), F.floor(-F.log(u) / F.lit(math.log(max(2, config.max_connections))))).cast("int")


# kernels: distances of many vectors at once


def _ready(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as the kernels take them: for cosine of length one (zero stays zero)."""
    x = np.asarray(x, np.float64)
    if metric == COSINE:
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    return x


def _apart(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all of ``a`` to all of ``b`` (also stacks of both)."""
    d = a @ np.swapaxes(b, -1, -2)
    if metric != L2:
        return 1 - d
    return np.maximum((a * a).sum(axis=-1)[..., :, None] + (b * b).sum(axis=-1)[..., None, :] - 2 * d, 0)


def select_neighbours(x: np.ndarray, base: int, candidates: np.ndarray, most: int, metric: str) -> np.ndarray:
    """Of ``candidates``, nearest first (ties: the earlier row): each one that is not nearer to one kept before than to
    ``base``, until ``most`` are kept."""
    candidates = np.unique(candidates[candidates != base])
    d = _apart(x[base : base + 1], x[candidates], metric)[0]
    order = np.lexsort((candidates, d))
    candidates, d = candidates[order], d[order]
    kept: list[int] = []
    least = np.full(len(candidates), np.inf)
    for i in range(len(candidates)):
        if least[i] >= d[i]:
            kept.append(i)
            if len(kept) == most:
                break
            least = np.minimum(least, _apart(x[candidates[i : i + 1]], x[candidates], metric)[0])
    return candidates[kept]


def _select_all(x: np.ndarray, candidates: np.ndarray, d: np.ndarray, most: int, metric: str) -> list[np.ndarray]:
    """``select_neighbours`` for rows of candidates in order of distance (missing: -1), many rows at a time."""
    out: list[np.ndarray] = []
    step = max(1, (4 << 20) // max(1, candidates.shape[1] ** 2 + candidates.shape[1] * x.shape[1]))
    for at in range(0, len(candidates), step):
        c, own = candidates[at : at + step], d[at : at + step]
        near = _apart(x[c], x[c], metric)
        least, count = np.full(c.shape, np.inf), np.zeros(len(c), int)
        keep = np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            keep[:, j] = (c[:, j] >= 0) & (least[:, j] >= own[:, j]) & (count < most)
            count += keep[:, j]
            least = np.where(keep[:, j, None], np.minimum(least, near[:, j, :]), least)
            if (count >= most).all():
                break
        out += [row[k] for row, k in zip(c, keep, strict=True)]
    return out


def link(x: np.ndarray, m: int, cap: int, width: int, metric: str) -> list[np.ndarray]:
    """Links of a layer's nodes: each chooses up to ``m`` of its ``width`` nearest, the chosen link back, and who has more
    than ``cap`` links then chooses again among them. Distances are taken in blocks; no list of pairs is kept."""
    n = len(x)
    width = min(width, n - 1)
    if width <= 0 or m <= 0:
        return [np.zeros(0, np.int64)] * n
    chosen: list[np.ndarray] = []
    step = max(1, (2 << 20) // n)
    for at in range(0, n, step):
        d = _apart(x[at : at + step], x, metric)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near = np.argpartition(d, width - 1, axis=1)[:, :width]
        near.sort(axis=1)
        dist = np.take_along_axis(d, near, 1)
        order = dist.argsort(axis=1, kind="stable")
        chosen += _select_all(x, np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1), m, metric)
    a = np.repeat(np.arange(n), [len(c) for c in chosen])
    b = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    ends = np.searchsorted(pairs, np.arange(1, n) * n)
    both = np.split(pairs % n, ends)
    return [select_neighbours(x, i, c, cap, metric) if len(c) > cap else c for i, c in enumerate(both)]


def entries(links: list[np.ndarray], first: int) -> list[int]:
    """``first`` and, as long as links lead from there not to every node, the least node that is out of reach."""
    n = len(links)
    seen, starts, todo = np.zeros(n, bool), [], first
    while True:
        starts.append(todo)
        front = [todo]
        seen[todo] = True
        while front:
            new = np.unique(np.concatenate([links[i] for i in front]))
            new = new[~seen[new]]
            seen[new] = True
            front = new.tolist()
        if seen.all():
            return starts
        todo = int(np.flatnonzero(~seen)[0])


def _padded(links: list[np.ndarray]) -> np.ndarray:
    wide = max([len(c) for c in links], default=0)
    out = np.full((len(links), max(1, wide)), -1, np.int64)
    for i, c in enumerate(links):
        out[i, : len(c)] = c
    return out


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, starts: np.ndarray, ef: int, metric: str, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(nodes, distances)`` of the ``ef`` nearest live nodes found for each query (missing: -1), and how many nodes each
    query measured. All queries advance together: the nearest nodes of a beam that are not yet expanded are, until every
    beam is. Nodes that are not live lead on and take no place among the hits."""
    n, nq = len(x), len(q)
    own = np.arange(nq)[:, None]
    seen = np.zeros((nq, n), bool)

    def measured(nodes: np.ndarray) -> np.ndarray:
        """Distances of rows of nodes, infinite for missing ones, ones seen before and repeats."""
        new = nodes >= 0
        new &= ~seen[own[: len(nodes)] if len(nodes) == nq else rows[:, None], np.maximum(nodes, 0)]
        order = nodes.argsort(axis=1, kind="stable")
        s = np.take_along_axis(nodes, order, 1)
        again = np.zeros(nodes.shape, bool)
        np.put_along_axis(again, order, np.concatenate([np.zeros((len(s), 1), bool), s[:, 1:] == s[:, :-1]], axis=1), axis=1)
        new &= ~again
        d = np.full(nodes.shape, np.inf)
        i, j = np.nonzero(new)
        at, to = rows[i], nodes[i, j]
        seen[at, to] = True
        a, b = q[at], x[to]
        d[i, j] = ((a - b) ** 2).sum(axis=1) if metric == L2 else 1 - (a * b).sum(axis=1)
        return d

    def best(ids: np.ndarray, d: np.ndarray, more: np.ndarray, dm: np.ndarray, open_: np.ndarray | None = None):
        ids, d = np.concatenate([ids, more], axis=1), np.concatenate([d, dm], axis=1)
        order = np.lexsort((ids, d), axis=1)[:, :ef]
        got = [np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)]
        if open_ is not None:
            got.append(np.take_along_axis(np.concatenate([open_, np.isfinite(dm)], axis=1), order, 1))
        return got

    rows = np.arange(nq)
    none = (np.full((nq, 0), -1, np.int64), np.zeros((nq, 0)))
    first = np.broadcast_to(starts, (nq, starts.shape[-1])) if starts.ndim < 2 else starts
    d0 = measured(first)
    ids, d, left = best(*none, first, d0, np.zeros((nq, 0), bool))
    hits = None
    if live is not None:
        hits = best(*none, first, np.where(live[np.maximum(first, 0)], d0, np.inf))
    while True:
        rows = np.flatnonzero(left.any(axis=1))
        if not len(rows):
            break
        some = left[rows]
        at = np.where(some, d[rows], np.inf).argsort(axis=1, kind="stable")[:, :EXPAND]
        take = np.take_along_axis(some, at, 1)
        left[rows[:, None], at] = False
        from_ = np.where(take, np.take_along_axis(ids[rows], at, 1), -1)
        nb = np.where(from_[:, :, None] >= 0, links[np.maximum(from_, 0)], -1).reshape(len(rows), -1)
        dn = measured(nb)
        fresh = best(ids[rows], d[rows], nb, dn, left[rows])
        ids, d, left = (_put(old, rows, new, fill) for old, new, fill in zip((ids, d, left), fresh, (-1, np.inf, False), strict=True))
        if hits is not None:
            fresh = best(hits[0][rows], hits[1][rows], nb, np.where(live[np.maximum(nb, 0)], dn, np.inf))
            hits = [_put(old, rows, new, fill) for old, new, fill in zip(hits, fresh, (-1, np.inf), strict=True)]
    ids, d = (ids, d) if hits is None else hits
    return np.where(np.isfinite(d), ids, -1), d, seen.sum(axis=1)


def _put(old: np.ndarray, rows: np.ndarray, new: np.ndarray, fill) -> np.ndarray:
    """``old`` with its ``rows`` replaced; the wider of both widths."""
    w = max(old.shape[1], new.shape[1])
    out = np.full((len(old), w), fill, old.dtype)
    out[:, : old.shape[1]] = old
    out[rows] = fill
    out[rows, : new.shape[1]] = new
    return out


# layers and shards


def _nearest(rows: DataFrame, key: str, vector: str, nodes: DataFrame, beam_: int, metric: str, dims: int) -> DataFrame:
    """``rows`` with ``node, d``: the ``beam_`` nearest of few ``nodes(node, v)``, which go to every task."""
    local = sorted(nodes.select("node", "v").collect(), key=lambda r: r.node)
    ids, x = np.array([r.node for r in local], np.int64), _ready(np.array([r.v for r in local]).reshape(len(local), dims), metric)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = _ready(np.array(b.column(names.index(vector)).to_pylist(), np.float64).reshape(b.num_rows, dims), metric)
            d = _apart(q, x, metric)
            order = d.argsort(axis=1, kind="stable")[:, :beam_]
            take = pa.array(np.repeat(np.arange(b.num_rows), order.shape[1]))
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(d, order, 1).ravel())], [*names, "node", "d"])

    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(each, f"{schema}, node long, d double")


class Layers:
    """The layers above the shards, highest first. ``tables[i]`` has ``node, v, parent``: the nodes that reach its layer
    and, but for the first, the nearest node of the table before."""

    def __init__(self, tables: list[DataFrame], metric: str, dims: int):
        self.tables, self.metric, self.dims = tables, metric, dims
        self.names: list[str] = []

    @classmethod
    def build(cls, rows: DataFrame, lowest: int, path: str, config: Config, dims: int) -> Layers:
        """``rows(seq, vector, level)``; the shards' layer is the highest one with a node up to ``lowest``."""
        counts = {r.level: r.n for r in rows.groupBy("level").agg(F.count("*").alias("n")).collect()}
        top = max(counts, default=0)
        reach = {layer: sum(n for lv, n in counts.items() if lv >= layer) for layer in range(top + 1)}
        lowest = min(lowest, top)
        first = lowest
        while first < top and reach[first] * dims * 8 > SENT_BYTES:
            first += 1
        got = cls([], config.metric, dims)
        for layer in range(first, lowest - 1, -1):
            nodes = rows.where(F.col("level") >= layer).select(F.col("seq").alias("node"), F.col("vector").alias("v"))
            up = got.down(nodes.withColumnRenamed("node", "key"), "key", "v", 1) if got.tables else nodes.withColumnRenamed("node", "key").withColumn("node", F.lit(None).cast("long"))
            at = f"{path}/layer-{layer:02d}"
            up.select(F.col("key").alias("node"), "v", F.col("node").alias("parent")).write.mode("overwrite").parquet(at)
            got.tables.append(rows.sparkSession.read.parquet(at))
            got.names.append(at.rsplit("/", 1)[1])
        return got

    def down(self, rows: DataFrame, key: str, vector: str, width: int) -> DataFrame:
        """``rows`` with ``node, d`` of the last table: the ``width`` nearest that descent finds. The first layer goes to
        every task; from a layer to the next, a row meets the children of its nodes in a join."""
        got = _nearest(rows, key, vector, self.tables[0], width, self.metric, self.dims)
        best = Window.partitionBy(key).orderBy("d", "node")
        for t in self.tables[1:]:
            met = got.drop("d").withColumnRenamed("node", "parent").join(t, "parent")
            far = distance(self.metric, F.col(vector), F.col("v")).cast("double")
            met = met.select(*rows.columns, "node", far.alias("d"))
            got = met.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= width).drop("__r")
        return got


ROWS = "id string, seq long, vector array<float>, level int"
SHARDS = f"shard long, part int, {ROWS}, links array<array<long>>, entry boolean"


class GraphIndex:
    """Linked shards of ``rows(id, seq, vector)``, written at ``path``; ``seq`` is unique."""

    def __init__(self, table: DataFrame, layers: Layers | None, rows: int, dims: int, config: Config):
        self.table, self.layers, self.rows, self.dims, self.config = table, layers, rows, dims, config

    @classmethod
    def build(cls, rows: DataFrame, path: str, config: Config | None = None, shard_layer: int = SHARD_LAYER, full: int = FULL) -> GraphIndex:
        """Vectors must be of one length (see ``log.quarantine``). Rows enter the shards of their nearest node, and of a
        second one that is about as near; a shard of more than ``full`` rows (copies of one vector, say) is cut by a hash
        of ``seq``. A shard is one task's work, its equal vectors are one node."""
        config, spark = config or Config(), rows.sparkSession
        ship(spark)
        metric = parse_metric(config.metric)
        base = rows.select(F.col("id").cast("string").alias("id"), "seq", F.col("vector").cast("array<float>").alias("vector")).withColumn("level", level(F.col("seq"), config))
        base.write.mode("overwrite").parquet(f"{path}/rows")
        base = spark.read.schema(ROWS).parquet(f"{path}/rows")
        n, dims = base.agg(F.count("*"), F.max(F.size("vector"))).first()
        if not n:
            return cls(spark.createDataFrame([], SHARDS), None, 0, 0, config)
        layers = Layers.build(base, shard_layer, path, config, dims)
        near = layers.down(base, "seq", "vector", COPIES)
        least = Window.partitionBy("seq")
        room = F.abs(F.col("__m")) * F.lit(NEAR - 1) + F.col("__m")
        dealt = near.withColumn("__m", F.min("d").over(least)).where((F.col("d") <= F.col("__m")) | ((F.col("d") <= room) if metric != DOT else F.lit(False)))
        dealt = dealt.withColumnRenamed("node", "shard").drop("d", "__m")
        # rows equally near to several nodes enter all of them; sizes are counted, not guessed
        sizes = dealt.groupBy("shard").agg(F.count("*").alias("__n"))
        dealt = dealt.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("seq"), F.ceil(F.col("__n") / full)).cast("int")).drop("__n")
        m, width = config.max_connections, max(1, config.ef_construction)

        def links(t: pa.Table) -> pa.Table:
            return _linked(t, m, width, metric)

        made = dealt.select("shard", "part", "id", "seq", "vector", "level").groupBy("shard", "part").applyInArrow(links, SHARDS)
        made.write.mode("overwrite").parquet(f"{path}/shards")
        return cls(spark.read.schema(SHARDS).parquet(f"{path}/shards"), layers, n, dims, config)

    @classmethod
    def open(cls, spark: SparkSession, path: str, layers: list[str], rows: int, dims: int, config: Config) -> GraphIndex:
        """An index built before; ``layers`` are the names of its layers' folders, highest first."""
        ship(spark)
        tables = [spark.read.parquet(f"{path}/{name}") for name in layers]
        return cls(spark.read.schema(SHARDS).parquet(f"{path}/shards"), Layers(tables, config.metric, dims), rows, dims, config)

    def asked(self, queries: DataFrame, ef: int) -> DataFrame:
        """``qid, vector, shard``: the nearest shards, more of them with a wider beam, all with one as wide as the rows."""
        wide = self.rows if ef >= self.rows else max(ASKED, -(-ef // 8))
        return self.layers.down(queries.select("qid", "vector"), "qid", "vector", wide).withColumnRenamed("node", "shard").drop("d")

    def candidates(self, queries: DataFrame, k: int, dead: DataFrame | None = None) -> DataFrame:
        """``qid, id, seq, vector, q, measured``: what each shard's beam finds, k live rows and those within rounding of
        the k-th; ``measured`` nodes of the shard were compared. ``dead(seq)`` rows lead on, but are no hits.
        ``queries(qid, vector)`` have distinct ``qid``."""
        spark, config, dims = queries.sparkSession, self.config, self.dims
        kind = queries.schema["qid"].dataType.simpleString()
        out = f"qid {kind}, id string, seq long, vector array<float>, q array<float>, measured long"
        if self.layers is None or k <= 0:
            return spark.createDataFrame([], out)
        ef, metric = max(k, config.ef_search), config.metric
        asked = self.asked(queries, ef)
        table = self.table if dead is None else self.table.join(dead.select("seq", F.lit(True).alias("gone")), "seq", "left")
        table = table.select("shard", "part", "id", "seq", "vector", "level", "links", "entry", *(["gone"] if dead is not None else []))
        # a shard with many queries is answered by several tasks, each with a block of them
        count = asked.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__b"))
        asked = asked.join(count, "shard").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("__b")).cast("int"))
        parts = table.select("shard", "part").distinct()
        asked = asked.join(parts, "shard").select(*(F.col(c).alias(c) for c in ("shard", "part", "block", "qid", "vector")))
        blocks = count.select("shard", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)).alias("block"))
        sent = table.join(blocks, "shard")

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            return _found(left, right, k, ef, metric, dims)

        return sent.groupBy("shard", "part", "block").cogroup(asked.groupBy("shard", "part", "block")).applyInArrow(search, out)

    def search(self, queries: DataFrame, k: int, dead: DataFrame | None = None) -> DataFrame:
        """``qid, id, seq, distance, rank``: at most k rows a query, nearest first, ties by ``seq``. With ``ef_search`` of as
        many as there are rows the result is exact; less of it costs less and may miss some."""
        return rank(self.candidates(queries, k, dead), k, self.config.metric)

    def exact(self, queries: DataFrame, rows: DataFrame, k: int, dead: DataFrame | None = None) -> DataFrame:
        """As ``search``, and then exact: what the beam found bounds a check of the live ``rows(id, seq, vector)``."""
        return completed(self.search(queries, k, dead), rows, queries, k, self.config.metric)

    def measured(self, queries: DataFrame, k: int) -> DataFrame:
        """``qid, measured``: how many nodes were compared for each query; the exact plan compares every row."""
        return self.candidates(queries, k).select("qid", "q", "measured", "seq").groupBy("qid").agg(F.max("measured").alias("measured"))


def rank(found: DataFrame, k: int, metric: str) -> DataFrame:
    """The k nearest of candidates by the exact kernel; a row found in two shards counts once."""
    once = found.groupBy("qid", "seq").agg(F.first("id").alias("id"), F.first("vector").alias("vector"), F.first("q").alias("q"))
    return ranked(once.select("qid", "id", "seq", distance(metric, F.col("q"), F.col("vector")).alias("distance")), k)


def _columns(t: pa.Table, dims: int | None = None) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    t = t.combine_chunks().sort_by("seq")
    x = np.array(t.column("vector").to_pylist(), np.float32).reshape(t.num_rows, -1)
    return t, t.column("seq").to_numpy(), x


def _linked(t: pa.Table, m: int, width: int, metric: str) -> pa.Table:
    """One shard with its rows' links in each of its layers, as ``seq`` of the nodes' first rows; other copies have none."""
    t, seq, x = _columns(t)
    _, first, of = np.unique(x, axis=0, return_index=True, return_inverse=True)
    nodes = np.sort(first)  # a node is its first row
    node_of = np.searchsorted(nodes, first[of.ravel()])
    level_ = np.zeros(len(nodes), np.int64)
    np.maximum.at(level_, node_of, t.column("level").to_numpy())
    y = _ready(x[nodes], metric)
    links: list[list[list[int]]] = [[] for _ in range(len(seq))]
    top = int(level_.max())
    start = [int(np.flatnonzero(level_ == top)[0])]
    for layer in range(top + 1):
        own = np.flatnonzero(level_ >= layer)
        got = link(y[own], m, 2 * m if layer == 0 else m, width, metric)
        for i, c in zip(own, got, strict=True):
            links[nodes[i]].append(seq[nodes[own[c]]].tolist())
        if layer == 0:
            start = entries(got, start[0])
    entry = np.zeros(len(seq), bool)
    entry[nodes[start]] = True
    return t.append_column("links", pa.array(links, pa.list_(pa.list_(pa.int64())))).append_column("entry", pa.array(entry))


def _found(left: pa.Table, right: pa.Table, k: int, ef: int, metric: str, dims: int) -> pa.Table:
    """A block of queries in one shard: down its layers with a beam of one, along the lowest with ``ef``."""
    qid_type, none = right.schema.field("qid").type, [pa.array([], t) for t in (right.schema.field("qid").type, pa.string(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.int64())]
    names = ["qid", "id", "seq", "vector", "q", "measured"]
    if not left.num_rows or not right.num_rows:
        return pa.table(none, names=names)
    t, seq, x = _columns(left)
    q = np.array(right.column("vector").to_pylist(), np.float32).reshape(right.num_rows, dims)
    links = t.column("links").to_pylist()
    nodes = np.array([i for i, c in enumerate(links) if c], np.int64)
    of = {s: i for i, s in enumerate(seq[nodes].tolist())}
    alive = np.ones(len(seq), bool)
    if "gone" in t.column_names:
        alive = np.array([not g for g in t.column("gone").to_pylist()])
    _, first, inverse = np.unique(x, axis=0, return_index=True, return_inverse=True)
    node_of = np.searchsorted(nodes, first[inverse.ravel()])
    live = np.zeros(len(nodes), bool)
    live[node_of[alive]] = True
    y, p = _ready(x[nodes], metric), _ready(q, metric)
    if ef >= len(nodes):
        d = _apart(p, y, metric)
        d[:, ~live] = np.inf
        ids, d, measured = np.broadcast_to(np.arange(len(nodes)), d.shape), d, np.full(len(q), len(nodes))
    else:
        lists = [links[i] for i in nodes]
        top = max(map(len, lists)) - 1
        starts = np.flatnonzero(np.array(t.column("entry").to_pylist())[nodes])
        high = np.flatnonzero([len(c) > top for c in lists])[:1]
        at, measured = np.broadcast_to(high, (len(q), 1)), np.zeros(len(q), np.int64)
        for layer in range(top, 0, -1):
            own = _padded([np.array([of[s] for s in c[layer]], np.int64) if len(c) > layer else np.zeros(0, np.int64) for c in lists])
            at, _, n = beam(y, own, p, at, 1, metric)
            measured += n
        own = _padded([np.array([of[s] for s in c[0]], np.int64) for c in lists])
        at = np.concatenate([at, np.broadcast_to(starts, (len(q), len(starts)))], axis=1)
        ids, d, n = beam(y, own, p, at, ef, metric, None if live.all() else live)
        measured += n
    # rows of the nodes found: k and what lies within the rounding of both kernels of the k-th
    rows_of = np.split(np.argsort(node_of, kind="stable"), np.cumsum(np.bincount(node_of, minlength=len(nodes)))[:-1])
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    most = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max())
    scale = np.ones(len(q)) if metric == COSINE else (norm + most) ** 2 if metric == L2 else 1 + norm * most
    slack = (4 * dims + 16) * 2.0**-23 * scale
    pick_q, pick_row = [], []
    for i in range(len(q)):
        order = np.lexsort((ids[i], d[i]))
        order = order[np.isfinite(d[i][order])]
        count, limit = 0, np.inf
        for j in order:
            if d[i][j] > limit:
                break
            own_rows = rows_of[ids[i][j]]
            own_rows = own_rows[alive[own_rows]][:k]
            pick_q += [i] * len(own_rows)
            pick_row += own_rows.tolist()
            if count < k <= count + len(own_rows):
                limit = d[i][j] + 2 * slack[i]
            count += len(own_rows)
    a, b = pa.array(np.array(pick_q, np.int64)), pa.array(np.array(pick_row, np.int64))
    got = [right.column("qid").take(a).cast(qid_type), t.column("id").take(b), t.column("seq").take(b), t.column("vector").take(b), right.column("vector").take(a), pa.array(measured[np.array(pick_q, np.int64)] if pick_q else [], pa.int64())]
    return pa.table(got, names=names)
