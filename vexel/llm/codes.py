"""Codes of vectors in parts: codebooks by whole-number k-means, whose assignments are kept up by adaptive bounds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import SENT, arrow, discard, made, read, table
from vexel.llm.vectors import commonest_length, finite, matrix, whole

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Closest entries kept with a lower bound each, at first and at least; their number follows what the last round used.
KEPT, FEWEST = 8, 2
#: Bounds are doubles widened by this share, and stored rounded down.
SLACK = 1e-9
STATE = "row long, code binary, near binary, low binary, outer binary"


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exact: as long where they fit, else as Python's whole numbers."""
    d = x[:, None, :] - entries[None]
    return (d * d).sum(axis=2)


def _exact(x: np.ndarray, *books: np.ndarray) -> tuple[np.ndarray, ...]:
    """``x`` and the codebooks as longs if no squared distance can overflow, else as Python's whole numbers."""
    most = max(float(np.abs(a.astype(np.float64)).max(initial=0)) for a in (x, *books))
    width = x.shape[-1]
    if most < math.sqrt(2.0**61 / max(1, width)) / 2:
        return tuple(a.astype(np.int64) for a in (x, *books))
    return tuple(a.astype(object) for a in (x, *books))


def _down(a: np.ndarray) -> np.ndarray:
    """Single precision, never above ``a``."""
    f = a.astype(np.float32)
    return np.where(f.astype(np.float64) > a, np.nextafter(f, np.float32(-np.inf)), f)


def closest(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows: the nearest entry (ties: the lower index), the next ``b`` in order with lower bounds, and the bound below
    all others."""
    d = _squares(x, entries)
    k = len(entries)
    own = np.arange(len(x))
    best = d.argmin(axis=1) if d.dtype != object else np.array([min(range(k), key=r.__getitem__) for r in d], np.int64)
    root = np.sqrt(d.astype(np.float64)) * (1 - SLACK)
    root[own, best] = -1.0  # the first in order
    b = min(b, k - 1)
    if b + 1 < k:
        order = np.argpartition(root, b + 1, axis=1)[:, : b + 2]
        r = np.take_along_axis(root, order, 1)
        by = r.argsort(axis=1, kind="stable")
        order, r = np.take_along_axis(order, by, 1), np.take_along_axis(r, by, 1)
        outer = r[:, -1]
        near, low = order[:, 1:-1], r[:, 1:-1]
    else:
        order = root.argsort(axis=1, kind="stable")
        near, low, outer = order[:, 1:], np.take_along_axis(root, order[:, 1:], 1), np.full(len(x), np.inf)
    return best, near, low, outer


def moved(was: np.ndarray, now: np.ndarray) -> np.ndarray:
    """How far each entry moved, rounded up."""
    d = (now.astype(object) - was.astype(object)).astype(np.float64)
    return np.sqrt((d * d).sum(axis=1)) * (1 + SLACK) + SLACK


def reassigned(x: np.ndarray, entries: np.ndarray, shift: np.ndarray, best: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The next assignment from kept bounds, and how many kept entries each row had to look at (``b`` + 1: all entries).

    Lower bounds fall by what their entries moved, the outer one by the farthest move of all. The distance to the own
    entry is computed anew in whole numbers. Rows whose bounds all lie above it keep their entry. Others look, in whole
    numbers, at the kept entries whose bound is not above; only where the outer bound is not above either, at all."""
    n = len(x)
    d = x - entries[best]
    mine = (d * d).sum(axis=1)
    upper = np.sqrt(mine.astype(np.float64)) * (1 + SLACK)
    low = low - shift[near] if near.shape[1] else low
    outer = outer - shift.max(initial=0.0)
    used = np.zeros(n, np.int64)
    full = outer <= upper
    close = (low <= upper[:, None]) & ~full[:, None]
    best, near, low, outer = best.copy(), near.copy(), low.copy(), outer.copy()
    some = np.flatnonzero(close.any(axis=1))
    if len(some):
        used[some] = near.shape[1] - close[some][:, ::-1].argmax(axis=1)
        ids = np.concatenate([best[some, None], near[some]], axis=1)
        diff = x[some][:, None, :] - entries[ids]
        dist = (diff * diff).sum(axis=2)
        far = np.concatenate([np.zeros((len(some), 1), bool), ~close[some]], axis=1)
        if dist.dtype == object:
            at = np.array([min((j for j in range(len(r)) if not f[j]), key=lambda j: (r[j], i[j])) for r, f, i in zip(dist, far, ids, strict=True)], np.int64)
        else:
            least = np.where(far, np.iinfo(np.int64).max, dist).min(axis=1)
            at = np.where((dist == least[:, None]) & ~far, ids, np.iinfo(np.int64).max).argmin(axis=1)
        root = np.sqrt(dist.astype(np.float64)) * (1 - SLACK)
        bound = np.concatenate([root[:, :1], np.where(close[some], root[:, 1:], low[some])], axis=1)
        keep = np.arange(ids.shape[1])[None] != at[:, None]
        best[some] = ids[np.arange(len(some)), at]
        near[some], low[some] = ids[keep].reshape(len(some), -1), bound[keep].reshape(len(some), -1)
    if near.shape[1]:
        by = low.argsort(axis=1, kind="stable")
        near, low = np.take_along_axis(near, by, 1), np.take_along_axis(low, by, 1)
    b = min(b, len(entries) - 1)
    if near.shape[1] > b:  # entries given up fall under the outer bound
        outer = np.minimum(outer, low[:, b])
        near, low = near[:, :b], low[:, :b]
    again = np.flatnonzero(full)
    if len(again):
        used[again] = near.shape[1] + 1
        w = near.shape[1]
        best[again], fresh, bound, out = closest(x[again], entries, w)
        near[again], low[again], outer[again] = fresh, bound, out
    return best, near, low, outer, used


class Books:
    """Codebooks of all parts, ``parts`` x ``entries`` x ``width``, as Python's whole numbers."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries

    def part(self, p: int) -> np.ndarray:
        a = np.array(self.entries[p], dtype=object)
        return a.astype(np.int64) if all(abs(v) < 2**62 for e in self.entries[p] for v in e) else a

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for p in self.entries for e in p for v in e).encode()).hexdigest()


def _part(x: np.ndarray, p: int, parts: int) -> np.ndarray:
    w = x.shape[1] // parts
    return x[:, p * w : (p + 1) * w]


def _state(batch: pa.RecordBatch, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    col = {c: b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()) for c in ("code", "near", "low", "outer")}
    return (np.frombuffer(col["code"], np.uint8).reshape(n, parts).astype(np.int64), np.frombuffer(col["near"], np.uint8).reshape(n, parts, -1).astype(np.int64),
            np.frombuffer(col["low"], np.float32).reshape(n, parts, -1).astype(np.float64), np.frombuffer(col["outer"], np.float32).reshape(n, parts).astype(np.float64))


def _packed(rows: np.ndarray, got: list[tuple]) -> pa.RecordBatch:
    """``STATE`` of one batch; ``got`` holds ``best, near, low, outer`` of each part."""
    code = np.stack([g[0] for g in got], 1).astype(np.uint8)
    near, low = np.stack([g[1] for g in got], 1).astype(np.uint8), _down(np.stack([g[2] for g in got], 1))
    outer = _down(np.stack([g[3] for g in got], 1))
    blobs = [[r.tobytes() for r in a] for a in (code, near, low, outer)]
    return pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(b, pa.binary()) for b in blobs)], ["row", "code", "near", "low", "outer"])


def assigned(vectors: DataFrame, books: Books, parts: int, kept: int) -> DataFrame:
    """``row, x, code`` and the bounds of the first assignment: all entries are compared."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, got = matrix(b.column(1)), []
            for p in range(parts):
                y, e = _exact(_part(x, p, parts), books.part(p))
                got.append(closest(y, e, kept))
            s = _packed(b.column(0).to_numpy(), got)
            yield pa.RecordBatch.from_arrays([*s.columns, b.column(1)], [*s.schema.names, "x"])

    return arrow(vectors.select("row", "x"), f"{STATE}, x array<long>", each)


def updated(state: DataFrame, was: Books, now: Books, parts: int, kept: int) -> DataFrame:
    """The next assignment, from the kept bounds; ``used``: how many rows and parts looked at so many kept entries."""
    shift = [moved(was.part(p), now.part(p)) for p in range(parts)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(b.schema.get_field_index("x")))
            code, near, low, outer = _state(b, parts)
            got, used = [], np.zeros((b.num_rows, parts), np.int64)
            for p in range(parts):
                y, e = _exact(_part(x, p, parts), now.part(p))
                *g, used[:, p] = reassigned(y, e, shift[p], code[:, p], near[:, p], low[:, p], outer[:, p], kept)
                got.append(tuple(g))
            s = _packed(b.column(0).to_numpy(), got)
            counts = pa.array(list(used.astype(np.uint8)), pa.list_(pa.uint8())).cast(pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([*s.columns, b.column(b.schema.get_field_index("x")), counts], [*s.schema.names, "x", "used"])

    return arrow(state.select("row", "code", "near", "low", "outer", "x"), f"{STATE}, x array<long>, used array<short>", each)


def means(state: DataFrame, books: Books, parts: int) -> Books:
    """Each entry replaced by its parts' componentwise floor(sum / count), exact; unused entries stay.

    Tasks add up their rows; their sums (parts x entries x width rows a task at most) are added by Spark as decimals, and
    the result has the codebooks' size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            x = matrix(b.column(1))
            code = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            high = float(np.abs(x.astype(np.float64)).max(initial=0)) * b.num_rows >= 2.0**62
            for p in range(parts if b.num_rows else 0):
                y = _part(x, p, parts)
                for e in np.unique(code[:, p]).tolist():
                    own = y[code[:, p] == e]
                    s = own.astype(object).sum(axis=0).tolist() if high else own.sum(axis=0).tolist()
                    at = sums.setdefault((p, e), [0] * (len(s) + 1))
                    for j, v in enumerate([*s, len(own)]):
                        at[j] += int(v)
        out = [(p, e, j, v) for (p, e), s in sums.items() for j, v in enumerate(s)]
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        from decimal import Decimal

        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), pa.array([Decimal(v) for v in cols[3]], pa.decimal128(38, 0))], ["p", "e", "j", "v"])

    got = arrow(state.select("code", "x"), "p int, e int, j int, v decimal(38,0)", each).groupBy("p", "e", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()
    width = len(books.entries[0][0])
    total = {(r.p, r.e, r.j): int(r.v) for r in got}
    return Books([[[total[p, e, j] // total[p, e, width] for j in range(width)] if (p, e, width) in total else own for e, own in enumerate(book)] for p, book in enumerate(books.entries)])


def bounds_to_keep(state: DataFrame, kept: int) -> int:
    """For the next round: so many kept entries that 95 of 100 rows that needed no full look would have found theirs."""
    used = {r.u: r["count"] for r in state.select(F.explode("used").alias("u")).groupBy("u").count().collect() if r.u <= kept}
    left = 0.95 * sum(used.values())
    for u in sorted(used):
        left -= used[u]
        if left <= 0:
            return max(FEWEST, min(kept, u + 1))
    return kept


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> DataFrame:
    """``id, code, error, label_error, codebooks_sha256`` of each row with a vector of finite components.

    Codebooks start as the ``entries`` first rows by id (then by components, where ids repeat; null ids last); fewer rows
    make smaller codebooks. Every assignment is exact in whole numbers, ties go to the lower index. The first compares
    all entries and keeps, for each part of each vector, the closest ones in order with a lower bound each, and one bound
    below all others; they are written as a table. After entries have moved, bounds fall by the moves, and only parts whose
    bounds don't decide are compared again, the few kept entries first. How many are kept follows what a round used.

    Rows whose vector is null, empty, or has null or non-finite components are left out; so are vectors of another length
    than the commonest one (the longer of equally common), which no codebook fits. A length that ``parts`` does not
    divide is an error. Components beyond +-2^62 after scaling are held there; an error beyond a long is null. Repeated
    ids are separate rows; null labels are one label. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    before = made(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    out_schema = f"id {kind}, code string, error long, label_error long, codebooks_sha256 string"
    good = vectors.where(finite(vector_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), whole(vectors, vector_col, scale).alias("x"))
    rows = table(good.withColumn("row", F.monotonically_increasing_id()), "code-vectors")
    d = commonest_length(rows, "x")
    if not d:
        return spark.createDataFrame([], out_schema)
    if d % parts:
        raise ValueError(f"vectors of {d} components cannot be cut into {parts} equal parts")
    rows = rows.where(F.size("x") == d)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    w = d // parts
    books = Books([[list(r.x[p * w : (p + 1) * w]) for r in first] for p in range(parts)])
    kept, state, was = KEPT, table(assigned(rows, books, parts, KEPT), "code-bounds"), None
    for _ in range(rounds):
        was, books = books, means(state, books, parts)
        old, state = made(spark)[-1], table(updated(state, was, books, parts, kept), "code-bounds")
        discard(spark, old)
        kept = bounds_to_keep(state, kept)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(2))
            code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, parts)
            total: list[int] = [0] * b.num_rows
            for p in range(parts):
                y, e = _exact(_part(x, p, parts), books.part(p))
                diff = y - e[code[:, p]]
                total = [a + int(s) for a, s in zip(total, (diff * diff).sum(axis=1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array([t if t < 2**63 else None for t in total], pa.int64())], ["row", "code", "error"])

    coded = table(arrow(state.select("row", "code", "x"), "row long, code string, error long", finish), "code-codes")
    both = coded.join(rows.select("row", "id", "label"), "row")
    # few labels go to every task; more meet their rows in a sorted join, which splits a hot label
    sums = table(both.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "l"), "code-labels")
    few = sums.limit(SENT + 1).count() <= SENT
    out = both.join(F.broadcast(sums) if few else sums, both.label.eqNullSafe(sums.l))
    for at in made(spark):
        if at not in before and "code-bounds" in at:
            discard(spark, at)
    return out.select("id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every row of ``embeddings`` with a finite vector; what
    ``encode`` says of nulls, lengths, ties and repeated ids holds."""
    return encode(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
