"""Whitening of vectors: eigenvectors kept up row by row by rank-one updates, combined over partitions, then refined."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import arrow, read, table
from vexel.llm.vectors import commonest_length, exact_squares, finite, matrix, whole

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Partial results that one task combines.
FAN = 16
EPS = float(np.finfo(np.float64).eps)


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``diag(d) + rho z z'`` and the matrix of ``d_j - lambda_i`` (row i), for strictly rising ``d``, no
    zero in ``z`` and ``rho > 0``.

    Root i lies between d_i and d_{i+1}, the last one below d_n + rho |z|^2. It is found as a distance from the nearer
    pole, so that differences to poles keep full relative precision; steps of a two-pole rational fit, halving whenever
    one would leave the bracket."""
    n = len(d)
    z2 = rho * z * z
    gap = np.append(d[1:], d[-1] + z2.sum()) - d
    mid = d + gap / 2
    at_mid = 1 + (z2 / (d - mid[:, None])).sum(axis=1)
    left = at_mid > 0  # the root is in the left half: its own pole is the nearer one
    left[-1] = True
    pole = np.where(left, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    delta = d - d[pole][:, None]  # poles as seen from each origin
    lo = np.where(left, 0.0, -gap / 2)
    hi = np.where(left, np.where(np.arange(n) == n - 1, gap, gap / 2), 0.0)
    lower = np.tri(n, dtype=bool)  # poles at or left of the root
    t = (lo + hi) / 2
    near, far = np.arange(n), np.minimum(np.arange(n) + 1, n - 1)
    d1, d2 = delta[np.arange(n), near], delta[np.arange(n), far]
    for _ in range(80):
        diff = delta - t[:, None]
        diff = np.where(diff == 0, EPS * np.maximum(np.abs(hi), np.abs(lo))[:, None] + 1e-300, diff)
        term = z2 / diff
        slope = term / diff
        f = 1 + term.sum(axis=1)
        size = 1 + np.abs(term).sum(axis=1)
        lo, hi = np.where(f < 0, t, lo), np.where(f < 0, hi, t)
        settled = (np.abs(f) <= 4 * EPS * n * size) | (hi - lo <= 4 * EPS * np.maximum(np.abs(hi), np.abs(lo)))
        if settled.all():
            break
        psi, phi = (slope * lower).sum(axis=1), (slope * ~lower).sum(axis=1)
        a1, a2 = d1 - t, d2 - t
        # f is taken as c + s1 / (d1 - x) + s2 / (d2 - x), equal to it in value and in both slopes
        s1, s2 = psi * a1 * a1, phi * a2 * a2
        c = f - psi * a1 - phi * a2
        one = np.arange(n) == n - 1  # no pole to the right of the last root
        b = c * (a1 + a2) + s1 + s2
        q = f * a1 * a2
        root = np.sqrt(np.maximum(b * b - 4 * c * q, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(b > 0, 2 * q / (b + root), (b - root) / (2 * c))
            step = np.where(one, a1 + s1 / np.where(c == 0, 1e-300, c), step)
        new = t + step
        t = np.where(settled, t, np.where((new > lo) & (new < hi) & np.isfinite(new), new, (lo + hi) / 2))
    return d[pole] + t, delta - t[:, None]


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``u diag(d) u' + rho v v'``.

    Deflation: components of ``v`` that are negligible leave their pair as it is, and of equal eigenvalues all but one
    are turned (a reflection within their space) so that they are."""
    z = u.T @ v
    norm2 = float(z @ z)
    if rho * norm2 <= 0:
        return d, u
    scale = max(abs(d[0]), abs(d[-1]), rho * norm2)
    tol = 8 * EPS * scale
    run = np.flatnonzero(np.diff(d) <= tol)
    if len(run):
        u = u.copy()
        d = d.copy()
        ends = np.split(run, np.flatnonzero(np.diff(run) > 1) + 1)
        for group in ends:
            a, b = group[0], group[-1] + 2
            w = z[a:b].copy()
            size = np.sqrt(w @ w)
            if size > 0:
                w[-1] += np.copysign(size, w[-1])
                w /= np.sqrt(w @ w)
                u[:, a:b] -= 2 * np.outer(u[:, a:b] @ w, w)
                z[a:b] = 0
                z[b - 1] = -np.copysign(size, w[-1])
            d[a:b] = d[a:b].mean()
    own = np.flatnonzero(rho * np.abs(z) * np.sqrt(norm2) > tol)
    # after the reflections equal values are apart, but for chains within the tolerance
    own = own[np.append(np.diff(d[own]) > 0, True)] if len(own) else own
    if not len(own):
        return d, u
    values, away = secular(d[own], z[own], rho)
    # vectors from the z for which these values are exact, so that they are orthogonal
    k = len(own)
    ratio = np.abs(away)  # |d_j - lambda_i|, row i
    gaps = np.abs(d[own][:, None] - d[own][None, :])
    np.fill_diagonal(gaps, 1.0)
    with np.errstate(divide="ignore"):
        logs = np.log(ratio).sum(axis=0) - np.log(gaps).sum(axis=0)
    fit = np.copysign(np.exp(logs / 2), z[own])
    w = fit / away  # row i: the eigenvector of value i
    w /= np.sqrt((w * w).sum(axis=1, keepdims=True))
    new_u, new_d = u.copy(), d.copy()
    new_u[:, own], new_d[own] = u[:, own] @ w.T, values
    order = np.argsort(new_d, kind="stable")
    assert k == len(values)
    return new_d[order], new_u[:, order]


class Spectrum:
    """Count, mean, and eigenvalues and eigenvectors of the centred scatter of the rows seen."""

    def __init__(self, dims: int):
        self.n, self.mean, self.d, self.u = 0, np.zeros(dims), np.zeros(dims), np.eye(dims)

    def add(self, x: np.ndarray) -> None:
        delta = x - self.mean
        if self.n:
            self.d, self.u = rank_one(self.d, self.u, delta, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + delta / self.n

    def join(self, other: Spectrum) -> None:
        """The other's scatter as rank-one updates, one for each of its pairs, and one for the means' distance."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.d, self.u = other.n, other.mean, other.d, other.u
            return
        for value, vector in zip(other.d, other.u.T, strict=True):
            if value > 0:
                self.d, self.u = rank_one(self.d, self.u, vector, float(value))
        delta, n = other.mean - self.mean, self.n + other.n
        self.d, self.u = rank_one(self.d, self.u, delta, self.n * other.n / n)
        self.mean, self.n = self.mean + delta * (other.n / n), n

    def blob(self) -> bytes:
        return np.concatenate([[float(self.n)], self.mean, self.d, self.u.ravel()]).tobytes()

    @classmethod
    def of(cls, blob: bytes, dims: int) -> Spectrum:
        a = np.frombuffer(blob)
        s = cls(dims)
        s.n, s.mean, s.d, s.u = int(a[0]), a[1 : dims + 1], a[dims + 1 : 2 * dims + 1], a[2 * dims + 1 :].reshape(dims, dims)
        return s


def combined(partial: DataFrame, combine: Callable[[list[bytes]], bytes], label: str) -> bytes | None:
    """One blob from ``partial(part, blob)``: FAN at a time in tasks, level by level, in the order of ``part``."""
    partial = table(partial, label)
    while True:
        n = partial.count()
        if n <= 1:
            got = partial.first()
            return bytes(got.blob) if got else None

        def each(pdf: pd.DataFrame) -> pd.DataFrame:
            blobs = [bytes(b) for b in pdf.sort_values("part").blob]
            return pd.DataFrame({"part": [int(pdf.group.iloc[0])], "blob": [combine(blobs)]})

        ranked = partial.withColumn("place", F.expr("row_number() over (order by part)")) if n <= FAN * FAN else partial.withColumn("place", F.col("part"))
        grouped = ranked.select(F.floor((F.col("place") - 1) / FAN).cast("long").alias("group"), "part", "blob")
        partial = table(grouped.groupBy("group").applyInPandas(each, "part long, blob binary"), label)


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def totals(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of rows and their exact sum in each dimension: tasks add up theirs, Spark adds those as decimals."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, [0] * dims
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                high = float(np.abs(x.astype(np.float64)).max()) * len(x) >= 2.0**62
                n += len(x)
                s = [a + int(v) for a, v in zip(s, (x.astype(object) if high else x).sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array([Decimal(v) for v in [*s, n]], pa.decimal128(38, 0))], ["j", "v"])

    got = {r.j: int(r.v) for r in arrow(rows.select("x"), "j int, v decimal(38,0)", each).groupBy("j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}
    return got.get(dims, 0), [got.get(j, 0) for j in range(dims)]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``x - S/n`` in double precision: whole parts are taken off before the division, so nothing cancels."""
    base = np.array([t // n for t in total], dtype=object)
    rest = np.array([(t % n) / n for t in total])
    small = all(abs(v) < 2**61 for v in base.tolist()) and float(np.abs(x.astype(np.float64)).max(initial=0)) < 2.0**61
    return (x - base.astype(np.int64) if small else x.astype(object) - base).astype(np.float64) - rest


def spectrum(rows: DataFrame, n: int, total: list[int], dims: int) -> Spectrum:
    """Tasks update their spectrum row by row; spectra join in a tree. Rows are centred on the exact mean first, which
    takes nothing from the method (each task still follows its own mean) and keeps the numbers small."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum(dims)
        for b in batches:
            for x in centred(matrix(b.column(0)), n, total) if b.num_rows else ():
                s.add(x)
        if s.n:
            yield pa.RecordBatch.from_arrays([pa.array([_partition()], pa.int64()), pa.array([s.blob()], pa.binary())], ["part", "blob"])

    def join(blobs: list[bytes]) -> bytes:
        s = Spectrum.of(blobs[0], dims)
        for b in blobs[1:]:
            s.join(Spectrum.of(b, dims))
        return s.blob()

    return Spectrum.of(combined(arrow(rows.select("x"), "part long, blob binary", each), join, "white-spectra"), dims)


def projected(rows: DataFrame, n: int, total: list[int], basis: np.ndarray) -> np.ndarray:
    """``basis' V basis`` over all rows, each centred before multiplying: sums of blocks in tasks, joined in a tree."""
    k = basis.shape[1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                y = centred(matrix(b.column(0)), n, total) @ basis
                h += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([_partition()], pa.int64()), pa.array([h.tobytes()], pa.binary())], ["part", "blob"])

    def add(blobs: list[bytes]) -> bytes:
        return np.sum([np.frombuffer(b) for b in blobs], axis=0).tobytes()

    return np.frombuffer(combined(arrow(rows.select("x"), "part long, blob binary", each), add, "white-products")).reshape(k, k) / n


def refine(rows: DataFrame, n: int, total: list[int], basis: np.ndarray, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz over all rows: eigenpairs (falling) of ``basis' V basis``, until what is off the diagonal is rounding."""
    basis = np.linalg.qr(basis)[0]
    for _ in range(most):
        h = projected(rows, n, total, basis)
        h = (h + h.T) / 2
        values, turn = np.linalg.eigh(h)
        values, turn = values[::-1], turn[:, ::-1]
        basis = basis @ turn
        off = np.abs(h - np.diag(np.diag(h))).max()
        if off <= 1e-12 * max(values[0], 1e-300):
            break
    return values, basis


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row for each vector of finite components
    and each of the first ``components`` eigenvectors (fewer dimensions: all of them) of the covariance of all of them.

    Each component c becomes ``floor(scale * c) + shift``; sums are exact, and rows are centred before multiplying.
    Tasks keep an eigendecomposition of their rows' scatter by centred rank-one updates; spectra join by rank-one
    updates; a distributed Rayleigh-Ritz step over all rows gives values and vectors to double precision.

    Rows whose vector is null, empty, or has null or non-finite components are left out, as are vectors of another length
    than the commonest one (the longer of equally common), which no covariance takes. Directions without variance (equal
    rows, a single row, more dimensions than rows) have whitened and explained 0 and take no part in identity_error.
    Equal eigenvalues have any basis of their space, the same for all rows. Components are held within +-2^62 after
    scaling, a deviation beyond a long is null. Repeated ids are separate rows; an empty table gives an empty result;
    other columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = table(vectors.where(finite(vector_col)).select(F.col(id_col).alias("id"), whole(vectors, vector_col, scale, shift).alias("x")), "white-rows")
    dims = commonest_length(rows, "x")
    if not dims:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == dims)
    n, total = totals(rows, dims)
    values, basis = refine(rows, n, total, spectrum(rows, n, total, dims).u[:, ::-1])
    trace = float(values.sum())
    real = values > dims * EPS * max(values[0], 0.0)
    k = min(components, dims)
    weights = np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)[:k]
    explained = np.where(real[:k], values[:k] / trace if trace > 0 else 0.0, 0.0)
    turn = basis[:, :k] * weights
    off = np.abs(projected(rows, n, total, turn) - np.eye(k))[np.ix_(real[:k], real[:k])]
    error = float(off.max()) if off.size else 0.0

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_ in batches:
            for at in range(0, whole_.num_rows, 512):
                b = whole_.slice(at, 512)
                x = matrix(b.column(1))
                big = float(np.abs(x.astype(np.float64)).max()) * n >= 2.0**61 or max(map(abs, total)) >= 2**61
                s = np.array(total, dtype=object if big else np.int64)
                deviation = exact_squares((x.astype(object) if big else x) * n - s)
                y = centred(x, n, total) @ turn
                m = len(x)
                take = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(deviation, pa.int64()).take(take), pa.array(y.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return arrow(rows, schema, each)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every row of ``embeddings`` with a
    finite vector and 32 components; what ``whiten`` says of nulls, lengths and missing variance holds."""
    return whiten(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
