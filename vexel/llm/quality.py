"""Quality rules: base counts, then robust multivariate outliers by minimum covariance determinant (MCD)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.llm.common import WORD, arrow, cut, parts, read, table

SYMBOL = re.compile(r"[#*$%&|<>]")
#: Transformed statistics: name, and the least standard deviation that the estimate may have. Without a floor the many
#: texts that share a value exactly (no symbol, no repeat) would make the covariance singular and reject all others.
STATS = (("log_words", 0.5), ("word_len", 0.5), ("symbols", 0.1), ("dup_lines", 0.15), ("repeats", 0.15), ("capitals", 0.1))
P = len(STATS)
#: Share of a group that the determinant is minimised over, and the chi-square tail beyond which a row is rejected.
SHARE, TAIL = 0.75, 1e-5
#: Distances are binned by their logarithm, so many bins a factor of two; moments are summed by bin.
BINS_PER_OCTAVE, OCTAVES = 8, 24
#: Up to so many groups their estimates (about 60 numbers each) go to the tasks whole; above, they are joined.
MODEL_ROWS = 20_000
#: A start is settled once a step lowers the logarithm of its determinant by no more than this.
SETTLED = 1e-3


def counts(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, upper-case letters."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeat = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        seen = Counter(grams)
        if len(seen) < len(grams):
            end = 0
            for i, g in enumerate(grams):
                if seen[g] > 1:
                    repeat += i + 3 - max(end, i)
                    end = i + 3
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeat, len(lines), sum(map(str.isupper, text))


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def statistics(n: np.ndarray, chars: np.ndarray, sym: np.ndarray, dup: np.ndarray, rep: np.ndarray, lines: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The transformed vectors: logarithm of the length, mean word length, square roots of shares (all 0 to 1)."""
    words = np.maximum(n, 1)
    share = lambda a, b: np.sqrt(np.clip(a / np.maximum(b, 1), 0, 1))
    return np.stack([np.log1p(n), np.minimum(chars / words, 64.0), share(sym, words), share(dup, lines), share(rep, words), share(upper, chars)], axis=1)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def measured(docs: DataFrame, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``docs``, without its text unless asked for, with the base counts and ``x``, the statistic vector. Columns of
    ``docs`` with one of these names, or named ``__text``, are dropped; null texts have no words."""
    docs = docs.drop(*[c for c in (*BASE, "x", "__text") if c != text_col])
    keep = [c for c in docs.columns if with_text or c != text_col]
    at = len(keep)
    fields = ", ".join(f"{c} long" for c in BASE)
    src = docs.select(*keep, F.col(text_col).alias("__text"))
    names = [*keep, *BASE, "x"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([counts(t.as_py()) for t in b.column(at)], np.int64).reshape(-1, len(BASE))
            x = statistics(*got.T.astype(float))
            xs = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), P).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *(pa.array(np.ascontiguousarray(c)) for c in got.T), xs], names)

    extra = T._parse_datatype_string(f"{fields}, x array<double>")
    return arrow(src, T.StructType([*src.schema.fields[:at], *extra.fields]), each)


def chi2_cut(p: int, tail: float) -> float:
    """Wilson-Hilferty approximation of the chi-square quantile."""
    lo, hi = 0.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(mid / math.sqrt(2)) > tail else (lo, mid)
    return p * (1 - 2 / (9 * p) + lo * math.sqrt(2 / (9 * p))) ** 3


def consistency(p: int, share: float) -> float:
    """Factor that makes the covariance of the ``share`` nearest rows of a normal sample unbiased."""
    q = chi2_cut(p, 1 - share)
    k, x, n = p / 2 + 1, q / 2, 400
    t = np.linspace(0, x, n + 1)  # regularised lower gamma(k, x) by Simpson's rule
    f = t ** (k - 1) * np.exp(-t)
    low = (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()) * (x / n) / 3 / math.gamma(k)
    return share / low


FLOOR = np.diag([s * s for _, s in STATS])
M = 1 + P + P * (P + 1) // 2  # count, sums, sums of products
UP = np.triu_indices(P)


def moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x, x[:, UP[0]] * x[:, UP[1]]], axis=1)


def estimate(m: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    n = max(m[0], 1.0)
    mean = m[1 : P + 1] / n
    cov = np.zeros((P, P))
    cov[UP] = m[P + 1 :] / n
    cov = cov + np.triu(cov, 1).T
    return mean, (cov - np.outer(mean, mean)) * scale + FLOOR


def bins_of(x: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, inv = model[:P], model[P : P + P * P].reshape(P, P)
    d = x - mean
    d2 = np.einsum("ij,jk,ik->i", d, inv, d)
    return d2, np.clip(np.floor(np.log2(np.maximum(d2, 2.0**-8)) * BINS_PER_OCTAVE).astype(np.int64) + 8 * BINS_PER_OCTAVE, 0, OCTAVES * BINS_PER_OCTAVE)


def packed(mean: np.ndarray, cov: np.ndarray) -> list[float]:
    return [*mean.tolist(), *np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])]


def with_model(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``rows`` with the ``model`` of their group. Few models (checked) are broadcast; many meet hot groups' rows in a
    join on the group and a salt, each model once a salt."""
    if models.count() <= MODEL_ROWS:
        return rows.join(F.broadcast(models), "g")
    n = parts(rows.sparkSession)
    salted = models.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("__s", F.pmod(F.xxhash64("x"), F.lit(n)).cast("int")).join(salted, ["g", "__s"]).drop("__s")


class Sums:
    """Moments by group, start and bin, within a task."""

    def __init__(self):
        self.total: dict[tuple, np.ndarray] = {}

    def add(self, g: str, s: int, x: np.ndarray, model: np.ndarray) -> None:
        bins = bins_of(x, model)[1] if len(model) else np.zeros(len(x), np.int64)
        order = np.argsort(bins, kind="stable")
        at = np.flatnonzero(np.diff(bins[order], prepend=-1))
        for k, m in zip(bins[order][at].tolist(), np.add.reduceat(moments(x)[order], at, axis=0), strict=True):
            self.total[g, s, k] = self.total[g, s, k] + m if (g, s, k) in self.total else m

    def out(self) -> pa.RecordBatch:
        g, s, k = zip(*self.total, strict=True)
        m = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(list(self.total.values()))), M).cast(pa.list_(pa.float64()))
        self.total = {}
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(s, pa.int32()), pa.array(k, pa.int32()), m], ["g", "s", "bin", "m"])


def summed(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Moments of the ``x`` of ``rows(g, x)`` by group, start and bin of the distance under each of ``models(g, s, model)``.

    One scan with a map-side combine. Few models (checked) go to the tasks as they are; many meet their rows in a join.
    """
    x_of = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(-1, P)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for b in batches:
            g, x = b.column(0).dictionary_encode(), x_of(b.column(1))
            code = g.indices.to_numpy()
            for i, name in enumerate(g.dictionary.to_pylist()):
                for s, model in sent.value.get(name, ()):
                    sums.add(name, s, x[code == i], model)
            if len(sums.total) > 50_000:
                yield sums.out()
        if sums.total:
            yield sums.out()

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for b in batches:
            x = x_of(b.column(2))
            key = np.array([f"{s} {g}" for g, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], object)
            for k in dict.fromkeys(key.tolist()):
                at = np.flatnonzero(key == k)
                s, _, g = k.partition(" ")
                sums.add(g, int(s), x[at], np.array(b.column(3)[int(at[0])].as_py()))
            if len(sums.total) > 50_000:
                yield sums.out()
        if sums.total:
            yield sums.out()

    schema = "g string, s int, bin int, m array<double>"
    if models.count() <= MODEL_ROWS:
        known: dict[str, list] = {}
        for r in models.collect():
            known.setdefault(r.g, []).append((r.s, np.array(r.model)))
        sent = rows.sparkSession.sparkContext.broadcast(known)
        got = arrow(rows.select("g", "x"), schema, few)
    else:
        got = arrow(with_model(rows.select("g", "x"), models).select("g", "s", "x", "model"), schema, many)
    return got.groupBy("g", "s", "bin").agg(F.array(*[F.sum(F.col("m")[i]) for i in range(M)]).alias("m"))


STATE = "g string, s int, model array<double>"


def step(share: float, factor: float):
    """A group's and start's model from its moments by bin: the nearest rows, as far as the bin that reaches ``share``."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        m = np.stack(pdf.m.to_numpy())
        c = m[:, 0].cumsum()
        upto = int(np.searchsorted(c, share * c[-1] - 1e-9)) + 1
        return pd.DataFrame({"g": [pdf.g.iloc[0]], "s": [pdf.s.iloc[0]], "model": [packed(*estimate(m[:upto].sum(axis=0), factor))]})

    return each


def medians(pdf: pd.DataFrame) -> pd.DataFrame:
    """A group's first start: medians of the coordinates, scales from their quartiles."""
    q = np.zeros((3, P))
    for j in range(P):
        own = pdf[pdf.j == j].sort_values("v")
        c = own.n.cumsum().to_numpy()
        for k, share in enumerate((0.25, 0.5, 0.75)):
            q[k, j] = own.v.to_numpy()[np.searchsorted(c, share * c[-1])]
    return pd.DataFrame({"g": [pdf.g.iloc[0]], "s": [0], "model": [packed(q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + FLOOR)]})


def mcd(rows: DataFrame) -> DataFrame:
    """``g, model``: by group, mean, inverse covariance and log determinant of the MCD estimate of all rows' ``x``.

    Two starts (the coordinates' medians with scales from their quartiles, and all rows' moments) are concentrated
    together. A concentration step takes rows by distance, as far as the bin (of width 2^(1/8)) in which the share is
    reached, and re-estimates; moments are summed by group, start and bin, so a step is one scan with a map-side combine
    and gathers at most bins x starts rows a group, however many rows it has. A start goes on as long as a step lowers
    its determinant by more than SETTLED (so it ends), then leaves the scan. The start with the least determinant wins,
    and is reweighted by all rows below the 0.975 quantile. Results don't depend on the order or the partitioning
    beyond the rounding of sums.
    """
    scale, scale_w = consistency(P, SHARE), consistency(P, 0.975)
    grid = F.posexplode(F.transform("x", lambda v: F.round(v * 50) / 50))
    quant = rows.select("g", grid.alias("j", "v")).groupBy("g", "j", "v").agg(F.count("*").alias("n"))
    first = quant.groupBy("g").applyInPandas(medians, STATE)
    none = rows.select("g").distinct().select("g", F.lit(1).alias("s"), F.array().cast("array<double>").alias("model"))
    every = summed(rows, cut(none)).groupBy("g", "s").applyInPandas(step(1.0, 1.0), STATE)
    concentrated = lambda models: summed(rows, models).groupBy("g", "s").applyInPandas(step(SHARE, scale), STATE)
    now, settled = cut(concentrated(cut(first.union(every)))), []
    det = lambda c: F.element_at(c, -1)
    while now.limit(1).count():
        new = concentrated(now).select("g", "s", F.col("model").alias("new"))
        both = cut(now.join(new, ["g", "s"]).withColumn("better", det("new") < det("model") - SETTLED))
        settled.append(both.where("not better").select("g", "s", "model"))
        now = both.where("better").select("g", "s", F.col("new").alias("model"))
    models = now
    for s in settled:
        models = models.union(s)
    best = models.groupBy("g").agg(F.min_by(F.struct("s", "model"), F.struct(det("model"), "s")).alias("b")).select("g", "b.s", "b.model")
    top = math.floor(math.log2(chi2_cut(P, 0.025)) * BINS_PER_OCTAVE) + 8 * BINS_PER_OCTAVE
    near = summed(rows, cut(best)).where(F.col("bin") <= top)
    return cut(near.groupBy("g", "s").applyInPandas(step(1.0, scale_w), STATE).select("g", "model"))


def group_key(lang: str = "lang", source: str = "source"):
    """Null is a group of its own, apart from any string."""
    part = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.length(c).cast("string"), F.lit(":"), F.col(c)))
    return F.concat(part(lang), F.lit("|"), part(source))


def judged(docs: DataFrame, text_col: str = "text", tail: float = TAIL, with_text: bool = False) -> DataFrame:
    """All columns of ``docs`` (its text only if asked for), with the base counts, base_failed, distance and kept, a row for each row.

    Estimates are made for each language and source from the rows that pass the base rules; a group without such a row
    has no estimate, and its rows keep the base verdict. Null texts have no words and fail. A group too small to define
    a covariance relies on the variance floors. Repeated rows are judged (and weigh) each. Input columns whose names
    clash with the added ones are replaced.
    """
    docs = docs.drop(*[c for c in (*BASE, "x", "g", "base_failed", "distance", "kept") if c in docs.columns])
    rows = table(measured(docs.withColumn("g", group_key()), text_col, with_text).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "quality")
    models = mcd(rows.where("not base_failed").select("g", "x"))
    known = models.groupBy("g").agg(F.first("model").alias("model"))
    groups = rows.select("g").distinct().join(known, "g", "left")
    d = F.expr(f"""aggregate(sequence(0, {P * P - 1}), 0D, (s, i) -> s + (x[i div {P}] - model[i div {P}]) * (x[i % {P}] - model[i % {P}]) * model[{P} + i])""")
    got = with_model(rows, cut(groups)).withColumn("distance", d)
    return got.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_cut(P, tail), F.lit(True))).drop("g", "x", "model")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and the distance for every row of ``documents``; nulls, empty
    texts, repeats and empty tables as in ``judged``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
