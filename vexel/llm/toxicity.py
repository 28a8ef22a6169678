"""Toxicity by compression distance: zstandard dictionaries of ordinary and of toxic text, windows compressed with both."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import arrow, read, table

WORD = re.compile(r"\w+")
#: A window has so many words; the next one begins so many words later.
WINDOW, STEP = 12, 6
#: Bounds of the training sample: rows of each class with the least hashes, and bytes of text in all and of one text.
ROWS, BYTES, LONGEST = {0: 4000, 1: 2500}, 24 << 20, 1 << 20
#: Sizes asked of the dictionary trainer, and the lengths of its segments.
ORDINARY, TOXIC, SEGMENT_ORDINARY, SEGMENT_TOXIC = 1 << 16, 1 << 13, 12, 20
#: A word counts as toxic if it is in no ordinary text of the sample and in so many toxic ones, or this share of them.
RECURS, SHARE = 2, 0.005
FOLDS = 3
#: Gains (bytes that the toxic dictionary saves on a window) are kept as a histogram up to this.
MOST = 24
PREDICT = 0.3


def words(text: str | None) -> Iterator[str]:
    """Lower-cased words, one by one."""
    return (m.group() for m in WORD.finditer((text or "").lower()))


def windows(text: str | None, size: int = WINDOW, step: int = STEP) -> Iterator[bytes]:
    """Windows of ``size`` words, ``step`` apart, up to the text's end, as spaced UTF-8; none for a text without words."""
    left, run = words(text), []
    while True:
        more = list(itertools.islice(left, size - len(run)))
        if not more and run:
            return
        run += more
        if not run:
            return
        yield f" {' '.join(run)} ".encode("utf-8", "replace")
        if len(run) < size:
            return
        run = run[step:]


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """What the library's trainer picks from ``samples``, as plain content; samples too few to train on are taken whole."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        got = zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    # after the header with entropy tables, which hold for longer inputs, the content is at the end
    return got[min(len(got) // 4, 300) :]


class Compressors:
    """Window lengths after ordinary text alone, and after ordinary and toxic text: the difference is the toxic gain."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=6, min_match=6, target_length=32, strategy=zstandard.STRATEGY_LAZY, write_checksum=False, write_content_size=False, write_dict_id=False)
        self._by = []
        for content in (ordinary, ordinary + toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            if content:
                d.precompute_compress(compression_params=how)
            self._by.append(zstandard.ZstdCompressor(compression_params=how, **({"dict_data": d} if content else {})).compress)

    def gains(self, text: str | None) -> np.ndarray:
        """How many windows of the whole text have each gain, 0 or less first, MOST or more last."""
        a, b = self._by
        out = [0] * (MOST + 1)
        for w in windows(text):
            out[min(MOST, max(0, len(a(w)) - len(b(w))))] += 1
        return np.array(out, np.float64)


def features(counts: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Of histograms (rows), against ``plain``, the shares of ordinary windows with at least each gain: the excess over
    what so many ordinary windows have, in standard deviations, shares, and how rare the greatest gain is among so many
    windows. So a text's length alone moves nothing."""
    n = counts.sum(axis=1, keepdims=True)
    tail = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
    share = tail / np.maximum(n, 1)
    top = np.where(counts > 0, np.arange(counts.shape[1]), 0).max(axis=1)
    rare = -np.log(np.maximum(n[:, 0], 1) * plain[top])
    excess = (tail - n * plain) / np.sqrt(n * plain + 1)
    return np.hstack([np.arcsinh(excess[:, [2, 3, 4, 6]]), (share - plain)[:, [2, 3, 5]] * 4, np.clip(rare, -4, 8)[:, None] / 2, (share - plain)[:, 1:].sum(axis=1, keepdims=True)])


def plain_shares(counts: np.ndarray) -> np.ndarray:
    """Shares of windows with at least each gain, in histograms of ordinary texts."""
    total = counts.sum(axis=0)
    return (np.cumsum(total[::-1])[::-1] + 0.5) / (total.sum() + 1)


def calibrate(x: np.ndarray, y: np.ndarray, pull: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic weights (last: constant) by Newton steps, pulled to zero but for the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([pull] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def train_dictionaries(ordinary: list[str], toxic: list[str]) -> Compressors:
    """The ordinary dictionary is trained on each ordinary text's words. The toxic one on words of toxic texts that recur
    there and are in no ordinary text; a passage of five words counts in the first text that has it, so copies do not."""
    plain = [dict.fromkeys(words(t)) for t in ordinary]
    known = set().union(*plain) if plain else set()
    seen, own = set(), []
    for t in toxic:
        w, new = list(words(t)), {}
        for i in range(len(w)):
            passage = zlib.crc32(" ".join(w[i : i + 5]).encode("utf-8", "replace")), len(w[i])
            if passage not in seen:
                seen.add(passage)
                new.update(dict.fromkeys(w[i : i + 5]))
        own.append([x for x in new if x not in known])
    df = Counter(x for s in own for x in s)
    least = max(RECURS, int(np.ceil(SHARE * len(toxic))))
    own = [sorted(x for x in s if df[x] >= least) for s in own]

    def samples(sets: list) -> list[bytes]:
        return [f" {' '.join(sorted(s))} ".encode("utf-8", "replace") for s in sets if s]

    return Compressors(dictionary(samples(plain), ORDINARY, SEGMENT_ORDINARY), dictionary(samples(own), TOXIC, SEGMENT_TOXIC))


class Model:
    """Both dictionaries and the calibration; without both classes in the sample, the score is the share of toxic rows."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: list[float], rate: float, plain: list[float] = ()):
        self.blobs, self.weights, self.rate, self.plain = (ordinary, toxic), np.array(weights), rate, np.array(plain)
        self._compressors: Compressors | None = None

    @classmethod
    def fit(cls, texts: list[str], labels: list[int]) -> Model:
        """One row in FOLDS of each class calibrates the gains under dictionaries that are trained on the others."""
        y = np.array(labels, np.float64)
        rate = float(y.mean()) if len(y) else 0.0
        if len(set(labels)) < 2 or min(np.bincount(y.astype(int))) < FOLDS:
            return cls(b"", b"", [], rate)
        place = np.zeros(len(y), int)
        for c in (0, 1):
            at = np.flatnonzero(y == c)
            place[at] = np.arange(len(at)) % FOLDS
        made = train_dictionaries([t for t, c, p in zip(texts, labels, place, strict=True) if p and not c], [t for t, c, p in zip(texts, labels, place, strict=True) if p and c])
        own = np.flatnonzero(place == 0)
        counts = np.stack([made.gains(texts[i]) for i in own])
        plain = plain_shares(counts[y[own] == 0])
        return cls(made.ordinary, made.toxic, calibrate(features(counts, plain), y[own]).tolist(), rate, plain.tolist())

    def __getstate__(self):
        return self.blobs, self.weights, self.rate, self.plain

    def __setstate__(self, state):
        self.blobs, self.weights, self.rate, self.plain = state
        self._compressors = None

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.rate)
        if self._compressors is None:
            self._compressors = Compressors(*self.blobs)
        if not texts:
            return np.zeros(0)
        x = features(np.stack([self._compressors.gains(t) for t in texts]), self.plain)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def remainder(id_: str = "doc_id", of: int = 4) -> F.Column:
    return F.crc32(F.col(id_).cast("string").cast("binary")) % of


def train(docs: DataFrame, labels: DataFrame, rest: int = 2) -> Model:
    """Learns from labelled documents whose remainder is not ``rest``: of each class the ROWS with the least hashes, at
    most BYTES of text in all, no text above LONGEST bytes. Fitted in one task, whose input has these bounds.

    A document with labels of both kinds counts as toxic; null labels and texts teach nothing.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # ids and sizes meet the labels; texts stay where they are
    own = docs.where(F.col("text").isNotNull() & (remainder() != rest)).select("doc_id", F.octet_length("text").alias("bytes"))
    known = own.where(F.col("bytes") <= LONGEST).join(marks, "doc_id")
    sizes = table(known.select("doc_id", "toxic", "bytes", F.xxhash64("doc_id").alias("h")), "toxic-sizes")
    total = {r.toxic: r.n for r in sizes.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    some = None
    for c, n in sorted(total.items()):
        part = sizes.where((F.col("toxic") == c) & (F.col("h") <= F.lit(-(2.0**63) + 2.0**64 * min(1.0, 1.1 * ROWS[c] / n))))
        part = part.orderBy("h", "doc_id").limit(ROWS[c])
        some = part if some is None else some.union(part)
    if some is None:
        return Model(b"", b"", [], 0.0)
    kept, left = [], dict.fromkeys(total, BYTES // 2)
    for r in sorted(some.collect(), key=lambda r: (r.h, r.doc_id)):
        left[r.toxic] -= r.bytes
        if left[r.toxic] >= 0:
            kept.append((r.doc_id, r.toxic))
    spark = docs.sparkSession
    chosen = spark.createDataFrame(sorted(set(kept)), "doc_id long, toxic int")  # at most the ROWS of both classes
    texts = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= LONGEST)).select("doc_id", "text")
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", F.xxhash64("doc_id").alias("h"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((h, i, t, c) for b in batches for i, t, c, h in zip(*(x.to_pylist() for x in b.columns), strict=True))
        m = Model.fit([r[2] for r in rows], [r[3] for r in rows])
        yield pa.RecordBatch.from_pydict({"ordinary": [m.blobs[0]], "toxic": [m.blobs[1]], "weights": [m.weights.tolist()], "rate": [m.rate], "plain": [m.plain.tolist()]})

    got = arrow(sample.repartition(1), "ordinary binary, toxic binary, weights array<double>, rate double, plain array<double>", fit).first()
    return Model(bytes(got.ordinary), bytes(got.toxic), list(got.weights), got.rate, list(got.plain))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row of ``docs``: whole texts, 0 to 1. Null and empty texts, and texts without a word, get
    the calibration's value for no window. Repeated ids are separate rows, ties are no matter, an empty table gives an
    empty result; other columns are not read."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1).to_pylist()), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow(rows, f"id {rows.schema['id'].dataType.simpleString()}, score double", each)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``; labels are read of rows not held out only.

    What ``scored`` says of nulls and empty texts holds; a null doc_id is not held out."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    out = scored(docs, model).withColumnRenamed("id", "doc_id")
    held = F.coalesce(remainder() == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
