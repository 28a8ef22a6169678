"""Language-model scoring with a probabilistic suffix tree over words, beside a unigram baseline."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import arrow, discard, made, parts, read, release, table

#: Contexts are suffixes of the running text of one word, two words, and so on up to so many.
DEPTH = 4
#: A context is a candidate if it occurs so often, and one of its successors if it follows so often: absolute numbers,
#: the same for every corpus, so that contexts and successors grow with the input.
LEAST, TWICE = 48, 2
#: Divergence tests, in nats of the training text: what a successor, and what a context with all its successors, must
#: tell better than the context's own suffix does, each occurrence being told by the others.
SUCCESSOR_GAIN, GAIN = 1.0, 12.0
#: Tables up to these numbers of rows go to every task (8 to 16 bytes a row); the rest of a larger one is joined.
HOT_CONTEXTS, HOT_ENTRIES, HOT_WORDS, SMALL = 4_000_000, 4_000_000, 1_000_000, 500_000
#: Pairs that a task adds up before it sends them on, a few times so many.
HELD = 400_000
#: Binary logarithm of the bits that sieve look-ups of successors missing in the tasks.
SIEVE = 26
#: Sorted keys up to this number are searched in any order.
CACHED = 500_000

# Spark's xxhash64 of longs (XXH64), so that tasks and columns give equal keys.
SEED = 42
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED)


#: Before a text's first word, and its last token; neither byte occurs in UTF-8.
START, END = np.uint64(word_key(b"\xff")), np.uint64(word_key(b"\xfe"))


def signed(x: np.uint64) -> int:
    return int(np.array(x, np.uint64).view(np.int64))


def _one(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    h = (seed + P5 + np.uint64(8)) ^ (turn(x * P2, 31) * P1)
    h = turn(h, 27) * P1 + P4
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What ``F.xxhash64(h, w)`` gives: the key of a context ``h`` with a further word, and of a successor of ``h``."""
    return _one(w, _one(h, np.full(len(h), SEED, np.uint64)))


def held_out(id_col: str):
    """crc32 of the id as text, mod 5, is 1; null ids are training rows."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


class Codes(dict):
    """Numbers of words, by first occurrence."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compress better."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def joined(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, n).T.copy().view(kind).ravel()


def risen(x: np.ndarray) -> bytes:
    """Ascending numbers by their steps."""
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def shrunk(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def tokenised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table, one row for each block of texts (an Arrow batch): the ids, which are held out, the number of the
    first row, the numbers of words, the 8-byte keys of the block's different words, and the words by their place there."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            if not b.num_rows:
                continue
            codes, texts = Codes(), []
            for t in b.column(2):
                own = (t.as_py() or b"").lower().split()
                texts.append(np.fromiter(map(codes.__getitem__, own), np.uint32, len(own)))
            words = np.fromiter(map(word_key, codes), np.uint64, len(codes))
            sizes = np.array([len(t) for t in texts], np.uint32)
            cols = [[b.column(0).to_pylist()], [b.column(1).to_pylist()], [row], [sizes.tobytes()], [words.tobytes()], [shrunk(planes(np.concatenate(texts)))]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
            row += b.num_rows

    names = ["id", "held", "row", "sizes", "words", "codes"]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    src = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held"), F.col(text_col).cast("binary").alias("text"))
    got = arrow(src, "id array<long>, held array<boolean>, row long, sizes binary, words binary, codes binary", each)
    return table(got, "lm-tokens")


class Block:
    """The tokens of a block of texts, an end after each: ``sym`` and ``before`` (the word before, or the start) by their
    places in ``keys``, and the place in the text; ``at``: where texts begin."""

    def __init__(self, held: list[bool], sizes: bytes, words: bytes, codes: bytes):
        n = np.frombuffer(sizes, np.uint32).astype(np.int64)
        size = int(n.sum())
        words = np.frombuffer(words, np.uint64)
        self.keys = np.concatenate((words, np.array([START, END])))
        self.n = n + 1
        self.at = np.cumsum(self.n) - self.n
        self.sym = np.full(size + len(n), len(words) + 1)
        inner = np.ones(len(self.sym), bool)
        inner[self.at + n] = False
        self.sym[inner] = joined(pa.decompress(codes, 4 * size, codec="zstd", asbytes=True), np.uint32, size)
        self.before = np.concatenate((self.sym[:1], self.sym[:-1]))
        self.before[self.at] = len(words)
        self.pos = np.arange(len(self.sym)) - np.repeat(self.at, self.n)
        self.train = np.repeat(~np.array(held, bool), self.n)

    def contexts(self, first: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from one word on: the tokens, ascending, that may have a candidate context so long, and the
        contexts' keys. ``first``: which words of ``keys`` may be one; ``bits``: the sieve of the candidates of two
        words. Each two neighbours in a longer candidate are one of these."""
        one = key(np.zeros(len(self.keys), np.uint64), self.keys)
        i = np.flatnonzero(first[self.before])
        yield i, one[self.before[i]]
        ok, h = self.pos >= 1, one[self.before]
        for k in range(2, DEPTH + 1):
            i = np.flatnonzero(ok)
            longer = key(h[i - 1], self.keys[self.before[i]])
            if k == 2:
                maybe = sifted(bits, longer)
                i, longer = i[maybe], longer[maybe]
            yield i, longer
            h = np.zeros(len(self.sym), np.uint64)
            h[i] = longer
            there = np.zeros(len(self.sym), bool)
            there[i] = True
            ok = there & np.concatenate((there[:1], there[:-1])) & (self.pos >= k)


def opened(b: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    """Blocks of a batch that has their columns."""
    cols = [b.column(b.schema.get_field_index(c)) for c in ("held", "sizes", "words", "codes")]
    for r in range(b.num_rows):
        yield r, Block(*(c[r].as_py() for c in cols))


def stacked(pick: list[np.ndarray], what: list[np.ndarray], at: np.ndarray) -> pa.Array:
    """Lists, one a text, of the picked values of several arrays over the tokens; ``at``: where texts begin."""
    width = len(pick)
    pick, what = np.stack(pick, axis=1).ravel(), np.stack(what, axis=1).ravel()
    n = np.add.reduceat(pick.astype(np.int64), at * width)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(what[pick].view(np.int64)))


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def added(some: list[Pairs]) -> tuple[Pairs, np.ndarray]:
    """Pairs ``h, w``, numbers, and whether to spread them; equal ones are added up. And the pairs' keys, ascending."""
    h, w, n, spread = (np.concatenate(x) for x in zip(*some, strict=True))
    k = key(h, w)
    order = np.argsort(k)
    k = k[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    n = np.add.reduceat(n[order], first)
    order = order[first]
    return (h[order], w[order], n, spread[order]), k[first]


def bucket_of(k: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with ``k``."""
    return (k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def cuts(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    cut = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1], [True]))).tolist() if len(sorted_) else []
    return list(zip(cut[:-1], cut[1:], strict=True))


def pieces(data: bytes, sizes: list[int]) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    data = pa.decompress(data, ends[-1], codec="zstd", asbytes=True)
    return [data[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]


def counted(blocks: DataFrame, of: Callable[[Block], Pairs], buckets: int, least: int, label: str, known=None, low: bool = False) -> DataFrame:
    """``h, w, n``, a written table: how often the pairs that ``of(block)`` counts occur, ``least`` times or more.

    Tasks add up their pairs and send them on by buckets, in compressed arrays; a bucket is then added up. All pairs of
    an ``h`` are in one bucket, but for those that ``of`` tells to spread: these are dealt by their own keys.
    ``known``: broadcast logarithms of shares of words, whose places there stand for them on the way; with ``low`` the
    table has the share of ``w`` too, null if not there.
    """

    def sent(pairs: Pairs, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, w, n, spread = pairs
        order = np.argsort(h)  # of a context's pairs, those of a bucket stay together
        order = order[np.argsort(bucket_of(np.where(spread, k, h)[order], buckets).astype(np.uint32), kind="stable")] if spread.any() else order
        h, w, n, bucket = h[order], w[order], n[order], bucket_of(np.where(spread, k, h)[order], buckets)
        listed = known.value.keys if known is not None else np.zeros(0, np.uint64)
        for a, z in cuts(bucket):
            first = np.flatnonzero(np.concatenate(([True], h[a + 1 : z] != h[a : z - 1])))
            hs, runs = h[a:z][first], np.diff(np.append(first, z - a)).astype(np.uint32)
            ws, wi = np.unique(w[a:z], return_inverse=True)
            at = np.searchsorted(listed, ws)
            there = listed[np.minimum(at, len(listed) - 1)] == ws if len(listed) else np.zeros(len(ws), bool)
            wi = np.where(there, np.cumsum(there) - 1, there.sum() + np.cumsum(~there) - 1)[wi]
            data = risen(hs) + risen(at[there].astype(np.uint32)) + risen(ws[~there]) + planes(runs) + planes(wi.astype(np.uint32)) + planes(np.ascontiguousarray(n[a:z]))
            cols = [[int(bucket[a])], [len(hs)], [int(there.sum())], [int((~there).sum())], [z - a], [shrunk(data)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, size = [], 0
        for b in batches:
            for _, block in opened(b):
                own = of(block)
                if len(own[0]):
                    have.append(own)
                    size += len(own[0])
                if size > 5 * HELD:
                    new = added(have)
                    have, size = [new[0]], len(new[1])
                    if size > 3 * HELD:
                        yield from sent(*new)
                        have, size = [], 0
        if have:
            yield from sent(*added(have))

    def total(group: pa.Table) -> pa.Table:
        own = []
        for r in group.to_pylist():
            nh, nw, more, m = r["nh"], r["nw"], r["more"], r["m"]
            hs, at, ws, runs, wi, n = pieces(r["data"], [8 * nh, 4 * nw, 8 * more, 4 * nh, 4 * m, 8 * m])
            hs, ws = np.cumsum(joined(hs, np.uint64, nh), dtype=np.uint64), np.cumsum(joined(ws, np.uint64, more), dtype=np.uint64)
            if nw:
                ws = np.concatenate((known.value.keys[np.cumsum(joined(at, np.uint32, nw))], ws))
            own.append((np.repeat(hs, joined(runs, np.uint32, nh)), ws[joined(wi, np.uint32, m)], joined(n, np.int64, m), np.zeros(m, bool)))
        (h, w, n, _), _ = added(own)
        del own
        often = n >= least
        h, w, n = h[often], w[often], n[often]
        order = np.argsort(h)
        h, w, n = h[order], w[order], n[order]
        cols = {"h": pa.array(h.view(np.int64)), "w": pa.array(w.view(np.int64)), "n": pa.array(n)}
        if low:
            share = known.value.get(w)
            cols["low"] = pa.array(10.0**share, pa.float32(), mask=np.isnan(share))
        got = pa.table(cols)
        return pa.Table.from_batches(got.to_batches(max_chunksize=100_000), got.schema)

    names, kinds = ["bucket", "nh", "nw", "more", "m", "data"], [pa.int64(), *[pa.int32()] * 4, pa.binary()]
    rows = arrow(blocks.select("held", "sizes", "words", "codes"), "bucket long, nh int, nw int, more int, m int, data binary", each)
    return table(rows.groupBy("bucket").applyInArrow(total, "h long, w long, n long" + ", low float" * low), label)


def meet(rows: DataFrame, other: DataFrame, on: list[str], n: int, how: str = "inner") -> DataFrame:
    """A join with ``other``, whose ``n`` rows go to every task if they are few."""
    return rows.join(F.broadcast(other) if n <= SMALL else other, on, how)


class Found:
    """Sorted keys with a value each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def get(self, asked: np.ndarray) -> np.ndarray:
        """Values, nan where there is none."""
        if not len(self.keys) or not len(asked):
            return np.full(len(asked), np.nan)
        if len(self.keys) < CACHED:
            i = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            return np.where(self.keys[i] == asked, self.values[i], np.nan).astype(np.float64)
        order = np.argsort(asked)  # sorted, the search stays in the cache
        own = asked[order]
        i = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        got = np.empty(len(asked))
        got[order] = np.where(self.keys[i] == own, self.values[i], np.nan)
        return got


def _local(df: DataFrame, value: str) -> Found:
    """``df(k, value)``, whose number of rows was checked."""
    got = df.select("k", F.col(value).cast("float").alias("v")).toArrow()
    return Found(got["k"].to_numpy().view(np.uint64), got["v"].to_numpy())


def threshold(df: DataFrame, by: str, most: int, weight=None) -> int:
    """The least of a few numbers (four an octave) such that rows with ``by`` at or above it weigh ``most`` together at most."""
    level = F.floor(4 * F.log2(F.col(by))).cast("int").alias("b")
    t, total = 4 * 62, 0
    for r in sorted(df.groupBy(level).agg(F.sum(weight if weight is not None else F.lit(1)).alias("n")).collect(), key=lambda r: -r.b):
        total += r.n
        if total > most:
            break
        t = r.b
    return math.ceil(2.0 ** (t / 4))


def slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys >> np.uint64(64 - SIEVE + 3), np.uint8(1) << ((keys >> np.uint64(64 - SIEVE)) & np.uint64(7)).astype(np.uint8)


def sifted(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which may be among the keys of a sieve."""
    at, bit = slots(keys)
    return (bits[at] & bit) > 0


def sieve(keys: DataFrame) -> np.ndarray:
    """Bits, 2^SIEVE whatever the number of ``keys(k)``, that tell of most other keys that they are none of these."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << SIEVE, bool)
        for b in batches:
            on[b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - SIEVE)] = True
        yield pa.RecordBatch.from_arrays([pa.array([shrunk(np.packbits(on, bitorder="little").tobytes())], pa.binary())], ["bits"])

    out = np.zeros(1 << SIEVE - 3, np.uint8)
    for r in arrow(keys.coalesce(16), "bits binary", each).toLocalIterator():
        out |= np.frombuffer(pa.decompress(r.bits, len(out), codec="zstd", asbytes=True), np.uint8)
    return out


QUESTIONS = pa.struct([("bucket", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("data", pa.binary())])


def questions(k: np.ndarray, text: np.ndarray, buckets: int) -> list[dict]:
    """Keys that the texts of a block ask for, by buckets: each key once, with the places of its texts in the block."""
    order = np.argsort(k)
    k, text = k[order], text[order].astype(np.uint32)
    out = []
    for a, z in cuts(bucket_of(k, buckets)):
        own, runs = np.unique(k[a:z], return_counts=True)
        data = risen(own) + planes(runs.astype(np.uint32)) + planes(text[a:z])
        out.append({"bucket": int(bucket_of(own[:1], buckets)[0]), "n": len(own), "m": z - a, "data": shrunk(data)})
    return out


def answers(asked: pa.Table, held: pa.Table) -> pa.Table:
    """``row, c``: sums of a bucket's values by text."""
    have = Found(held["k"].to_numpy().view(np.uint64), held["more"].to_numpy())
    rows, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
    for r in asked.to_pylist():
        own, runs, text = pieces(r["data"], [8 * r["n"], 4 * r["n"], 4 * r["m"]])
        got = np.nan_to_num(have.get(np.cumsum(joined(own, np.uint64, r["n"]), dtype=np.uint64)))
        got = np.bincount(joined(text, np.uint32, r["m"]), np.repeat(got, joined(runs, np.uint32, r["n"])))
        there = np.flatnonzero(got)
        rows.append(there + r["row"])
        sums.append(got[there])
    got = pa.table({"row": np.concatenate(rows), "c": np.concatenate(sums)})
    return pa.Table.from_batches(got.to_batches(max_chunksize=100_000), got.schema)


class Tree:
    """Tables of the retained contexts ``k, h, n, back`` and their kept successors ``k, h, w, d``, with
    their contexts' ``n, back``; log10.

    A token costs its baseline share and, for each context of it that is retained, ``d`` if the token is a kept
    successor there, else ``back``: d is what the smoothed share differs from that of the context's suffix.
    """

    def __init__(self, contexts: DataFrame | None, entries: DataFrame | None):
        self.contexts, self.entries = contexts, entries


def grow(blocks: DataFrame, words: DataFrame, n_all: int, floor: float, known, sure: int) -> tuple[Tree, np.ndarray, np.ndarray]:
    """The tree, and the sieves of the candidates of one word and of two.

    The contexts of k + 1 words that occur LEAST times are among the successors counted for those of k words. The
    successors of one word are counted first; one further pass counts those of all longer contexts that consist of
    candidates of two words, and each level takes what belongs to its own candidates. ``known``: broadcast logarithms of
    the shares of words that occur ``sure`` times or more.
    """
    spark = blocks.sparkSession
    buckets = max(parts(spark), n_all // 2_000_000)
    one = words.where((F.col("n") >= LEAST) & (F.col("w") != signed(END))).select("w", "n")
    texts = words.where(F.col("w") == signed(END)).where(F.col("n") >= LEAST).select(F.lit(signed(START)).alias("w"), "n")
    root = F.lit(0).cast("long")
    cands = one.union(texts).select(F.xxhash64(root, "w").alias("h"), F.lit(None).cast("long").alias("up"), F.col("n").alias("total"))
    none = np.zeros(1 << SIEVE - 3, np.uint8)
    kept, told, before, longer, sieves = [], [], None, None, [none, none]
    for k in range(1, DEPTH + 1):
        cands = table(cands, f"lm-candidates{k}")
        n_cands = cands.count()
        if not n_cands:
            break
        if k <= 2:
            sieves[k - 1] = sieve(cands.select("h"))
            heavy = cands.where(F.col("total") >= n_all / (8 * buckets)).select("h").toArrow()["h"].to_numpy().view(np.uint64)  # 8 a bucket at most
        if k == 1:
            bits = spark.sparkContext.broadcast(sieves[0])

            def of(b: Block, bits=bits, heavy=heavy) -> Pairs:
                h = key(np.zeros(len(b.keys), np.uint64), b.keys)
                ok = b.train & sifted(bits.value, h)[b.before]
                pair = np.sort(b.before[ok] * len(b.keys) + b.sym[ok])
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1])))
                n, pair = np.diff(np.append(first, len(pair))), pair[first]
                h = h[pair // len(b.keys)]
                return h, b.keys[pair % len(b.keys)], n, np.isin(h, heavy)

            raw = counted(blocks, of, buckets, TWICE, "lm-counts1", known, low=True)
            spent = [made(spark)[-1]]
            if sure > TWICE:  # words that are not in the tasks
                share = words.where((F.col("n") >= TWICE) & (F.col("n") < sure)).select("w", ((F.col("n") + 0.5) / F.lit(floor)).cast("float").alias("low"))
                rest = table(raw.where("low is null").drop("low").join(share, "w"), "lm-counts1-rare")
                spent.append(made(spark)[-1])
                raw = raw.where("low is not null").unionByName(rest)
        else:
            if k == 2:
                bits = spark.sparkContext.broadcast(sieves[1])

                def of(b: Block, bits=bits, heavy=heavy) -> Pairs:
                    found = list(b.contexts(np.zeros(len(b.keys), bool), bits.value))[1:]
                    spread = np.zeros(len(b.sym), bool)  # with the last two words
                    spread[found[0][0]] = np.isin(found[0][1], heavy)
                    i, h = np.concatenate([i for i, _ in found]), np.concatenate([h for _, h in found])
                    i, h = i[b.train[i]], h[b.train[i]]
                    return h, b.keys[b.sym[i]], np.ones(len(i), np.int64), spread[i]

                longer = counted(blocks, of, buckets, TWICE, "lm-counts", known)
            e = meet(longer, cands.select("h", "up"), ["h"], n_cands)
            raw = table(e.select(F.xxhash64("up", "w").alias("k"), "h", "w", "n").join(before, "k").drop("k"), f"lm-counts{k}")
            spent = [made(spark)[-1]]
        # total, the kinds of successors (those seen once are total less the others), and both tests
        kinds = raw.groupBy("h").agg((F.count("*") - F.sum("n")).alias("more"))
        heads = table(cands.join(kinds, "h").select("h", "up", "total", (F.col("total") + F.col("more")).alias("kinds")), f"lm-heads{k}")
        e = meet(raw, heads, ["h"], n_cands)
        gain = lambda rest: F.col("n") * F.log((F.col("n") - 1 + rest * F.col("low")) / ((F.col("total") - 1 + F.col("kinds")) * F.col("low")))
        good = e.where(gain(F.col("kinds")) >= SUCCESSOR_GAIN)
        rest = F.col("kinds") + F.col("total") - F.col("sure")
        mass = good.groupBy("h").agg(F.first("total").alias("t"), F.first("kinds").alias("c"), F.sum("n").alias("sure"))
        lost = F.col("t") - F.col("sure")
        mass = table(mass.select("h", "sure", "c", "t", (lost * F.log((F.col("c") + lost) / (F.col("t") + F.col("c")))).alias("cost")), f"lm-mass{k}")
        gains = meet(good, mass.select("h", "sure", "cost"), ["h"], n_cands).groupBy("h").agg((F.sum(gain(rest)) + F.first("cost")).alias("gain"))
        top = mass.join(gains.where(F.col("gain") >= GAIN).select("h"), "h", "left_semi")
        top = table(top.select("h", "sure", "c", "t"), f"lm-contexts{k}")
        back = F.log10((F.col("c") + F.col("t") - F.col("sure")) / (F.col("t") + F.col("c")))
        kept.append(top.select(F.col("h").alias("k"), "h", F.col("t").alias("n"), back.alias("back")))
        e = meet(e, top.select("h", "sure", back.alias("back")), ["h"], n_cands, "left").withColumn("rest", rest)
        on = F.col("sure").isNotNull()
        sure_ = on & (gain(F.col("kinds")) >= SUCCESSOR_GAIN)
        p = (F.when(sure_, F.col("n")).otherwise(0) + F.col("rest") * F.col("low")) / (F.col("total") + F.col("kinds"))
        told_ = F.when(sure_, F.log10(p / F.col("low"))).cast("float").alias("d")
        e = e.select("h", "up", "w", "n", "total", "back", F.coalesce(sure_, F.lit(False)).alias("sure"), F.when(on, p).otherwise(F.col("low")).cast("float").alias("p"), told_)
        done = table(e, f"lm-successors{k}")
        for at in spent:  # the raw counts; contexts and successors stand behind them
            discard(spark, at)
        told.append(done.where("sure").select(F.xxhash64("h", "w").alias("k"), "h", "w", "d", F.col("total").alias("n"), "back"))
        before = done.select(F.xxhash64("h", "w").alias("k"), F.col("p").alias("low"))
        next_ = done.where((F.col("n") >= LEAST) & (F.col("w") != signed(END)))
        shorter = F.xxhash64(root, "w") if k == 1 else F.xxhash64("up", "w")
        cands = next_.select(F.xxhash64("h", "w").alias("h"), shorter.alias("up"), F.col("n").alias("total"))
        release(spark)
    union = lambda dfs: None if not dfs else dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    return Tree(union(kept), union(told)), *sieves


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row; all log10.

    The tree's contexts are suffixes of the words before a token, of variable length, retained where their successors
    diverge from those of their suffix; a token is scored in the longest retained one, smoothed with its suffixes, the
    last of which is the baseline. Words are told apart by 64-bit hashes (two of a billion words are equal with a
    probability of 3 in 100). Null or empty texts are the end alone, wordless ones too. Null ids are training rows,
    repeated rows are separate rows; an empty table gives an empty result; without training rows all counts are 0 and
    all scores 0. Other columns are not read. The most frequent words, contexts and successors go to every task, as far
    as HOT_WORDS, HOT_CONTEXTS and HOT_ENTRIES reach; all others meet their tokens in joins.
    """
    spark = docs.sparkSession
    tokens = tokenised(docs, id_col, text_col)
    at_tokens = made(spark)[-1]

    def of(b: Block) -> Pairs:
        n = np.bincount(b.sym[b.train], minlength=len(b.keys))
        there = np.flatnonzero(n)
        return np.zeros(len(there), np.uint64), b.keys[there], n[there], np.ones(len(there), bool)

    words = counted(tokens, of, parts(spark), 1, "lm-words").select("w", "n")
    n_all, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = n_all + 0.5 * (v + 1)
    sure = threshold(words, "n", HOT_WORDS)
    got = words.where(F.col("n") >= sure).toArrow()
    hot_words = Found(got["w"].to_numpy().view(np.uint64), np.log10((got["n"].to_numpy() + 0.5) / floor))
    del got
    release(spark)
    tree, *sieves = grow(tokens, words, n_all, floor, spark.sparkContext.broadcast(hot_words), sure)
    hot_contexts = hot_entries = Found(np.zeros(0, np.uint64), np.zeros(0))
    cold = beyond = False
    bits = None
    if tree.contexts is not None:
        size = tree.entries.groupBy("h").agg(F.count("*").alias("m"))
        ready = table(tree.contexts.join(size, "h"), "lm-tree")
        t, least = threshold(ready, "n", HOT_ENTRIES, F.col("m")), threshold(ready, "n", HOT_CONTEXTS)
        t = max(t, least)
        # contexts whose successors are not all in the tasks have back-offs (below 0) with the sign changed there; those with fewer than `least` not even that
        hot_contexts = _local(ready.where(F.col("n") >= least).withColumn("v", F.when(F.col("n") >= t, F.col("back")).otherwise(-F.col("back"))), "v")
        hot_entries = _local(tree.entries.where(F.col("n") >= t), "d")
        rare, lost = ready.where(F.col("n") < t).select("h"), ready.where(F.col("n") < least).select("h", "back")
        cold, beyond = rare.limit(1).count() > 0, lost.limit(1).count() > 0
        if cold:
            rest = table(tree.entries.where(F.col("n") < t).select("k", (F.col("d") - F.col("back")).cast("float").alias("more")), "lm-rest")
            bits = sieve(rest.select("k"))
    buckets = max(parts(spark), n_all // 2_000_000)
    sent = spark.sparkContext.broadcast((hot_words, hot_contexts, hot_entries, bits, *sieves))
    del hot_words, hot_contexts, hot_entries

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, contexts_, entries, bits, one, two = sent.value
        for b in batches:
            for r, block in opened(b):
                sym, at, size = block.sym, block.at, len(block.sym)
                base = words.get(block.keys)
                known = ~np.isnan(base)[sym]
                told = np.where(np.isnan(base), 0.0, base)[sym]
                more = told.copy()
                asked, unknown, text = [], [], np.repeat(np.arange(len(at)), block.n)
                single = key(np.zeros(len(block.keys), np.uint64), block.keys)
                first = contexts_.get(single)
                for level, (i, h) in enumerate(block.contexts(sifted(one, single) if beyond else ~np.isnan(first), two)):
                    back = contexts_.get(h) if level else first[block.before[i]]
                    sparse = back > 0
                    back = -np.abs(back)
                    there = ~np.isnan(back)
                    if beyond:
                        maybe, full = np.zeros(size, bool), np.zeros(size, np.uint64)
                        maybe[i], full[i] = ~there, h
                        unknown.append((maybe, full))
                    i, h, back, sparse = i[there], h[there], back[there], sparse[there]
                    k = key(h, block.keys[sym[i]])
                    d = entries.get(k)
                    more[i] += np.where(np.isnan(d), back, d)
                    if cold:
                        maybe = np.flatnonzero(sparse)
                        maybe = maybe[sifted(bits, k[maybe])]
                        asked.append((k[maybe], text[i[maybe]]))
                cols = [np.arange(len(at)) + b.column(0)[r].as_py(), b.column(1)[r].values, b.column(2)[r].values, block.n, np.add.reduceat(known.astype(np.int64), at), np.add.reduceat(told, at), np.add.reduceat(more, at)]
                cols = [*map(pa.array, cols), stacked([~known], [block.keys[sym]], at)]
                if cold:  # with the first text of the block
                    ks = questions(np.concatenate([k for k, _ in asked]), np.concatenate([x for _, x in asked]), buckets)
                    cols.append(pa.array([ks, *[None] * (len(at) - 1)], pa.list_(QUESTIONS)))
                if beyond:
                    cols += [stacked([m for m, _ in unknown], x, at) for x in ([h for _, h in unknown], [block.keys[sym]] * len(unknown))]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", *["ks"] * cold, *["h", "w"] * beyond]
    schema = "row long, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>" + ", ks array<struct<bucket long, n int, m int, data binary>>" * cold + ", h array<long>, w array<long>" * beyond
    rows = table(arrow(tokens.select("row", "id", "held", "sizes", "words", "codes"), schema, each), "lm-rows")
    discard(spark, at_tokens)  # nothing reads them any more
    asked = rows.select("row", F.explode("rare").alias("w")).groupBy("row", "w").agg(F.count("*").alias("times"))
    own = F.coalesce("n", F.lit(0))
    met = asked.join(words, "w", "left").groupBy("row").agg(F.sum(F.when(own > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.log10((own + 0.5) / F.lit(floor))).alias("b"))
    got = rows.select("row", "id", "held_out", "n_tokens", "n_known", "base_score", "score").join(met, "row", "left").withColumn("c", F.lit(0.0))
    found = []
    if cold:
        put = rows.where("ks is not null").select("row", F.explode("ks").alias("x")).select("row", "x.*").groupBy("bucket")
        held = rest.withColumn("bucket", F.shiftrightunsigned(F.shiftrightunsigned("k", 32) * F.lit(buckets), 32)).groupBy("bucket")
        found.append(put.cogroup(held).applyInArrow(answers, "row long, c double").groupBy("row").agg(F.sum("c").alias("c")))
    if beyond:  # contexts that not even their marks are in the tasks for
        pairs = rows.select("row", F.explode(F.arrays_zip("h", "w")).alias("x")).select("row", "x.h", "x.w").join(lost, "h")
        pairs = pairs.join(tree.entries.select("h", "w", "d"), ["h", "w"], "left")
        found.append(pairs.groupBy("row").agg(F.sum(F.coalesce("d", "back")).alias("c")))
    if found:
        both = found[0] if len(found) == 1 else found[0].union(found[1]).groupBy("row").agg(F.sum("c").alias("c"))
        got = got.drop("c").join(both, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return got.select("id", "held_out", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), (F.col("base_score") + zero("b")).alias("base_score"), (F.col("score") + zero("b") + zero("c")).alias("score"))


def op8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``documents``, as ``score``
    has it for nulls, empty texts, repeated rows and empty tables."""
    return score(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
