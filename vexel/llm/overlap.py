"""Groups of texts by the exact similarity of their shingle sets: links that fingerprints find, checked exactly, completed
by a prefix-filter join, whose buckets go by stars."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.llm.common import arrow, components, cut, discard, parts, picked, release, table
from vexel.llm.common import made as written

SEED = 42
#: About so many documents tell which shingles are frequent, and so many of these go last. Both only order the shingles.
SAMPLE, LAST = 8000, 200_000
#: Buckets with more members than this are compared in pairs of blocks.
BLOCK = 1024
#: Bits that hold, for each text, the parity of its shingles with that hash: two texts differ in as many at least.
PARITY = 1024
#: Of texts with more shingles than this, so few bits say little; they have parities of two to four bits a shingle besides.
LONG = 512
#: What tells one pair of a bucket's blocks from another.
KEY = ("h", "lo", "hi")
TINY = 1e-9


def hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the ``width``-word shingles (of the whole sequence if it is shorter) in order, repeats included, as longs."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, k, h = b" ".join(words), min(width, len(words)), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    got = [h(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    return np.array(got, np.uint64).view(np.int64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct ``hashes``, sorted."""
    return np.unique(hashes(text, width))


def parities(own: np.ndarray, bits: int) -> np.ndarray:
    """Of each value of the hashes' last bits, whether an odd number of ``own`` has it; packed. Halves laid over each other
    give the parities of half as many bits."""
    return np.packbits(np.bincount(own & (bits - 1), minlength=bits) & 1)


def wide(own: np.ndarray) -> bytes | None:
    return parities(own, 2 << (len(own) - 1).bit_length()).tobytes() if len(own) > LONG else None


def differing(a: bytes, b: bytes) -> int:
    """How many parities differ, of as many as both have."""
    a, b = (np.frombuffer(x, np.uint64) for x in (a, b))
    while len(a) != len(b):
        a, b = (np.bitwise_xor(*np.split(x, 2)) if len(x) > min(len(a), len(b)) else x for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def place(id_col: str):
    """What decides which row of a group stays: the least id, null ids last."""
    return F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.col("__row").alias("row")).alias("at")


def _frequent(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """Shingles of two or more documents of a sample chosen by hash, the most frequent last."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t.as_py(), width) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*own, np.zeros(0, np.int64)]))], ["h"])

    text = F.col(text_col)
    some = docs.select(text.alias("t")).where(F.pmod(F.xxhash64(text), F.lit(max(1, docs.count() // SAMPLE))) == 0)
    often = arrow(some, "h long", each).groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(LAST)
    return np.array([r.h for r in often.collect()][::-1], np.int64)


def _similar(pairs: DataFrame, rows: DataFrame, text_col: str, width: int, least: float) -> DataFrame:
    """The ``pairs(a, b)`` of rows whose texts share ``least`` or more of all their shingles, counted exactly."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), width) for t in b.column(1)], pa.list_(pa.int64()))], ["node", "h"])

    pairs = cut(pairs)
    pairs = cut(_apart(pairs, rows, least))
    texts = picked(rows.select("__row", F.col(text_col).alias("text")), _ends(pairs), "__row")
    sets = table(arrow(texts, "node long, h array<long>", each), "overlap-sets")
    at = written(pairs.sparkSession)[-1]
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    got = cut(both.where(shared >= least * (F.size("ha") + F.size("hb") - shared)).select("a", "b"))
    discard(pairs.sparkSession, at)
    release(pairs.sparkSession)
    return got


def _ends(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.col("a").alias("__row")).union(pairs.select(F.col("b").alias("__row"))).distinct())


def _apart(pairs: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """``pairs`` without those of long texts whose wide parities tell that they are too different; a wide parity is a 16th
    to a 32nd of the set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_, b_, both, wa, wb = (c.to_pylist() for c in b.columns)
            most = (1 - least) / (1 + least)
            ok = [x is None or y is None or differing(x, y) <= most * n + TINY for x, y, n in zip(wa, wb, both, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    own = picked(rows.select("__row", "__n", "__wide"), _ends(pairs), "__row")
    met = pairs
    for c in ("b", "a"):
        met = met.join(own.select(F.col("__row").alias(c), F.col("__n").alias(f"n{c}"), F.col("__wide").alias(f"w{c}")), c)
    return arrow(met.select("a", "b", F.col("na") + F.col("nb"), "wa", "wb"), "a long, b long", each)


def classes(docs: DataFrame, id_col: str, text_col: str, width: int, least: float, mark: Callable, near: Callable) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``__row``, materialised; and ``at, root`` for each distinct shingle set: its first row, its group.

    ``mark`` makes a fingerprint of a text's ``hashes``, ``near`` gives pairs ``a, b`` of ``node, fp`` whose fingerprints
    link. Those that reach ``least`` make the first groups, and the join below adds what fingerprints miss.

    In any one order of all shingles, two sets that share ``least`` of their union share one of the first
    size - ceil(least * size) + 1 of each (their prefixes); the first that they share is there for both, and few enough
    lie before it to leave room for the rest. So buckets of prefix shingles hold every such pair. The order puts the
    frequent ones last, which keeps buckets small. Equal sets are one class before. In each bucket the least row is
    compared with all others, along with the fingerprints' pairs. Of what is then still in different groups, spanning forests of the pairs that may reach
    ``least`` by their sizes, places and parities are checked, and at last all such pairs left between groups. So a dense
    group costs its size and nothing is lost. Every link is checked on the whole sets.
    """
    at, last = docs.columns.index(text_col), _frequent(docs, text_col, width)
    order = np.argsort(last)
    known = last[order]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, size, first, odd, fp, more = [], [], [], [], [], []
            for t in b.column(at):
                own = hashes(t.as_py(), width)
                fp.append(mark(own))
                own = np.unique(own)
                more.append(wide(own))
                sig.append(xxhash.xxh3_128_digest(own.tobytes()))
                size.append(len(own))
                odd.append(parities(own, PARITY).view(np.int64))
                rank = np.full(len(own), -1)
                if len(known):
                    i = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[i] == own, order[i], -1)
                first.append(own[np.lexsort((own, rank))][: len(own) - math.ceil(least * len(own) - TINY) + 1])
            longs = pa.list_(pa.int64())
            got = [pa.array(sig, pa.binary()), pa.array(size, pa.int32()), pa.array(first, longs), pa.array(odd, longs), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(more, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *got], [*b.schema.names, *(f.name for f in fields)])

    longs = T.ArrayType(T.LongType())
    fields = [T.StructField(*f) for f in (("__sig", T.BinaryType()), ("__n", T.IntegerType()), ("__p", longs), ("__odd", longs), ("__fp", T.LongType()), ("__wide", T.BinaryType()))]
    made = arrow(docs, T.StructType([*docs.schema.fields, *fields]), each)
    rows = table(made.withColumn("__row", F.monotonically_increasing_id()), "overlap-rows")
    slim = rows.select("__sig", place(id_col))
    first = table(slim.groupBy("__sig").agg(F.min("at").alias("at")).select("at"), "overlap-classes")

    again = cut(rows.select("__row").join(first.select(F.col("at.row").alias("__row")).hint("shuffle_hash"), "__row", "left_anti"))
    sketches = rows.select(F.col("__row").alias("node"), F.col("__n").alias("n"), F.col("__odd").alias("odd"))
    marked = picked(rows.select("__row", "__fp"), again, "__row", "left_anti").select(F.col("__row").alias("node"), F.col("__fp").alias("fp"))
    own = picked(rows.select("__row", "__n", "__p"), again, "__row", "left_anti")
    entries = own.select(F.posexplode("__p").alias("pos", "h"), F.struct(F.col("__row").alias("node"), F.col("__n").alias("n")).alias("x"))
    entries = entries.select("h", F.struct("x.node", "x.n", "pos").alias("x"))
    w = Window.partitionBy("h")
    met = table(entries.withColumn("c", F.count("*").over(w)).withColumn("lead", F.min("x").over(w)).where("c > 1"), "overlap-buckets")

    at_met = written(docs.sparkSession)[-1]
    release(docs.sparkSession)

    first_pairs = near(marked).union(_stars(met, least)).distinct()
    tree = components(_similar(_close(first_pairs, sketches, least), rows, text_col, width, least))
    left = met.where("c > 2 and x.node <> lead.node").select("h", "c", "x.*")
    nb = F.ceil(F.col("c") / BLOCK).cast("int")
    blocks = _grouped(left, tree, w).select("h", "node", "n", "pos", nb.alias("nb"), F.pmod(F.xxhash64("node"), nb).cast("int").alias("i"))
    blocks = blocks.select("h", "node", "n", "pos", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    blocks = blocks.select("h", "node", "n", "pos", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    blocks = table(blocks.join(sketches.select("node", "odd"), "node"), "overlap-blocks")
    discard(docs.sparkSession, at_met)
    release(docs.sparkSession)
    at_blocks = written(docs.sparkSession)[-1]
    for forest in (True, False):
        members = blocks.join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
        members = members.repartition(parts(docs.sparkSession), *KEY).sortWithinPartitions(*KEY)
        pairs = arrow(members.select(*KEY, "node", "n", "pos", "root", "odd"), "a long, b long", _compare(least, forest))
        more = _similar(pairs.distinct(), rows, text_col, width, least)
        tree = _widened(tree, more)
    discard(docs.sparkSession, at_blocks)
    return rows, first.join(tree, first.at.row == tree.node, "left").select("at", F.coalesce("root", F.col("at.row")).alias("root"))


def _close(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Those ``pairs(a, b)`` whose parities leave room for ``least``. Only these need their whole sets; the parities are a
    few bytes a text, and every pair that reaches ``least`` passes."""
    met = pairs
    for c in ("b", "a"):
        met = met.join(sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")), c)
    apart = sum((F.bit_count(F.col("odd_a")[i].bitwiseXOR(F.col("odd_b")[i])) for i in range(PARITY // 64)), F.lit(0))
    return met.where(apart <= (1 - least) / (1 + least) * (F.col("n_a") + F.col("n_b")) + TINY).select("a", "b")


def _widened(tree: DataFrame, links: DataFrame) -> DataFrame:
    """The groups with more ``links``, a checkpoint; if there is none, those of before."""
    if not links.limit(1).count():
        return tree
    return components(tree.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def _stars(met: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` of each bucket's least row and the others, without those that are too different in size, or share too
    little from here on, to reach ``least``."""
    na, nb = F.col("lead.n"), F.col("x.n")
    rest = F.least(na - F.col("lead.pos"), nb - F.col("x.pos"))
    room = (F.least(na, nb) >= least * F.greatest(na, nb) - TINY) & (rest >= least / (1 + least) * (na + nb) - TINY)
    return met.where("x.node <> lead.node").where(room).select(F.col("lead.node").alias("a"), F.col("x.node").alias("b"))


def _grouped(members: DataFrame, tree: DataFrame, w) -> DataFrame:
    """``members`` with their ``root`` so far, of those buckets that hold more than one."""
    got = members.join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return got.withColumn("r0", F.min("root").over(w)).withColumn("r1", F.max("root").over(w)).where("r0 <> r1").drop("r0", "r1")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups of rows sorted by KEY, with the groups' bounds. A group, never more than two blocks, waits
    until the next one begins."""

    def bounds(t: pa.Table) -> list[int]:
        keys = [t.column(c).to_numpy() for c in KEY]
        return [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist()]

    held: list[pa.RecordBatch] = []
    for b in batches:
        held += [b] if b.num_rows else []
        at = bounds(pa.Table.from_batches(held)) if held else [0]
        if at[-1]:
            t = pa.Table.from_batches(held)
            yield t.slice(0, at[-1]), at
            held = t.slice(at[-1]).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, [*bounds(t), len(t)]


def _compare(least: float, forest: bool):
    """Pairs of a block in different groups that may reach ``least``: all, or a spanning forest over the groups."""

    def solve(node: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, odd: np.ndarray, a: list, b: list) -> None:
        def near(i: int, js: np.ndarray) -> np.ndarray:
            both, rest = n[i] + n[js], np.minimum(n[i] - pos[i], n[js] - pos[js])
            ok = (root[js] != root[i]) & (np.minimum(n[i], n[js]) >= least * np.maximum(n[i], n[js]) - TINY)
            ok &= rest >= least / (1 + least) * both - TINY
            js, both = js[ok], both[ok]
            return js[np.bitwise_count(odd[js] ^ odd[i]).sum(axis=1) <= (1 - least) / (1 + least) * both + TINY]

        left, todo = np.arange(len(node)), []
        while len(left):
            if not todo:
                todo, left = [left[0]], left[1:]
            i = todo.pop()
            met = near(i, left)
            a += np.minimum(node[i], node[met]).tolist()
            b += np.maximum(node[i], node[met]).tolist()
            if forest:
                reached = np.isin(left, met) | (root[left] == root[i])
                todo.extend(left[reached].tolist())
                left = left[~reached]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _whole(batches):
            node, n, pos, root = (t.column(c).to_numpy() for c in ("node", "n", "pos", "root"))
            odd = t.column("odd").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
            a, b = [], []
            for lo, hi in zip(at, at[1:], strict=False):
                if (root[lo:hi] != root[lo]).any():
                    solve(*(x[lo:hi] for x in (node, n, pos, root, odd)), a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return each
