"""SimHash near-duplicates: fingerprints of word shingles, pigeonring candidate filter, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.llm import overlap
from vexel.llm.common import arrow, components, parts, picked, read, table

BITS = 64
SEED = 42
#: A bucket with more fingerprints than this is compared in pairs of blocks, by as many tasks.
BLOCK = 4096
#: What a text without words has as its one shingle.
NO_WORD = overlap.hashes("", 1)[0]


def fingerprint(text: str | None, width: int = 4) -> int:
    """Majority bits of the XXH64 of all ``width``-word shingles of ``text`` (A-Z lower-cased); 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    h = xxhash.xxh64_intdigest
    ends_k, starts_k = ends[k - 1 :].tolist(), starts[: len(words) - k + 1].tolist()
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(ends_k), 65536):
        got = np.array([h(joined[a:b], SEED) for a, b in zip(starts_k[at : at + 65536], ends_k[at : at + 65536], strict=True)], ">u8")
        votes += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(votes * 2 > len(ends_k)).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """``fingerprint`` of a text, given the ``overlap.hashes`` of its shingles."""
    if len(hashes) == 1 and hashes[0] == NO_WORD:
        return 0
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[at : at + 65536].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``id, fp`` (the 64 bits as a signed long) of each row; repeated rows stay, null text has fingerprint zero."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    return arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), "id long, fp long", each)


def segments(limit: int, m: int | None = None) -> list[tuple[int, int]]:
    """``m`` (default ``limit + 1``) consecutive bit ranges (from, to) of nearly equal width."""
    m = m or limit + 1
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _mask(lo: int, hi: int) -> int:
    return ((1 << (hi - lo)) - 1) << lo


def plan(limit: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bucket keys for the pigeonring: each item is (mask of bits that must agree, chain tests).

    With m = limit + 1 segments on a ring, some start j has, for every k, at most floor(k * limit / m) differing bits in
    segments j .. j+k-1. So segment j is equal (k = 1), j+1 holds at most one difference, and j+1, j+2 at most two.
    Each of these two is halved; the differing halves are masked out: one half of each, or both halves of j+2. Whatever
    satisfies the chain's first three budgets agrees in all bits of at least one such mask. Chain tests, (mask, budget)
    for k = 2 .. m, prune the members of a bucket before the full Hamming distance. ``limit`` under 3 or over 15: other
    budgets hold, so that plain equality of one segment is the key.
    """
    seg = segments(limit)
    m = len(seg)
    out = []
    for j in range(m):
        chain, tests = 0, []
        for k in range(1, m + 1):
            chain |= _mask(*seg[(j + k - 1) % m])
            tests.append((chain, k * limit // m))
        eq = _mask(*seg[j])
        if limit < 3 or limit > 15:
            out.append((eq, tests))
            continue
        (a, b), (c, d) = seg[(j + 1) % m], seg[(j + 2) % m]
        h1 = [_mask(a, (a + b) // 2), _mask((a + b) // 2, b)]
        h2 = [_mask(c, (c + d) // 2), _mask((c + d) // 2, d)]
        out += [(eq | x | y, tests) for x in h1 for y in h2] + [(eq | h1[0] | h1[1], tests)]
    return out


def _grow(fps: np.ndarray, tests: list[tuple[np.uint64, int]], limit: int) -> np.ndarray:
    """For each of the distinct ``fps`` the one that it was first reached from within this bucket (itself: a start).

    Search from one fingerprint after another against those not reached yet: a dense group costs little more than its
    size, and what comes out is a spanning forest of the bucket's links.
    """
    left, parent = np.arange(len(fps)), fps.view(np.int64).copy()
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo:
            i = todo.pop()
            if not len(left):
                break
            diff = fps[left] ^ fps[i]
            ok = np.arange(len(left))
            for mask, budget in tests:  # cumulative differences along the chain
                ok = ok[np.bitwise_count(diff[ok] & mask) <= budget]
                if not len(ok):
                    break
            ok = ok[np.bitwise_count(diff[ok]) <= limit]
            if len(ok):
                todo.extend(left[ok].tolist())
                parent[left[ok]] = fps.view(np.int64)[i]
                left = np.delete(left, ok)
    return parent


def links(fps: DataFrame, limit: int = 4) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs of the distinct ``fp`` at ``limit`` or fewer differing bits.

    Each edge is such a pair. Output is linear in the bucket entries: a bucket gives a spanning forest, its pairs are
    never listed. Buckets above BLOCK entries go to block pairs, each bounded, so any bucket size is exact.
    """
    keys = plan(limit)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    spread = fps.select("fp", F.explode(F.array([F.struct(F.lit(o).alias("o"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("k")) for o, (mask, _) in enumerate(keys)])).alias("e"))
    spread = spread.select("e.o", "e.k", "fp")
    met = spread.groupBy("o", "k").agg(F.count("*").alias("n")).where("n > 1")
    # a hot bucket is split by the join; never all entries to every task, which a small table's compressed size invites
    counted = spread.join(met.hint("shuffle_hash"), ["o", "k"])
    tests = {o: [(np.uint64(m), b) for m, b in t] for o, (_, t) in enumerate(keys)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by their bucket."""
        held: list[pa.RecordBatch] = []

        def solve(cols: list[np.ndarray], fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for lo, hi in zip([0, *change], [*change, len(fp)], strict=True):
                own = np.unique(fp[lo:hi])
                parent = _grow(own.view(np.uint64), tests[int(cols[0][lo])], limit)
                keep = parent != own
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(parent[keep])], ["a", "b"])

        def cols_of(bs: list[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray]:
            t = pa.Table.from_batches(bs)
            return [t.column(i).to_numpy() for i in range(t.num_columns - 1)], t.column(t.num_columns - 1).to_numpy()

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            cols, fp = cols_of(held)
            last = np.all([c == c[-1] for c in cols], axis=0)
            at = len(fp) if not last.all() and last[-1] else 0
            at = int(np.flatnonzero(~last)[-1]) + 1 if at else 0
            if at:
                yield from solve([c[:at] for c in cols], fp[:at])
                t = pa.Table.from_batches(held).slice(at).combine_chunks()
                held = t.to_batches()
        if held:
            yield from solve(*cols_of(held))

    n = parts(fps.sparkSession)
    few = counted.where(f"n <= {BLOCK}").select("o", "k", "fp").repartition(n, "o", "k").sortWithinPartitions("o", "k")
    few = arrow(few, "a long, b long", each)
    blocks = counted.where(f"n > {BLOCK}").withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    pairs = blocks.select("o", "k", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), "fp").select("o", "k", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp")
    pairs = pairs.repartition(n, "o", "k", "lo", "hi").sortWithinPartitions("o", "k", "lo", "hi")
    return few.union(arrow(pairs, "a long, b long", each)).distinct()


def rooted(rows: DataFrame, limit: int = 4) -> DataFrame:
    """``fp, root`` for each distinct ``fp`` of ``rows``: the least fingerprint (as a long) that links reach."""
    known = rows.select("fp").distinct()
    tree = components(links(known, limit).select("a", "b"))
    return known.join(tree, known.fp == tree.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def linked(rows: DataFrame, limit: int = 4) -> DataFrame:
    """Pairs ``a, b`` of ``rows(node, fp)`` that hold together what fingerprints link: of equal ones the least node with each
    other, of ``links`` the least nodes of both."""
    low = table(rows.groupBy("fp").agg(F.min("node").alias("low")), "simhash-least")
    same = rows.join(low, "fp").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    near = links(low.select("fp"), limit)
    for c in ("a", "b"):
        near = near.join(low.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}")), c)
    return same.union(near.select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, limit: int = 4) -> DataFrame:
    """``id, fp, component_id`` per row of ``docs``: groups linked by fingerprints at most ``limit`` bits apart.

    Equal fingerprints are one class from the start. Null or wordless texts have fingerprint zero and link like others.
    component_id: the least id reachable (nulls are never least, so null where a component has no other id). Repeated
    rows stay repeated; an empty table gives an empty result; other columns are not read.
    """
    rows = table(fingerprints(docs, id_col, text_col, width), "simhash")
    classes = rows.groupBy("fp").agg(F.min("id").alias("low")).join(rooted(rows, limit), "fp")
    best = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(classes.join(best, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, limit: int = 4, least: float | None = None) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the least id (of null or equal ids, any one).

    ``least``: groups are then those of all pairs of texts with that similarity of their shingle sets. Links at ``limit`` or
    fewer differing bits are checked on the whole sets and are the first groups; an exact join (see ``overlap``) adds the
    links whose fingerprints are farther apart, so ``limit`` decides what is left to it, not the result. Null, empty and
    wordless texts are equal to each other; an empty table stays empty. Columns named like the added ones (``__fp``,
    ``__row``, ``__sig``, ``__n``, ``__p``, ``__odd``, ``__wide``) are dropped, all others stay.
    """
    docs = docs.drop(*[c for c in ("__fp", "__row", "__sig", "__n", "__p", "__odd", "__wide") if c not in (id_col, text_col)])
    names = docs.columns
    if least:
        rows, classes = overlap.classes(docs, id_col, text_col, width, least, majority, lambda marked: linked(marked, limit))
    else:
        at = names.index(text_col)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fp = np.array([fingerprint(t.as_py(), width) for t in b.column(at)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], [*b.schema.names, "__fp"])

        made = arrow(docs, T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())]), each)
        rows = table(made.withColumn("__row", F.monotonically_increasing_id()), "simhash-rows")
        slim = rows.select(F.col("__fp").alias("fp"), overlap.place(id_col))
        classes = slim.groupBy("fp").agg(F.min("at").alias("at")).join(rooted(slim, limit), "fp")
    chosen = classes.groupBy("root").agg(F.min("at").alias("at")).select(F.col("at.row").alias("__row"))
    gone = table(rows.select("__row").join(chosen.hint("shuffle_hash"), "__row", "left_anti"), "near-copies")
    return picked(rows, gone, "__row", "left_anti").select(*names)


def hex_bits(col: str):
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``documents``; nulls, repeats and empty tables as in
    ``near_duplicates``."""
    got = near_duplicates(read(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), hex_bits("fp").alias("fingerprint"), "component_id")
