"""Mixing sources to target weights by dependent rounding: fractional copies are paired, mass moves until one is whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vexel.llm.common import SENT, WORD_SQL, arrow, cut, offsets_by_part, parts, read, table

#: Weights in the order of the sources, repeating; the most that a source or document may grow.
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SEED = 11
#: Rows that one node of the reduction tree combines, about.
FAN = 64


def sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``size``: words of the text (null: 0)."""
    return docs.withColumn("size", F.coalesce(F.expr(f"size(filter(split({text_col}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''))"), F.lit(0)).cast("long"))


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, label: str = "mix") -> DataFrame:
    """``totals(source, source_size)`` with ``target``: water filling under ``cap``, sources in code point order, null last.

    Sources are numbered by range partitions, and each round of water filling is one aggregate of two numbers, so that
    any number of sources works; a round caps at least one source or is the last, and few are needed.
    """
    dealt = offsets_by_part(totals, [F.col("source").asc_nulls_last()], label)
    counts = {r[0]: r[1] for r in dealt.groupBy("__part").count().collect()}
    at, start = 0, []
    for p in sorted(counts):
        start.append((p, at))
        at += counts[p]
    before = dealt.sparkSession.createDataFrame(start or [(0, 0)], "__part int, __before long")
    n = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last()))
    ranked = dealt.join(F.broadcast(before), "__part").withColumn("__i", F.col("__before") + n - 1)
    weighed = cut(ranked.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (F.col("__i") % len(weights) + 1).cast("int"))).select("source", "source_size", "__w"))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    # a source is capped at level L (words a unit of weight) if cap * size < L * weight
    level = 0.0
    while True:
        over = F.col("__w") * level > cap * F.col("source_size")
        full, free = weighed.agg(F.sum(F.when(over, cap * F.col("source_size")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("__w")))).first()
        new = (total - (full or 0.0)) / free if free else level
        if not free or new <= level * (1 + 1e-15):
            break
        level = new
    return weighed.select("source", "source_size", F.least(cap * F.col("source_size"), F.col("__w") * F.lit(level)).alias("target"))


def _coin(*key: int, seed: int = SEED) -> float:
    return xxhash.xxh64_intdigest(b"".join(int(k & (1 << 64) - 1).to_bytes(8, "little") for k in key), seed) / 2.0**64


def pivot(size: np.ndarray, frac: np.ndarray, ids: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, int, float]:
    """Rounds ``frac`` in [0, 1) in order (large rows first leaves a small one at the end), keeping sum(size * frac) as long as two are fractional.

    Returns the copies (0 or 1) by row, the place of the one row left fractional (-1: none) and its fraction. Each pair
    moves words from one to the other until one is whole; the direction's odds keep every expectation.
    """
    out = np.zeros(len(size), np.int64)
    at, p = -1, 0.0
    for i in range(len(size)):
        q, s = float(frac[i]), int(size[i])
        if s <= 0 or q <= 1e-12:
            continue
        if q >= 1 - 1e-12:
            out[i] = 1
            continue
        if at < 0:
            at, p = i, q
            continue
        t = int(size[at])
        up = min((1 - p) * t, q * s)  # words that can move to `at`
        down = min(p * t, (1 - q) * s)
        if _coin(int(ids[at]), int(ids[i]), seed=seed) < down / (up + down):
            p, q = p + up / t, q - up / s
        else:
            p, q = p - down / t, q + down / s
        for j, v in ((at, p), (i, q)):
            if v >= 1 - 1e-9:
                out[j] = 1
        fp, fq = 1e-9 < p < 1 - 1e-9, 1e-9 < q < 1 - 1e-9
        at, p = (at, p) if fp else (i, q) if fq else (-1, 0.0)
    return out, at, p


def _groups(node: np.ndarray) -> Iterator[tuple[int, int]]:
    change = np.flatnonzero(node[1:] != node[:-1]) + 1
    return zip([0, *change.tolist()], [*change.tolist(), len(node)], strict=True)


def _level(rows: DataFrame, last: bool) -> DataFrame:
    """One level of the tree over ``node, src, leaf, key, uid, size, frac``; every row comes back with ``up`` (0 or 1; null: not settled)."""
    n = parts(rows.sparkSession)
    sorted_rows = rows.select("node", "src", "leaf", "key", "uid", "size", "frac").repartition(n, "node").sortWithinPartitions("node", F.col("size").desc(), "key", "uid")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(t: pa.Table) -> pa.RecordBatch:
            node, size, frac, key = (t.column(c).to_numpy() for c in ("node", "size", "frac", "key"))
            up, left = np.zeros(len(node), np.int64), np.full(len(node), -1.0)
            for lo, hi in _groups(node) if len(node) else ():
                got, at, p = pivot(size[lo:hi], frac[lo:hi], key[lo:hi])
                up[lo:hi] = got
                if at >= 0:
                    if last:
                        up[lo + at] = int(_coin(int(key[lo + at]), 0, 0) < p)
                    else:
                        left[lo + at] = p
            t = t.append_column("up", pa.array(up)).append_column("left", pa.array(left))
            return t.combine_chunks().to_batches()[0]

        for b in batches:
            held.append(b)
            t = pa.Table.from_batches(held)
            node = t.column("node").to_numpy()
            here = np.flatnonzero(node != node[-1]) if len(node) else ()
            if len(here):
                at = int(here[-1]) + 1
                yield solve(t.slice(0, at))
                held = t.slice(at).combine_chunks().to_batches()
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield solve(t)

    return arrow(sorted_rows, "node long, src long, leaf long, key long, uid long, size long, frac double, up long, left double", each)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, with_row: bool = False) -> DataFrame:
    """``id, size, source, source_size, target, copies, taken`` for each row (and ``row``, its columns, if asked for).

    A document gets target / source_size copies in expectation: the whole part, and one more by dependent rounding. The
    rows of a source are dealt by hash into leaves of about FAN rows; a leaf pairs its rows until one is fractional, and
    leaves' residuals meet FAN at a time in the next level. So a source's words differ from its target by less than
    the size of one document, that of its last residual, which a last coin decides; every document is taken with exactly
    its odds. No task holds a source, and the order of rows doesn't matter: coins are hashes of ids, and of the place in
    the table only for rows that are equal in id and size, so that these meet different leaves and coins.
    Null texts and texts without words have size 0 and are never taken. Null sources are one source, last in order.
    Repeated rows are separate documents. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), *[F.struct(*docs.columns).alias("row")] * with_row)
    rows = table(sizes(rows).drop("text"), "mix-sizes")
    shares = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).select("source", "source_size")))
    n_rows = rows.groupBy("source").agg(F.count("*").alias("__n"))
    src = F.xxhash64(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull())
    plan = shares.join(n_rows, shares["source"].eqNullSafe(n_rows["source"])).drop(n_rows["source"]).withColumn("src", src)
    plan = cut(plan.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.col("target") / F.col("source_size"))).otherwise(0.0)).withColumn("leaves", F.ceil(F.col("__n") / FAN).cast("long")))
    # rows equal in id and size (null ids, repeated rows) get keys of their own, so that no leaf holds them all
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    again = cut(rows.groupBy("id", "size").agg(F.count("*").alias("__c")).where("__c > 1").select(F.col("id").alias("__id"), F.col("size").alias("__size"), F.lit(True).alias("__again")))
    few = again.limit(SENT + 1).count() <= SENT
    rows = rows.join(F.broadcast(again) if few else again, rows["id"].eqNullSafe(again["__id"]) & (rows["size"] == again["__size"]), "left")
    key = F.xxhash64("id", F.coalesce(F.col("size"), F.lit(0)), F.lit(SEED))
    key = F.when(F.col("__again"), F.xxhash64(key, "uid")).otherwise(key)
    small = F.broadcast if plan.count() <= 100_000 else lambda x: x
    own = small(plan.select(F.col("source").alias("__source"), "src", "source_size", "target", "rate", "leaves"))
    meant = rows.join(own, rows.source.eqNullSafe(own["__source"])).drop("__source")
    meant = meant.withColumn("key", key).drop("__id", "__size", "__again").withColumn("whole", F.floor(F.col("rate") + 1e-12).cast("long")).withColumn("frac", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    kept_row = ["row"] * with_row
    meant = table(meant.withColumn("leaf", F.pmod(F.col("key"), F.col("leaves"))), "mix-rows")

    most = plan.agg(F.max("leaves")).first()[0] or 0
    node = lambda level: F.xxhash64(F.col("src"), F.floor(F.col("leaf") / (FAN**level)).cast("long"), F.lit(level))
    level, settled = 0, []
    live = meant.where("frac > 0 and size > 0").select("src", "leaf", "key", "uid", "size", "frac")
    while True:
        last = most <= FAN**level
        done = table(_level(live.withColumn("node", node(level)), last), f"mix-level{level}")
        settled.append(done.where("left < 0").select("uid", "up"))
        if last:
            break
        live = done.where("left >= 0").select("src", "leaf", "key", "uid", "size", F.col("left").alias("frac"))
        level += 1
    ups = settled[0]
    for s in settled[1:]:
        ups = ups.union(s)
    # rows, with whole texts, stay where they are as long as the ids of those that are taken once more are few enough
    more = table(ups.where("up = 1").select("uid", "up"), "mix-ups")
    few = more.limit(SENT + 1).count() <= SENT
    got = meant.join(F.broadcast(more) if few else more.hint("shuffle_hash"), "uid", "left").withColumn("copies", F.col("whole") + F.coalesce("up", F.lit(0)))
    got = got.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0))
    return got.select("id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *kept_row)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix has it: each row as often as it is taken, the others gone.

    Rows with nulls in any column, repeated rows and rows equal in id are taken each by itself; texts without a word are
    never taken; an empty table stays empty. All columns stay, whatever their names.
    """
    got = mix(docs, with_row=True, **how)
    return got.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` (and source, copies) for every row of ``documents``, as ``mix`` has it."""
    got = mix(read(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")
