"""Near-duplicate vectors: spherical k-means cells, exact cosine within and across cell borders, representatives."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import arrow, components, cut, discard, made, read, release, table

LEAST = 0.98
#: Vectors a cell should hold, and vectors above which a cell is split again (or, where that is of no use, narrowed down
#: by sketches); children of a cell, and sample rows that fit them, at most.
CELL, FULL, CHILDREN, SAMPLE = 2000, 4096, 64, 20_000
ROUNDS, SEED = 6, 3
#: A split is of use if a vector enters no more children than this on average, and comparisons fall to this share.
SPREAD, SAVED = 2.0, 0.5
#: Sketches that a block holds, and bytes of its vectors in double precision; cosines that a task holds at a time.
SKETCHES, BLOCK_BYTES, TILE = 65_536, 16 << 20, 1 << 21
#: Slack for rounding in the border test, and of sketches in half precision; only adds comparisons.
SLACK, SKETCH_SLACK = 1e-6, 2e-3


def classes(rows: DataFrame) -> DataFrame:
    """``cls, label, v, low, n``: distinct (label, vector) among the linking rows, with the least id and the count.

    Equal vectors are one class from the start, so a group of copies of any size costs one vector afterwards.
    """
    c = component(rows)
    ok = F.col("v").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(ok).select("id", "label", F.transform("v", lambda x: x.cast(c) + F.lit(0.0).cast(c)).alias("v"))
    one = good.groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    return table(one.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")


def component(rows: DataFrame) -> str:
    """The type that holds components as they are: single precision stays so, at half the bytes."""
    return "float" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "double"


def units(blobs: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, as ``placed`` stores them, in double precision and of length one."""
    return unit(np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(float))


def unit(x: np.ndarray) -> np.ndarray:
    """Unit rows, scaled first by the greatest component so that neither overflow nor underflow occurs."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Spherical k-means: unit centroids, assignment by cosine; empty cells keep their centroid."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        norm = np.sqrt((total * total).sum(axis=1))
        c = np.where(norm[:, None] > 1e-12, total / np.maximum(norm, 1e-12)[:, None], c)
    return c


def entered(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and which children it enters: that one, and those whose border it is near."""
    s = x @ c.T
    best = s.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-18))
    margin = (s[np.arange(len(x)), best][:, None] - s) / apart[best]
    return best, (margin <= reach) | (np.arange(len(c)) == best[:, None])


def centroids(big: DataFrame, least_hash: DataFrame, reach: float, kind: str) -> DataFrame:
    """``cell, centres, k``: spherical k-means of each cell, fitted on about SAMPLE of its rows, those with small hashes.

    Cells that it would not make smaller have none. The sample tells, before any vector moves: among vectors without
    structure each one enters nearly all children, so a split would only multiply the rows.
    """

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        x = units(pdf.sort_values(["h", "cls"]).x.tolist(), kind)
        k = int(min(CHILDREN, max(2, round(pdf.m.iloc[0] / CELL)), len(x)))
        c = fit(x, k)
        share = entered(x, c, reach)[1].mean(axis=0)
        useful = share.sum() <= SPREAD and (share * share).sum() <= SAVED
        return pd.DataFrame({"cell": [pdf.cell.iloc[0]], "centres": [c.tobytes() if useful else b""], "k": [k if useful else 0]})

    chosen = big.join(least_hash, "cell").where(F.col("h") < F.col("most"))
    return chosen.select("cell", "cls", "x", "h", "m").groupBy("cell").applyInPandas(each, "cell string, centres binary, k int").where("k > 0")


def split(rows: DataFrame, centres: DataFrame, reach: float, kind: str) -> DataFrame:
    """Rows of split cells, each entered in all children whose border it is near; ``home`` gets the child that it is in.

    A row whose home is another cell counts as at home in the child it is nearest to, for the next split; its real home
    stays. Two linked rows x, y of a cell meet in x's child: y is within ``reach`` of the border of y's and x's child.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, homes = np.array(b.column(1).to_pylist(), object), b.column(2).to_pylist()
            for name in dict.fromkeys(cells.tolist()):
                at = np.flatnonzero(cells == name)
                c = np.frombuffer(b.column(5)[int(at[0])].as_py()).reshape(b.column(6)[int(at[0])].as_py(), -1)
                best, into = entered(units(b.column(4).take(pa.array(at)).to_pylist(), kind), c, reach)
                i, j = np.nonzero(into)
                take = pa.array(at[i])
                # child names of one length, so that a parent's name order is its children's
                cell = [f"{name}.{k:02d}" for k in j.tolist()]
                home = [f"{name}.{best[r]:02d}" if homes[at[r]] == name else homes[at[r]] for r in i.tolist()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(cell, pa.string()), pa.array(home, pa.string()), b.column(3).take(take), b.column(4).take(take)], ["cls", "cell", "home", "n", "x"])

    met = rows.join(centres, "cell").select("cls", "cell", "home", "n", "x", "centres", "k")
    return arrow(met, PLACED, each)


PLACED = "cls long, cell string, home string, n long, x binary"


def placed(cls: DataFrame, reach: float, kind: str) -> DataFrame:
    """Every class in its cells (``PLACED``): labels are cells at first, and cells above FULL rows are split by k-means,
    again and again, as long as a split is of use (it is not where most vectors are within the borders)."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [np.array(v.as_py(), kind).tobytes() for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(1), b.column(3), pa.array(blobs, pa.binary())], ["cls", "cell", "home", "n", "x"])

    rows = table(arrow(cls.select("cls", "g", "v", "n"), PLACED, start), "vector-cells")
    done, depth, parents = [], 0, None
    while True:
        sizes = rows.groupBy("cell").agg(F.count("*").alias("m"))
        if parents is not None:  # a child nearly as large as its parent stays whole
            sizes = sizes.withColumn("up", F.expr("substring(cell, 1, length(cell) - 3)")).join(parents, "up", "left").withColumn("stay", F.col("m") > 0.8 * F.col("was")).drop("up", "was")
        else:
            sizes = sizes.withColumn("stay", F.lit(False))
        sizes = table(sizes, "vector-sizes")
        full = sizes.where(f"m > {FULL} and not coalesce(stay, false)").select("cell", "m")
        if not full.limit(1).count():
            return _union([*done, rows])
        big = rows.join(full, "cell").withColumn("h", F.xxhash64("x", F.lit(depth)))
        least = full.select("cell", (F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("m"))).alias("most"))
        centres = cut(centroids(big, least, reach, kind))
        parted = full.join(centres.select("cell"), "cell")
        if not parted.limit(1).count():
            return _union([*done, rows])
        done.append(rows.join(centres.select("cell"), "cell", "left_anti").select("cls", "cell", "home", "n", "x"))
        # hot cells are split by the join; their rows are dealt anew afterwards
        rows = table(split(rows, centres, reach, kind), f"vector-cells{depth}")
        parents, depth = parted.select(F.col("cell").alias("up"), F.col("m").alias("was")), depth + 1


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


@lru_cache(maxsize=8)
def _turn(d: int, m: int) -> np.ndarray:
    """``m`` orthonormal directions of ``d`` dimensions, the same in every process."""
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, m)))[0]


def sketch(x: np.ndarray) -> np.ndarray:
    """Short unit vectors in half precision, for unit rows: a quarter of the dimensions (16 at least), turned, and the length
    of the rest. The cosine of two sketches is not less than that of their vectors, but for rounding (SKETCH_SLACK)."""
    d = x.shape[1]
    m = max(16, d // 4)
    if m >= d:
        return x.astype(np.float16)
    y = x @ _turn(d, m)
    return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))[:, None]]).astype(np.float16)


def groups(large: DataFrame, least: float, kind: str) -> DataFrame:
    """``node, root`` for the rows of ``large`` (PLACED and the cell's size ``m``) that may link with another: the classes
    that links of sketches join. No link leaves a group, and a class without such a link is in none.

    Sketches travel packed, some 42 bytes a vector of 64 components, and meet in pairs of blocks; what leaves a task is a
    spanning forest.
    """
    dealt = large.withColumn("b", F.ceil(F.col("m") / SKETCHES).cast("int")).withColumn("i", F.pmod(F.xxhash64("cls"), F.col("b")).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            cls, b, i = (t.column(k).to_numpy() for k in (0, 3, 4))
            names, code = np.unique(np.array(t.column(1).to_pylist(), object).astype(str), return_inverse=True)
            order = np.lexsort((i, code))
            ends = np.flatnonzero(np.diff(code[order]) | np.diff(i[order])) + 1
            out = []
            for at in np.split(order, ends):
                s = sketch(units(t.column(2).take(pa.array(at)).to_pylist(), kind))
                out.append((str(names[code[at[0]]]), int(b[at[0]]), int(i[at[0]]), cls[at].tobytes(), s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["cell", "b", "i", "ids", "s"])

    packs = arrow(dealt.select("cls", "cell", "x", "b", "i"), "cell string, b int, i int, ids binary, s binary", pack)
    met = packs.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    met = met.select("cell", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "ids", "s")
    forest = met.groupBy("cell", "lo", "hi").applyInArrow(lambda t: _forest(t, least - SKETCH_SLACK), "a long, b long")
    tree = components(table(forest, "vector-forest"))
    return table(tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct()), "vector-groups")


def _forest(t: pa.Table, least: float) -> pa.Table:
    """``a, b``: a spanning forest of the sketches of two blocks, or of one, with a cosine of ``least`` or more."""
    i, lo, hi = t.column("i").to_numpy(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
    ids, sides = [], []
    for k in dict.fromkeys((lo, hi)):
        own = t.filter(pa.array(i == k))
        ids.append(np.frombuffer(b"".join(own.column("ids").to_pylist()), np.int64))
        sides.append(np.frombuffer(b"".join(own.column("s").to_pylist()), np.float16).reshape(len(ids[-1]), -1).astype(np.float32) if len(ids[-1]) else None)
    left, right, shift = sides[0], sides[-1], len(ids[0]) if lo != hi else 0
    ids = np.concatenate(ids)
    low, p, q, n = np.arange(len(ids)), [], [], 0
    step = max(1, TILE // max(1, len(ids) - shift))
    for at in range(0, len(left) if left is not None and right is not None else 0, step):
        first = at if lo == hi else 0
        a, b = np.nonzero(left[at : at + step] @ right[first:].T >= least)
        a, b = a + at, b + first + shift
        new = low[a] != low[b]
        p.append(a[new])
        q.append(b[new])
        n += len(p[-1])
        if n > TILE // 8 or (n and at + step >= len(left)):
            low, p, q, n = _joined(low, np.concatenate(p), np.concatenate(q)), [], [], 0
    on = low != np.arange(len(ids))
    return pa.table({"a": pa.array(ids[on]), "b": pa.array(ids[low[on]])})


def _met(large: DataFrame, least: float, kind: str) -> DataFrame:
    """Rows of large cells as tasks take them (``TAKEN``): those of small groups many together, since a group's rows link
    with no others; a group above FULL by itself, in pairs of blocks where it is larger than a block."""
    own = large.select("cell", "cls").join(groups(large, least, kind), F.col("cls") == F.col("node")).select("cell", "cls", "root")
    sizes = own.groupBy("cell", "root").agg(F.count("*").alias("g"))
    small = sizes.where(f"g <= {FULL}").groupBy("cell").agg(F.ceil(F.sum("g") / CELL).alias("buckets"))
    part = F.when(F.col("g") > FULL, -1 - F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.col("buckets")))
    known = sizes.where("g > 1").join(small, "cell", "left").select("cell", "root", part.alias("part"), F.when(F.col("g") > FULL, F.col("g")).otherwise(0).alias("g"))
    rows = large.join(table(own.join(known, ["cell", "root"]).select("cell", "cls", "part", "g"), "vector-met"), ["cell", "cls"])
    wide = 8 // np.dtype(kind).itemsize
    rows = rows.withColumn("b", F.greatest(F.lit(1), F.ceil(F.col("g") / F.greatest(F.lit(1), F.floor(BLOCK_BYTES / (wide * F.length("x")))))).cast("int"))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("cls"), F.col("b")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    return rows.select("cell", "part", "cls", "home", "n", "x", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST) -> DataFrame:
    """``id, n_links, component_id, kept`` for each row; exact for every pair of equal, non-null labels.

    Labels are cells; cells above FULL vectors are split by k-means, fitted on a bounded sample of each (about SAMPLE
    rows with small hashes); all vectors are indexed. A vector of one cell is also entered in a cell whose border is
    within r, the chord of the threshold: whatever is linked to it there is no farther, so the two meet. A cell is one
    task's work, by matrix products in blocks. A large cell that no split makes smaller keeps its vectors in place: short
    sketches meet instead, whose cosines are not less than the vectors', and only vectors with a near sketch are compared,
    by groups that no link leaves. What leaves a task is link counts and a spanning forest, never the pairs. Vectors that
    are null, zero, or hold null or non-finite components, and rows with a null label, have no links. Vectors of different
    length don't link. Repeated ids are separate rows. n_links counts other rows. kept: the id is its component's least.
    An empty table gives an empty result; other columns are not read. ``vectors`` is read twice.
    """
    spark, before = vectors.sparkSession, made(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    kind = {"float": "f4", "double": "f8"}[component(rows)]
    cls = classes(rows).withColumn("g", F.concat_ws("/", F.size("v").cast("string"), F.length("label").cast("string"), "label"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    cells = placed(cls, reach, kind)
    sizes = table(cells.groupBy("cell").agg(F.count("*").alias("m")), "vector-sizes")
    zero = F.lit(0)
    taken = cells.join(sizes.where(f"m between 2 and {FULL}"), "cell").select("cell", zero.cast("long").alias("part"), "cls", "home", "n", "x", zero.alias("lo"), zero.alias("hi"), zero.alias("i"))
    if sizes.where(f"m > {FULL}").limit(1).count():
        taken = taken.unionByName(_met(cells.join(sizes.where(f"m > {FULL}"), "cell"), least, kind))

    def compare(t: pa.Table) -> pa.Table:
        """One cell, or a part of one, or one pair of a part's blocks. A pair of vectors counts in the cell that is the
        lesser of their homes."""
        return _compare(t.column("cell")[0].as_py(), t, least, kind)

    release(spark)
    found = table(taken.groupBy("cell", "part", "lo", "hi").applyInArrow(compare, "cls long, links long, root long"), "vector-links")
    for at in made(spark):  # of the vectors' copies only the classes are read again
        if at not in before and "/vector-classes-" not in at and "/vector-links-" not in at:
            discard(spark, at)
    release(spark)
    tree = components(found.where("root <> cls").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = cls.select("cls", "low", "n").join(links, "cls", "left").where("n > 1 or links > 0").join(tree, F.col("cls") == tree.node, "left").select("cls", "low", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root"))
    best = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = known.join(best, "root").select("cls", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id").join(cls.select("cls", F.col("label").alias("l"), F.col("v").alias("w")), "cls")
    got = _attach(rows, known)
    n = F.coalesce("n_links", F.lit(0))
    comp = F.coalesce("component_id", "id")
    return got.select("id", n.alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def _attach(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Each row with its class: by label and a digest of the vector's components, compared in full as well."""
    digest = lambda c: F.xxhash64(c)
    c = component(rows)
    own = rows.select("id", "label", F.transform("v", lambda x: x.cast(c) + F.lit(0.0).cast(c)).alias("w")).withColumn("h", digest(F.col("w")))
    k = known.select("l", F.col("w").alias("u"), digest(F.col("w")).alias("hh"), "n_links", "component_id")
    return own.join(k, (own.label == k.l) & (own.h == k.hh) & (own.w == k.u), "left").select("id", "n_links", "component_id")


def _compare(cell: str, t: pa.Table, least: float, kind: str) -> pa.Table:
    """``cls, links, root`` of those linked. Rows of blocks lo and hi (both ends of ``t``'s pair): pairs across, or all
    where the blocks are one. Vectors are taken some at a time against all, and their links then forgotten."""
    t = t.sort_by("cls")
    ids, home, n, i = (t.column(c).to_numpy() for c in ("cls", "home", "n", "i"))
    lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
    x = units(t.column("x").to_pylist(), kind)
    names, code = np.unique(home.astype(str), return_inverse=True)
    here = np.searchsorted(names, cell)
    own = here < len(names) and names[here] == cell
    links, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
    left = np.flatnonzero(i == lo)
    right = left if lo == hi else np.flatnonzero(i == hi)
    across, step = x[right].T, max(1, TILE // max(1, len(right)))
    for at in range(0, len(left) if own else 0, step):
        some = left[at : at + step]
        s = x[some] @ across
        hit = s >= least
        for p, q in np.argwhere(np.abs(s - least) < 1e-12):  # at the threshold the plain sum of products decides
            hit[p, q] = float((x[some[p]] * x[right[q]]).sum()) >= least
        hit &= np.minimum(code[some][:, None], code[right][None, :]) == here
        p, q = np.nonzero(hit)
        p, q = some[p], right[q]
        p, q = p[p != q], q[p != q]
        np.add.at(links, p, n[q])
        if lo != hi:
            np.add.at(links, q, n[p])
        new = low[p] != low[q]
        if new.any():
            low = _joined(low, p[new], q[new])
    on = links > 0
    return pa.table({"cls": pa.array(ids[on]), "links": pa.array(links[on]), "root": pa.array(ids[low][on])})


def _joined(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each reaches, by links ``a, b`` beside those that gave ``low``; by pointer jumping."""
    own = np.arange(len(low))
    a, b = np.concatenate((a, own)), np.concatenate((b, low))
    while True:
        was, m = low, np.minimum(low[a], low[b])
        low = low.copy()
        for side in (a, b):
            np.minimum.at(low, was[side], m)
            np.minimum.at(low, side, m)
        low = low[low]
        if (low == was).all():
            return low


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``embeddings``; what ``near_duplicates`` says of nulls holds."""
    return near_duplicates(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
