import numpy as np
import pytest

from vexel.llm import common, embeddings


def brute(rows, least=0.98):
    n = len(rows)
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                link[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= least
    low = np.array([r[0] for r in rows])
    while True:
        new = np.array([min(low[i], low[link[i]].min() if link[i].any() else low[i]) for i in range(n)])
        if (new == low).all():
            return sorted((rows[i][0], int(link[i].sum()), int(low[i]), bool(low[i] == rows[i][0])) for i in range(n))
        low = new


SCHEMA = "vec_id long, embedding array<float>, label int, component_id string, v int"


@pytest.mark.parametrize(("cell", "full", "children"), [(40, 60, 3), (2000, 50, 64), (2000, 4096, 64)])
def test_equals_brute_force_over_cells_and_blocks(spark, monkeypatch, cell, full, children):
    """Cells split several times, cells that no split makes smaller and whose blocks are compared, and whole labels."""
    for name, value in (("CELL", cell), ("FULL", full), ("CHILDREN", children)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((120, 8))
    rows = []
    for i in range(420):
        v = base[rng.integers(120)] + rng.standard_normal(8) * rng.choice([0.0, 0.05, 0.12, 0.5])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(2))))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(60)]  # copies
    rows += [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [float("nan")] * 8, 1), (2003, [1.0, None] * 4, 1), (2004, rows[0][1], None), (2005, [], 1), (2006, [float("inf")] * 8, 0), (2007, [1e38] * 8, 0), (2008, [1e-38] * 8, 0), (2009, [-0.0] + [1.0] * 7, 0), (2010, [0.0] + [1.0] * 7, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in embeddings.near_duplicates(df).collect())
    assert got == brute(rows)
    assert sum(r[1] for r in got) > 3000


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def without_structure(n, d=64, seed=2):
    """Vectors that lie all over the sphere, and clumps of near copies about some of them."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    for i in range(0, n // 4):
        base[i] = base[i % 20] + rng.standard_normal(d) * rng.choice([0.02, 0.1, 0.14, 0.2])
    return [(i, [float(x) for x in v.astype(np.float32)], int(i % 3 == 0)) for i, v in enumerate(base)]


@pytest.mark.parametrize(("sketches", "block"), [(65_536, 16 << 20), (100, 16 << 20), (100, 20 * 64 * 8)])
def test_vectors_without_structure_stay_in_place(spark, monkeypatch, sketches, block):
    """Splits would enter each vector in nearly all children; they are given up before any vector moves."""
    for name, value in (("CELL", 30), ("FULL", 20), ("SKETCHES", sketches), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(embeddings, name, value, raising=False)
    rows, placed = without_structure(800), []
    monkeypatch.setattr(embeddings, "table", lambda df, label: [t := common.table(df, label), placed.append(t.count()) if label.startswith("vector-cells") else None][0])
    got = sorted(tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect())
    assert got == brute(rows)
    assert 300 < sum(r[1] for r in got)
    assert 0 < sum(placed) <= 2 * len(rows)


def test_copies_of_vectors_go_once_they_are_compared(spark):
    was = common.made(spark)
    assert embeddings.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in without_structure(60)], SCHEMA)).count() == 60
    left = [at.rpartition("/")[2] for at in common.made(spark) if at not in was]
    assert sorted(x.rsplit("-", 1)[0] for x in left) == ["vector-classes", "vector-links"]


@pytest.mark.parametrize("d", [3, 16, 17, 64, 130])
def test_cosines_of_sketches_are_no_less(d):
    rng = np.random.default_rng(d)
    x = embeddings.unit(np.vstack([rng.standard_normal((60, d)), rng.standard_normal(d) + rng.standard_normal((60, d)) * 0.1, np.eye(d)[:3], -np.eye(d)[:3]]))
    s = embeddings.sketch(x)
    assert s.dtype == np.float16 and s.shape[1] <= max(17, d // 4 + 1)
    assert (s.astype(np.float32) @ s.astype(np.float32).T >= x @ x.T - embeddings.SKETCH_SLACK).all()


@pytest.mark.parametrize("kind", ["float", "double", "int"])
def test_components_of_any_type(spark, kind):
    rng = np.random.default_rng(5)
    base = rng.integers(-90, 90, (40, 20))
    rows = [(i, [int(x) for x in base[i % 40] + rng.integers(-12, 13, 20)], 0) for i in range(160)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA.replace("float", "int"))
    got = embeddings.near_duplicates(df.withColumn("embedding", df.embedding.cast(f"array<{kind}>")))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
