"""Whitening and vector codes against brute force."""

import hashlib

import numpy as np
import pytest

from vexel.llm import codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, code string, x int"
ODD = [None, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [], [1.0] * 3]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x", 2) for i, v, lab in rows], SCHEMA)


def good(rows):
    return [(i, v, lab) for i, v, lab in rows if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v)]


def vectors(n, seed=1, spread=0.2):
    rng = np.random.default_rng(seed)
    v = (rng.standard_normal((n, 16)) * np.linspace(0.05, spread, 16) @ np.linalg.qr(rng.standard_normal((16, 16)))[0]).astype(np.float32)
    return [(i, [float(x) for x in r], int(i % 3) if i % 7 else None) for i, r in enumerate(v)]


# vector codes


def code_brute(rows, parts=16, entries=64, rounds=2, scale=256):
    rows = sorted(good(rows), key=lambda r: (r[0] is None, r[0] or 0, [int(np.floor(scale * x)) for x in r[1]]))
    x = [[int(np.floor(scale * float(c))) for c in r[1]] for r in rows]
    w = len(x[0]) // parts
    books = [[y[p * w : (p + 1) * w] for y in x[:entries]] for p in range(parts)]

    def nearest(y, p):
        return min((sum((a - b) ** 2 for a, b in zip(y[p * w : (p + 1) * w], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        own = [[nearest(y, p)[1] for p in range(parts)] for y in x]
        for p in range(parts):
            new = []
            for k, e in enumerate(books[p]):
                got = [y[p * w : (p + 1) * w] for y, o in zip(x, own, strict=True) if o[p] == k]
                new.append([sum(c) // len(got) for c in zip(*got, strict=True)] if got else e)
            books[p] = new
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out, by = [], {}
    for (i, _, lab), y in zip(rows, x, strict=True):
        near = [nearest(y, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), lab))
        by[lab] = by.get(lab, 0) + out[-1][2]
    return sorted(((i, c, e, by[lab], sha) for i, c, e, lab in out), key=repr)


@pytest.mark.parametrize(("parts", "entries", "kept"), [(16, 64, 8), (4, 8, 3), (8, 64, 63), (2, 30, 2)])
def test_codes_equal_brute_force(spark, monkeypatch, parts, entries, kept):
    monkeypatch.setattr(codes, "KEPT", kept)
    rows = vectors(300) + [(1000 + i, vectors(1)[0][1], 1) for i in range(40)] + [(5, vectors(9)[8][1], 2), (None, vectors(4)[3][1], None)]
    rows += [(2000 + i, v, 1) for i, v in enumerate(ODD)]
    got = codes.encode(frame(spark, rows), parts=parts, entries=entries)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == code_brute(rows, parts, entries)


def test_codes_of_more_rounds_huge_components_and_few_rows(spark):
    rows = vectors(200, 5)
    got = codes.encode(frame(spark, rows), entries=16, parts=4, rounds=6)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == code_brute(rows, 4, 16, 6)
    huge = [(i, [float(np.float32(x * 1e7)) for x in v], lab) for i, v, lab in vectors(90, 3)] + [(500, [float(np.float32(2e14))] * 16, None)]
    assert sorted((tuple(r) for r in codes.encode(frame(spark, huge), parts=4).collect()), key=repr) == code_brute(huge, 4)
    three = vectors(3)
    assert sorted((tuple(r) for r in codes.encode(frame(spark, three)).collect()), key=repr) == code_brute(three)
    assert codes.encode(frame(spark, [(1, None, 1)])).count() == 0
    with pytest.raises(ValueError, match="cannot be cut"):
        codes.encode(frame(spark, [(1, [1.0] * 10, 1)]))


def test_bounds_decide_what_whole_numbers_confirm():
    """Bounds never lie above true distances over several rounds, ties go to the lower index, and most parts skip most."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (40, 4))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-15, 15, (3000, 4))
    entries = x[:40].copy()
    best, near, low, outer = codes.closest(x, entries, 6)
    used = []
    for b in (6, 6, 4, 2, 2):
        new = np.array([x[best == k].sum(axis=0) // max(1, (best == k).sum()) if (best == k).any() else entries[k] for k in range(40)])
        best, near, low, outer, u = codes.reassigned(x, new, codes.moved(entries, new), best, near, low, outer, b)
        entries = new
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (best == d.argmin(axis=1)).all()
        true = np.sqrt(d)
        assert (np.take_along_axis(true, near, 1) >= low).all() and near.shape[1] == b
        true[np.arange(len(x))[:, None], near] = np.inf
        true[np.arange(len(x)), best] = np.inf
        assert (true.min(axis=1) >= outer).all()
        used.append((u == 0).mean())
    assert used[-1] > 0.4
    tie = codes.closest(np.array([[0, 0]]), np.array([[3, 0], [0, 2], [2, 0], [0, -2]]), 2)
    assert tie[0].tolist() == [1]


# whitening


@pytest.mark.parametrize("case", ["plain", "copies", "repeated values", "rising", "graded"])
def test_rank_one_updates_keep_the_spectrum(case):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 12)) * np.linspace(0.1, 3, 12)
    if case == "copies":
        x[40:] = x[rng.integers(0, 5, 80)]
    if case == "repeated values":
        x = np.concatenate([np.eye(12), -np.eye(12), 2 * np.eye(12)[:3]])
    if case == "rising":
        x[:, 3:] = 0
    if case == "graded":
        x = x * 10.0 ** -np.arange(12)
    parts = [whitening.Spectrum(12) for _ in range(3)]
    for i, r in enumerate(x):
        parts[i % 3 if i > 5 else 0].add(r)
    one = parts[0]
    for p in parts[1:]:
        one.join(whitening.Spectrum.of(p.blob(), 12))
    c = x - x.mean(axis=0)
    scatter = c.T @ c
    size = np.abs(np.linalg.eigvalsh(scatter)).max()
    assert one.n == len(x) and np.allclose(one.mean, x.mean(axis=0))
    assert np.abs(one.u.T @ one.u - np.eye(12)).max() < 1e-11
    assert np.abs(one.u @ np.diag(one.d) @ one.u.T - scatter).max() < 1e-11 * size
    assert np.abs(one.d - np.linalg.eigvalsh(scatter)).max() < 1e-11 * size


def check(rows, got, k):
    own = good(rows)
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v, _ in own])
    n, total = len(x), x.sum(axis=0)
    c = x - total / n
    values = np.linalg.eigvalsh(c.T @ c / n)[::-1]
    deviation = sorted((i, sum(int(n * a - s) ** 2 for a, s in zip(r.tolist(), total.tolist(), strict=True))) for (i, _, _), r in zip(own, x, strict=True))
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == deviation
    assert {r.n for r in got} == {n} and len(got) == n * k and len({r.identity_error for r in got}) == 1
    return x, c, values


def test_whitening(spark):
    rows = vectors(400) + [(7, vectors(1)[0][1], 1)] + [(1000 + i, v, 1) for i, v in enumerate(ODD)]
    df = frame(spark, rows).repartition(7)
    got = whitening.whiten(df, components=10).withColumnRenamed("id", "vec_id").collect()
    x, c, values = check(rows, got, 10)
    assert got[0].identity_error < 1e-9
    for k in range(1, 11):
        e = {r.explained for r in got if r.component == k}
        assert len(e) == 1 and abs(e.pop() / (values[k - 1] / values.sum()) - 1) < 1e-9
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r.whitened)
    vectors_ = np.linalg.eigh(c.T @ c / len(x))[1][:, ::-1]
    y = c @ vectors_[:, :10] / np.sqrt(values[:10])
    for j, (i, _, _) in enumerate(good(rows)):
        for k in range(10):
            assert min(abs(abs(w) - abs(y[j, k])) for w in by[i][k + 1]) < 1e-7


def test_whitening_without_variance(spark):
    flat = [(i, [0.25] * 16, 1) for i in range(5)]
    got = whitening.whiten(frame(spark, flat)).withColumnRenamed("id", "vec_id").collect()
    check(flat, got, 16)
    assert all(r.whitened == r.explained == r.identity_error == 0 for r in got)
    few = vectors(4)
    got = whitening.whiten(frame(spark, few)).withColumnRenamed("id", "vec_id").collect()
    check(few, got, 16)
    assert got[0].identity_error < 1e-9 and all((r.whitened == 0) == (r.component > 3) for r in got)
    assert abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-9
    huge = [(i, [x * 1e12 for x in v], 1) for i, v, _ in vectors(30)] + [(99, [3e38] * 16, 1)]
    assert len(whitening.whiten(frame(spark, huge)).collect()) == 31 * 16
    assert whitening.whiten(frame(spark, [(1, None, 1), (2, [], 1)])).count() == 0
