"""Toxicity: windows, dictionaries, held-out accuracy, whole texts, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.llm import toxicity as T
from vexel.llm.queries import QUERIES

SYLLABLES = "an en in on er re st th nd ti ha he or ou ea wh ing ion ly ble".split()
BAD = ["idiot", "worthless", "pathetic", "scumbag", "moron"]


def word(rng):
    return "".join(rng.choice(SYLLABLES, rng.integers(1, 5)))


def text(rng, bad, n=None):
    w = [word(rng) for _ in range(n or int(rng.integers(30, 300)))]
    if bad:
        for at in rng.choice(len(w), max(2, len(w) // 40), replace=False):
            w[at] = str(rng.choice(BAD))
    return " ".join(w).capitalize() + "."


def corpus(n=700, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, text(rng, i % 5 == 0), int(i % 5 == 0)) for i in range(n)]


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_windows_cover_every_word_of_any_length():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 11, 12, 13, 17, 18, 19, 30, 1001):
        w = [f"{word(rng)}{i}" for i in range(n)]
        got = [x.decode().split() for x in T.windows(" ,".join(w).upper())]
        assert [x for g in got for x in g if g] and len(got) >= n // 12 if n else got == []
        assert {x for g in got for x in g} == set(w) and all(len(g) <= 12 for g in got)
        for a, b in zip(got, got[1:], strict=False):
            assert a[6:] == b[: len(a) - 6]
    assert list(T.windows(None)) == list(T.windows("?! …")) == []


def test_gains_are_differences_of_compressed_lengths():
    rows = corpus(300)
    c = T.train_dictionaries([t for _, t, y in rows if not y], [t for _, t, y in rows if y])
    assert all(b.encode()[:6] in c.toxic for b in BAD) and not any(b.encode() in c.ordinary for b in BAD)
    a, b = c._by
    t = rows[5][1]
    want = np.bincount([min(T.MOST, max(0, len(a(w)) - len(b(w)))) for w in T.windows(t)], minlength=T.MOST + 1)
    assert (c.gains(t) == want).all() and want[1:].sum() > 0
    share = [sum(c.gains(t)[4:].sum() for _, t, y in rows if y == k) / sum(c.gains(t).sum() for _, t, y in rows if y == k) for k in (0, 1)]
    assert share[1] > 5 * share[0]


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("toxic")
    rng = np.random.default_rng(9)
    rows = corpus()
    long_ = [(900, " ".join(text(rng, False, 300) for _ in range(200)), 0), (901, " ".join([text(rng, False, 300) for _ in range(20)] + [text(rng, True, 300) for _ in range(10)]), 1)]
    odd = [(910, None, None), (911, "", 0), (912, "?!", None), (913, "idiot " * 3, None), (None, rows[1][1], 0)] + [(920, rows[0][1], None)] * 2
    docs = [(i, t, "en", "s", "x") for i, t, _ in rows + long_ + odd]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score string").write.parquet(f"{d}/documents.parquet")
    marks = [(i, 1, y) for i, _, y in rows if i % 10 != 9] + [(911, 1, 0), (910, 0, 1), (3, 1, None), (7, 1, 0), (7, 1, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_query(spark, at):
    got = QUERIES["op12_toxicity"](spark, at)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "boolean", "double", "int"]
    rows = got.collect()
    assert len(rows) == 709
    by = {r.doc_id: r for r in rows}
    assert all(r.held_out == held(r.doc_id) for r in rows if r.doc_id is not None) and not by[None].held_out
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    for out in (True, False):
        own = [(by[i].predicted, y) for i, _, y in corpus() if held(i) == out]
        hit = sum(p and y for p, y in own)
        assert hit / sum(y for _, y in own) > 0.9 and hit / sum(p for p, _ in own) > 0.9
    assert by[900].predicted == 0 and by[901].predicted == 1
    assert by[910].score == by[911].score == by[912].score == min(by[910].score, 0.29) and by[920].score == by[0].score


def test_labels_of_held_out_rows_are_not_read(spark, at):
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.train(docs, labels), T.train(docs.repartition(5), other)
    assert a.blobs == b.blobs and (a.weights == b.weights).all() and len(a.weights)


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.scored(docs, T.train(docs, none)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r.score for r in T.scored(docs, T.train(docs, one)).collect()] == [1.0, 1.0]
    assert T.scored(docs.limit(0), T.train(docs.limit(0), one)).count() == 0
