import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.config import Config, parse_metric, seed_from_number
from vexel.errors import BadFormatError, DimensionMismatchError, SnapshotError, VersionMismatchError
from vexel.functions.distance import cosine_distance, distance, dot_distance, l2_squared, vector_literal
from vexel.functions.embedding import HashingEmbedder, ModelEmbedder, bucket, tokens
from vexel.operators import search
from vexel.sources.snapshot import Collection, Files, safe_name
from vexel.store import TextStore, VectorStore
from vexel.streaming.fold import SnapshotFold


def splitmix(seed):
    s, mask = seed, (1 << 64) - 1
    while True:
        s = (s + 0x9E3779B97F4A7C15) & mask
        z = s
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
        yield z ^ z >> 31


def generated(seed, n, dims):
    g = splitmix(seed)
    return [[float(np.float32((next(g) >> 40) / 2.0**24 * 2 - 1)) for _ in range(dims)] for _ in range(n)]


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_config():
    assert parse_metric("Euclidean") == "l2" and Config().metric == "cosine"
    with pytest.raises(ValueError):
        parse_metric("x")
    assert seed_from_number(1.0) == 0x3FF0000000000000
    assert safe_name("..a/b") == "_a_b" and safe_name("") == "_"


def test_known_distances(spark):
    z, u, a = vector_literal([0.0, 0.0]), vector_literal([1.0, 0.0]), vector_literal([3.0, 4.0])
    r = spark.range(1).select(cosine_distance(z, a), cosine_distance(z, z), dot_distance(u, u), l2_squared(z, a), distance("cosine", vector_literal([]), vector_literal([]))).first()
    assert tuple(r) == (1.0, 1.0, 0.0, 25.0, 1.0)


def test_hash_buckets(spark):
    want = {"the": 28, "cat": 7, "sat": 23, "on": 16, "mat": 29, "a": 12, "feline": 6, "quantum": 2, "chromodynamics": 27, "describes": 1, "quarks": 10}
    got = spark.createDataFrame([(w,) for w in want], "w string").select("w", bucket(F.col("w"), 32)).collect()
    assert {r[0]: r[1] for r in got} == want


def test_life_cycle(spark):
    s = VectorStore.create(spark, 4)
    assert s.is_empty() and s.search([0.0] * 4, 5).count() == 0
    for i, v in zip("abc", np.eye(4)[:3].tolist(), strict=True):
        s.insert(i, v)
    assert ids(s.search([0.95, 0.05, 0, 0], 1)) == ["a"]
    with pytest.raises(DimensionMismatchError, match="expected 4, got 2"):
        s.insert("a", [1.0, 2.0])
    with pytest.raises(DimensionMismatchError):
        s.search([1.0], 0)
    assert s.search([1.0, 0, 0, 0], 0).count() == 0
    assert s.remove("a") and not s.remove("a") and len(s) == 2 and "a" not in s
    s.insert("b", [1.0, 0, 0, 0])  # upsert moves to the end
    assert ids(s.search([1.0, 0, 0, 0], 5)) == ["b", "c"]
    s.insert("d", [1.0, 0, 0, 0])
    assert ids(s.search([1.0, 0, 0, 0], 2)) == ["b", "d"]  # ties by insertion
    s.compact()
    assert len(s) == 3 and [r.seq for r in s.live().orderBy("seq").collect()] == [0, 1, 2]
    s.clear()
    assert s.is_empty()
    s.insert("c", [0, 0, 0, 1.0])
    assert ids(s.search([0, 0, 0, 1.0], 3)) == ["c"]


def test_generated_neighbours(spark):
    want = {"cosine": "v71 v73 v146 v219 v402 v60 v283 v269 v233 v272", "dot": "v118 v73 v495 v26 v402 v60 v4 v324 v233 v126", "l2": "v71 v343 v102 v219 v342 v60 v283 v269 v233 v272"}
    data, asked = generated(0xABCD1234, 500, 16), generated(0x5555AAAA, 10, 16)
    rows = spark.createDataFrame([(f"v{i}", i, v) for i, v in enumerate(data)], "id string, seq long, vector array<float>")
    q = spark.createDataFrame(list(enumerate(asked)), "qid long, vector array<float>")
    for metric, names in want.items():
        exact = {(r.qid, r["rank"]): (r.id, r.distance) for r in search.knn_batch(rows, q, 5, metric).collect()}
        assert [exact[i, 1][0] for i in range(10)] == names.split()
        fast = {(r.qid, r["rank"]): (r.id, r.distance) for r in search.knn_batch_arrow(rows, q, 5, metric).collect()}
        assert fast == exact


def test_snapshots(spark, tmp_path):
    s = VectorStore.open(spark, str(tmp_path), "my store", 3)
    with pytest.raises(TimeoutError):
        VectorStore.open(spark, str(tmp_path), "my store", 3, timeout=0.3)
    s.insert("x", [1, 2, 3])
    s.insert("y", [0, 0, 1])
    s.remove("y")
    s.close()
    t = VectorStore.open(spark, str(tmp_path), "my store", 3)
    assert len(t) == 1 and t.live().first().seq == 0
    t.insert("z", [1, 1, 1])
    assert [r.seq for r in t.live().orderBy("seq").collect()] == [0, 3]
    t.close()
    c = Collection(spark, str(tmp_path), "my store")
    at, files = f"{c.path}/{c.current()}", Files(spark)
    good = files.read(f"{at}/manifest.json")
    for data, error in ((b"no", BadFormatError), (json.dumps({"magic": "?"}).encode(), BadFormatError), (json.dumps({**json.loads(good), "version": 2}).encode(), VersionMismatchError), (json.dumps({**json.loads(good), "rows": 9}).encode(), SnapshotError)):
        files.write(f"{at}/manifest.json", data)
        with pytest.raises(error):
            c.load()


def test_text(spark):
    t = TextStore.create(spark, HashingEmbedder())
    assert t.insert("the cat sat on the mat") == "auto-0"
    assert t.insert("a feline napped on a rug", "feline-doc") == "feline-doc"
    assert t.insert("quantum chromodynamics describes quarks", request="r1") == "auto-1"
    assert t.insert("quantum chromodynamics describes quarks", request="r1") == "auto-1" and t.size() == 3
    hit = t.query("the cat sat on the mat", 1)[0]
    assert hit["id"] == "auto-0" and hit["score"] > 0.99 and hit["text"] == "the cat sat on the mat"
    assert t.remove("auto-0") and t.size() == 2


def test_hashing_embedder_equals_columns(spark):
    texts = ["the cat sat on the mat", "", None, "A  a\u00a0b\u3000c\x1cd", "\U0001f600 é É İ", " lead trail "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    words = rows.select("i", F.explode(tokens(F.col("t"))).alias("w")).select("i", bucket(F.col("w"), 32).alias("b")).collect()
    for r in rows.select("i", HashingEmbedder().embed(F.col("t")).alias("v")).collect():
        n = np.bincount([w.b for w in words if w.i == r.i], minlength=32).astype(float)
        assert np.allclose(r.v, n / (np.sqrt((n * n).sum()) or 1), atol=1e-7)


def test_model_embedder(spark):
    def load():
        calls = []

        def model(texts):
            assert len(texts) <= 3
            calls.append(len(texts))
            return [[len(t), len(calls) > 0] for t in texts]

        return model

    e = ModelEmbedder(load, 2, batch=3)
    rows = spark.createDataFrame([("a" * i,) for i in range(20)] + [(None,)], "t string")
    assert sorted(tuple(r.v) for r in rows.select(e.embed(F.col("t")).alias("v")).collect()) == sorted([(float(i), 1.0) for i in range(20)] + [(0.0, 1.0)])
    t = TextStore.create(spark, e)
    assert t.insert("four") == "auto-0" and t.query("four", 1)[0]["id"] == "auto-0"


LOG = [(1, "insert", "a"), (2, "insert", "b"), (3, "clear", None), (4, "insert", "a"), (5, "remove", "a")]


def fold_rows(spark, at, batches, every):
    fold = SnapshotFold(spark, str(at), "c", 2, every=every)
    for i, own in enumerate(batches):
        rows = [(s, op, k, [float(s), 0.0] if op == "insert" else None, None) for s, op, k in own]
        for _ in range(1 + (i == 1)):  # a replay changes nothing
            fold(spark.createDataFrame(rows, "seq long, op string, id string, vector array<float>, text string"), i)
    return fold


@pytest.mark.parametrize("every", [1, 2])
def test_stream_fold_in_any_order(spark, tmp_path, every):
    orders = list(itertools.permutations([*LOG, (6, "insert", "b")]))[every::240]
    for n, order in enumerate(orders):
        fold = fold_rows(spark, tmp_path / str(n), [order[:2], order[2:3], order[3:]], every)
        assert [(r.id, r.seq) for r in fold.rows().collect()] == [("b", 6)], order
        fold.publish()
        assert [(r.id, r.seq) for r in fold.rows().collect()] == [("b", 6)] and fold.collection.load()[1].next_seq == 7


def test_late_insert_stays_removed(spark, tmp_path):
    fold = fold_rows(spark, tmp_path, [[(5, "remove", "a")], [(1, "insert", "a"), (2, "insert", "b")], [(3, "clear", None)], [(2, "insert", "c")]], 1)
    assert fold.rows().count() == 0


def test_lease_of_a_dead_writer(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "x")
    lease = c.acquire(seconds=0.5)
    with pytest.raises(TimeoutError):
        c.acquire(timeout=1.5)  # renewed meanwhile
    lease.stop()
    other = c.acquire(timeout=10)
    assert other.held() and not lease.held()
    lease.release()
    assert other.held()
    other.release()


def test_open_texts(spark, tmp_path):
    t = TextStore.open(spark, str(tmp_path), "notes", HashingEmbedder())
    t.insert("alpha one")
    t.insert("beta two")
    other = TextStore.open(spark, str(tmp_path), "notes", HashingEmbedder(), timeout=0.3)
    assert t.store.persistent and not other.store.persistent and other.size() == 0
    t.close()
    again = TextStore.open(spark, str(tmp_path), "notes", HashingEmbedder())
    assert again.size() == 2 and again.insert("gamma three") == "auto-2"
    again.close()


def test_batch_of_no_queries(spark):
    rows = spark.createDataFrame([("a", 0, [1.0])], "id string, seq long, vector array<float>")
    none = spark.createDataFrame([], "qid string, vector array<float>")
    assert search.knn_batch_arrow(rows, none, 3).dtypes[0] == ("qid", "string") and search.knn_batch_arrow(rows, none, 3).count() == 0
