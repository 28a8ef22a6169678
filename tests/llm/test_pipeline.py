"""The pipeline's stages, each on its own input, on a small fixture."""

from collections import Counter

import numpy as np

import corpus_pipeline as pipeline
from vexel.llm import common, simhash

rng = np.random.default_rng(8)
VOCAB = ["".join(rng.choice(list("abcdeéñ"), rng.integers(2, 7))) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCAB, n))


KEY = "AKIA" + "Q7W8E9R1T2Y3U4I5"


def fixture(spark, at):
    rows = [(i, prose(120, i) + (f" {KEY}" if i == 7 else ""), "en", f"s{i % 4}") for i in range(80)]
    rows += [(500 + i, rows[i][1], "en", "s0") for i in range(10)]  # copies
    long = prose(900, 1000)
    rows += [(600, long, "en", "s1"), (601, long + " one more", "en", "s1")]  # near copies
    rows += [(700, "too short", "en", "s1"), (701, "again and " * 200, "en", "s2"), (702, None, "en", "s2"), (703, "", None, None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")


def test_stages(spark, tmp_path):
    at = str(tmp_path)
    fixture(spark, at)
    seen, docs = {}, common.read(spark, at, "documents")
    for name, stage in pipeline.STAGES:
        docs = common.table(stage(spark, docs, at), f"test-{name}")
        seen[name] = docs.toPandas()
        if name != "packing":
            assert tuple(docs.columns) == pipeline.COLUMNS
    clean = set(range(80)) | {500 + i for i in range(10)} | {600, 601}
    assert set(seen["quality"].doc_id) == clean
    assert set(seen["near_duplicates"].doc_id) == set(range(80)) | {600}
    text = seen["secrets"].set_index("doc_id")
    assert len(text) == 81 and KEY not in text.text[7] and text.text[7].endswith("[secret]") and text.n_chars[7] == len(text.text[7])
    assert all(text.text[i] == prose(120, i) for i in range(80) if i != 7)
    copies = Counter(seen["mixing"].doc_id)
    assert set(copies) <= set(text.index) and max(copies.values()) <= 3
    pieces = seen["packing"]
    assert Counter(pieces[pieces.start == 0].doc_id) == copies
    again = pipeline.run(spark, at).toPandas()
    assert Counter(map(tuple, again[["doc_id", "start", "length", "ids_crc32"]].to_numpy().tolist())) == Counter(map(tuple, pieces[["doc_id", "start", "length", "ids_crc32"]].to_numpy().tolist()))


def test_near_copies_are_close():
    long = prose(900, 1000)
    assert bin(simhash.fingerprint(long, 5) ^ simhash.fingerprint(long + " one more", 5)).count("1") <= 4


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
