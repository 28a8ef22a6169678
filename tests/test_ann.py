import os

import numpy as np
import pytest

from vexel.config import Config
from vexel.operators.ann import IvfIndex
from vexel.plans.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_recall_is_whole(spark):
    assert QUERIES["ann_recall"](spark, DATA).first().recall >= 0.9


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_one_probe_is_exact(spark, tmp_path, metric):
    r = np.random.default_rng(2)
    rows = [(str(i), i, v) for i, v in enumerate(r.normal(size=(300, 8)).tolist() + [[0.0] * 8])]
    table = spark.createDataFrame(rows, "id string, seq long, vector array<float>")
    queries = table.where("seq % 20 = 0").selectExpr("seq as qid", "vector")
    index = IvfIndex.build(table, str(tmp_path / "ivf"), Config(metric=metric), clusters=8, rounds=3)
    pick = lambda df: sorted((x.qid, x["rank"], x.id) for x in df.collect())
    assert pick(index.search(queries, 5, 1)) == pick(index.exact(queries, 5)) == pick(index.search(queries, 5))
