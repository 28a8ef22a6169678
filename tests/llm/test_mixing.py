"""Mixing where many rows are equal in id and size."""

from pyspark.sql import functions as F

from vexel.llm import mixing


def test_equal_rows_are_dealt_over_leaves(spark, monkeypatch):
    """A third of all rows have no id and one size: no leaf holds more than a few, and totals hold."""
    n = 6000
    rows = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("one two three four").alias("text"), F.when(F.col("id") % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("source"))
    largest = []
    level = mixing._level

    def watched(rows, last):
        largest.append(rows.groupBy("node").count().agg(F.max("count")).first()[0])
        return level(rows, last)

    monkeypatch.setattr(mixing, "_level", watched)
    got = mixing.mix(rows).collect()
    assert len(got) == n and max(largest) < 4 * mixing.FAN
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4
        # equal rows have coins of their own: some are taken once more than others
        assert len({r.copies for r in own if r.id is None}) == 2
