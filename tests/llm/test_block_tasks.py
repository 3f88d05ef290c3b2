"""Pairs of blocks are dealt by a shuffle of their own, and trees over halves lose no pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgauge.llm import simhash


def test_block_pairs_are_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 64)
    rng = np.random.default_rng(2)
    rows = [(f"{p:016x}", p, 0, 1, 1) for p in rng.integers(-(1 << 63), (1 << 63) - 1, 600).tolist()]
    points = spark.createDataFrame(rows, "node string, fp long, fp2 long, lo long, hi long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = simhash.links(points, 3, 3, None)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = plan[plan.index("FlatMapGroupsInArrow") :]
    assert "Exchange hashpartitioning(_task" in below[: below.index("Project")], plan


@pytest.mark.parametrize("radius", [2, 3])
def test_halves_cover_pairs(radius):
    rng = np.random.default_rng(7)
    points = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    near = points.copy()
    for _ in range(radius):
        near ^= np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)
    met = np.zeros(4000, bool)
    for mask in map(np.uint64, simhash.HALVES):
        tree = simhash.grow(points & mask, 4000, radius // 2, 300)
        leaves = [set() for _ in range(8000)]
        for row, leaf in zip(*simhash.route(tree, np.concatenate([points, near]) & mask, radius // 2), strict=True):
            leaves[row].add(leaf)
        assert len(set().union(*leaves)) > 8
        met |= [bool(leaves[i] & leaves[i + 4000]) for i in range(4000)]
    assert met.all()


def test_equal_fingerprints_of_many_rows(spark):
    """A third of all rows with one text, and null texts: one component each."""
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one and the same text")).when(F.col("id") % 3 == 1, F.concat(F.lit("own "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    got = simhash.near_duplicates(df).groupBy("component_id").count().filter("count > 1").collect()
    assert {(r["component_id"], r["count"]) for r in got} >= {(0, 10_000), (2, 10_000)}
