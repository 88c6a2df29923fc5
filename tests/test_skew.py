"""Joins in which one key holds most rows, against loops over the same rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quadrille.operators import sets, skew


@pytest.fixture(autouse=True)
def small_pieces(monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 5)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join(spark, how):
    rng = random.Random(1)
    a = [(rng.choice([1] * 9 + [2, 3, None]), i) for i in range(300)]
    b = [(1, "x"), (1, "y"), (2, "z"), (None, "n"), (9, "q")]
    left, right = spark.createDataFrame(a, "k int, i int"), spark.createDataFrame(b, "k int, v string")
    assert Counter(map(tuple, skew.spread_join(left, right, ["k"], F.xxhash64("i"), how).collect())) == Counter(map(tuple, left.join(right, "k", how).collect()))


def test_cells_are_disjoint_and_cover_a_band(spark):
    rng = random.Random(2)
    ends = [sorted((rng.randrange(64), rng.randrange(64))) for _ in range(300)] + [[0, 63], [5, 5]]
    for r in spark.createDataFrame(ends, "a long, b long").select("a", "b", sets.band_cells(F.col("a"), F.col("b"), 6).alias("c")).collect():
        assert sorted(x for d in r["c"] for x in range(d["cell"] << d["level"], (d["cell"] + 1) << d["level"])) == list(range(r["a"], r["b"] + 1))
        assert len(r["c"]) <= 12


def test_range_join_with_open_and_wide_bands(spark):
    rng = random.Random(3)
    points = [(i, rng.choice([rng.uniform(-50, 1000), 7.0, None])) for i in range(500)]
    bands = [(i, rng.choice([None, rng.uniform(-100, 1100)]), rng.choice([None, rng.uniform(-100, 1100)])) for i in range(60)] + [(60, 7.0, 7.0), (61, 2000.0, 3000.0)]
    got = sets.range_join(spark.createDataFrame(points, "p long, v double"), spark.createDataFrame(bands, "k long, lo double, hi double"), "v", "lo", "hi", 3.0, bound=5)
    assert sorted((r["p"], r["k"]) for r in got.collect()) == sorted((p, k) for p, v in points if v is not None for k, lo, hi in bands if (lo is None or lo <= v) and (hi is None or v <= hi))


def test_asof_join_with_a_hot_key(spark):
    rng = random.Random(4)
    events = [(rng.choice([1] * 9 + [2, 3, None]), rng.choice([rng.randint(0, 40), 20, 20, None]), i) for i in range(600)]
    known = [(rng.choice([1] * 9 + [2, 3, None]), rng.choice([rng.randint(0, 40), 20, None]), rng.randint(0, 99)) for i in range(200)]
    got = sets.asof_join(spark.createDataFrame(events, "k long, t long, i long"), spark.createDataFrame(known, "k long, u long, v long"), "k", "t", "u", "v").collect()
    best = lambda k, t: max(((u, v) for kk, u, v in known if kk == k and u is not None and u <= t), default=(0, None))[1] if None not in (k, t) else None
    assert sorted((r["i"], r["v"]) for r in got) == [(i, best(k, t)) for k, t, i in events]


def test_a_key_of_most_rows_is_dealt_evenly(spark):
    """One key holds 90 of 100 events; no piece holds more than twice the share that a piece may have."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), (F.col("id") * 7919 % 20_000).alias("t"))
    total, parts = 20_000, 64
    cuts = skew.time_cuts(rows, "k", "t", total, parts)
    placed = rows.join(cuts, F.col("k") == F.col("__key")).withColumn("piece", skew.below(F.col("__cuts"), F.col("t"), parts))
    sizes = [r["count"] for r in placed.groupBy("piece").count().collect()]
    assert len(sizes) >= 50 and max(sizes) <= 2 * total // parts
