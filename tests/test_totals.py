"""Scores of multisets without a join of their counts, and totals over bands without pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators import evaluation, sets


def test_multisets_meet_without_a_join(spark):
    schema = "case long, row array<string>"
    predicted = spark.createDataFrame([(1, ["a"]), (1, ["a"]), (1, ["b", None]), (2, ["x"]), (None, ["a"]), (4, None), (5, ["a,b"])], schema)
    reference = spark.createDataFrame([(1, ["a"]), (1, ["b", None]), (1, ["b", "null"]), (3, ["y"]), (None, ["a"]), (4, None), (5, ["a", "b"])], schema)
    got = evaluation.multiset_scores(predicted, reference)
    assert {r["case"]: (r["predicted"], r["reference"], r["overlap"]) for r in got.collect()} == {1: (3, 3, 2), 2: (1, 0, 0), 3: (0, 1, 0), None: (1, 1, 0), 4: (1, 1, 0), 5: (1, 1, 0)}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("width", [0.5, 3.0, 1e6])
def test_range_totals_are_those_of_the_pairs(spark, width):
    rng = random.Random(7)
    points = [(i, rng.choice([None, round(rng.uniform(-50, 50), 1), float(rng.randrange(-50, 50))])) for i in range(400)]
    ends = lambda: rng.choice([None, -80.0, 80.0, round(rng.uniform(-60, 60), 1)])
    bands = [(i, ends(), ends()) for i in range(80)] + [(90, 5.0, 5.0), (91, 5.0, 5.0), (92, None, None), (93, 9.0, -9.0), (94, 200.0, None)]
    expected = {}
    for b, low, high in bands:
        if held := [i for i, v in points if v is not None and (low is None or v >= low) and (high is None or v <= high)]:
            expected[b] = (len(held), min(held), max(held))
    p, b = spark.createDataFrame(points, "i long, v double"), spark.createDataFrame(bands, "b long, low double, high double")
    totals = {"n": (F.lit(1).cast("long"), "sum"), "first": (F.col("i"), "min"), "last": (F.col("i"), "max")}
    got = sets.range_totals(p, b, "v", "low", "high", width, totals).collect()
    assert len(got) == len(expected) and {r["b"]: (r["n"], r["first"], r["last"]) for r in got} == expected
    assert sets.range_totals(p.where("v IS NULL"), b, "v", "low", "high", width, totals).collect() == []
