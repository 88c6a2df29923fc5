"""Repeated keys: null is a key as in a window of SQL, and texts are folded once and joined by digests."""

import pytest
from pyspark.sql import functions as F

from quadrille import workloads
from quadrille.operators import constraints


def test_first_holders_take_null_as_a_key(spark):
    rows = spark.createDataFrame([(4, None), (2, None), (3, "a"), (1, "b"), (5, "a"), (6, "")], "id long, t string")
    assert sorted(map(tuple, constraints.first_holders(rows, F.col("t"), "id", "id").collect())) == [(4, 2), (5, 3)]


@pytest.mark.parametrize("name", ["first_holder_of_dup", "leaked_from_train"])
def test_texts_are_folded_once(spark, sf_dir, name):
    """The plan of the result reads written digests: it neither folds nor shuffles texts."""
    plan = workloads.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "documents" not in plan
