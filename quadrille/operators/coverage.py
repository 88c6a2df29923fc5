"""Coverage requirements of a release, and the gaps against them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CoverageError
from .constraints import REGISTERS, SPLITS


def load_requirements(spark: SparkSession, path: str, families: dict) -> dict:
    """The four fields, strictly: all registers, and numeric cases that set every slot of their family."""
    value = json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    wanted = {"priority_domains", "numeric_cases", "rejection_classes", "required_registers"}
    if not isinstance(value, dict) or value.keys() != wanted:
        raise CoverageError("coverage requirements must have exactly " + ", ".join(sorted(wanted)))
    if sorted(value["required_registers"]) != sorted(REGISTERS):
        raise CoverageError("required_registers must be the allowed registers")
    for c in value["numeric_cases"]:
        if not isinstance(c, dict) or c.keys() != {"query_id", "split", "slots"} or c["split"] not in SPLITS:
            raise CoverageError(f"malformed numeric case: {c}")
        f = families.get(c["query_id"])
        if f is None or f.slots.keys() != c["slots"].keys():
            raise CoverageError(f"numeric case does not set the slots of {c['query_id']}")
    return value


def missing_numeric_cases(matched: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases (query_id, split, slots as a map) that no row's slots equal; compared as sorted entries."""
    key = lambda c: F.array_sort(F.map_entries(c))
    return cases.withColumn("k", key(F.col("slots"))).join(matched.select("query_id", "split", key(F.col("slots")).alias("k")).distinct(), ["query_id", "split", "k"], "left_anti").drop("k")


def grid_gaps(rows: DataFrame, **axes: Column | list) -> DataFrame:
    """Combinations of the declared axes (column name -> values) that no row has. The grid is the product of a
    few declared lists, never of data."""
    spark = rows.sparkSession
    cells = spark.range(1).select()
    for name, values in axes.items():
        cells = cells.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return cells.join(rows.select(*axes).distinct(), list(axes), "left_anti")


def complete(**gaps: DataFrame) -> DataFrame:
    """(name, gaps, complete): the number of gaps of each kind, and whether all are empty."""
    out = None
    for name, df in gaps.items():
        one = df.agg(F.count(F.lit(1)).alias("gaps")).select(F.lit(name).alias("name"), "gaps")
        out = one if out is None else out.union(one)
    every = out.agg(F.bool_and(F.col("gaps") == 0).alias("complete"))
    return out.crossJoin(F.broadcast(every))


def require_complete(report: DataFrame) -> None:
    bad = report.where("gaps > 0").orderBy("name").collect()
    if bad:
        raise CoverageError("coverage is incomplete: " + ", ".join(f"{r['name']} ({r['gaps']})" for r in bad))


def readiness(report: DataFrame, catalogue_required: bool, missing_slots: DataFrame) -> dict:
    """The list of gaps that keep a release from training."""
    gaps = [] if catalogue_required else [{"code": "catalogue_not_fully_covered"}]
    slots = [r.asDict() for r in missing_slots.where(F.size("missing") > 0).orderBy("query_id", "slot").collect()]
    if slots:
        gaps.append({"code": "finite_slots_missing_from_train", "slots": slots})
    counts = {r["name"]: r["gaps"] for r in report.collect()}
    if any(counts.values()):
        gaps.append({"code": "coverage_incomplete", **counts})
    return {"ready": not gaps, "gaps": gaps}
