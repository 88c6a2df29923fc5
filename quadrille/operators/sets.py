"""Set and bag operations, ordered dedup, per-key selection and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .skew import last_before, spread_join


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("*").distinct().exceptAll(b.distinct())


def multiset_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, as often as in the side with fewer; counted before they meet."""
    keys = a.columns
    x, y = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("__x")), b.groupBy(*keys).agg(F.count(F.lit(1)).alias("__y"))
    both = x.alias("x").join(y.alias("y"), _same(keys))
    return both.select(*[F.col(f"x.{k}") for k in keys], F.explode(F.sequence(F.lit(1), F.least("__x", "__y").cast("int"))).alias("__i")).drop("__i")


def _same(keys: list[str]) -> Column:
    out = None
    for k in keys:
        c = F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
        out = c if out is None else out & c
    return out


def ordered_dedup(df: DataFrame, value: str, order: str) -> DataFrame:
    """The first row of each value, by a map-side minimum (a window would gather a frequent value in one task)."""
    rest = [c for c in df.columns if c not in (value, order)]
    return df.groupBy(value).agg(F.min(F.struct(order, *rest)).alias("__f")).select(value, "__f.*")


def longest_per_key(df: DataFrame, key: str, length: Column, order: str, k: int) -> DataFrame:
    """One row per key (its first), then the ``k`` longest, ties by order: a top-k, not a sort."""
    first = ordered_dedup(df.withColumn("__len", length), key, order)
    return first.orderBy(F.desc("__len"), F.asc(order)).limit(k)


def asof_latest(df: DataFrame, by: str, order: Column, at: Column) -> DataFrame:
    """Per key the last row with order <= at, by max_by: no sort, no window, partial sums on the map side."""
    rest = [c for c in df.columns if c != by]
    return df.where(order <= at).groupBy(by).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(by, "__r.*")


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """Each left row with the ``value`` of the latest right row of its key not after it (null without one).

    A union and a running last value, so a key is never multiplied; a key that holds a large share of the rows is cut by time.
    """
    known = right.select(F.col(by), F.col(right_time).alias("__t"), F.col(value))
    spread = F.xxhash64(*left.columns)
    return last_before(left.withColumn("__t", F.col(left_time)), known, by, "__t", value, spread).drop("__t")


#: Levels of cells at most; a band that is wider than 2 ** LEVELS cells meets all points through cells of the last level.
LEVELS = 40


def band_cells(low: Column, high: Column, levels: int) -> Column:
    """array<struct<level, cell>>: disjoint cells that together are the cells low .. high of level 0; at most two a level."""

    def of(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        a, b = F.call_function("div", low + size - 1, size), F.call_function("div", high + 1, size)
        cell = lambda c: F.struct(k.alias("level"), c.alias("cell"))
        top = F.when(a < b, F.transform(F.sequence(a, F.greatest(a, b - 1)), cell))
        odd = F.when(a < b, F.array_compact(F.array(F.when(F.pmod(a, F.lit(2)) == 1, cell(a)), F.when(F.pmod(b, F.lit(2)) == 1, cell(b - 1)))))
        return F.coalesce(F.when(k == levels - 1, top).otherwise(odd), F.array().cast("array<struct<level:int,cell:bigint>>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), of))


def range_join(points: DataFrame, bands: DataFrame, value: str, low: str, high: str, width: float, bound: int = 10_000) -> DataFrame:
    """Points with the bands low <= value <= high; a null end is open. A small band table is broadcast.

    Beyond that the axis is cut into cells of ``width`` and, level by level, of twice that. A band is the sum of at most two cells a
    level, a point lies in one cell of each level that a band uses, and the two meet by equality; cells with many points are salted.
    So a band of any width costs a few rows. The cells at a band's ends are checked exactly. ``points`` is read several times.
    """
    inside = F.coalesce(F.col(value) >= F.col(low), F.lit(True)) & F.coalesce(F.col(value) <= F.col(high), F.lit(True))
    points = points.where(F.col(value).isNotNull())
    if bands.limit(bound + 1).count() <= bound:
        return points.join(F.broadcast(bands), inside)
    least, most = points.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    if least is None:
        return points.join(bands, F.lit(False))
    n = int((most - least) // width)
    levels = min(max(n.bit_length(), 1), LEVELS)
    place = lambda c: F.floor((c.cast("double") - F.lit(least)) / F.lit(float(width))).cast("long")
    first, last = F.coalesce(F.greatest(place(F.col(low)), F.lit(0)), F.lit(0)), F.coalesce(F.least(place(F.col(high)), F.lit(n)), F.lit(n))
    ends = bands.withColumns({"__first": first, "__last": last}).where("__first <= __last")
    cut = materialize(ends.withColumn("__c", F.explode(band_cells(F.col("__first"), F.col("__last"), levels))).select(*bands.columns, "__c.level", "__c.cell").withColumnsRenamed({"level": "__level", "cell": "__cell"}))
    used = sorted(r[0] for r in cut.select("__level").distinct().collect())  # at most LEVELS
    at = place(F.col(value))
    cells = points.withColumn("__at", at).withColumn("__level", F.explode(F.array(*[F.lit(k) for k in used]) if used else F.array().cast("array<int>")))
    cells = cells.withColumn("__cell", F.expr("shiftright(__at, __level)")).drop("__at")
    return spread_join(cells, cut, ["__level", "__cell"], F.xxhash64(*points.columns), "inner").where(inside).drop("__level", "__cell")


def range_totals(points: DataFrame, bands: DataFrame, value: str, low: str, high: str, width: float, totals: dict[str, tuple[Column, str]]) -> DataFrame:
    """Bands that hold points low <= value <= high (a null end is open), with totals of these points, and no pair of the two is made.

    ``totals`` names for each result an expression of a point's columns and sum, min or max. Points of one value are one row first, then the
    cells of :func:`range_join` are totalled level by level; equal bands are answered once. A band is a sum of disjoint cells, so its total is that of
    its inner cells' totals and of those values of the two cells at its ends that lie inside.
    """
    merge = lambda names: [getattr(F, kind)(F.col(n)).alias(n) for n, (_, kind) in totals.items() if n in names]
    points = points.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(*[getattr(F, kind)(c).alias(n) for n, (c, kind) in totals.items()])
    points = materialize(points)
    least, most = points.agg(F.min("__v").cast("double"), F.max("__v").cast("double")).first()
    asked = materialize(bands.select(F.col(low).alias("__low"), F.col(high).alias("__high")).distinct())
    if least is None:
        found = asked.join(points, F.lit(False))
    else:
        n = int((most - least) // width)
        levels = min(max(n.bit_length(), 1), LEVELS)
        place = lambda c: F.floor((c.cast("double") - F.lit(least)) / F.lit(float(width))).cast("long")
        first, last = F.coalesce(F.greatest(place(F.col("__low")), F.lit(0)), F.lit(0)), F.coalesce(F.least(place(F.col("__high")), F.lit(n)), F.lit(n))
        ends = asked.withColumns({"__first": first, "__last": last}).where("__first <= __last")
        # An end that is open, or lies outside the axis, leaves its cell whole; its values are looked at all the same.
        edge = ends.select("__low", "__high", F.explode(F.array_distinct(F.array("__first", "__last"))).alias("__cell"))
        inside = F.coalesce(F.col("__v") >= F.col("__low"), F.lit(True)) & F.coalesce(F.col("__v") <= F.col("__high"), F.lit(True))
        at_ends = spread_join(edge, points.withColumn("__cell", place(F.col("__v"))), ["__cell"], F.xxhash64("__low", "__high"), "inner").where(inside).select("__low", "__high", *totals)
        cut = ends.where("__first + 1 < __last").withColumn("__c", F.explode(band_cells(F.col("__first") + 1, F.col("__last") - 1, levels)))
        cut = materialize(cut.select("__low", "__high", F.col("__c.level").alias("__level"), F.col("__c.cell").alias("__cell")))
        cells = points.withColumn("__at", place(F.col("__v"))).groupBy("__at").agg(*merge(totals))
        cells = cells.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("__cell", F.expr("shiftright(__at, __level)"))
        cells = materialize(cells.groupBy("__level", "__cell").agg(*merge(totals)))
        within = spread_join(cut, cells, ["__level", "__cell"], F.xxhash64("__low", "__high"), "inner").select("__low", "__high", *totals)
        found = at_ends.unionByName(within)
    found = found.groupBy("__low", "__high").agg(*merge(totals))
    same = F.col(low).eqNullSafe(F.col("__low")) & F.col(high).eqNullSafe(F.col("__high"))
    return bands.join(found, same).drop("__low", "__high")
