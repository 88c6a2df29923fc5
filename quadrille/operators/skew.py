"""Joins and windows in which one key may hold most rows: salts for joins, chunks of time for scans.

All lists that are broadcast here have at most ``parts`` rows: a key is hot when it has more than one in ``parts`` of all rows.
Cuts of keys with more than a fixed number of rows have no such bound and are joined with salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialize

#: Rows below which no key is worth splitting.
LEAST_ROWS = 1000


def parts_of(spark: SparkSession) -> int:
    return max(256, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(rows: DataFrame, keys: list[str], total: int, parts: int, most: int | None = None) -> DataFrame:
    """(keys, __pieces): keys with more than one in ``parts`` of ``total`` rows (or more than ``most`` rows), and into how many pieces each is cut.
    Counted within tasks first."""
    share = max(total // parts, LEAST_ROWS) if most is None else most
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > share).select(*keys, F.ceil(F.col("__n") / share).cast("int").alias("__pieces"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left", total: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """An equi-join on ``keys`` whose hot keys of the left side are dealt over salts by ``spread``; the right side's rows of
    these are repeated once a salt. ``how`` is inner, left, left_semi or left_anti. ``left`` is read twice, or ``counted`` once for it, a
    table that has the same keys as often. Keys are counted and salted by their hash: keys of one hash share their salts."""
    total = left.count() if total is None else total
    parts = parts_of(left.sparkSession)
    if total <= LEAST_ROWS:
        return left.join(right, keys, how)
    hashed = F.xxhash64(*keys)
    hot = hot_keys((left if counted is None else counted).select(hashed.alias("__hash")), ["__hash"], total, parts)
    hot = F.broadcast(materialize(hot.withColumnRenamed("__pieces", "__salts")))
    salt = F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(spread, F.col("__salts"))).cast("int")
    a = left.withColumn("__hash", hashed).join(hot, "__hash", "left").withColumn("__salt", salt).drop("__salts", "__hash")
    b = right.withColumn("__hash", hashed).join(hot, "__hash", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))).drop("__salts", "__hash")
    return a.join(b, [*keys, "__salt"], how).drop("__salt")


def below(bounds: Column, t: Column, parts: int, equal: bool = False) -> Column:
    """How many of the sorted ``bounds`` (at most ``parts``) lie below ``t``, or equal it too; by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(parts.bit_length()))])

    def go(at: Column, step: Column) -> Column:
        bound = F.get(bounds, at + step - 1)
        return F.when((at + step <= F.size(bounds)) & ((bound <= t) if equal else (bound < t)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), go)


def time_cuts(rows: DataFrame, key: str, time: str, total: int, parts: int, most: int | None = None) -> DataFrame:
    """(__key, __cuts): for each hot key the quantiles of its times that cut it into at most ``parts`` pieces; a written table.

    It has at most ``parts`` rows and can be broadcast, unless ``most`` is given, the number of rows from which on a key is cut.
    """
    hot = hot_keys(rows, [key], total, parts, most).select(F.col(key).alias("__key"), F.least("__pieces", F.lit(parts)).alias("__pieces"))
    hot = materialize(hot)
    grid = F.percentile_approx(time, [i / parts for i in range(1, parts)], 10 * parts)
    own = rows.select(key, time)
    if most is None:
        found = own.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__key")), "left").where("__pieces IS NOT NULL")
    elif hot.isEmpty():
        return hot.select("__key", F.lit(None).cast("array<double>").alias("__cuts"))
    else:
        found = spread_join(own.withColumnRenamed(key, "__key"), hot, ["__key"], F.xxhash64(time), "inner", total)
    found = found.groupBy("__key").agg(F.max("__pieces").alias("__pieces"), grid.alias("q"))
    some = F.transform(F.sequence(F.lit(1), F.col("__pieces") - 1), lambda i: F.element_at("q", (i * parts / F.col("__pieces")).cast("int")))
    return materialize(found.where("__pieces > 1").select("__key", some.alias("__cuts")))


def last_before(rows: DataFrame, known: DataFrame, key: str, time: str, value: str, spread: Column) -> DataFrame:
    """``rows`` with the ``value`` of ``known`` (key, time, value) that is the latest not after them; null without one.

    Rows of both sides meet in one task for each piece of a key. A hot key is cut by time; the last value before a piece, found by a
    running last over the pieces, enters it as one row. Of several values of a key and time the largest counts; rows without a time
    or with a null key get null.
    """
    spark = rows.sparkSession
    parts = parts_of(spark)
    kind = known.schema[value].dataType
    held = known.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, time).agg(F.max(value).alias("__v"))
    both = rows.withColumns({"__v": F.lit(None).cast(kind), "__asks": F.lit(1)}).unionByName(held.withColumn("__asks", F.lit(0)), allowMissingColumns=True)
    both = materialize(both)
    cuts = time_cuts(both.where(F.col(key).isNotNull()), key, time, both.count(), parts)
    wide = both.join(F.broadcast(cuts), F.col(key) == F.col("__key"), "left")
    low = below(F.col("__cuts"), F.col(time), parts)
    # Asking rows at a cut may lie in any piece that begins or ends there; values at a cut end the first of these.
    high = F.when(F.col("__asks") == 1, below(F.col("__cuts"), F.col(time), parts, True)).otherwise(low)
    piece = F.when(F.col("__cuts").isNull() | F.col(time).isNull(), 0).otherwise(low + F.pmod(spread, high - low + 1).cast("int"))
    placed = wide.withColumn("__piece", piece).drop("__key")
    ends = placed.where("__asks = 0 AND __cuts IS NOT NULL").groupBy(key, "__piece").agg(F.max_by("__v", time).alias("__v"))
    pieces = cuts.select(F.col("__key").alias(key), F.explode(F.sequence(F.lit(0), F.size("__cuts"))).alias("__piece"))
    run = Window.partitionBy(key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.join(ends, [key, "__piece"], "left").withColumn("__v", F.last("__v", ignorenulls=True).over(run)).where("__v IS NOT NULL")
    carried = carried.withColumns({"__asks": F.lit(-1)})
    placed = placed.drop("__cuts").unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(key, "__piece").orderBy(F.col("__asks") >= 0, time, "__asks").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn(value, F.when(F.col(time).isNotNull() & F.col(key).isNotNull(), F.last("__v", ignorenulls=True).over(w)))
    return found.where("__asks = 1").drop("__v", "__asks", "__piece")
