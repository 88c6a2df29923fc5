"""What the operators of this subpackage share: salted joins, key filters, components, let-bindings."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize

#: A key is hot when it holds more than one row in HOT_SHARE; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1024
#: ASCII white space, as in the word classes `[^\x20\x09-\x0D]+`.
SPACE = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def released(run):
    """An Arrow function that gives freed memory back to the system when its task ends: workers live on from stage to
    stage, and what they hold counts against the executor."""

    def go(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return go


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session while a step runs."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def hot_keys(left: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Keys with more than rows / HOT_SHARE rows (at most HOT_SHARE of them) and their salt counts."""
    share = max(rows // HOT_SHARE, 100)
    return (
        left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > share)
        .select(*keys, F.ceil(F.col("__n") / share).cast("int").alias("__salts"))
    )


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, rows: int, how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Join ``left``, in which a key may hold any share of the rows, to ``right``, unique by key.

    Rows of a hot key are spread over salts by ``spread``, a hash of what tells rows apart,
    and the right side's one row of that key is repeated once a salt. The list of hot keys
    is all that is broadcast: at most HOT_SHARE rows by its definition. Null keys match nothing.
    """
    hot = hot_keys(left, keys, rows) if hot is None else hot
    a = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(spread, F.col("__salts")).cast("int"))).drop("__salts")
    b = right.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))).drop("__salts")
    return a.join(b, [*keys, "__salt"], how).drop("__salt")


def bounded_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, rows: int, bound: int = 50_000, how: str = "left") -> DataFrame:
    """Broadcast ``right`` when it has at most ``bound`` (narrow) rows; beyond that a salted shuffle join."""
    if right.limit(bound + 1).count() <= bound:
        return left.join(F.broadcast(right), keys, how)
    return skew_join(left, right, keys, spread, rows, how)


FILTER_BLOCK = 32768  # bits; what bitmap_construct_agg makes
FILTER_BLOCKS = 65536  # 256 MB at most are broadcast


def id_filter(ids: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Bitmap blocks (__block, __bits) of a one-column table of keys, and the number of blocks.

    16 bits a key up to FILTER_BLOCKS blocks (134 million keys); past that it fills up and lets more rows through.
    """
    blocks = 1
    while blocks * FILTER_BLOCK < 16 * rows and blocks < FILTER_BLOCKS:
        blocks *= 2
    h = F.xxhash64(ids.columns[0])
    slots = ids.select(F.pmod(h, F.lit(blocks)).cast("int").alias("__block"), F.pmod(F.shiftright(h, 20), F.lit(FILTER_BLOCK)).cast("int").alias("p"))
    return materialize(slots.groupBy("__block").agg(F.bitmap_construct_agg(F.col("p")).alias("__bits"))), blocks


def flag_ids(df: DataFrame, id_col: str, filter_: tuple[DataFrame, int], name: str = "__hit") -> DataFrame:
    """``df`` with a boolean column: false only where the id is not among the filter's keys."""
    bitmaps, blocks = filter_
    h = F.xxhash64(id_col)
    tested = df.withColumns({"__block": F.pmod(h, F.lit(blocks)).cast("int"), "__p": F.pmod(F.shiftright(h, 20), F.lit(FILTER_BLOCK)).cast("int")})
    bit = F.expr("getbit(cast(conv(hex(substring(__bits, __p div 8 + 1, 1)), 16, 10) as int), __p % 8) = 1")
    return tested.join(F.broadcast(bitmaps), "__block", "left").withColumn(name, F.coalesce(bit, F.lit(False))).drop("__block", "__bits", "__p")


def keep_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id is in the one-column table ``ids``; others don't shuffle (but for the filter's errors)."""
    hits = flag_ids(df, id_col, id_filter(ids, ids.count())).where("__hit").drop("__hit")
    return hits.join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_semi")


def drop_ids(df: DataFrame, id_col: str, ids: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` whose id is not in the one-column table ``ids`` (null ids stay).

    A filter of ``ids`` lets most others pass straight through; those it flags falsely are found in ``known``, a narrow table
    of the ids of ``df`` where one is at hand, and put in a second filter. Only rows flagged by both are joined.
    """
    n = ids.count()
    if not n:
        return df
    name, gone = ids.columns[0], id_filter(ids, n)
    ids = ids.select(F.col(name).alias(id_col))
    keys = flag_ids((df if known is None else known).select(id_col), id_col, gone).where("__hit").select(id_col).distinct()
    false = materialize(keys.join(ids, id_col, "left_anti"))
    flagged = flag_ids(flag_ids(df, id_col, gone), id_col, id_filter(false, false.count()), "__false")
    passed = flagged.where(~F.col("__hit")).drop("__hit", "__false")
    tested = flagged.where("__hit AND __false").drop("__hit", "__false").join(ids, id_col, "left_anti")
    return passed.unionByName(tested.select(*passed.columns))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b), by alternating star steps.

    Each step takes the smallest neighbour of a node by a map-side aggregate and joins it
    back with salts, so that a hub of any degree is spread; rounds grow with the logarithm of the longest path.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        rows = e.count()
        if not rows:
            break
        # Large star: every larger neighbour of a node moves to the node's smallest neighbour.
        both = e.select("a", "b").union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        big = skew_join(both, least, ["a"], F.xxhash64("b"), 2 * rows, "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = materialize(big.where("a <> b").distinct())
        # Small star: a node and its smaller neighbours move to the smallest of these.
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("s")).select("s.*").where("a <> b").distinct()
        new = materialize(small)
        same = new.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == e.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        e = new
        if same:
            break
    labels = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.union(e.select(F.col("b"), F.col("b"))).groupBy("node").agg(F.min("component").alias("component"))
