"""Routing rows to staging shards, and assembling shards into a release with stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CurationError
from ..functions.text import padded_id

#: Domain of a family -> staging shard, and the order of splits and shards.
SHARDS = {
    "procedure": "procedure",
    "tuition": "tuition-academic-rule",
    "academic-rule": "tuition-academic-rule",
    "certificate": "certificate-form-document",
    "form": "certificate-form-document",
    "out-of-domain": "out-of-domain",
}
SHARD_ORDER = ("procedure", "tuition-academic-rule", "certificate-form-document", "out-of-domain")
SPLIT_ORDER = ("train", "val", "test")


def shard_of(domain: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SHARDS.items() for x in kv]), domain)


def route(rows: DataFrame, families: DataFrame) -> DataFrame:
    """``rows`` with their shard; families (query_id, domain). A row of an unknown family is an error."""
    routed = rows.join(families.select("query_id", "domain"), "query_id", "left")
    bad = routed.where(F.col("domain").isNull()).select("query_id").limit(1).collect()
    if bad:
        raise CurationError(f"unknown query_id: {bad[0][0]}")
    return routed.withColumn("shard", shard_of(F.col("domain"))).drop("domain")


def _rank(c: Column, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), c).cast("int")


def assign_ids(rows: DataFrame, key: str = "id", split: str = "split", shard: str = "shard", splits: tuple[str, ...] = SPLIT_ORDER, shards: tuple[str, ...] = SHARD_ORDER, prefix: str = "question-") -> DataFrame:
    """``rows`` with release_id: a sequence from 1 by split, shard and id.

    The sequence is global but no task sees all rows: rows are ranked inside (split, shard, hash range of ids) and each
    range gets the number of rows before it.
    """
    keyed = rows.withColumns({"__s": _rank(F.col(split), splits), "__d": _rank(F.col(shard), shards)})
    ordered = keyed.repartitionByRange(F.col("__s"), F.col("__d"), F.col(key)).sortWithinPartitions("__s", "__d", key).withColumn("__p", F.spark_partition_id())
    from ..scratch import materialize

    ordered = materialize(ordered)
    sizes = ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("__s", "__d", key)).alias("__first"))
    # One row per partition; their running sum is all that meets in one task.
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__first")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy("__s", "__d", key))
    n = F.col("__before") + F.col("__i")
    return ordered.withColumn("__i", inside).join(F.broadcast(before), "__p").withColumn("release_id", padded_id(prefix, n)).drop("__s", "__d", "__p", "__i", "__before")


def remap_checklist(checklist: DataFrame, released: DataFrame, key: str = "id") -> DataFrame:
    """(class, ids): each list of temporary ids as release ids, in its order. checklist: (class, ids)."""
    flat = checklist.select("class", F.posexplode("ids").alias("ord", key))
    got = flat.join(released.select(key, "release_id"), key)
    return got.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "release_id"))), lambda x: x["release_id"]).alias("ids"))


def outside_checklist(checklist: DataFrame, allowed: DataFrame, key: str = "id") -> DataFrame:
    """Checklist ids that are not out-of-domain rows."""
    return checklist.select("class", F.explode("ids").alias(key)).join(allowed.select(key), key, "left_anti")


def assemble(rows: DataFrame, checklist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(release, remapped checklist) from staged rows (id, split, shard, ...); repeated or foreign ids are errors."""
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("id").limit(1).collect()
    if twice:
        raise CurationError(f"duplicate temporary id: {twice[0][0]}")
    bad = outside_checklist(checklist, rows.where("shard = 'out-of-domain'")).orderBy("id").limit(1).collect()
    if bad:
        raise CurationError(f"checklist id is not an out-of-domain row: {bad[0]['id']}")
    released = assign_ids(rows)
    return released, remap_checklist(checklist, released)
