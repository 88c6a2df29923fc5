"""Constraint checks of question datasets. Each check is a DataFrame of violations
(check_id, record_id, detail, ord); :func:`first_violation` reproduces fail-fast order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DatasetError
from ..functions.text import normalize_column
from ..scratch import materialize

FIELDS = ("id", "query_id", "register", "input", "target")
SPLITS = ("train", "val", "test")
REGISTERS = ("formal", "neutral", "colloquial", "noisy")
UNSAFE = "[_^@]"
TRAIN_MIN_ROWS, HELD_OUT_MIN_ROWS, HELD_OUT_MIN_REGISTERS = 4, 2, 2
LISTED = 10


def violations(df: DataFrame, check: str, record: Column, detail: Column, order: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check_id"), record.cast("string").alias("record_id"), detail.cast("string").alias("detail"), order.cast("long").alias("ord"))


def empty_split(rows: DataFrame) -> DataFrame:
    n = rows.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return violations(n.where("n = 0"), "empty", F.lit(None), F.lit("dataset split is empty"), F.lit(0))


def key_differences(df: DataFrame, keys: Column, required: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows whose JSON keys are not exactly ``required``: with the missing and the unexpected ones."""
    want = F.array(*map(F.lit, required))
    return df.withColumns({"missing": F.array_sort(F.array_except(want, keys)), "unexpected": F.array_sort(F.array_except(keys, want))}).where((F.size("missing") > 0) | (F.size("unexpected") > 0))


def blank_fields(rows: DataFrame, record: str = "id", order: str = "_pos", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    bad = F.array_compact(F.array(*[F.when(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), F.lit(f)) for f in fields]))
    return violations(rows.withColumn("__bad", bad).where(F.size("__bad") > 0), "blank", F.col(record), F.concat_ws(",", "__bad"), F.col(order))


def duplicates(rows: DataFrame, key: str, order: str = "_pos", check: str = "duplicate", record: str = "id") -> DataFrame:
    """Every row after the first of its key, naming the first holder."""
    w = Window.partitionBy(key).orderBy(order)
    seen = rows.withColumns({"__n": F.row_number().over(w), "__first": F.first(record).over(w)}).where("__n > 1")
    return violations(seen, check, F.col(record), F.col("__first"), F.col(order))


def digest(key: Column) -> Column:
    """What stands for a long key in joins and groups: 32 bytes, null for null."""
    return F.unhex(F.sha2(key.cast("string"), 256))


def first_holders(rows: DataFrame, key: Column, record: str, order: str) -> DataFrame:
    """(record_id, first_id) of repeated keys without a window over the group: the first holder is a map-side minimum. Null is a key.

    Keys are made once and written as digests; whole texts are never shuffled.
    """
    keyed = materialize(rows.select(F.col(record).alias("record_id"), F.col(order).alias("o"), F.coalesce(digest(key), F.lit(b"")).alias("k")))
    first = keyed.groupBy("k").agg(F.min(F.struct("o", "record_id")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(first, "k").where(F.struct("o", "record_id") != F.col("f")).select("record_id", F.col("f.record_id").alias("first_id"))


def invalid_register(rows: DataFrame, register: str = "register", record: str = "id", order: str = "_pos", allowed: tuple[str, ...] = REGISTERS) -> DataFrame:
    return violations(rows.where(~F.col(register).isin(*allowed)), "register", F.col(record), F.col(register), F.col(order))


def unknown_family(rows: DataFrame, families: DataFrame, key: str = "query_id", record: str = "id", order: str = "_pos") -> DataFrame:
    return violations(rows.join(families.select(key).distinct(), key, "left_anti"), "family", F.col(record), F.col(key), F.col(order))


def unsafe_text(rows: DataFrame, text: str = "target", record: str = "id", order: str = "_pos") -> DataFrame:
    """Targets that are not one canonical line, or hold characters that tokenizers cannot keep."""
    c = F.col(text)
    kind = F.when(F.rlike(c, F.lit("[\r\n]")) | F.rlike(c, F.lit("(?U)\\s{2,}")) | F.rlike(c, F.lit("(?U)^\\s|\\s$")), "line").when(F.rlike(c, F.lit(UNSAFE)), "characters")
    return violations(rows.withColumn("__kind", kind).where("__kind IS NOT NULL"), "text", F.col(record), F.col("__kind"), F.col(order))


def family_counts(rows: DataFrame, family: str, split: str, register: str) -> DataFrame:
    """(family, split, rows, registers): one aggregate that all per-family checks read."""
    return rows.groupBy(F.col(family).alias("family"), F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set(register)).alias("registers"))


def grid(families: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Every family with every split; families are a column ``family``."""
    return families.select("family").distinct().select("family", F.explode(F.array(*map(F.lit, splits))).alias("split"))


def missing_families(counts: DataFrame, families: DataFrame | None = None, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """(split, families): families without a row in a split; of the declared or else the observed families."""
    absent = grid(counts if families is None else families, splits).join(counts.select("family", "split"), ["family", "split"], "left_anti")
    return absent.groupBy("split").agg(F.array_sort(F.collect_list("family")).alias("families"))


def sparse_families(counts: DataFrame, families: DataFrame | None = None, train: int = TRAIN_MIN_ROWS, held_out: int = HELD_OUT_MIN_ROWS, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """(family, split, rows): fewer rows than a split needs."""
    full = grid(counts if families is None else families, splits).join(counts, ["family", "split"], "left")
    least = F.when(F.col("split") == "train", train).otherwise(held_out)
    return full.select("family", "split", F.coalesce("rows", F.lit(0)).alias("rows")).where(F.col("rows") < least)


def register_gaps(counts: DataFrame, allowed: tuple[str, ...], splits: tuple[str, ...] = ("train",)) -> DataFrame:
    """(family, split, missing): registers a family lacks."""
    lacks = F.array_sort(F.array_except(F.array(*map(F.lit, allowed)), F.col("registers")))
    return counts.where(F.col("split").isin(*splits)).select("family", "split", lacks.alias("missing")).where(F.size("missing") > 0)


def few_registers(counts: DataFrame, least: int = HELD_OUT_MIN_REGISTERS) -> DataFrame:
    """(family, split, registers) of held-out splits with too few registers."""
    return counts.where((F.col("split") != "train") & (F.size("registers") < least)).select("family", "split", F.size("registers").alias("registers"))


def crossing(rows: DataFrame, key: Column, split: str = "split") -> DataFrame:
    """(key, splits): values found in two splits or more."""
    return rows.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def leaked(rows: DataFrame, train: DataFrame, text: str) -> DataFrame:
    """Rows whose normalised text occurs in ``train``."""
    return rows.withColumn("__k", normalize_column(F.col(text))).join(train.select(normalize_column(F.col(text)).alias("__k")).distinct(), "__k", "left_semi").drop("__k")


def id_differences(examples: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """(id, problem): missing and unexpected predictions, a set difference both ways."""
    missing = examples.select(key).join(predictions, key, "left_anti").distinct().withColumn("problem", F.lit("missing"))
    extra = predictions.select(key).join(examples, key, "left_anti").distinct().withColumn("problem", F.lit("unexpected"))
    return missing.union(extra)


def first_listed(df: DataFrame, *order: str, n: int = LISTED) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_violation(*found: DataFrame) -> tuple[str, str, str] | None:
    """The violation a row-by-row check would stop at: earliest row, then the order of the checks."""
    ranked = [d.withColumn("__rank", F.lit(i)) for i, d in enumerate(found)]
    row = reduce(DataFrame.unionByName, ranked).orderBy("ord", "__rank").limit(1).collect()
    return (row[0]["check_id"], row[0]["record_id"], row[0]["detail"]) if row else None


def require(*found: DataFrame) -> None:
    """Raise DatasetError with the first violation."""
    bad = first_violation(*found)
    if bad is not None:
        raise DatasetError(f"{bad[1] or 'dataset'}: {bad[0]} ({bad[2]})")
