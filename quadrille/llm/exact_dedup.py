"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one hashes every text and counts the slots of a blocked Bloom filter (one block
of 32768 bits and two bits in it a text); a bit stays set only where a slot was hit twice or
more. Pass two tests each row: unless both its bits are set the text has no equal and the
row passes straight through, without a shuffle. Only the others are grouped by digest.

The filter takes 16 bits a row up to ``max_blocks`` blocks of 4 KB, a fixed bound on
what is broadcast. A bit is set by two hits, so it fills slowly: with 16 bits a row 1 row in 20,000 without
an equal is grouped, with 4 bits 1 in 120, with 2 bits (a billion rows at 256 MB) 7 in 100. Beyond
that more rows than needed are grouped; the result is exact at any fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, skew_join

BLOCK_BITS = 32768  # what bitmap_construct_agg makes
BITS_PER_ROW = 16
MAX_BLOCKS = 65536  # 256 MB


def _slots(text: Column, blocks: int) -> Column:
    h = F.xxhash64(text)
    return F.struct(
        F.pmod(h, F.lit(blocks)).cast("int").alias("block"),
        F.pmod(F.shiftright(h, 20), F.lit(BLOCK_BITS)).cast("int").alias("p"),
        F.pmod(F.shiftright(h, 40), F.lit(BLOCK_BITS)).cast("int").alias("q"),
    )


def _bit(pos: str) -> Column:
    return F.expr(f"getbit(cast(conv(hex(substring(__bits, __s.{pos} div 8 + 1, 1)), 16, 10) as int), __s.{pos} % 8) = 1")


def repeated_filter(docs: DataFrame, text: Column, rows: int, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """Blocks (__block, __bits) of the filter of slots hit twice or more, and the number of blocks."""
    blocks = 1
    while blocks * BLOCK_BITS < BITS_PER_ROW * rows and blocks < max_blocks:
        blocks *= 2
    twice = (
        docs.select(_slots(text, blocks).alias("s"))
        .select(F.col("s.block").alias("__block"), F.explode(F.array_distinct(F.array("s.p", "s.q"))).alias("p"))
        .groupBy("__block", "p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    return twice.groupBy("__block").agg(F.bitmap_construct_agg(F.col("p")).alias("__bits")), blocks


def flag_repeats(docs: DataFrame, text: Column, rows: int | None = None, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``docs`` with ``__cand``: false only for rows whose text has no equal in the table."""
    bitmaps, blocks = repeated_filter(docs, text, docs.count() if rows is None else rows, max_blocks)
    bitmaps = materialize(bitmaps)
    return (
        docs.withColumn("__s", _slots(text, blocks)).withColumn("__block", F.col("__s.block"))
        .join(F.broadcast(bitmaps), "__block", "left")
        .withColumn("__cand", F.coalesce(_bit("p") & _bit("q"), F.lit(False)))
        .drop("__s", "__block", "__bits")
    )


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the largest id.

    Null text counts as empty; a null id is smaller than any other. Of rows equal in text and id one
    stays, which one is open. Columns are kept as they are; names beginning with two
    underscores are reserved. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    flagged = flag_repeats(docs, text, max_blocks=max_blocks)
    alone = flagged.where(~F.col("__cand")).drop("__cand")
    again = flagged.where("__cand").drop("__cand").withColumn("__sha", F.sha2(text, 256))
    keep = again.groupBy("__sha").agg(F.max(id_col).alias("__keep")).withColumnRenamed("__sha", "__ksha")
    kept = again.join(keep, (F.col("__sha") == F.col("__ksha")) & F.col(id_col).eqNullSafe(F.col("__keep")), "left_semi")
    return alone.unionByName(kept.dropDuplicates(["__sha", id_col]).drop("__sha"))


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per document, dropped ones too: id, keep_id, group_size, kept, text_sha256.

    Edge cases as in :func:`exact_dedup`; of rows equal in text and id one is kept.
    Hot groups: their rows are pre-aggregated map-side, and the join back to each row is salted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.count()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col))
    digests = materialize(flag_repeats(base, text, rows, max_blocks).select("doc_id", F.sha2(text, 256).alias("text_sha256"), "__cand"))
    alone = digests.where(~F.col("__cand")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = digests.where("__cand").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("__m"))
    keep = digests.where("__cand").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = skew_join(again, keep, ["text_sha256"], F.xxhash64("doc_id"), rows, "inner")
    groups = joined.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m")))).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__i") == 1)).alias("kept"), "text_sha256"
    )
    return alone.unionByName(groups)
