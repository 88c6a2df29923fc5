"""Line dedup by distinct-site spread, in DataFrame functions only.

A HyperLogLog sketch of the sites per line hash merges by aggregation. A line whose estimate lies near
the threshold gets an exact distinct count; lines on enough sites are boilerplate and go from
every document. Only documents that hold such a line take part in the join that cleans them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bounded_join, flag_ids, id_filter, materialize

MIN_SITES = 8
LG_K = 12
#: Six standard errors of the sketch (1.04 / sqrt(2^LG_K)): outside of this band the estimate decides.
NEAR = 0.1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _counts(line: Column) -> Column:
    """A line takes part when it has a character other than white space."""
    return F.translate(line, SPACE, "") != ""


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(line): hashes of the lines found on ``min_sites`` distinct sites or more. Null sites count as none."""
    lines = docs.select(F.col(site_col).cast("string").alias("site"), F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col(text_col)), _counts), lambda x: F.xxhash64(x)))).alias("line")).where("site IS NOT NULL")
    estimate = materialize(
        lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites")).where(F.col("sites") >= min_sites * (1 - NEAR))
    )
    sure = estimate.where(F.col("sites") > min_sites * (1 + NEAR)).select("line")
    near = materialize(estimate.where(F.col("sites") <= min_sites * (1 + NEAR)).select("line"))
    asked = flag_ids(lines, "line", id_filter(near, near.count())).where("__hit").select("line", "site").distinct()
    exact = asked.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("line").join(near, "line", "left_semi")
    return materialize(sure.union(exact))


def clean_lines(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines removed from the text, and __lines and __removed counted.

    Null text stays null with no lines. Lines of white space stay. Repeated rows are cleaned
    alike. A document may be left with an empty text; it stays.
    """
    gone = boilerplate_lines(docs, min_sites, text_col, site_col)
    row = F.xxhash64(*[F.col(c).cast("string") for c in docs.columns if c != text_col], text_col)
    keyed = docs.withColumn("__row", row)
    places = keyed.select("__row", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col(text_col)), _counts), lambda x: F.xxhash64(x)))).alias("line"))
    hits = bounded_join(places, gone.withColumn("__in", F.lit(True)), ["line"], F.xxhash64("__row"), docs.count(), how="inner")
    cut = materialize(hits.groupBy("__row").agg(F.collect_set("line").alias("__cut")))
    flagged = flag_ids(keyed, "__row", id_filter(cut.select("__row"), cut.count()))
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(_lines(F.col(text_col)))).cast("long")
    same = flagged.where(~F.col("__hit")).withColumns({"__lines": n, "__removed": F.lit(0).cast("long")})
    left = F.filter(_lines(F.col(text_col)), lambda x: ~(_counts(x) & F.coalesce(F.array_contains("__cut", F.xxhash64(x)), F.lit(False))))
    found = flagged.where("__hit").join(cut, "__row", "left").withColumns({"__lines": n, "__left": F.when(F.col("__cut").isNull(), _lines(F.col(text_col))).otherwise(left)})
    found = found.withColumns({
        "__removed": F.when(F.col(text_col).isNull(), 0).otherwise(F.col("__lines") - F.size("__left")).cast("long"),
        text_col: F.when(F.col(text_col).isNull(), F.col(text_col)).otherwise(F.concat_ws("\n", "__left")),
    })
    columns = [*docs.columns, "__lines", "__removed"]
    return same.select(*columns).unionByName(found.select(*columns))
