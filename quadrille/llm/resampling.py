"""Importance resampling toward a target distribution, over hashed n-gram buckets.

A document becomes the array of its features' buckets by higher-order functions and is written once in that short form.
Bucket totals of the pool and of the target are all that is counted over the corpus; the logarithmic ratio of the two is an
array of one gain a bucket, a literal in the plan, so that a document is scored where it lies, without an explode or a join.
The draw adds Gumbel noise from the hash of the id and keeps the highest scores (sampling without replacement).

Null and empty texts have no features and weight 0; they and other texts below ``min_words`` are never drawn. A null id is hashed as
an empty string and comes last among ties. Rows that are repeated are each a row of their own. Empty tables give no rows
(an empty target leaves a gain for each bucket that only the pool's counts decide). Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

#: ASCII letters and digits and all that is not ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, MIN_WORDS, SHARE, SEED = 10_000, 20, 10, 2024
#: Bars of the histogram by which the draw finds the scores worth sorting.
BARS = 4096


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def feature_buckets(tokens: Column, longest: int = 1, buckets: int = BUCKETS) -> Column:
    """The buckets of all runs of 1 to ``longest`` consecutive tokens, repeats included."""

    def run_at(n: int):
        return lambda i: F.array_join(F.slice(tokens, i, n), " ")

    runs = [tokens]
    for n in range(2, longest + 1):
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(starts, run_at(n)))
    return F.transform(F.concat(*runs) if len(runs) > 1 else tokens, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(buckets)).cast("int"))


def bucketed(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, buckets) of every row."""
    found = let(words(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), feature_buckets(w, longest, buckets).alias("buckets")))
    return docs.select(F.col(id_col).alias("doc_id"), found.alias("f")).select("doc_id", "f.*")


def bucket_totals(rows: DataFrame) -> DataFrame:
    """(bucket, n): summed within each task first, so at most one row a bucket and task is shuffled."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(pool: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) for every bucket, from two tables of totals of at most B rows."""
    both = pool.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = materialize(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    s_all, t_all = (int(x or 0) for x in both.agg(F.sum("s"), F.sum("t")).first())
    seen = both.unionByName(both.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    n = lambda c: F.col(c).cast("double") + F.lit(1.0)
    ratio = n("t") * F.lit(float(s_all + buckets)) / (n("s") * F.lit(float(t_all + buckets)))
    table = seen.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))
    return [r["gain"] for r in sorted(table.collect(), key=lambda r: r["bucket"])]


def _literal(values: list[int]) -> Column:
    """One literal array; the optimizer folds the split and the cast."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256("seed:id")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(rows: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of bucketed rows."""
    table = _literal(gain)
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b + 1))
    out = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def draw(rows: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """``rows`` with their rank (1, 2, ...) among the ``share`` percent of highest scores; null where not drawn.

    A histogram of scores tells which rows can be drawn; those alone are dealt by range and sorted, and a row's rank is its
    place within its range behind the sizes of the ranges before it. ``rows`` is read several times and should be a written table.
    """
    open_ = F.col("n_words") >= min_words
    low, high, n = rows.where(open_).agg(F.min("score"), F.max("score"), F.count(F.lit(1))).first()
    most = share * n // 100
    if not most:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    width = (high - low) // BARS + 1
    bars = sorted(rows.where(open_).groupBy(F.expr(f"(score - {low}L) div {width}L").alias("bar")).count().collect(), key=lambda r: -r["bar"])
    found = 0
    for bar in bars:  # at most BARS
        found += bar["count"]
        if found >= most:
            break
    near = open_ & (F.col("score") >= F.lit(low + bar["bar"] * width))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__row")]
    sorted_ = rows.where(near).withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = materialize(sorted_.withColumn("__place", F.monotonically_increasing_id()))
    part, before, at = F.shiftright("__place", 33), {}, 0
    for r in sorted(sorted_.groupBy(part.alias("part")).count().collect()):  # a row for each range
        before[r["part"]], at = at, at + r["count"]
    offsets = rows.sparkSession.createDataFrame(list(before.items()), "__part long, __before long")
    ranked = sorted_.withColumn("__part", part).join(F.broadcast(offsets), "__part", "left").withColumn("rank", F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return rows.where(~near).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked.select(*rows.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_features, weight, score and its rank in the draw toward ``target`` (text)."""
    rows = materialize(bucketed(docs, longest, buckets))
    aims = bucketed(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets)
    gain = gains(bucket_totals(rows), bucket_totals(aims), buckets)
    return draw(materialize(scored(rows, gain, seed)), share, min_words).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; ids must be unique."""
    ranks = resample(docs, target, **how).where("rank IS NOT NULL").select("doc_id", F.col("rank").alias("__rank"))
    return docs.join(ranks, "doc_id").drop("__rank")
