"""Questions as a stream: normalised, matched to query families and counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_column


def question_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of ``path`` as they come."""
    return spark.readStream.schema(schema).parquet(path)


def normalized(questions: DataFrame, text: str = "text") -> DataFrame:
    return questions.withColumn("normalized", normalize_column(F.col(text)))


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n) per window; rows later than the watermark are dropped, state is bounded by it."""
    seen = events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))
    return seen.select(F.col("window.start").alias("start"), key, "n")
