"""The same transformations over files as they arrive, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def process_new_files(spark: SparkSession, source: str, schema: T.StructType, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Runs ``step`` over the files that came since the last run and ends. Each file is processed exactly once, over
    restarts too, as the log of what is done lies in the checkpoint."""
    stream = spark.readStream.schema(schema).parquet(source)
    return step(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key is new within the watermark; state older than that is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, window: str, by: str, late: str = "1 hour") -> DataFrame:
    """(window_start, by, n) of tumbling windows, final once the watermark has passed them."""
    w = F.window(time, window)
    return stream.withWatermark(time, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), by, "n")
