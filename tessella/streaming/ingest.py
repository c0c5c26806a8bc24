"""Articles as a stream: files as they arrive, late copies dropped, windows, and an idempotent upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.relations import keep_first


def article_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def without_copies(stream: DataFrame, key: str = "url", time: str = "ingested_at", delay: str = "30 days") -> DataFrame:
    """The first row of each key; state is kept only for ``delay``, later copies than that count anew."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, group: str, time: str, width: str = "1 day", slide: str | None = None, delay: str = "7 days") -> DataFrame:
    """Rows per window and group; a window is final when the watermark has passed it."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return timed.groupBy(window.alias("w"), group).agg(F.count("*").alias("n")).select("w.start", "w.end", group, "n")


def upsert_to(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that keeps the latest row of each key; each batch has a folder of its own, so a repeat changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        keep_first(batch, [key], [F.desc(order), key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The upserted table: the latest row of each key over all batches."""
    return keep_first(spark.read.parquet(path), [key], [F.desc(order), F.desc("batch")]).drop("batch")


def run_available(stream: DataFrame, checkpoint: str, writer: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process all files that are there and stop."""
    query = stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
