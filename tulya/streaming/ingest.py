"""Documents as they arrive: the batch transforms on every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def files(spark: SparkSession, path: str, schema: StructType, per_batch: int = 64, fmt: str = "parquet") -> DataFrame:
    """A stream of a folder's files, so many to the batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(fmt).load(path)


def each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Writes transform(batch) to a folder of the batch's number, so a batch that runs again replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_counts(log: DataFrame, ts: str, stage: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Rows per stage and window of a log; rows later than the watermark don't count."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, window), stage).agg(F.count("*").alias("n"))


def once(log: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return log.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
