"""Streams: new submissions through the detectors, findings kept latest-wins, counts over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.detectors import Inputs, run_all
from ..operators.store import Store


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def detect(stream: DataFrame, comparison: Callable[[DataFrame], Inputs], store: Store, checkpoint: str, detectors: list[str] | None = None) -> StreamingQuery:
    """Run detectors on each micro-batch of submissions and merge the findings into the store.

    A batch that is delivered again after a failure replaces its own findings, as these are keyed by content.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        findings, _ = run_all(comparison(batch), detectors)
        keyed = findings.withColumn("finding_id", F.substring(F.sha2(F.concat_ws(":", "finding_type", "title", F.col("doc_id").cast("string"), F.col("source_id").cast("string")), 256), 1, 12)).withColumn("epoch", F.lit(epoch))
        store.merge("findings", keyed, ["finding_id"], [F.desc("epoch")])

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time_col: str, keys: list[str], width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(window_start, keys, n) over event time; rows later than ``late`` are dropped, as the watermark must bound state."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def first_deliveries(stream: DataFrame, keys: list[str], time_col: str, late: str = "7 days") -> DataFrame:
    """Each key once, within the watermark."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)
