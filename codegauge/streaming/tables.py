"""Streams from and to tables: every micro-batch is one folder, written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codegauge.workspace import shared_folder

# Fixed value: how many jobs are taken in at a time.
INTAKE = 100


def stream_table(
    spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = INTAKE
) -> DataFrame:
    """A stream over the parquet files of a folder."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def with_event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Sets the watermark; stored times carry no zone and are taken as session (UTC) times."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def write_batches(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    each: Callable[[DataFrame, int], DataFrame] | None = None,
    mode: str = "append",
    interval: str | None = None,
):
    """Starts a query that writes each micro-batch to ``out/batch_id=N``.

    A repeated batch replaces its own folder, so a restart never doubles rows.
    Without an interval the query takes what is there and ends.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if each is None else each(batch, batch_id)
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def run_to_table(
    spark: SparkSession,
    stream: DataFrame,
    name: str,
    each: Callable[[DataFrame, int], DataFrame] | None = None,
    mode: str = "append",
) -> DataFrame:
    """Runs a stream over all that is there and reads the written batches back."""
    folder = shared_folder(spark, name)
    query = write_batches(stream, f"{folder}/out", f"{folder}/checkpoint", each, mode)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
