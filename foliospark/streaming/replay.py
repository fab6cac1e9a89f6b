"""Run a stream over files to its end and give back what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.session import run_folder


def read_stream(
    spark: SparkSession, folder: str, like: DataFrame, files: str = "*.parquet", files_per_trigger: int = 64
) -> DataFrame:
    """New files of a folder as a stream with the columns of ``like``; a trigger takes in so many at most, also in a backfill."""
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", files)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def drain(stream: DataFrame) -> DataFrame:
    """Take everything there is, through the exactly-once file sink, and read the result."""
    spark = stream.sparkSession
    folder = run_folder(spark, "stream")
    running = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
