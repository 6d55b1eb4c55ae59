"""Reading folders as streams and running a stream until its input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_files(spark: SparkSession, path: str, schema: T.StructType | str, time: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder (or one file) as a stream, those there now and those that come later.
    ``time`` is read as an instant, which watermarks need; times without a zone are the session's."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A pattern that fits only this path: a stream takes a single file by pattern only.
    df = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    return df.withColumn(time, F.col(time).cast("timestamp"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append to the files under ``path`` all that follows from the input there is now, then stop. State
    and progress stay under ``checkpoint``: the next run, or one after a failure, goes on from
    there, and no row comes out twice. Returns what has been written so far."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
