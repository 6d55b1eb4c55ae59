"""Reading tables and files, writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_table(
    spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None, schema: T.StructType | str | None = None
) -> DataFrame:
    """A parquet table, or some of its columns. A stated schema saves the look into the
    files that inferring one takes."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def scan_jdbc(spark: SparkSession, url: str, query: str, properties: dict[str, str], partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """Result of a query in a row store. ``partition`` is (column, low, high, count) and
    lets that many tasks read side by side; without it one task reads everything."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", "10000").options(**properties)
    if partition is None:
        return reader.option("query", query).load()
    column, low, high, count = partition
    return (
        reader.option("dbtable", f"({query}) src")
        .option("partitionColumn", column).option("lowerBound", low).option("upperBound", high)
        .option("numPartitions", count).load()
    )


def run_sql(spark: SparkSession, sql: str, args: dict | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """SQL text with named parameters (``:name``), passed as typed values, over named frames (``{name}``)."""
    return spark.sql(sql, args=args or {}, **(tables or {}))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header line and a stated schema, so nothing has to be re-cast."""
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def cached_result(spark: SparkSession, path: str, build) -> DataFrame:
    """Result saved under ``path``: read if complete, else built and written there first."""
    success = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    files = success.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(success):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_dated_files(spark: SparkSession, glob: str, schema: T.StructType | str, pattern: str = r"(\d{4}-\d{2}-\d{2})") -> DataFrame:
    """Many dated CSV files as one frame, the day taken out of each file's path (its name,
    or the name of its folder)."""
    files = spark.read.csv(glob, header=True, schema=schema)
    found = F.regexp_extract_all(F.col("_metadata.file_path"), F.lit(pattern), 1)
    return files.withColumn("file_day", F.to_date(F.element_at(found, -1)))


def write_assignment(df: DataFrame, path: str) -> None:
    """Chosen group per unit."""
    df.write.mode("overwrite").parquet(path)


def write_by_day(df: DataFrame, path: str, day: str) -> None:
    """The table with a folder per day. Rows are brought together by day before they are written,
    large days in several files and small ones not split, so there are few files."""
    df.hint("rebalance", F.col(day)).write.mode("overwrite").partitionBy(day).parquet(path)


def read_days(spark: SparkSession, path: str, day: str, spine: DataFrame, spine_day: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a table written by day whose day is in the spine, which may have gaps. The spine is known only
    when the query runs; its days then decide which folders are read at all (dynamic partition
    pruning), if it comes from a filter and is small enough for Spark to broadcast."""
    stored = spark.read.schema(schema).parquet(path)
    return stored.join(spine.select(F.col(spine_day).alias(day)), day)
