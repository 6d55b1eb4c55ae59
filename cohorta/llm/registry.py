"""Registry of this subpackage's queries, and what all of its operators need of a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import cohorta
from cohorta.session import scratch_dir, tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Rows that go to a Python worker at once; texts may be long.
BATCH_ROWS = 512

# Workers get this package's functions along with a query, installed there or not.
register_pickle_by_value(cohorta)


def prepare(spark: SparkSession) -> SparkSession:
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL when it has one."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(prepare(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """The two columns the operators read, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: the lineage ends here, and executors
    that are lost later cost no more than what comes after."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sample_texts(docs: DataFrame, limit: int) -> list[str]:
    """At most ``limit`` texts that are not empty: those with the smallest hashes of id and
    text, so the same ones however the table is stored."""
    d = docs.where("text <> ''").select("text", F.xxhash64("doc_id", "text").alias("h"))
    edge = d.select("h").orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    return [] if edge is None else [r.text for r in d.where(F.col("h") <= edge).orderBy("h").limit(limit).collect()]
