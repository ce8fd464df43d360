"""Canonical event schema and its derivation from an ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The legal event types and the default priority.
EVENT_TYPES = ("DATA", "ALERT", "METRIC", "HEARTBEAT", "ERROR")
DEFAULT_PRIORITY = 3

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("payload", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

# ``payload`` and ``metadata`` are JSON text: VARIANT can be neither a grouping
# nor a window key, and a MAP would lose the value types.


# Tables that grow with the data, as opposed to lookup tables.
FACT_TABLES = ("events", "lineitem", "orders", "documents")


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that has fewer splits than there are cores.

    A Parquet file is split at row groups only, so one file of one row group
    would keep a single core busy.  A large table has splits enough and is left
    alone, and so is any table on a cluster.  Filters and column pruning pass
    through the repartitioning.
    """
    if not df.sparkSession.sparkContext.master.startswith("local"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in FACT_TABLES else table


def canonical_events(raw: DataFrame) -> DataFrame:
    """Map the ``events`` table (batch or streaming) to the canonical schema."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    return raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("src-"), (F.col("user_id") % 10).cast("string")).alias("source_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(kind == "error", "ERROR")
        .when(kind == "purchase", "ALERT")
        .when(kind == "view", "METRIC")
        .when(kind == "signup", "HEARTBEAT")
        .otherwise("DATA")
        .alias("event_type"),
        F.when(kind == "error", 1)
        .when(kind == "purchase", 2)
        .when(kind == "click", 3)
        .when(kind == "view", 5)
        .cast("int")
        .alias("priority"),
        F.concat(
            F.lit('{"type":"'), kind,
            F.lit('","user_id":'), F.col("user_id").cast("string"),
            F.lit(',"value":'), F.col("value").cast("string"),
            F.lit(',"k":'), k,
            F.lit("}"),
        ).alias("payload"),
        F.lit(None).cast("string").alias("metadata"),
        F.col("props").alias("raw"),
    )


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(read_table(spark, sf_dir, "events"))
