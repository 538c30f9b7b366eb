"""Sources: CSV in three ways, text, JSON arrays, rows, and message logs with a broker's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def read_csv_fixed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A fixed schema, checked against the header; an empty field is null."""
    return spark.read.option("header", True).option("enforceSchema", False).option("nullValue", "").schema(schema).csv(path)


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_text_lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """One row for each line that is neither blank nor a comment."""
    return spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith(comment))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that hold one JSON array each."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def rows_frame(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """The broker's own source; needs its connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load()


def message_files_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Files with a broker's columns (key, value, topic, partition, offset, timestamp), in order of modification."""
    schema = "key string, value binary, topic string, partition int, offset long, timestamp timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def poll(log: DataFrame, committed: dict[int, int], limit: int | None = None) -> DataFrame:
    """Messages at and after the committed offset of each partition (0 where there is none), at most ``limit`` of each."""
    at = F.create_map(*[F.lit(x) for kv in committed.items() for x in kv]) if committed else F.create_map().cast("map<int,bigint>")
    start = F.coalesce(F.try_element_at(at, F.col("partition")).cast("long"), F.lit(0))
    out = log.filter(F.col("offset") >= start)
    return out.filter(F.col("offset") < start + limit) if limit is not None else out


def offsets_to_commit(messages: DataFrame) -> DataFrame:
    """For each topic and partition the offset to go on from, and the one to go back to after a failure."""
    return messages.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("commit"), F.min("offset").alias("rewind"))


def consumer_lag(log: DataFrame, committed: DataFrame) -> DataFrame:
    end = log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end"))
    return end.join(committed.select("topic", "partition", "commit"), ["topic", "partition"], "left").select("topic", "partition", (F.col("end") - F.coalesce("commit", F.lit(0))).alias("lag"))
