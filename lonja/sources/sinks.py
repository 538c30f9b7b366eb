"""Sinks: single-file exports, partition overwrite, text reports, catalog tables and keyed message files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def export_single(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """One file for another engine; meant for results that are small by nature."""
    w = df.coalesce(1).write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that the rows hold, so a day can be written again."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_report(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def register_table(spark: SparkSession, name: str, path: str, kind: str = "parquet", header: bool = True) -> None:
    opts = f" OPTIONS (header '{str(header).lower()}')" if kind == "csv" else ""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING {kind}{opts} LOCATION '{path}'")


def broker_partition(key: Column, partitions: int) -> Column:
    """The partition of a key, by the first 32 bits of its MD5, so that any client can tell it; a null key goes to partition 0."""
    head = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.coalesce((head % partitions).cast("int"), F.lit(0))


def as_messages(df: DataFrame, key: str, topic: str, partitions: int, order: str, ranges: int = 64) -> DataFrame:
    """Rows as messages: JSON payload, partition by key, offsets from 0 in each partition in the order of a numeric column.

    A partition of any size is numbered by ranges of the order column: the rows of the ranges before a range are its
    first offset, so no task sorts more than one range. Ties get offsets in no particular order; a null order comes first.
    """
    made = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).cast("binary").alias("value"), F.lit(topic).alias("topic"), broker_partition(F.col(key), partitions).alias("partition"), F.col(order).cast("double").alias("__order"))
    cuts = made.agg(F.percentile_approx("__order", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    made = made.withColumn("__range", F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c < F.col("__order"))))
    made = made.withColumn("__range", F.when(F.col("__order").isNull(), -1).otherwise(F.col("__range")))
    before = Window.partitionBy("partition").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    first = made.groupBy("partition", "__range").agg(F.count("*").alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    # partitions x ranges rows
    placed = made.join(F.broadcast(first), ["partition", "__range"])
    inside = Window.partitionBy("partition", "__range").orderBy("__order")
    return placed.select("key", "value", "topic", "partition", (F.row_number().over(inside) - 1 + F.col("__first")).cast("long").alias("offset"))
