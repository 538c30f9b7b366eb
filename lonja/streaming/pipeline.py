"""Order streams: sources with the same columns, windows under a watermark, and a sink that replays don't change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.sources.versioned import VersionedTable

ORDER_SCHEMA = "pedido_id string, fecha string, region string, categoria string, producto string, cantidad int, precio_unit double, total double, canal string, metodo_pago string, devuelto boolean"


def to_orders(stream: DataFrame, payload: str = "value", time: str = "timestamp") -> DataFrame:
    """Bytes to typed columns and ``kafka_time``, whatever the source; a malformed payload gives nulls."""
    lineage = [F.col(c).alias(f"_kafka_{c}") for c in ("topic", "partition", "offset") if c in stream.columns]
    return stream.select(F.from_json(F.col(payload).cast("string"), ORDER_SCHEMA).alias("d"), F.col(time).cast("timestamp").alias("kafka_time"), *lineage).select("d.*", "kafka_time", *[c for c in ("_kafka_topic", "_kafka_partition", "_kafka_offset") if c[7:] in stream.columns])


def from_kinesis(stream: DataFrame) -> DataFrame:
    return to_orders(stream, "data", "approximateArrivalTimestamp")


def windowed_sales(orders: DataFrame, time: str = "kafka_time", group: str = "region", amount: str = "total", key: str = "pedido_id", width: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = orders.withWatermark(time, late).groupBy(w.alias("w"), group).agg(F.sum(amount).alias("ventas_totales"), F.count(key).alias("num_pedidos"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), group, "ventas_totales", "num_pedidos")


def session_sales(orders: DataFrame, time: str, group: str, amount: str, gap: str, late: str = "10 minutes") -> DataFrame:
    out = orders.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), group).agg(F.sum(amount).alias("ventas_totales"), F.count("*").alias("num_pedidos"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), group, "ventas_totales", "num_pedidos")


def upsert_sink(table: VersionedTable, keys: list[str], stream_id: str, after: Callable[[int], None] | None = None):
    """A foreachBatch function: null-safe upsert, each batch once. ``after`` is a hook for faults between merge and commit."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, keys, null_safe=True, txn=(stream_id, batch_id))
        if after:
            after(batch_id)

    return write


def run_available(stream: DataFrame, sink, checkpoint: str, mode: str = "update", processing_time: str | None = None):
    """Runs a stream over what is there (or by a processing-time trigger) into a foreachBatch sink."""
    w = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    q = (w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)).start()
    if not processing_time:
        q.awaitTermination()
    return q


def latest_by_id(orders: DataFrame) -> DataFrame:
    """One row for each order id: the last message of it."""
    rows = orders.filter("pedido_id is not null")
    return rows.groupBy("pedido_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "pedido_id"]), F.struct("_kafka_partition", "_kafka_offset")).alias("r")).select("pedido_id", "r.*")


def consume(spark: SparkSession, log: DataFrame, table: VersionedTable, committed: dict[int, int], batch: int, fail_after: Callable[[int], None] | None = None) -> dict[int, int]:
    """At-least-once consumption: merge a batch, then move the offsets; a failure in between leaves them, so the batch comes again.

    A batch begins at the next message that a partition holds, wherever its log has gaps, and ends when none holds one.
    """
    from lonja.sources.readers import offsets_to_commit, poll

    while True:
        ahead = {r["partition"]: r["rewind"] for r in offsets_to_commit(poll(log, committed)).collect()}  # a row for each partition of the topic
        if not ahead:
            return committed
        part = poll(log, {**committed, **ahead}, batch)
        moves = offsets_to_commit(part).collect()
        table.upsert(latest_by_id(to_orders(part).withColumn("_ingested_at", F.current_timestamp())), ["pedido_id"])
        for m in moves:
            if fail_after:
                fail_after(m["commit"])
        committed = {**committed, **{m["partition"]: m["commit"] for m in moves}}


def last_write_sink(table: VersionedTable, stream_id: str, after: Callable[[int], None] | None = None):
    """A foreachBatch function for order messages: the last message of an order replaces its row, each batch once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(latest_by_id(batch), ["pedido_id"], txn=(stream_id, batch_id))
        if after:
            after(batch_id)

    return write


def first_seen(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Rows whose key wasn't seen within the lateness allowed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append_sink(table: VersionedTable, stream_id: str):
    """A foreachBatch function that appends, each batch once."""
    return lambda batch, batch_id: table.append(batch, txn=(stream_id, batch_id))


def replay(events: DataFrame, order: str, commit_every: int, crash_at: int) -> DataFrame:
    """Deliveries of a consumer that commits every so often and crashes once: what came after the last commit comes twice.

    ``order`` numbers the events from 0.
    """
    again = events.filter((F.col(order) >= crash_at - crash_at % commit_every) & (F.col(order) < crash_at))
    return events.withColumn("entrega", F.lit(1)).unionByName(again.withColumn("entrega", F.lit(2)))
