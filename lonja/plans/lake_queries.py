"""Queries that go through files, versioned tables and streams; everything is staged in the shared scratch folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.operators.medallion import BUSINESS, to_bronze
from lonja.operators.models import load_models, units_by_product
from lonja.operators.runner import explained, scanned
from lonja.plans.sales_queries import KEY_PARTITION
from lonja.session import reliable_checkpoint, table
from lonja.sources import generators, readers, sinks
from lonja.sources.storage import scratch_dir
from lonja.sources.versioned import VersionedTable
from lonja.streaming import pipeline as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- sources and sinks ------------------------------------------------------------------------------------------------------
def _csv(spark, d) -> str:
    path = scratch_dir(spark, "csv")
    table(spark, d, "customer").write.option("header", True).csv(path)
    return path


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def src1_csv_strings(spark, d):
    return readers.read_csv_strings(spark, _csv(spark, d)).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src2_csv_fixed(spark, d):
    return readers.read_csv_fixed(spark, _csv(spark, d), table(spark, d, "customer").schema)


@query("SELECT c_mktsegment, count(*) AS n, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE), 2) AS saldo FROM customer GROUP BY 1")
def src3_csv_inferred(spark, d):
    c = readers.read_csv_inferred(spark, _csv(spark, d))
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double"), 2).alias("saldo"))


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '1995-06-30'")
def src4_parquet_pushdown(spark, d):
    return table(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz '1995-06-30'").select("l_orderkey", "l_quantity")


@query("SELECT nombre AS value FROM productos")
def src9_text_lines(spark, d):
    path = scratch_dir(spark, "text")
    lines = table(spark, d, "productos").select(F.explode(F.array("nombre", F.lit(""), F.lit("# nota"))).alias("value"))
    lines.write.text(path)
    return readers.read_text_lines(spark, path)


@query("SELECT producto_id, nombre, precio FROM productos")
def src10_json_array(spark, d):
    path = scratch_dir(spark, "json")
    # A fixed list of products becomes one array.
    table(spark, d, "productos").agg(F.to_json(F.collect_list(F.struct("producto_id", "nombre", "precio"))).alias("value")).write.text(path)
    return readers.read_json_array(spark, path, "producto_id long, nombre string, precio long")


@query("SELECT * FROM (VALUES (1::BIGINT, 'a'), (2::BIGINT, NULL)) t(id, nombre)")
def src11_rows(spark, d):
    return readers.rows_frame(spark, [(1, "a"), (2, None)], "id long, nombre string")


@query("SELECT range AS id FROM range(5)")
def src12_range(spark, d):
    return spark.range(5)


def _messages(spark, d) -> DataFrame:
    p = table(spark, d, "pedidos_ventas")
    payload = F.to_json(F.struct(*[c for c in "pedido_id fecha region categoria producto cantidad precio_unit total canal metodo_pago devuelto".split()]))
    return p.select(F.col("_kafka_key").alias("key"), payload.cast("binary").alias("value"), F.col("_kafka_topic").alias("topic"), F.col("_kafka_partition").alias("partition"), F.col("_kafka_offset").alias("offset"), F.col("kafka_time").alias("timestamp"))


@query("SELECT pedido_id, region, total, _kafka_partition, _kafka_offset FROM pedidos_ventas")
def src13_message_payloads(spark, d):
    return S.to_orders(_messages(spark, d)).select("pedido_id", "region", "total", "_kafka_partition", "_kafka_offset")


@query("SELECT pedido_id, region, total FROM pedidos_ventas")
def src14_kinesis_adapter(spark, d):
    k = _messages(spark, d).select(F.col("value").alias("data"), F.col("timestamp").alias("approximateArrivalTimestamp"))
    return S.from_kinesis(k).select("pedido_id", "region", "total")


@query("SELECT _kafka_partition AS partition, _kafka_offset AS offset FROM pedidos_ventas WHERE _kafka_offset >= CASE _kafka_partition WHEN 0 THEN 100 WHEN 1 THEN 50 ELSE 0 END")
def src15_poll_from_offsets(spark, d):
    return readers.poll(_messages(spark, d), {0: 100, 1: 50}).select("partition", "offset")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def snk4_partition_overwrite(spark, d):
    """The partition overwrite over every month: one is written again, all the others stay."""
    path = scratch_dir(spark, "days")
    # Each month in one task, so its files stay few.
    o = table(spark, d, "orders").withColumn("mes", F.date_format("o_orderdate", "yyyy-MM"))
    sinks.overwrite_partitions(o.repartition("mes"), path, "mes")
    sinks.overwrite_partitions(o.filter("mes = '1995-03'"), path, "mes")
    return spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT r_regionkey, r_name FROM region")
def snk5_single_file_export(spark, d):
    path = scratch_dir(spark, "export")
    sinks.export_single(table(spark, d, "region"), path, "csv")
    return spark.read.option("header", True).schema(table(spark, d, "region").schema).csv(path)


@query("SELECT * FROM (VALUES ('informe'), ('fin')) t(value)")
def snk6_text_report(spark, d):
    path = scratch_dir(spark, "report")
    sinks.write_report(spark, ["informe", "fin"], path)
    return spark.read.text(path)


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def snk7_catalog_table(spark, d):
    path = scratch_dir(spark, "catalog")
    table(spark, d, "nation").write.parquet(path)
    sinks.register_table(spark, "lonja_nation", path)
    return spark.sql("SELECT n_name, n_regionkey FROM lonja_nation WHERE n_regionkey = 2")


@query(f"SELECT entrega_id, region AS key, particion AS partition, row_number() OVER (PARTITION BY particion ORDER BY entrega_id) - 1 AS offset FROM (SELECT entrega_id, region, {KEY_PARTITION.format('region')} AS particion FROM pedidos_ventas)")
def snk10_keyed_messages(spark, d):
    m = sinks.as_messages(table(spark, d, "pedidos_ventas").select("entrega_id", "region", "total"), "region", "ventas", 4, "entrega_id")
    return m.select(F.get_json_object(F.col("value").cast("string"), "$.entrega_id").cast("long").alias("entrega_id"), "key", "partition", "offset")


@query("SELECT entrega_id, region AS particion, pedido_id, categoria, total, devuelto, CAST(NULL AS VARCHAR) AS producto, CAST(NULL AS INT) AS cantidad FROM pedidos_ventas")
def snk11_six_field_put(spark, d):
    """Records of six fields, partitioned by region; what they lack parses to null."""
    p = table(spark, d, "pedidos_ventas").select("entrega_id", "pedido_id", "region", "categoria", "total", F.col("fecha").alias("timestamp"), "devuelto")
    put = p.select("entrega_id", F.col("region").alias("particion"), F.to_json(F.struct("pedido_id", "region", "categoria", "total", "timestamp", "devuelto")).cast("binary").alias("data"), F.current_timestamp().alias("approximateArrivalTimestamp"))
    got = put.select("entrega_id", "particion", F.from_json(F.col("data").cast("string"), S.ORDER_SCHEMA).alias("d"))
    return got.select("entrega_id", "particion", "d.pedido_id", "d.categoria", "d.total", "d.devuelto", "d.producto", "d.cantidad")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def snk8_csv_table(spark, d):
    """An external table over CSV files with a header."""
    path = scratch_dir(spark, "csv")
    table(spark, d, "nation").write.option("header", True).csv(path)
    spark.sql("DROP TABLE IF EXISTS lonja_nation_csv")
    spark.sql(f"CREATE TABLE lonja_nation_csv (n_nationkey INT, n_name STRING, n_regionkey INT) USING csv OPTIONS (header 'true') LOCATION '{path}'")
    return spark.sql("SELECT n_nationkey, n_name, n_regionkey FROM lonja_nation_csv")


_ROWS = "(SELECT DISTINCT * FROM pedidos WHERE pedido_id IS NOT NULL)"


@query(f"SELECT 'documentos' AS modelo, count(*) AS n, sum(total)::BIGINT AS suma FROM {_ROWS} UNION ALL SELECT 'region_dia', count(*), sum(total)::BIGINT FROM {_ROWS} UNION ALL SELECT 'por_cliente', count(*), sum(total)::BIGINT FROM {_ROWS} WHERE cliente_id IS NOT NULL "
       f"UNION ALL SELECT 'ranking', count(*), sum(u)::BIGINT FROM (SELECT i.producto_id, sum(i.cantidad) AS u FROM (SELECT unnest(items) AS i FROM {_ROWS}) GROUP BY 1) UNION ALL SELECT 'compras', count(*), sum(u)::BIGINT FROM (SELECT cliente_id, i.producto_id, sum(i.cantidad) AS u FROM (SELECT cliente_id, unnest(items) AS i FROM {_ROWS} WHERE cliente_id IS NOT NULL) GROUP BY 1, 2)")  # fmt: skip
def snk12_model_loaders(spark, d):
    """The derived tables of all four models, written twice and read back."""
    path, t = scratch_dir(spark, "models"), lambda n: table(spark, d, n)
    for _ in range(2):
        made = load_models(t("pedidos"), t("clientes"), t("productos"), path)
    parts = [spark.read.parquet(p).agg(F.lit(name).alias("modelo"), F.count("*").alias("n"), F.sum("unidades" if name in ("ranking", "compras") else "total").cast("long").alias("suma")) for name, p in made.items()]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT count(*) AS filas, true AS menos_bytes, true AS plan FROM lineitem")
def ben2_scanned(spark, d):
    """Rows, files and bytes of the same query over Parquet and over CSV."""
    path, li = scratch_dir(spark, "csv"), table(spark, d, "lineitem")
    li.write.option("header", True).csv(path)
    csv = spark.read.option("header", True).schema(li.schema).csv(path)
    a, b = scanned(li), scanned(csv)
    plan = "ReadSchema" in explained(li.select("l_orderkey"))
    return spark.createDataFrame([(a["rows"], a["rows"] == b["rows"] and a["bytes"] < b["bytes"], plan)], "filas long, menos_bytes boolean, plan boolean")


@query("SELECT o_orderpriority, count(*) AS n, count(*) AS otra_vez FROM orders GROUP BY 1")
def snk15_physical_controls(spark, d):
    """Rows that are persisted are counted twice and released; the result is one partition."""
    o = table(spark, d, "orders").select("o_orderpriority").persist()
    try:
        n, again = (o.groupBy("o_orderpriority").agg(F.count("*").alias(c)) for c in ("n", "otra_vez"))
        return reliable_checkpoint(n.join(again, "o_orderpriority").coalesce(1))
    finally:
        o.unpersist()


@query("SELECT 20300 AS filas, 300 AS copias, true AS ids_nulos, true AS totales_nulos, true AS regiones, true AS igual")
def src16_generated_sales(spark, d):
    """What the seeded generator of raw sales must hold, whatever the partitions."""
    n = 20_000
    raw = reliable_checkpoint(generators.dirty_sales(spark, n))
    one = raw.agg(F.count("*").alias("filas"), F.avg(F.col("pedido_id").isNull().cast("int")).alias("i"), F.avg(F.col("total").isNull().cast("int")).alias("t"), F.avg((F.initcap(F.trim("region")) == "Bogotá").cast("int")).alias("r"), F.sum(F.xxhash64(*raw.columns).cast("decimal(38,0)")).alias("h")).first()
    other = generators.dirty_sales(spark, n).repartition(7).agg(F.sum(F.xxhash64(*raw.columns).cast("decimal(38,0)"))).first()[0]
    said = (20_300 if abs(one["filas"] - 20_300) < 90 else one["filas"], 300 if abs(one["filas"] - n - 300) < 90 else -1, 0.0005 < one["i"] < 0.004, 0.02 < one["t"] < 0.03, 0.38 < one["r"] < 0.42, one["h"] == other)
    return spark.createDataFrame([said], "filas int, copias int, ids_nulos boolean, totales_nulos boolean, regiones boolean, igual boolean")


# -- versioned tables -----------------------------------------------------------------------------------------------------------
def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _written(spark, d) -> VersionedTable:
    """Version 0: the orders that are closed or in progress; 1: an upsert of all that are in progress or open, with a new status; 2: an append of key -1."""
    t, o = VersionedTable(spark, scratch_dir(spark, "table")), _orders(spark, d)
    t.upsert(o.filter("o_orderstatus <> 'O'"), ["o_orderkey"])
    t.upsert(o.filter("o_orderstatus <> 'F'").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])
    t.append(spark.createDataFrame([(-1, -1, "N", 0.0)], o.schema))
    return t


_V0 = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'O'"
_V1 = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders"


@query(_V1 + " UNION ALL SELECT -1, -1, 'N', 0.0")
def mrg1_upsert(spark, d):
    return _written(spark, d).read()


@query(_V0)
def src6_time_travel(spark, d):
    return _written(spark, d).read(version=0)


@query("SELECT * FROM (VALUES (0::BIGINT, 'UPSERT'), (1::BIGINT, 'UPSERT'), (2::BIGINT, 'APPEND')) t(version, operation)")
def src7_history(spark, d):
    return _written(spark, d).history().select("version", "operation")


@query("SELECT true AS antes, false AS sin")
def src8_table_exists(spark, d):
    t = _written(spark, d)
    return spark.createDataFrame([(VersionedTable.exists(spark, t.path), VersionedTable.exists(spark, t.path + "-no"))], "antes boolean, sin boolean")


@query("SELECT n_nationkey, n_name, CAST(NULL AS INT) AS extra FROM nation UNION ALL SELECT 100, 'N', 1")
def snk3_schema_merge(spark, d):
    t = VersionedTable(spark, scratch_dir(spark, "table"))
    t.overwrite(table(spark, d, "nation").select("n_nationkey", "n_name"))
    t.append(spark.createDataFrame([(100, "N", 1)], "n_nationkey int, n_name string, extra int"))
    return t.read()


@query("SELECT o_orderkey, o_totalprice FROM orders")
def snk14_optimize_zorder(spark, d):
    t = VersionedTable(spark, scratch_dir(spark, "table"))
    t.append(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"))
    t.optimize(4, ["o_custkey", "o_orderdate"])
    return t.read().select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderstatus, 2 * count(*) AS n FROM orders GROUP BY 1, 2")
def mrg2_composite_accumulate(spark, d):
    t = VersionedTable(spark, scratch_dir(spark, "table"))
    counts = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    t.upsert(counts, ["o_custkey", "o_orderstatus"], null_safe=True, accumulate=["n"])
    t.upsert(counts, ["o_custkey", "o_orderstatus"], null_safe=True, accumulate=["n"])
    return t.read()


@query("SELECT i.producto_id AS producto_id, (2 * sum(i.cantidad))::BIGINT AS unidades FROM (SELECT unnest(items) AS i FROM pedidos) GROUP BY 1")
def mrg4_accumulate(spark, d):
    """A sorted set's increments: the same units added twice."""
    t, units = VersionedTable(spark, scratch_dir(spark, "table")), units_by_product(table(spark, d, "pedidos"))
    for _ in range(2):
        t.upsert(units, ["producto_id"], null_safe=True, accumulate=["unidades"])
    return t.read()


@query("SELECT producto, pedido_id, arg_max(cantidad, entrega_id) AS cantidad FROM pedidos_ventas WHERE pedido_id IS NOT NULL GROUP BY 1, 2")
def mrg5_last_write_wins(spark, d):
    """Rows of a wide-column table by primary key (product, order): each delivery overwrites, in the order of their batches' halves."""
    p, t, keys = table(spark, d, "pedidos_ventas").filter("pedido_id is not null"), VersionedTable(spark, scratch_dir(spark, "table")), ["producto", "pedido_id"]
    half = p.agg(F.avg("entrega_id")).first()[0] or 0
    for part in (p.filter(F.col("entrega_id") < half), p.filter(F.col("entrega_id") >= half)):
        t.upsert(part.groupBy(*keys).agg(F.max_by("cantidad", "entrega_id").alias("cantidad")), keys, null_safe=True)
    return t.read()


@query(f"SELECT {', '.join(BUSINESS)} FROM ventas_colombia_raw")
def bronze_append(spark, d):
    t = VersionedTable(spark, scratch_dir(spark, "bronze"))
    t.append(to_bronze(spark.read.parquet(f"{d}/ventas_colombia_raw.parquet")))
    return t.read().select(*BUSINESS)


# -- streams -------------------------------------------------------------------------------------------------------------------------
def _event_files(spark, d, n: int = 3) -> str:
    """The events in files one after another in the order of time."""
    path, e = scratch_dir(spark, "stream"), table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = [None, *[r for r in e.select(F.percentile_approx(F.unix_micros("ts"), [k / n for k in range(1, n)], 1000)).first()[0]], None]
    at = F.unix_micros("ts")
    for lo, hi in zip(cuts, cuts[1:]):
        part = e.filter((at >= lo) if lo is not None else F.lit(True)).filter((at < hi) if hi is not None else F.lit(True))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def _event_stream(spark, path) -> DataFrame:
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").option("maxFilesPerTrigger", 1).parquet(path)


def _out(df: DataFrame) -> DataFrame:
    return df.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", F.round("ventas_totales", 2).alias("ventas"), F.col("num_pedidos").alias("n"))


_WINDOWS = "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end, event_type, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS ventas, count(event_id) AS n FROM events GROUP BY 1, 2, 3"


@query(_WINDOWS)
def stm2_windowed_upsert_stream(spark, d):
    """Watermark, tumbling window, update mode, checkpoint and an idempotent sink, run over what is there; then a replay from nothing."""
    path, t = _event_files(spark, d), VersionedTable(spark, scratch_dir(spark, "silver"))
    keys = ["window_start", "window_end", "event_type"]
    for _ in range(2):
        w = S.windowed_sales(_event_stream(spark, path), "ts", "event_type", "value", "event_id")
        S.run_available(w, S.upsert_sink(t, keys, scratch_dir(spark, "id")), scratch_dir(spark, "checkpoint"))
    return _out(t.read())


@query("SELECT pedido_id, max(_kafka_offset) AS vista FROM pedidos_ventas WHERE pedido_id IS NOT NULL GROUP BY 1")
def stm7_at_least_once_consumer(spark, d):
    """The consumer over all partitions to their end, in four merges whatever the log's length; it fails after the first and starts again."""
    t = VersionedTable(spark, scratch_dir(spark, "orders"))
    log = _messages(spark, d)
    batch = (log.agg(F.max("offset")).first()[0] or 0) // 4 + 1

    def fault(commit: int) -> None:
        raise RuntimeError("after the merge, before the commit")

    try:
        S.consume(spark, log, t, {}, batch, fault)
    except RuntimeError:
        pass
    S.consume(spark, log, t, {}, batch)
    return t.read().select("pedido_id", F.col("_kafka_offset").alias("vista"))


@query("SELECT event_id % 7 AS producto, count(*) AS una_vez, count(*) + count(*) FILTER (n >= 500 AND n < 700) AS ingenuo FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events) GROUP BY 1")
def stm9_replay_once_and_naive(spark, d):
    e = table(spark, d, "events")
    low = e.agg(F.min("event_id")).first()[0] or 0
    deliveries = S.replay(e.withColumn("n", F.col("event_id") - low), "n", 500, 700)
    return deliveries.groupBy((F.col("event_id") % 7).alias("producto")).agg(F.count_distinct("event_id").alias("una_vez"), F.count("*").alias("ingenuo"))


@query("SELECT _kafka_topic AS topic, _kafka_partition AS partition, max(_kafka_offset) + 1 - 10 AS lag FROM pedidos_ventas GROUP BY 1, 2")
def stm12_consumer_lag(spark, d):
    m = _messages(spark, d)
    return readers.consumer_lag(m, m.select("topic", "partition").distinct().withColumn("commit", F.lit(10).cast("long")))


def _message_files(spark, d, n: int = 3) -> str:
    """The topic as files with a broker's columns, one after another in the order of offsets."""
    path, m = scratch_dir(spark, "topic"), _messages(spark, d)
    last = m.agg(F.max("offset")).first()[0] or 0
    for k in range(n):
        m.filter((F.col("offset") > last * k // n if k else F.lit(True)) & (F.col("offset") <= last * (k + 1) // n)).coalesce(1).write.mode("append").parquet(path)
    return path


@query("SELECT pedido_id, arg_max(region, _kafka_offset) AS region, max(_kafka_offset) AS vista FROM pedidos_ventas WHERE pedido_id IS NOT NULL GROUP BY 1")
def stm4_restart_from_checkpoint(spark, d):
    """A stream of broker-shaped files that fails after its second merge and goes on from its checkpoint: the batch comes again and changes nothing."""
    path, t, checkpoint = _message_files(spark, d), VersionedTable(spark, scratch_dir(spark, "orders")), scratch_dir(spark, "checkpoint")

    def fault(batch_id: int) -> None:
        if batch_id == 1:
            raise RuntimeError("after the merge, before the commit")

    failed = False
    try:
        S.run_available(S.to_orders(readers.message_files_stream(spark, path)), S.last_write_sink(t, "s", fault), checkpoint, "append")
    except Exception as e:  # noqa: BLE001
        failed = "after the merge" in str(e)
    if not failed or t.version() != 1:
        raise AssertionError("the fault didn't stop the stream after its second merge")
    S.run_available(S.to_orders(readers.message_files_stream(spark, path)), S.last_write_sink(t, "s"), checkpoint, "append")
    return t.read().select("pedido_id", "region", F.col("_kafka_offset").alias("vista"))


@query("SELECT DISTINCT event_id FROM events")
def ded3_stream(spark, d):
    """Events delivered twice over a stream, each kept once under a watermark."""
    path, t = _event_files(spark, d), VersionedTable(spark, scratch_dir(spark, "table"))
    again = _event_stream(spark, path).withColumn("vez", F.explode(F.array(F.lit(1), F.lit(2))))
    S.run_available(S.first_seen(again, "event_id", "ts", "10 minutes"), S.append_sink(t, "s"), scratch_dir(spark, "checkpoint"), "append")
    return t.read().select("event_id")


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(5 * k) AS window_start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def stm13_sliding(spark, d):
    """Windows of ten minutes every five, over a stream."""
    path, t = _event_files(spark, d), VersionedTable(spark, scratch_dir(spark, "table"))
    w = S.windowed_sales(_event_stream(spark, path), "ts", "event_type", "value", "event_id", "10 minutes", slide="5 minutes")
    S.run_available(w, S.upsert_sink(t, ["window_start", "window_end", "event_type"], "s"), scratch_dir(spark, "checkpoint"))
    return t.read().select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", F.col("num_pedidos").alias("n"))


@query("SELECT v.event_id AS vista, p.event_id AS compra FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 30 MINUTE")
def stm13_stream_stream_join(spark, d):
    """Views with the purchases of the same user within half an hour; both streams keep what may still match."""
    path, t = _event_files(spark, d), VersionedTable(spark, scratch_dir(spark, "table"))
    side = lambda kind, name: _event_stream(spark, path).filter(F.col("event_type") == kind).select(F.col("event_id").alias(name), F.col("user_id").alias(f"u_{name}"), F.col("ts").alias(f"ts_{name}")).withWatermark(f"ts_{name}", "30 minutes")
    both = side("view", "vista").join(side("purchase", "compra"), F.expr("u_vista = u_compra and ts_compra between ts_vista and ts_vista + interval 30 minutes"))
    S.run_available(both, S.append_sink(t, "s"), scratch_dir(spark, "checkpoint"), "append")
    return t.read().select("vista", "compra")


_SESSIONS = """
WITH m AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 2 MINUTE, true) AS nueva FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT *, count(*) FILTER (nueva) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 2 MINUTE AS window_end, event_type, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS ventas, count(*) AS n FROM s GROUP BY event_type, k
"""


@query(_SESSIONS)
def stm13_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _out(S.session_sales(e, "ts", "event_type", "value", "2 minutes"))
