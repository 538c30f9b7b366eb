"""Queries of scans, projections, filters, joins, aggregates, windows, functions and models, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lonja.functions import values as V
from lonja.operators import medallion as M
from lonja.operators import models, quality, text_stats
from lonja.operators.joins import asof_join, band_join
from lonja.operators.quality import dirt_report, null_report
from lonja.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


RAW, ORD, ITEM = "ventas_colombia_raw", "orders", "lineitem"
MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def _sales(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customer's region; the dimensions are joined as the optimizer sees fit."""
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    geo = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    o = table(spark, d, ORD)
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(geo, c["c_nationkey"] == geo["n_nationkey"])


_SALES = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
# The mean to two decimals in whole cents, ties up; for sums that aren't negative.
MEAN = "CAST((2 * CAST(100 * sum(CAST({0} AS DECIMAL(18,2))) AS HUGEINT) + count({0})) // (2 * count({0})) AS DOUBLE) / 100"
_KPI = "round({m}, 2) AS ventas_totales, count(o_orderkey) AS num_pedidos, {t} AS ticket_promedio, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 4) AS tasa_devolucion".format(m=MONEY.format("o_totalprice"), t=MEAN.format("o_totalprice"))


# -- aggregates -----------------------------------------------------------------------------------------------------
@query(f"SELECT r_name, CAST(o_orderdate AS DATE) AS fecha, {_KPI} FROM {_SALES} GROUP BY 1, 2")
def kpi_region_day(spark, d):
    s = _sales(spark, d).withColumn("fecha", F.to_date("o_orderdate"))
    return M.sales_kpis(s, ["r_name", "fecha"], "o_totalprice", "o_orderkey", F.col("o_orderstatus") == "F")


@query("SELECT o_orderpriority, round(" + MONEY.format("o_totalprice") + ", 2) AS ventas FROM orders GROUP BY 1 ORDER BY 2 DESC")
def agg1_sum_sorted(spark, d):
    return table(spark, d, ORD).groupBy("o_orderpriority").agg(F.round(money("o_totalprice"), 2).alias("ventas")).orderBy(F.desc("ventas"))


@query("SELECT canal, count(*) AS n FROM ventas_colombia_raw GROUP BY 1 ORDER BY 2 DESC")
def agg2_count_sorted(spark, d):
    return table(spark, d, RAW).groupBy("canal").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("SELECT p_type, p_name, round(" + MONEY.format("l_extendedprice") + ", 2) AS ventas FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def agg4_product_sales(spark, d):
    li, p = table(spark, d, ITEM), table(spark, d, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy("p_type", "p_name").agg(F.round(money("l_extendedprice"), 2).alias("ventas"))


@query("SELECT o_orderpriority, o_orderstatus, count(DISTINCT o_custkey) AS clientes, count(*) AS pedidos, round(" + MONEY.format("o_totalprice") + ", 2) AS ventas FROM orders GROUP BY 1, 2")
def agg5_cohorts(spark, d):
    return table(spark, d, ORD).groupBy("o_orderpriority", "o_orderstatus").agg(F.count_distinct("o_custkey").alias("clientes"), F.count("*").alias("pedidos"), F.round(money("o_totalprice"), 2).alias("ventas"))


_COLS = ["pedido_id", "fecha", "cantidad", "total", "email_cliente", "region", "canal", "vendedor_id"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS columna, count(*) AS filas, count(*) FILTER ({c} IS NULL OR {c} = '') AS nulos FROM ventas_colombia_raw" for c in _COLS))
def agg6_nulls_by_column(spark, d):
    return null_report(table(spark, d, RAW), _COLS)


@query("SELECT min(x) AS minimo, max(x) AS maximo, round(" + MONEY.format("x") + " / count(x), 2) AS media, count(*) - count(x) AS nulos, count(*) FILTER (x < 0) AS negativos, count(*) FILTER (x = 0) AS ceros FROM (SELECT TRY_CAST(total AS DOUBLE) AS x FROM ventas_colombia_raw)")
def agg7_global_stats(spark, d):
    x = table(spark, d, RAW).select(V.number(F.col("total")).alias("x"))
    return x.agg(F.min("x").alias("minimo"), F.max("x").alias("maximo"), F.round(money("x") / F.count("x"), 2).alias("media"), (F.count("*") - F.count("x")).alias("nulos"), F.count_if(F.col("x") < 0).alias("negativos"), F.count_if(F.col("x") == 0).alias("ceros"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT region FROM ventas_colombia_raw)")
def agg8_distinct_with_null(spark, d):
    return table(spark, d, RAW).select("region").distinct().agg(F.count("*").alias("n"))


@query("SELECT coalesce(sum(total), 0) AS total FROM pedidos")
def agg9_global_sum(spark, d):
    return table(spark, d, "pedidos").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


@query("SELECT region, strftime(CAST(substr(fecha, 1, 10) AS DATE), '%Y-%m') AS anio_mes, sum(total) AS total_ventas, count(*) AS n_transacciones FROM pedidos GROUP BY 1, 2")
def agg10_region_month(spark, d):
    p = table(spark, d, "pedidos").withColumn("anio_mes", F.date_format(F.to_date(V.day_of_iso(F.col("fecha"))), "yyyy-MM"))
    return p.groupBy("region", "anio_mes").agg(F.sum("total").alias("total_ventas"), F.count("*").alias("n_transacciones"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end, event_type, round(" + MONEY.format("value") + ", 2) AS ventas, count(event_id) AS n FROM events GROUP BY 1, 2, 3")
def agg11_window_batch(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.round(money("value"), 2).alias("ventas"), F.count("event_id").alias("n"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), "event_type", "ventas", "n")


_ITEMS = "(SELECT pedido_id, cliente_id, unnest(items) AS i FROM pedidos)"


@query(f"SELECT i.producto_id AS producto_id, sum(i.cantidad) AS unidades FROM {_ITEMS} GROUP BY 1")
def agg12_units_by_product(spark, d):
    return models.units_by_product(table(spark, d, "pedidos"))


@query(f"SELECT cliente_id, i.producto_id AS producto_id, sum(i.cantidad) AS unidades FROM {_ITEMS} WHERE cliente_id IS NOT NULL GROUP BY 1, 2")
def agg13_edges(spark, d):
    return models.edges(table(spark, d, "pedidos"))


@query(f"SELECT cliente_id, count(DISTINCT i.producto_id) AS productos, min(i.producto_id) AS primero FROM {_ITEMS} WHERE cliente_id IS NOT NULL GROUP BY 1")
def agg14_products_of_customer(spark, d):
    # Sets of products stay distinct edge rows: a customer may hold any share of them.
    return models.edges(table(spark, d, "pedidos")).groupBy("cliente_id").agg(F.count("*").alias("productos"), F.min("producto_id").alias("primero"))


@query(f"WITH e AS (SELECT DISTINCT cliente_id, i.producto_id AS producto_id FROM {_ITEMS} WHERE cliente_id IS NOT NULL) SELECT producto_id, count(DISTINCT cliente_id) AS vecinos FROM e GROUP BY 1")
def agg15_neighbours(spark, d):
    return models.edges(table(spark, d, "pedidos")).groupBy("producto_id").agg(F.count_distinct("cliente_id").alias("vecinos"))


@query("SELECT region, count(*) FILTER (_kafka_partition = 0) AS p0, count(*) FILTER (_kafka_partition = 1) AS p1, count(*) FILTER (_kafka_partition = 2) AS p2, count(*) FILTER (_kafka_partition = 3) AS p3 FROM pedidos_ventas GROUP BY 1")
def agg16_pivot_partitions(spark, d):
    p = table(spark, d, "pedidos_ventas").groupBy("region").pivot("_kafka_partition", [0, 1, 2, 3]).count()
    return p.select("region", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"p{k}") for k in range(4)])


@query("SELECT _kafka_topic AS topic, _kafka_partition AS partition, max(_kafka_offset) + 1 AS commit, min(_kafka_offset) AS rewind FROM pedidos_ventas GROUP BY 1, 2")
def agg17_offsets(spark, d):
    from lonja.sources.readers import offsets_to_commit

    p = table(spark, d, "pedidos_ventas")
    return offsets_to_commit(p.select(F.col("_kafka_topic").alias("topic"), F.col("_kafka_partition").alias("partition"), F.col("_kafka_offset").alias("offset")))


_TOKENS = "(SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9áéíóúüñäöß]+'), lambda x: x <> '')) AS palabra FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT palabra, count(*) AS veces FROM {_TOKENS} GROUP BY 1")
def agg18_word_count(spark, d):
    return text_stats.word_count(table(spark, d, "documents"), "text")


@query("SELECT round(avg(len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9áéíóúüñäöß]+'), lambda x: x <> ''))), 4) AS promedio FROM documents WHERE text IS NOT NULL")
def agg19_average_words(spark, d):
    return text_stats.average_words(table(spark, d, "documents").filter("text is not null"), "text")


@query("SELECT l_returnflag, median(l_quantity) AS mediana FROM lineitem GROUP BY 1")
def agg20_median(spark, d):
    return table(spark, d, ITEM).groupBy("l_returnflag").agg(F.median("l_quantity").alias("mediana"))


@query("SELECT round(100.0 * count(*) FILTER (total IS NULL) / nullif(count(*), 0), 2) AS pct_nulos, round(100.0 * count(DISTINCT pedido_id) / nullif(count(*), 0), 2) AS pct_distintos FROM ventas_colombia_raw")
def agg21_ratios(spark, d):
    n = F.nullif(F.count("*"), F.lit(0))
    return table(spark, d, RAW).agg(F.round(100.0 * F.count_if(F.col("total").isNull()) / n, 2).alias("pct_nulos"), F.round(100.0 * F.count_distinct("pedido_id") / n, 2).alias("pct_distintos"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg22_cube(spark, d):
    return table(spark, d, ITEM).cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg22_rollup(spark, d):
    return table(spark, d, ITEM).rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def agg22_grouping_sets(spark, d):
    g = [["l_returnflag"], ["l_linestatus"], []]
    return table(spark, d, ITEM).groupingSets([[F.col(c) for c in s] for s in g], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, round(sum(o_totalprice * o_totalprice) / sum(o_totalprice), 0) AS media FROM orders GROUP BY 1")
def agg22_weighted_mean(spark, d):
    """An aggregate that no built-in function is: sums by partition in Arrow batches, merged by built-in ones, so that a group of any size is never in one task."""

    def sums(frames):
        for pdf in frames:
            g = pdf.assign(xx=pdf["o_totalprice"] ** 2).groupby("o_orderpriority", as_index=False, dropna=False)[["xx", "o_totalprice"]].sum()
            yield g.rename(columns={"o_totalprice": "x"})[["o_orderpriority", "xx", "x"]]

    parts = table(spark, d, ORD).select("o_orderpriority", "o_totalprice").mapInPandas(sums, "o_orderpriority string, xx double, x double")
    return parts.groupBy("o_orderpriority").agg(F.round(F.sum("xx") / F.sum("x"), 0).alias("media"))


@query("SELECT l_returnflag, true AS cerca FROM lineitem GROUP BY 1")
def agg22_approx_distinct(spark, d):
    """The approximate count within five standard errors of the exact one."""
    n = F.approx_count_distinct("l_partkey", 0.02), F.count_distinct("l_partkey")
    return table(spark, d, ITEM).groupBy("l_returnflag").agg((F.abs(n[0] - n[1]) <= 0.1 * n[1]).alias("cerca"))


# -- projections and filters ------------------------------------------------------------------------------------------
@query("SELECT o_orderkey AS pedido_id, CAST(o_orderdate AS DATE) AS fecha, CAST(o_custkey AS VARCHAR) AS cliente, round(o_totalprice, 1) AS total FROM orders")
def prj1_select_cast(spark, d):
    return table(spark, d, ORD).select(F.col("o_orderkey").alias("pedido_id"), F.to_date("o_orderdate").alias("fecha"), F.col("o_custkey").cast("string").alias("cliente"), F.round("o_totalprice", 1).alias("total"))


@query("SELECT l_orderkey, l_quantity, round(l_extendedprice * (1 - l_discount), 4) AS neto FROM lineitem")
def prj2_with_and_drop(spark, d):
    return table(spark, d, ITEM).withColumn("neto", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).drop("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query("SELECT pedido_id, i.producto_id AS producto_id, i.cantidad AS cantidad, i.precio_unit AS precio_unit FROM " + _ITEMS)
def prj3_struct_expansion(spark, d):
    return table(spark, d, "pedidos").select("pedido_id", F.explode("items").alias("i")).select("pedido_id", "i.*")


@query("SELECT " + ", ".join(f"count({c}) AS {c}" for c in _COLS) + " FROM ventas_colombia_raw")
def prj4_generated_columns(spark, d):
    return table(spark, d, RAW).select(*[F.count(c).alias(c) for c in _COLS])


@query("SELECT fila_id, producto FROM ventas_colombia_raw WHERE region = 'Bogotá' AND categoria = 'Cocina'")
def flt1_conjunction(spark, d):
    return table(spark, d, RAW).filter("region = 'Bogotá' and categoria = 'Cocina'").select("fila_id", "producto")


@query("SELECT fila_id FROM ventas_colombia_raw WHERE TRY_CAST(cantidad AS DOUBLE) > 0 AND TRY_CAST(precio_unit AS DOUBLE) > 0")
def flt2_positive(spark, d):
    return table(spark, d, RAW).filter((V.number(F.col("cantidad")) > 0) & (V.number(F.col("precio_unit")) > 0)).select("fila_id")


@query("SELECT fila_id, email_cliente IS NULL AS sin_correo FROM ventas_colombia_raw WHERE pedido_id IS NOT NULL")
def flt3_not_null(spark, d):
    return table(spark, d, RAW).filter("pedido_id is not null").select("fila_id", F.col("email_cliente").isNull().alias("sin_correo"))


@query("SELECT fila_id FROM ventas_colombia_raw WHERE total IS NULL OR trim(total) = '' OR lower(total) = 'null' OR TRY_CAST(total AS DOUBLE) IS NULL")
def flt4_bad_amounts(spark, d):
    return table(spark, d, RAW).filter(V.blank(F.col("total")) | V.number(F.col("total")).isNull()).select("fila_id")


@query(r"SELECT fila_id, email_cliente FROM ventas_colombia_raw WHERE NOT regexp_matches(email_cliente, '^[^@\s]+@[^@\s]+\.[^@\s]+$')")
def flt5_not_regex(spark, d):
    return table(spark, d, RAW).filter(~F.col("email_cliente").rlike(V.EMAIL)).select("fila_id", "email_cliente")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 3 MONTH")
def flt6_last_months(spark, d, as_of="1998-08-01"):
    return table(spark, d, ORD).filter(F.col("o_orderdate") >= F.add_months(F.lit(as_of).cast("date"), -3)).select("o_orderkey")


@query("SELECT pedido_id, total FROM pedidos WHERE CAST(substr(fecha, 1, 10) AS DATE) = (SELECT min(CAST(substr(fecha, 1, 10) AS DATE)) FROM pedidos)")
def flt7_one_day(spark, d):
    p = table(spark, d, "pedidos").withColumn("dia", F.to_date(V.day_of_iso(F.col("fecha"))))
    return p.join(F.broadcast(p.agg(F.min("dia").alias("dia"))), "dia").select("pedido_id", "total")  # one row


_STOP = ", ".join(f"'{w}'" for w in text_stats.STOPWORDS)


@query(f"SELECT palabra, count(*) AS veces FROM {_TOKENS} WHERE palabra NOT IN ({_STOP}) GROUP BY 1")
def flt8_stopwords(spark, d):
    return text_stats.word_count(table(spark, d, "documents"), "text", text_stats.STOPWORDS)


@query("SELECT entrega_id FROM pedidos_ventas WHERE NOT devuelto")
def flt9_flag(spark, d):
    return table(spark, d, "pedidos_ventas").filter(~F.col("devuelto")).select("entrega_id")


# -- joins ------------------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, c_name, n_name, r_name FROM " + _SALES)
def jn2_lookup(spark, d):
    return _sales(spark, d).select("o_orderkey", "c_name", "n_name", "r_name")


_CLIENT = "(SELECT min(cliente_id) FROM pedidos WHERE cliente_id IS NOT NULL)"
_E = f"WITH e AS (SELECT DISTINCT cliente_id, i.producto_id AS producto_id FROM {_ITEMS} WHERE cliente_id IS NOT NULL), own AS (SELECT producto_id FROM e WHERE cliente_id = {_CLIENT}), near AS (SELECT DISTINCT cliente_id FROM e WHERE cliente_id <> {_CLIENT} AND producto_id IN (SELECT producto_id FROM own))"


def _first_client(spark, d) -> int:
    return table(spark, d, "pedidos").agg(F.min("cliente_id")).first()[0]


@query(_E + " SELECT cliente_id FROM near")
def jn3_semi(spark, d):
    e, c = models.edges(table(spark, d, "pedidos")), _first_client(spark, d)
    return e.filter(F.col("cliente_id") != c).join(e.filter(F.col("cliente_id") == c).select("producto_id"), "producto_id", "left_semi").select("cliente_id").distinct()


@query(_E + " SELECT DISTINCT producto_id FROM e WHERE cliente_id IN (SELECT cliente_id FROM near) AND producto_id NOT IN (SELECT producto_id FROM own)")
def jn4_anti(spark, d):
    e, c = models.edges(table(spark, d, "pedidos")), _first_client(spark, d)
    own = e.filter(F.col("cliente_id") == c).select("producto_id")
    near = e.filter(F.col("cliente_id") != c).join(own, "producto_id", "left_semi").select("cliente_id").distinct()
    return e.join(near, "cliente_id", "left_semi").join(own, "producto_id", "left_anti").select("producto_id").distinct()


@query(_E + f" SELECT DISTINCT producto_id AS vertice FROM e WHERE cliente_id IN (SELECT cliente_id FROM near) OR cliente_id = {_CLIENT}")
def jn5_three_edges(spark, d):
    return models.hops(models.edges(table(spark, d, "pedidos")), _first_client(spark, d), 3)


@query(_E + f", h3 AS (SELECT DISTINCT producto_id FROM e WHERE cliente_id IN (SELECT cliente_id FROM near) OR cliente_id = {_CLIENT}) SELECT DISTINCT cliente_id AS vertice FROM e WHERE producto_id IN (SELECT producto_id FROM h3)")
def jn6_four_edges(spark, d):
    return models.hops(models.edges(table(spark, d, "pedidos")), _first_client(spark, d), 4)


@query("SELECT c.cliente_id AS cliente_id, p.pedido_id AS pedido_id FROM clientes c FULL OUTER JOIN pedidos p ON c.cliente_id = p.cliente_id")
def jn7_full_outer(spark, d):
    c, p = table(spark, d, "clientes").select("cliente_id"), table(spark, d, "pedidos").select("pedido_id", F.col("cliente_id").alias("de"))
    return c.join(p, c["cliente_id"] == p["de"], "full_outer").select("cliente_id", "pedido_id")


@query("SELECT l.event_id AS event_id, r.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts")
def jn7_asof(spark, d):
    """Each purchase with the last view of its user."""
    e = table(spark, d, "events")
    left, right = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'").select("user_id", "ts", "value")
    return asof_join(left, right, ["user_id"], "ts", "ts", ["value"]).select("event_id", "asof_value")


@query("SELECT c_custkey, b.id AS banda FROM customer JOIN (SELECT range AS id, -1000.0 + 500 * range AS desde, -1000.0 + 500 * range + 700 AS hasta FROM range(23)) b ON c_acctbal >= desde AND c_acctbal < hasta")
def jn7_bands(spark, d):
    """Customers with every band their balance lies in; bands overlap."""
    low = F.lit(-1000.0) + 500 * F.col("id")
    bands = spark.range(23).select(F.col("id").alias("banda"), low.alias("desde"), (low + 700).alias("hasta"))
    return band_join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), bands, "c_acctbal", "desde", "hasta", 700.0).select("c_custkey", "banda")


@query("SELECT p.pedido_id AS pedido_id, c.nombre AS nombre FROM clientes c RIGHT JOIN pedidos p ON c.cliente_id = p.cliente_id")
def jn7_right_outer(spark, d):
    c, p = table(spark, d, "clientes").select("cliente_id", "nombre"), table(spark, d, "pedidos").select("pedido_id", F.col("cliente_id").alias("de"))
    return c.join(p, c["cliente_id"] == p["de"], "right_outer").select("pedido_id", "nombre")


# -- duplicates, windows, sorting, limits, sets --------------------------------------------------------------------------
@query("SELECT DISTINCT pedido_id, cliente_id, fecha, total FROM pedidos")
def ded1_exact_rows(spark, d):
    return table(spark, d, "pedidos").dropDuplicates().select("pedido_id", "cliente_id", "fecha", "total").distinct()


_B = ", ".join(M.BUSINESS)


@query(f"SELECT count(*) AS filas FROM (SELECT DISTINCT {_B} FROM ventas_colombia_raw)")
def ded2_subset(spark, d):
    return table(spark, d, RAW).dropDuplicates(M.BUSINESS).agg(F.count("*").alias("filas"))


@query("SELECT pedido_id, min(total) AS total FROM pedidos WHERE pedido_id IS NOT NULL GROUP BY 1")
def ded3_by_id(spark, d):
    return table(spark, d, "pedidos").filter("pedido_id is not null").groupBy("pedido_id").agg(F.min("total").alias("total"))


@query("SELECT count(*) - count(DISTINCT pedido_id) AS repetidas FROM pedidos WHERE pedido_id IS NOT NULL")
def ded4_duplicate_keys(spark, d):
    return table(spark, d, "pedidos").filter("pedido_id is not null").agg((F.count("*") - F.count_distinct("pedido_id")).alias("repetidas"))


@query("SELECT p_type, p_name, ventas FROM (SELECT *, rank() OVER (PARTITION BY p_type ORDER BY ventas DESC) AS r FROM (" + ORACLE_SQL["agg4_product_sales"] + ")) WHERE r <= 3")
def win1_top3_by_group(spark, d):
    li, p = table(spark, d, ITEM), table(spark, d, "part")
    return M.top_by_group(li.join(p, li["l_partkey"] == p["p_partkey"]), "p_type", "p_name", "l_extendedprice", 3)


_T = "(SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9áéíóúüñäöß]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT t[k] || ' ' || t[k + 1] AS bigrama, count(*) AS veces FROM (SELECT t, unnest(range(1, len(t))) AS k FROM {_T}) GROUP BY 1")
def win2_bigrams(spark, d):
    return text_stats.bigram_count(table(spark, d, "documents"), "text")


@query("SELECT o_orderkey, row_number() OVER w AS fila, lag(o_totalprice) OVER w AS previo, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE), 2) AS acumulado FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def win3_row_number_lag_frame(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    run = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    return table(spark, d, ORD).select("o_orderkey", F.row_number().over(w).alias("fila"), F.lag("o_totalprice").over(w).alias("previo"), F.round(run, 2).alias("acumulado"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def srt2_sort_tie_break(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def top1_top5(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(5)


@query(f"SELECT producto_id, unidades FROM ({ORACLE_SQL['agg12_units_by_product']}) ORDER BY unidades DESC, producto_id LIMIT 20")
def top2_top20_products(spark, d):
    return models.units_by_product(table(spark, d, "pedidos")).orderBy(F.desc("unidades"), "producto_id").limit(20)


@query(f"SELECT producto_id, unidades FROM ({ORACLE_SQL['agg12_units_by_product']}) ORDER BY unidades DESC, producto_id LIMIT 1")
def top3_top1(spark, d):
    return models.units_by_product(table(spark, d, "pedidos")).orderBy(F.desc("unidades"), "producto_id").limit(1)


@query("SELECT fila_id, pedido_id FROM ventas_colombia_raw ORDER BY fila_id LIMIT 10000")
def lim1_ordered_limit(spark, d):
    return table(spark, d, RAW).select("fila_id", "pedido_id").orderBy("fila_id").limit(10_000)


@query("SELECT cliente_id FROM (SELECT DISTINCT cliente_id FROM clientes) ORDER BY md5(cliente_id::VARCHAR || ':7'), cliente_id LIMIT 5")
def smp1_seeded_keys(spark, d):
    return models.sample_keys(table(spark, d, "clientes"), "cliente_id", 7, 5)


@query("SELECT par FROM (SELECT DISTINCT region || '|' || substr(fecha, 1, 10) AS par FROM pedidos WHERE region IS NOT NULL AND fecha IS NOT NULL) ORDER BY md5(par || ':7'), par LIMIT 3")
def smp1_region_days(spark, d):
    pairs = table(spark, d, "pedidos").filter("region is not null and fecha is not null").select(F.concat_ws("|", "region", V.day_of_iso(F.col("fecha"))).alias("par"))
    return models.sample_keys(pairs, "par", 7, 3)


@query("SELECT region FROM clientes UNION ALL SELECT region FROM pedidos")
def set1_concat(spark, d):
    return table(spark, d, "clientes").select("region").unionByName(table(spark, d, "pedidos").select("region"))


@query("SELECT cliente_id FROM clientes EXCEPT SELECT cliente_id FROM pedidos")
def set2_difference(spark, d):
    return table(spark, d, "clientes").select("cliente_id").subtract(table(spark, d, "pedidos").select("cliente_id"))


@query("SELECT cliente_id FROM clientes INTERSECT SELECT cliente_id FROM pedidos")
def set3_intersect(spark, d):
    return table(spark, d, "clientes").select("cliente_id").intersect(table(spark, d, "pedidos").select("cliente_id"))


# -- functions -----------------------------------------------------------------------------------------------------------
@query("SELECT fila_id, upper(trim(producto)) AS mayus, lower(categoria) AS minus FROM ventas_colombia_raw")
def str1_case_trim(spark, d):
    return table(spark, d, RAW).select("fila_id", F.upper(F.trim("producto")).alias("mayus"), F.lower("categoria").alias("minus"))


_FOLD = f"translate({{}}, '{V.ACCENTED}', '{V.PLAIN}')"


@query(f"SELECT fila_id, {_FOLD.format('producto')} AS plano FROM ventas_colombia_raw")
def str2_accent_fold(spark, d):
    return table(spark, d, RAW).select("fila_id", V.accent_fold(F.col("producto")).alias("plano"))


_KEY = f"regexp_replace(upper(trim({_FOLD.format('{}')})), '[^A-Z0-9]', '', 'g')"


@query("SELECT fila_id, " + _KEY.format("producto") + " AS clave FROM ventas_colombia_raw")
def str3_alias_key(spark, d):
    return table(spark, d, RAW).select("fila_id", V.alias_key(F.col("producto")).alias("clave"))


_PAY = {"tarjeta crédito": "tarjeta", "tarjeta débito": "tarjeta", "billetera digital": "digital", "transferencia": "banco"}


@query("SELECT fila_id, CASE " + " ".join(f"WHEN {_KEY.format('metodo_pago')} = '{V.alias_key_of(k)}' THEN '{v}'" for k, v in _PAY.items()) + " ELSE 'otro' END AS pago FROM ventas_colombia_raw")
def str4_alias_map(spark, d):
    return V.map_aliases(table(spark, d, RAW), "metodo_pago", _PAY, "otro", "pago").select("fila_id", "pago")


@query(r"SELECT CASE WHEN regexp_matches(fecha, '^\d{4}-\d{2}-\d{2}$') THEN 'yyyy-mm-dd' WHEN regexp_matches(fecha, '^\d{4}/\d{2}/\d{2}$') THEN 'yyyy/mm/dd' WHEN regexp_matches(fecha, '^\d{2}-\d{2}-\d{4}$') THEN 'dd-mm-yyyy' WHEN regexp_matches(fecha, '^\d{2}/\d{2}/\d{4}$') THEN 'dd/mm/yyyy or mm/dd/yyyy' ELSE 'other' END AS forma, count(*) AS n FROM ventas_colombia_raw GROUP BY 1")
def str6_date_shapes(spark, d):
    return table(spark, d, RAW).groupBy(V.date_shape(F.col("fecha")).alias("forma")).agg(F.count("*").alias("n"))


@query(r"SELECT fila_id, regexp_matches(email_cliente, '^[^@\s]+@[^@\s]+\.[^@\s]+$') AS email_valido FROM ventas_colombia_raw")
def str7_email_flag(spark, d):
    return table(spark, d, RAW).select("fila_id", V.email_valid(F.col("email_cliente")).alias("email_valido"))


@query(r"SELECT fila_id, regexp_extract(vendedor_id, '(\d+)', 1) AS vendedor FROM ventas_colombia_raw")
def str8_first_digits(spark, d):
    return table(spark, d, RAW).select("fila_id", V.first_digits(F.col("vendedor_id")).alias("vendedor"))


@query(r"SELECT CASE WHEN vendedor_id IS NULL THEN 'null' WHEN starts_with(vendedor_id, 'VEN-') THEN 'VEN-' WHEN starts_with(vendedor_id, 'v') THEN 'v' WHEN regexp_matches(vendedor_id, '^\d+$') THEN 'digits' ELSE 'other' END AS forma, count(*) AS n FROM ventas_colombia_raw GROUP BY 1")
def str9_seller_shapes(spark, d):
    return table(spark, d, RAW).groupBy(V.seller_shape(F.col("vendedor_id")).alias("forma")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, contains(lower(text), 'ventil') AS tiene FROM documents WHERE text IS NOT NULL")
def str11_keyword(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.lower("text").contains("ventil").alias("tiene"))


@query("SELECT substr(fecha, 1, 10) AS dia, count(*) AS n FROM pedidos GROUP BY 1")
def str12_day_prefix(spark, d):
    return table(spark, d, "pedidos").groupBy(V.day_of_iso(F.col("fecha")).alias("dia")).agg(F.count("*").alias("n"))


_STRF = ["%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%d/%m/%Y", "%m/%d/%Y"]
_MIXED = "CASE " + " ".join(f"WHEN o_orderkey % 5 = {k} THEN strftime(o_orderdate, '{p}')" for k, p in enumerate(_STRF)) + " END"


@query(f"SELECT o_orderkey, CAST(coalesce({', '.join(f'try_strptime(t, {chr(39)}{p}{chr(39)})' for p in _STRF)}) AS DATE) AS fecha FROM (SELECT o_orderkey, {_MIXED} AS t FROM orders)")
def dat1_mixed_dates(spark, d):
    o, t = table(spark, d, ORD), F.lit(None).cast("string")
    for k, p in enumerate(V.DATE_PATTERNS):
        t = F.when(F.col("o_orderkey") % 5 == k, F.date_format("o_orderdate", p)).otherwise(t)
    return o.select("o_orderkey", V.multi_format_date(t).alias("fecha"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS anio_mes, CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH AS DATE) AS antes FROM orders")
def dat3_months(spark, d):
    return table(spark, d, ORD).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("anio_mes"), F.add_months(F.to_date("o_orderdate"), -3).alias("antes"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)), 1)::DOUBLE AS bruto FROM lineitem")
def mth1_round_product(spark, d):
    return table(spark, d, ITEM).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_quantity").cast("decimal(18,2)") * F.col("l_extendedprice").cast("decimal(18,2)"), 1).cast("double").alias("bruto"))


@query("SELECT fila_id, TRY_CAST(total AS DOUBLE) AS total, CAST(trunc(TRY_CAST(cantidad AS DOUBLE)) AS INT) AS cantidad FROM ventas_colombia_raw")
def cst1_try_casts(spark, d):
    return table(spark, d, RAW).select("fila_id", V.number(F.col("total")).alias("total"), V.number(F.col("cantidad")).cast("int").alias("cantidad"))


@query("SELECT cliente_id, coalesce(segmento, 'ninguno') AS segmento, CASE WHEN email IS NULL THEN 'sin' ELSE 'con' END AS correo FROM clientes")
def cnd1_when_coalesce(spark, d):
    return table(spark, d, "clientes").select("cliente_id", F.coalesce("segmento", F.lit("ninguno")).alias("segmento"), F.when(F.col("email").isNull(), "sin").otherwise("con").alias("correo"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsn1_from_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("SELECT event_id, user_id FROM events")
def jsn2_round_trip(spark, d):
    coded = table(spark, d, "events").select(F.to_json(F.struct("event_id", "user_id")).cast("binary").alias("value"))
    return coded.select(F.from_json(F.col("value").cast("string"), "event_id long, user_id long").alias("x")).select("x.*")


@query(f"SELECT pedido_id, sum(i.cantidad * i.precio_unit) AS suma, count(*) AS n FROM {_ITEMS} GROUP BY 1")
def arr1_items(spark, d):
    p = table(spark, d, "pedidos").filter("size(items) > 0")
    one = p.select("pedido_id", F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i["cantidad"] * i["precio_unit"]).alias("s"), F.size("items").alias("k"))
    return one.groupBy("pedido_id").agg(F.sum("s").alias("suma"), F.sum("k").alias("n"))


@query("SELECT p.pedido_id AS pedido_id, c.nombre AS nombre FROM pedidos p LEFT JOIN clientes c ON p.cliente_id = c.cliente_id")
def map1_lookup(spark, d):
    return table(spark, d, "pedidos").join(table(spark, d, "clientes").select("cliente_id", "nombre"), "cliente_id", "left").select("pedido_id", "nombre")


@query("SELECT cliente_id, substr(sha256(concat_ws('|', cliente_id::VARCHAR, nombre)), 1, 12) AS huella FROM clientes")
def hsh1_fingerprint(spark, d):
    return table(spark, d, "clientes").select("cliente_id", V.fingerprint(F.col("cliente_id").cast("string"), F.col("nombre")).alias("huella"))


KEY_PARTITION = "coalesce(CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT) % 4, 0)::INT"


@query(f"SELECT region, {KEY_PARTITION.format('region')} AS particion, count(*) AS n FROM pedidos GROUP BY 1, 2")
def hsh2_key_partitions(spark, d):
    from lonja.sources.sinks import broker_partition

    return table(spark, d, "pedidos").groupBy("region", broker_partition(F.col("region"), 4).alias("particion")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS filas, true AS con_archivo FROM clientes")
def fil1_input_file(spark, d):
    t = table(spark, d, "clientes").select(F.col("_metadata.file_path").alias("f"))
    return t.agg(F.count("*").alias("filas"), F.min(F.col("f").contains("clientes.parquet")).alias("con_archivo"))


# -- layers --------------------------------------------------------------------------------------------------------------
@query(f"SELECT CAST(sum(n) AS BIGINT) AS filas, CAST(sum(CASE WHEN pedido_id IS NULL THEN n ELSE 0 END) AS BIGINT) AS ids_nulos, CAST(sum(CASE WHEN total IS NULL OR trim(total) = '' OR lower(total) = 'null' OR TRY_CAST(total AS DOUBLE) IS NULL THEN n ELSE 0 END) AS BIGINT) AS montos_malos, CAST(sum(n - 1) AS BIGINT) AS repetidas FROM (SELECT {_B}, count(*) AS n FROM ventas_colombia_raw GROUP BY ALL)")
def dq4_still_dirty(spark, d):
    return dirt_report(table(spark, d, RAW), "pedido_id", "total", M.BUSINESS)


_GATES = " UNION ALL ".join(f"SELECT 'nulos' AS puerta, '{c}' AS columna, count(*) FILTER ({c} IS NULL OR {c} = '') > 0.05 * count(*) AS falla FROM ventas_colombia_raw" for c in _COLS)


@query(_GATES + " UNION ALL SELECT 'positivos', 'total', count(*) FILTER (TRY_CAST(total AS DOUBLE) <= 0) > 0 FROM ventas_colombia_raw UNION ALL SELECT 'positivos', 'o_totalprice', count(*) FILTER (o_totalprice <= 0) > 0 FROM orders UNION ALL SELECT 'cardinalidad', 'o_orderpriority', count(DISTINCT o_orderpriority) > 4 FROM orders UNION ALL SELECT 'cardinalidad', 'o_orderstatus', count(DISTINCT o_orderstatus) > 4 FROM orders")
def dq1_dq3_gates(spark, d):
    """What each gate says of the raw and the clean tables."""
    raw, o = table(spark, d, RAW), table(spark, d, ORD)

    def fails(gate) -> bool:
        try:
            return gate() is False
        except ValueError:
            return True

    said = [("nulos", c, fails(lambda c=c: quality.check_critical_nulls(raw, [c]))) for c in _COLS]
    said += [("positivos", "total", fails(lambda: quality.check_positive(raw.withColumn("total", V.number(F.col("total"))), "total"))), ("positivos", "o_totalprice", fails(lambda: quality.check_positive(o, "o_totalprice")))]
    said += [("cardinalidad", c, fails(lambda c=c: quality.check_cardinality(o, c, 4) <= 4)) for c in ("o_orderpriority", "o_orderstatus")]
    return spark.createDataFrame(said, "puerta string, columna string, falla boolean")


@query("SELECT metodo_pago AS valor, count(*) AS n FROM ventas_colombia_raw GROUP BY 1")
def dq5_values(spark, d):
    """The values behind a cardinality, with their rows."""
    return quality.value_counts(table(spark, d, RAW), "metodo_pago")


def _aliases(spark, d, name: str) -> dict[str, str]:
    """Aliases of a reference list, which is small and fixed, by the names that people use."""
    ref = table(spark, d, name).select("ref_id", "nombre", F.explode(F.concat(F.array("nombre", "codigo"), F.coalesce("otros_nombres", F.array().cast("array<string>")))).alias("alias"))
    return {r["alias"]: r["nombre"] for r in ref.filter("alias is not null").orderBy(F.desc("ref_id")).collect()}


def _silver(spark, d) -> DataFrame:
    return M.to_silver(table(spark, d, RAW), _aliases(spark, d, "regiones_ref"), _aliases(spark, d, "canales_ref"))


_DAYS = ["%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%d/%m/%Y", "%m/%d/%Y"]
_SHAPES = [r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}/\d{2}/\d{2}$", r"^\d{2}-\d{2}-\d{4}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}/\d{2}/\d{4}$"]
_DATED = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(fecha, '{r}') THEN CAST(try_strptime(fecha, '{p}') AS DATE) END" for p, r in zip(_DAYS, _SHAPES)) + ")"
_REST = "region canal categoria producto cantidad precio_unit vendedor_id email_cliente email_valido metodo_pago devuelto calificacion".split()
_SILVER = f"""
WITH one AS (SELECT DISTINCT {_B} FROM ventas_colombia_raw),
typed AS (SELECT *, TRY_CAST(cantidad AS DOUBLE) AS q, TRY_CAST(precio_unit AS DOUBLE) AS p, {_DATED} AS dia, {_KEY.format("region")} AS rk, {_KEY.format("canal")} AS ck FROM one),
""" + ", ".join(f"{t}_a AS (SELECT k, arg_min(nombre, ref_id) AS nombre FROM (SELECT ref_id, nombre, {_KEY.format('a')} AS k FROM (SELECT ref_id, nombre, unnest([nombre, codigo] || coalesce(otros_nombres, [])) AS a FROM {t}) WHERE a IS NOT NULL) GROUP BY 1)" for t in ("regiones_ref", "canales_ref")) + r""",
clean AS (SELECT pedido_id, dia AS fecha, coalesce(r.nombre, 'OTRO') AS region, coalesce(c.nombre, 'otro_canal') AS canal, categoria, producto, CAST(trunc(q) AS INT) AS cantidad, p AS precio_unit, round(q * p, 2) AS total_silver,
  regexp_extract(vendedor_id, '(\d+)', 1) AS vendedor_id, email_cliente, regexp_matches(email_cliente, '^[^@\s]+@[^@\s]+\.[^@\s]+$') AS email_valido, metodo_pago, devuelto, calificacion
  FROM typed LEFT JOIN regiones_ref_a r ON rk = r.k LEFT JOIN canales_ref_a c ON ck = c.k WHERE q > 0 AND p > 0 AND pedido_id IS NOT NULL AND dia IS NOT NULL),
silver AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY pedido_id ORDER BY """ + ", ".join(f"{c} DESC NULLS LAST" for c in ["fecha", "total_silver", *_REST]) + """) = 1)
"""


@query(_SILVER + "SELECT * FROM silver")
def silver_rows(spark, d):
    return _silver(spark, d)


@query(_SILVER + f"SELECT region, fecha, round({MONEY.format('total_silver')}, 2) AS ventas_totales, count(pedido_id) AS num_pedidos, {MEAN.format('total_silver')} AS ticket_promedio, round(avg(CASE WHEN devuelto = 'True' THEN 1.0 ELSE 0.0 END), 4) AS tasa_devolucion, {MEAN.format('TRY_CAST(calificacion AS DOUBLE)')} AS calificacion_promedio FROM silver GROUP BY 1, 2")
def agg3_gold_kpis(spark, d):
    return M.sales_kpis(_silver(spark, d), ["region", "fecha"], "total_silver", "pedido_id", F.col("devuelto") == "True", V.number(F.col("calificacion")))


# -- models -------------------------------------------------------------------------------------------------------------
@query("SELECT p.pedido_id AS pedido_id, p.fecha AS fecha, c.nombre AS cliente, u.pos AS pos, u.i.producto_id AS producto_id, pr.nombre AS nombre, u.i.precio_unit AS precio_unit FROM (SELECT DISTINCT * FROM pedidos WHERE pedido_id IS NOT NULL) p LEFT JOIN clientes c ON p.cliente_id = c.cliente_id, LATERAL (SELECT unnest(p.items) AS i, unnest(range(1, len(p.items) + 1)) AS pos) u LEFT JOIN productos pr ON u.i.producto_id = pr.producto_id")
def q1_full_order(spark, d):
    p = table(spark, d, "pedidos").filter("pedido_id is not null")
    docs = models.full_orders(p, table(spark, d, "clientes"), table(spark, d, "productos"))
    return docs.select("pedido_id", "fecha", F.col("cliente.cliente").alias("cliente"), F.posexplode("items").alias("k", "i")).select("pedido_id", "fecha", "cliente", (F.col("k") + 1).cast("long").alias("pos"), "i.producto_id", "i.nombre", "i.precio_unit")


_DAY = "(SELECT min(substr(fecha, 1, 10)) FROM pedidos WHERE region = 'Bogotá')"


@query(f"WITH h AS (SELECT * FROM pedidos WHERE region = 'Bogotá' AND substr(fecha, 1, 10) = {_DAY}) SELECT (SELECT count(*) FROM h) AS n, (SELECT coalesce(sum(total), 0) FROM h)::BIGINT AS total, (SELECT string_agg(pedido_id::VARCHAR, ',' ORDER BY fecha DESC, pedido_id DESC) FROM (SELECT * FROM h ORDER BY fecha DESC, pedido_id DESC LIMIT 5)) AS ultimos")
def q2a_region_day(spark, d):
    p = table(spark, d, "pedidos")
    day = p.filter("region = 'Bogotá'").agg(F.min(V.day_of_iso(F.col("fecha")))).first()[0]
    return models.region_day(p, "Bogotá", day or "").select("n", "total", F.concat_ws(",", F.transform("ultimos", lambda x: x.cast("string"))).alias("ultimos"))


@query(f"SELECT pedido_id, fecha, total FROM pedidos WHERE cliente_id = {_CLIENT} ORDER BY fecha DESC, pedido_id DESC LIMIT 10")
def q2b_latest_orders(spark, d):
    return models.latest_orders(table(spark, d, "pedidos"), _first_client(spark, d))


@query(f"SELECT producto_id, unidades FROM ({ORACLE_SQL['agg12_units_by_product']}) ORDER BY unidades DESC, producto_id LIMIT 10")
def q3_top_products(spark, d):
    return models.units_by_product(table(spark, d, "pedidos")).orderBy(F.desc("unidades"), "producto_id").limit(10)


@query(_E + " SELECT producto_id, count(DISTINCT cliente_id) AS vecinos FROM e WHERE cliente_id IN (SELECT cliente_id FROM near) AND producto_id NOT IN (SELECT producto_id FROM own) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def q4_recommendations(spark, d):
    return models.recommendations(models.edges(table(spark, d, "pedidos")), _first_client(spark, d))


@query("WITH k AS (SELECT *, nullif(lower(regexp_replace(pedido_id, '[^0-9A-Fa-f]', '', 'g')), '') AS k FROM pedidos_ventas) SELECT producto, sum(cantidad)::BIGINT AS unidades FROM (SELECT * FROM k WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY entrega_id) = 1) GROUP BY 1")
def q5_stream_once(spark, d):
    """Units by product, each delivered order counted once."""
    from lonja.operators.redelivery import kept_deliveries, message_key

    known = table(spark, d, "pedidos_ventas").filter(message_key(F.col("pedido_id")).isNotNull())
    return kept_deliveries(known, "entrega_id", "pedido_id", "kafka_time").groupBy("producto").agg(F.sum("cantidad").cast("long").alias("unidades"))


@query(f"SELECT (SELECT count(DISTINCT cliente_id) FROM clientes) AS clientes, (SELECT count(*) FROM productos) AS productos, (SELECT count(*) FROM ({ORACLE_SQL['agg13_edges']})) AS aristas")
def graph_counts(spark, d):
    e = models.edges(table(spark, d, "pedidos")).agg(F.count("*").alias("aristas"))
    c, p = table(spark, d, "clientes").agg(F.count_distinct("cliente_id").alias("clientes")), table(spark, d, "productos").agg(F.count("*").alias("productos"))
    return c.crossJoin(p).crossJoin(e)  # one row each
