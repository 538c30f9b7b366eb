"""Queries of the general data problems (1, 4, 5, 6) over the tables of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.operators.late_events import late_corrected_sums
from lonja.operators.profiling import CHANCE, DEPARTURE, HEAVY_SHARE, PATTERNS, RARE_SHARE, RARE_STEP, SHIFT, departing_loads, profile_loads, shifted_loads
from lonja.operators.redelivery import kept_deliveries, message_key, repeated_deliveries
from lonja.operators.timestamps import normalise_timestamps
from lonja.session import table

PROFILED = {"total": "numeric", "cantidad": "numeric", "email_cliente": "email", "vendedor_id": "seller"}


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    # origenes has one row for each system that sends raw sales: a fixed list.
    raw = table(spark, sf_dir, "ventas_colombia_raw").select("fila_id", "fecha", "origen_id")
    rows = raw.join(F.broadcast(table(spark, sf_dir, "origenes")), "origen_id", "left")
    return normalise_timestamps(rows, "fila_id", "fecha", "zona_horaria", "orden_fecha")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instants(spark, sf_dir).filter("status = 'ok'").select("fila_id", F.col("instant_us").alias("instante_us"))


def p1_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instants(spark, sf_dir).groupBy("status").agg(F.count("*").alias("filas"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return departing_loads(table(spark, sf_dir, "ventas_colombia_raw"), "carga_id", list(PROFILED)).select("carga_id", "columna")


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_loads(table(spark, sf_dir, "ventas_colombia_raw"), "carga_id", PROFILED).withColumn("ks", F.round("ks", 9))


def p4_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads whose values of a column are distributed otherwise than all others, nulls and odd forms aside."""
    return shifted_loads(table(spark, sf_dir, "ventas_colombia_raw"), "carga_id", PROFILED).withColumn("ks", F.round("ks", 9))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_deliveries(table(spark, sf_dir, "pedidos_ventas"), "entrega_id", "pedido_id", "kafka_time").select("entrega_id")


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_deliveries(table(spark, sf_dir, "pedidos_ventas"), "entrega_id", "pedido_id", "kafka_time").select("entrega_id", "pedido_id")


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "pedidos_ventas").filter(message_key(F.col("pedido_id")).isNotNull())
    kept = kept_deliveries(orders, "entrega_id", "pedido_id", "kafka_time")
    return late_corrected_sums(kept, "fecha", "kafka_time", "region", "total", "_kafka_partition", "lote_id").withColumnRenamed("grupo", "region")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(spark, sf_dir).filter("n_tarde > 0").select("periodo", "region")


def p6_hourly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _hourly(spark, sf_dir)
    return out.select("periodo", "region", F.round("suma_inicial", 2).alias("suma_inicial"), "n_inicial", F.round("suma", 2).alias("suma"), "n", "n_tarde", "n_fuera")


QUERIES = {f.__name__: f for f in (p1_found, p1_status, p4_found, p4_profile, p4_shifts, p5_found, p5_kept, p6_found, p6_hourly_sales)}

_KEY = "nullif(lower(regexp_replace(pedido_id, '[^0-9A-Fa-f]', '', 'g')), '')"
_HOURS = f"""
WITH keyed AS (SELECT *, {_KEY} AS k FROM pedidos_ventas),
kept AS (SELECT * FROM keyed WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY entrega_id) = 1),
parts AS (
  SELECT region, total, epoch_us(kafka_time) AS arrived,
    epoch_us(CAST(substr(fecha, 1, 23) AS TIMESTAMP)) - CASE WHEN right(fecha, 1) = 'Z' THEN 0 ELSE
      CASE WHEN substr(fecha, 24, 1) = '-' THEN -1 ELSE 1 END * (CAST(substr(fecha, 25, 2) AS BIGINT) * 3600 + CAST(substr(fecha, 28, 2) AS BIGINT) * 60) * 1000000 END AS at_us
  FROM kept WHERE fecha IS NOT NULL AND region IS NOT NULL AND kafka_time IS NOT NULL),
timed AS (SELECT region, coalesce(total, 0) AS total, at_us // 3600000000 AS p, arrived - (at_us // 3600000000 + 1) * 3600000000 AS delay FROM parts),
hours AS (
  SELECT p, region, sum(CASE WHEN delay <= 600000000 THEN total ELSE 0 END) AS suma_inicial, count(*) FILTER (delay <= 600000000) AS n_inicial,
    sum(CASE WHEN delay <= 86400000000 THEN total ELSE 0 END) AS suma, count(*) FILTER (delay <= 86400000000) AS n,
    count(*) FILTER (delay > 600000000 AND delay <= 86400000000) AS n_tarde, count(*) FILTER (delay > 86400000000) AS n_fuera
  FROM timed GROUP BY p, region),
named AS (SELECT strftime(make_timestamp(p * 3600000000), '%Y-%m-%dT%H:%M:%SZ') AS periodo, * FROM hours)
"""

_NUMERIC = ", ".join(f"'{c}'" for c, k in PROFILED.items() if k == "numeric")
_CURVES = "WITH u AS (" + " UNION ALL ".join(f"SELECT carga_id, '{c}' AS columna, {c} AS valor, '{PATTERNS[k]}' AS patron FROM ventas_colombia_raw" for c, k in PROFILED.items()) + f"""),
v AS (SELECT *, valor IS NULL OR trim(valor) = '' AS blanco, CASE WHEN columna IN ({_NUMERIC}) THEN TRY_CAST(valor AS DOUBLE) END AS x FROM u),
c AS (SELECT carga_id, columna, x, CASE WHEN x IS NULL THEN valor END AS s, count(*) AS n FROM v WHERE CASE WHEN columna IN ({_NUMERIC}) THEN x IS NOT NULL AND NOT isnan(x) ELSE NOT blanco END GROUP BY ALL),
g AS (SELECT l.carga_id, p.*, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT columna, x, s FROM c) p JOIN (SELECT DISTINCT carga_id, columna FROM c) l USING (columna) LEFT JOIN c ON c.columna = p.columna AND c.carga_id = l.carga_id AND c.x IS NOT DISTINCT FROM p.x AND c.s IS NOT DISTINCT FROM p.s),
a AS (SELECT columna, x, s, sum(n) OVER (PARTITION BY columna ORDER BY x, s) AS k, sum(n) OVER (PARTITION BY columna) AS t FROM (SELECT columna, x, s, sum(n) AS n FROM c GROUP BY ALL)),
f AS (SELECT g.carga_id, g.columna, sum(g.n) OVER w AS k, sum(g.n) OVER (PARTITION BY g.columna, g.carga_id) AS t, a.k AS ka, a.t AS ta FROM g JOIN a ON a.columna = g.columna AND a.x IS NOT DISTINCT FROM g.x AND a.s IS NOT DISTINCT FROM g.s WINDOW w AS (PARTITION BY g.columna, g.carga_id ORDER BY g.x, g.s)),
d AS (SELECT carga_id, columna, max(CASE WHEN ta > t THEN abs(k / t - (ka - k) / (ta - t)) ELSE 0 END) AS ks, max(t) AS valores, max(ta - t) AS otros FROM f GROUP BY 1, 2)
"""

_RARE = "WITH u AS (" + " UNION ALL ".join(f"SELECT carga_id, '{c}' AS columna, CASE WHEN trim({c}) <> '' THEN {c} END AS valor FROM ventas_colombia_raw WHERE carga_id IS NOT NULL" for c in PROFILED) + fr"""),
c AS (SELECT columna, carga_id, valor, count(*) AS n FROM u GROUP BY ALL),
z AS (SELECT columna, carga_id, sum(n) AS filas FROM c GROUP BY ALL),
h AS (SELECT DISTINCT columna, valor, true AS propio FROM c JOIN z USING (columna, carga_id) WHERE valor IS NOT NULL AND n >= 3 AND n >= {HEAVY_SHARE} * filas),
k AS (SELECT columna, carga_id, CASE WHEN valor IS NULL THEN 'nulo' WHEN propio THEN 'valor:' || valor ELSE 'forma:' || substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(valor, '\p{{Nd}}', '9', 'g'), '\p{{Lu}}+', 'A', 'g'), '\p{{Ll}}+', 'a', 'g'), '\s+', ' ', 'g'), 1, 64) END AS cat, sum(n) AS n FROM c LEFT JOIN h USING (columna, valor) GROUP BY ALL),
t AS (SELECT columna, count(*) AS cargas FROM z GROUP BY 1),
b AS (SELECT columna, cat, n / filas AS rareza FROM k JOIN z USING (columna, carga_id) JOIN t USING (columna) QUALIFY row_number() OVER (PARTITION BY columna, cat ORDER BY n / filas DESC) = cargas // 2 + 1),
r AS (SELECT columna, carga_id, round(coalesce(rareza, 0) / {RARE_STEP}) * {RARE_STEP} AS rareza, sum(n) AS n FROM k LEFT JOIN b USING (columna, cat) GROUP BY ALL),
g AS (SELECT p.columna, p.rareza, z.carga_id, z.filas, coalesce(sum(r.n), 0) AS acum FROM (SELECT DISTINCT columna, rareza FROM r WHERE rareza <= {RARE_SHARE}) p JOIN z USING (columna) LEFT JOIN r ON r.columna = p.columna AND r.carga_id = z.carga_id AND r.rareza <= p.rareza GROUP BY ALL),
o AS (SELECT a.columna, a.rareza, a.carga_id, any_value(a.acum / a.filas) AS p, any_value(a.filas) AS filas, median(d.acum / d.filas) AS q, sum(d.acum) / sum(d.filas) AS resto FROM g a JOIN g d ON a.columna = d.columna AND a.rareza = d.rareza AND a.carga_id <> d.carga_id GROUP BY ALL)
SELECT DISTINCT carga_id, columna FROM o WHERE p >= {DEPARTURE} AND p - q > 4 * sqrt(greatest(resto * (1 - resto), 0.01) / filas) AND (p - q >= {DEPARTURE} OR p > 2 * q)
"""

ORACLE_SQL = {
    "p4_found": _RARE,
    "p4_profile": _CURVES + """, q AS (SELECT carga_id, columna, min(x) AS minimo, quantile_disc(x, 0.25) AS q25, quantile_disc(x, 0.5) AS mediana, quantile_disc(x, 0.75) AS q75, max(x) AS maximo FROM v WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY 1, 2)
SELECT v.carga_id, v.columna, count(*) AS filas, count(*) FILTER (blanco) AS nulos, count(DISTINCT CASE WHEN NOT blanco THEN valor END) AS distintos, count(*) FILTER (NOT blanco AND NOT regexp_matches(valor, patron)) AS violaciones,
  any_value(q.minimo) AS minimo, any_value(q25) AS q25, any_value(mediana) AS mediana, any_value(q75) AS q75, any_value(q.maximo) AS maximo,
  min(CASE WHEN NOT blanco AND v.columna NOT IN (""" + _NUMERIC + """) THEN valor END) AS minimo_texto, max(CASE WHEN NOT blanco AND v.columna NOT IN (""" + _NUMERIC + """) THEN valor END) AS maximo_texto, any_value(round(ks, 9)) AS ks
FROM v LEFT JOIN d ON d.carga_id = v.carga_id AND d.columna = v.columna LEFT JOIN q ON q.carga_id = v.carga_id AND q.columna = v.columna GROUP BY v.carga_id, v.columna""",
    "p4_shifts": _CURVES + f"SELECT carga_id, columna, round(ks, 9) AS ks FROM d WHERE otros > 0 AND ks >= {SHIFT} AND ks > sqrt(ln(2 / {CHANCE}) / 2 * (1 / valores + 1 / otros))",
    "p5_found": f"SELECT entrega_id FROM (SELECT entrega_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY entrega_id) AS r FROM pedidos_ventas WHERE {_KEY} IS NOT NULL) WHERE r > 1",
    "p5_kept": f"SELECT entrega_id, pedido_id FROM (SELECT entrega_id, pedido_id, {_KEY} AS k, row_number() OVER (PARTITION BY {_KEY} ORDER BY entrega_id) AS r FROM pedidos_ventas) WHERE k IS NULL OR r = 1",
    "p6_found": _HOURS + "SELECT periodo, region FROM named WHERE n_tarde > 0",
    "p6_hourly_sales": _HOURS + "SELECT periodo, region, round(suma_inicial, 2) AS suma_inicial, n_inicial, round(suma, 2) AS suma, n, n_tarde, n_fuera FROM named",
}
