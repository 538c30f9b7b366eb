"""Seeded generators of sales tables: every value is a hash of the seed, the row and the column, so that any number of rows is
made in parallel and comes out the same again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The regions and their weights, categories and channels of the sales domain.
REGIONS = {"Bogotá": 0.40, "Medellín": 0.20, "Cali": 0.15, "Barranquilla": 0.10, "Otras": 0.15}
CATEGORIES = ["Electrónica", "Hogar", "Ropa", "Deportes", "Libros"]
CHANNELS = ["online", "tienda"]


def uniform(seed: int, column: str, row: Column | None = None) -> Column:
    """A number in [0, 1) for each row."""
    h = F.xxhash64(F.lit(seed), F.lit(column), F.col("id") if row is None else row)
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def pick(values: list, x: Column, weights: list[float] | None = None) -> Column:
    total, out = 0.0, F.lit(values[-1])
    for v, w in reversed(list(zip(values, weights or [1 / len(values)] * len(values)))[:-1]):
        total = sum((weights or [1 / len(values)] * len(values))[: values.index(v) + 1])
        out = F.when(x < total, F.lit(v)).otherwise(out)
    return out


def whole(low: int, high: int, x: Column) -> Column:
    return (F.floor(x * (high - low + 1)) + low).cast("int")


def clean_sales(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n sales with typed columns over one year; total = cantidad x precio_unit."""
    u = lambda c: uniform(seed, c)
    rows = spark.range(n).select(
        F.format_string("ORD-%06d", F.col("id") + 1).alias("order_id"), F.date_format(F.date_add(F.lit("2025-08-01").cast("date"), whole(0, 364, u("fecha"))), "yyyy-MM-dd").alias("fecha"),
        pick(list(REGIONS), u("region"), list(REGIONS.values())).alias("region"), F.concat(F.lit("Producto "), whole(1, 50, u("producto"))).alias("producto"), pick(CATEGORIES, u("categoria")).alias("categoria"),
        whole(1, 5, u("cantidad")).alias("cantidad"), whole(5_000, 900_000, u("precio")).cast("double").alias("precio_unit"), pick(CHANNELS, u("canal")).alias("canal"), (u("devuelto") < 0.06).alias("devuelto"),
    )
    return rows.withColumn("total", F.col("cantidad") * F.col("precio_unit"))


def dirty_sales(spark: SparkSession, n: int, seed: int = 42, repeated: float = 0.015) -> DataFrame:
    """n raw sales as strings with the usual defects, and a share of them again as exact copies."""
    u = lambda c: uniform(seed, c, F.col("order_id"))
    c = clean_sales(spark, n, seed)
    day = F.to_date("fecha")
    form = [F.date_format(day, p) for p in ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy")]
    total = F.when(u("t0") < 0.025, None).when(u("t0") < 0.039, -F.col("total")).when(u("t0") < 0.047, F.col("total") * 1000).otherwise(F.col("total"))
    seller = F.lpad(whole(1, 120, u("v1")).cast("string"), 4, "0")
    mail = F.concat(F.lit("cliente"), whole(1, 9999, u("m1")).cast("string"))
    out = c.select(
        F.when(u("i") >= 0.002, F.col("order_id")).alias("pedido_id"), F.element_at(F.array(*form), whole(1, 5, u("f"))).alias("fecha"), "categoria", "producto",
        F.when(u("q") < 0.006, -F.col("cantidad")).otherwise(F.col("cantidad")).cast("string").alias("cantidad"), F.when(u("p") < 0.0063, -F.col("precio_unit")).otherwise(F.col("precio_unit")).cast("string").alias("precio_unit"),
        total.cast("string").alias("total"), F.when(u("m0") < 0.0014, None).when(u("m0") < 0.013, mail).otherwise(F.concat(mail, F.lit("@correo.test"))).alias("email_cliente"),
        pick(["tarjeta crédito", "transferencia", "efectivo"], u("pago")).alias("metodo_pago"), F.initcap(F.col("devuelto").cast("string")).alias("devuelto"), F.when(u("c0") >= 0.1, whole(1, 5, u("c")).cast("string")).alias("calificacion"),
        F.element_at(F.array("region", F.upper("region"), F.lower("region"), F.concat(F.lit(" "), "region")), whole(1, 4, u("r"))).alias("region"), F.element_at(F.array("canal", F.upper("canal")), whole(1, 2, u("k"))).alias("canal"),
        F.when(u("v0") < 0.276, F.concat(F.lit("VEN-"), seller)).when(u("v0") < 0.314, F.concat(F.lit("v"), seller)).otherwise(seller).alias("vendedor_id"), u("d").alias("__copy"),
    )
    return out.unionAll(out.filter(F.col("__copy") < repeated)).drop("__copy")


def order_stream(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n keyed messages with the six fields of a put: the key is the region."""
    u = lambda c: uniform(seed, c)
    payload = F.struct(
        F.substring(F.md5(F.concat_ws(":", F.lit(seed), "id")), 1, 32).alias("pedido_id"), pick(list(REGIONS), u("region"), list(REGIONS.values())).alias("region"), pick(CATEGORIES, u("categoria")).alias("categoria"),
        F.round(u("total") * 2_485_000 + 15_000, 2).alias("total"), F.date_format(F.timestamp_seconds(F.lit(1_767_225_600) + F.col("id")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), (u("devuelto") < 0.07).alias("devuelto"),
    )
    return spark.range(n).select(payload["region"].alias("key"), F.to_json(payload).cast("binary").alias("data"), "id")
