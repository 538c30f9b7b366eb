"""Raw rows to Bronze, Silver and Gold as pure functions of data frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions.values import email_valid, first_digits, map_aliases, multi_format_date, number

BUSINESS = "pedido_id fecha categoria producto cantidad precio_unit total email_cliente metodo_pago devuelto calificacion region canal vendedor_id".split()


def to_bronze(raw: DataFrame) -> DataFrame:
    """Unchanged strings with the time of loading and the file."""
    return raw.select(*BUSINESS, F.current_timestamp().alias("_ingested_at"), F.col("_metadata.file_path").alias("_source_file"))


def to_silver(bronze: DataFrame, regions: dict[str, str], channels: dict[str, str]) -> DataFrame:
    """Typed rows with unique non-null keys: repeated business rows are one, rows without a readable date, a positive
    quantity and price or an id are dropped, regions and channels are mapped by their aliases (else OTRO and otro_canal), the
    total is recomputed, and of several rows of one order the greatest by (fecha, total) stays."""
    one = bronze.dropDuplicates(BUSINESS).withColumns({"q": number(F.col("cantidad")), "p": number(F.col("precio_unit")), "dia": multi_format_date(F.col("fecha"))})
    one = one.filter((F.col("q") > 0) & (F.col("p") > 0) & F.col("pedido_id").isNotNull() & F.col("dia").isNotNull())
    one = map_aliases(map_aliases(one, "region", regions, "OTRO", "zona"), "canal", channels, "otro_canal", "via")
    typed = one.select(
        "pedido_id", F.col("dia").alias("fecha"), F.col("zona").alias("region"), F.col("via").alias("canal"), "categoria", "producto", F.col("q").cast("int").alias("cantidad"), F.col("p").alias("precio_unit"),
        F.round(F.col("q") * F.col("p"), 2).alias("total_silver"), first_digits(F.col("vendedor_id")).alias("vendedor_id"), "email_cliente", email_valid(F.col("email_cliente")).alias("email_valido"),
        "metodo_pago", "devuelto", "calificacion",
    )
    rest = F.struct(F.col("fecha"), F.col("total_silver"), *[F.col(c) for c in typed.columns if c not in ("pedido_id", "fecha", "total_silver")])
    return typed.groupBy("pedido_id").agg(F.max(rest).alias("r")).select("pedido_id", *[F.col(f"r.{c}").alias(c) for c in typed.columns if c != "pedido_id"])


def _mean(c: Column) -> Column:
    """The mean to two decimals, in decimals: ties go up."""
    exact = c.cast("decimal(18,2)")
    return F.round(F.sum(exact) / F.count(exact), 2).cast("double")


def sales_kpis(df: DataFrame, keys: list[str], amount: str, key: str, returned: Column, rating: Column | None = None) -> DataFrame:
    """Sums, order counts, average tickets and return rates by any keys, and average ratings where there are some."""
    money = F.sum(F.col(amount).cast("decimal(18,2)")).cast("double")
    out = [F.round(money, 2).alias("ventas_totales"), F.count(key).alias("num_pedidos"), _mean(F.col(amount)).alias("ticket_promedio"), F.round(F.avg(F.when(returned, 1.0).otherwise(0.0)), 4).alias("tasa_devolucion")]
    if rating is not None:
        out.append(_mean(rating).alias("calificacion_promedio"))
    return df.groupBy(*keys).agg(*out)


def top_by_group(df: DataFrame, group: str, item: str, amount: str, k: int) -> DataFrame:
    """Items of rank k or better in each group by sales; ties share a rank."""
    sums = df.groupBy(group, item).agg(F.round(F.sum(F.col(amount).cast("decimal(18,2)")).cast("double"), 2).alias("ventas"))
    w = Window.partitionBy(group).orderBy(F.desc("ventas"))
    return sums.withColumn("r", F.rank().over(w)).filter(F.col("r") <= k).drop("r")
