"""Document, wide-column, key-value and graph queries over orders with nested items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def full_orders(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Each order row as one document: customer and items in their order, at the price that was paid. Rows that share an
    id stay apart; equal rows are one."""
    rows = orders.distinct().withColumn("__row", F.sha2(F.to_json(F.struct(*orders.columns)), 256))
    items = rows.select("__row", F.posexplode("items").alias("pos", "i"))
    named = items.join(products.select("producto_id", "nombre"), items["i.producto_id"] == products["producto_id"], "left")
    lists = named.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("i.producto_id").alias("producto_id"), F.col("nombre"), F.col("i.cantidad").alias("cantidad"), F.col("i.precio_unit").alias("precio_unit")))).alias("l"))
    who = customers.select(F.col("cliente_id"), F.col("nombre").alias("cliente"))
    return rows.drop("items").join(lists, "__row", "left").join(who, "cliente_id", "left").select(
        "pedido_id", "fecha", "region", F.struct("cliente_id", "cliente").alias("cliente"), F.transform("l", lambda x: x.dropFields("pos")).alias("items"), "total")


def load_models(orders: DataFrame, customers: DataFrame, products: DataFrame, path: str) -> dict[str, str]:
    """Writes the derived tables of all four models anew and returns their folders: order documents, sales by region and day
    and orders by customer (each row once, in the order they are read in), a sorted set of units, and purchase edges."""
    rows = orders.filter("pedido_id is not null").distinct()
    made = {
        "documentos": full_orders(rows, customers, products),
        "region_dia": rows.select("region", F.substring("fecha", 1, 10).alias("dia"), "fecha", "pedido_id", "total").repartition("region", "dia").sortWithinPartitions("region", "dia", F.desc("fecha"), F.desc("pedido_id")),
        "por_cliente": rows.select("cliente_id", "fecha", "pedido_id", "total").filter("cliente_id is not null").repartition("cliente_id").sortWithinPartitions("cliente_id", F.desc("fecha"), F.desc("pedido_id")),
        "ranking": units_by_product(rows), "compras": edges(rows),
    }
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return {name: f"{path}/{name}" for name in made}


def region_day(orders: DataFrame, region: str, day: str, last: int = 5) -> DataFrame:
    """Orders, their sum and the latest ids of a region on a day, in one row."""
    hit = orders.filter((F.col("region") == region) & F.col("fecha").startswith(day))
    top = hit.orderBy(F.desc("fecha"), F.desc("pedido_id")).limit(last).agg(F.sort_array(F.collect_list(F.struct("fecha", "pedido_id")), False).alias("l"))
    return hit.agg(F.count("*").alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).crossJoin(top.select(F.transform("l", lambda x: x["pedido_id"]).alias("ultimos")))  # one row each


def latest_orders(orders: DataFrame, customer: int, last: int = 10) -> DataFrame:
    return orders.filter(F.col("cliente_id") == customer).orderBy(F.desc("fecha"), F.desc("pedido_id")).limit(last).select("pedido_id", "fecha", "total")


def edges(orders: DataFrame) -> DataFrame:
    """(customer)-[bought units]->(product)."""
    i = orders.select("cliente_id", F.explode("items").alias("i")).filter(F.col("cliente_id").isNotNull())
    return i.groupBy("cliente_id", F.col("i.producto_id").alias("producto_id")).agg(F.sum("i.cantidad").alias("unidades"))


def units_by_product(orders: DataFrame) -> DataFrame:
    return orders.select(F.explode("items").alias("i")).groupBy(F.col("i.producto_id").alias("producto_id")).agg(F.sum("i.cantidad").alias("unidades"))


def recommendations(edge: DataFrame, customer: int, top: int = 5) -> DataFrame:
    """Products that customers with a common product bought and this one didn't, by the number of such customers."""
    pairs = edge.select("cliente_id", "producto_id")
    own = pairs.filter(F.col("cliente_id") == customer).select("producto_id")
    others = pairs.filter(F.col("cliente_id") != customer)
    near = others.join(own, "producto_id", "left_semi").select("cliente_id").distinct()
    new = others.join(near, "cliente_id", "left_semi").join(own, "producto_id", "left_anti")
    return new.groupBy("producto_id").agg(F.count_distinct("cliente_id").alias("vecinos")).orderBy(F.desc("vecinos"), "producto_id").limit(top)


def hops(edge: DataFrame, customer: int, steps: int) -> DataFrame:
    """Distinct vertices met after a number of steps from a customer; each step keeps distinct vertices only."""
    pairs = edge.select("cliente_id", "producto_id")
    at, here = pairs.sparkSession.createDataFrame([(customer,)], "cliente_id long"), "cliente_id"
    for _ in range(steps):
        there = "producto_id" if here == "cliente_id" else "cliente_id"
        at, here = pairs.join(at, here, "left_semi").select(there).distinct(), there
    return at.withColumnRenamed(here, "vertice")


def accumulate_scores(scores: DataFrame, changes: DataFrame, member: str, score: str) -> DataFrame:
    """A sorted set's increments: known members add up, new ones enter."""
    return scores.select(member, score).unionByName(changes.select(member, score)).groupBy(member).agg(F.sum(score).alias(score))


def sample_keys(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The same n keys for the same seed, whatever the partitions."""
    return df.select(key).distinct().orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
