"""Gates of data quality: each reads its input in one aggregate pass and raises or warns."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: rows and nulls (or empty strings)."""
    counts = [F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns]
    one = df.agg(F.count("*").alias("__rows"), *counts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), F.col("__rows").alias("filas"), F.col(c).alias("nulos")) for c in columns])).alias("r")).select("r.*")


def check_critical_nulls(df: DataFrame, columns: list[str], most: float = 0.05) -> None:
    """A column with a greater share of nulls than ``most`` is an error; an empty table is fine."""
    for r in null_report(df, columns).collect():
        if r["filas"] and r["nulos"] / r["filas"] > most:
            raise ValueError(f"column {r['columna']}: {100 * r['nulos'] / r['filas']:.1f} % nulls, more than {100 * most:g} %")


def check_positive(df: DataFrame, column: str) -> None:
    """Any value of 0 or less is an error; nulls aren't counted."""
    n = df.agg(F.count_if(F.col(column) <= 0)).first()[0]
    if n:
        raise ValueError(f"{n} rows with {column} of 0 or less")


def check_cardinality(df: DataFrame, column: str, most: int) -> int:
    """More distinct values than ``most`` is a warning only, which shows the commonest of them."""
    n = df.agg(F.count_distinct(column)).first()[0]
    if n > most:
        shown = [r["valor"] for r in value_counts(df, column).orderBy(F.desc("n"), "valor").limit(20).collect()]
        log.warning("%s has %d values, more than %d: %s", column, n, most, shown)
    return n


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("valor")).agg(F.count("*").alias("n"))


def dirt_report(df: DataFrame, id_col: str, amount_col: str, business: list[str]) -> DataFrame:
    """Nulls and repeated rows that a raw layer must still hold, in one row."""
    amount = F.col(amount_col)
    bad = amount.isNull() | (F.trim(amount) == "") | (F.lower(amount) == "null") | amount.try_cast("double").isNull()
    per_row = df.groupBy(*business).agg(F.count("*").alias("n"))
    return per_row.agg(F.sum("n").alias("filas"), F.sum(F.when(F.col(id_col).isNull(), F.col("n")).otherwise(0)).alias("ids_nulos"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("montos_malos"), F.sum(F.col("n") - 1).alias("repetidas"))


def assert_still_dirty(df: DataFrame, id_col: str, amount_col: str, business: list[str]) -> None:
    r = dirt_report(df, id_col, amount_col, business).first()
    for what in ("ids_nulos", "montos_malos", "repetidas"):
        if not r[what]:
            raise AssertionError(f"the raw layer was cleaned: {what} is 0")
