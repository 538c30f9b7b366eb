"""Queries of the text problems (2, 3, 7, 8, 9) over the tables of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.llm.canonical import map_to_reference
from lonja.llm.leakage import leaked_items
from lonja.llm.mixture import count_tokens, mix_sources
from lonja.llm.mojibake import corpus_model, restore_texts
from lonja.llm.stuffing import stuffed_documents
from lonja.session import reliable_checkpoint, table

TYPED = ["region", "canal"]


def _reference_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """Names of the two canonical lists, which are small and fixed."""
    names = []
    for t, more in (("regiones_ref", ["departamento"]), ("canales_ref", [])):
        df = table(spark, sf_dir, t)
        cols = [F.array(*[F.col(c) for c in ["nombre", *more]]), F.col("otros_nombres")]
        names += [r["n"] for r in df.select(F.explode(F.flatten(F.array(*cols))).alias("n")).distinct().collect() if r["n"]]
    return sorted(names)


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct values of the typed columns and their rows, read several times below."""
    raw = table(spark, sf_dir, "ventas_colombia_raw")
    pairs = raw.select(F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).alias("valor")) for c in TYPED])).alias("v"))
    return reliable_checkpoint(pairs.filter("v.valor is not null").groupBy("v.campo", "v.valor").agg(F.count("*").alias("n")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = corpus_model(_values(spark, sf_dir), "valor", _reference_names(spark, sf_dir), "n")
    return restore_texts(table(spark, sf_dir, "ventas_colombia_raw"), "fila_id", TYPED, model).select("fila_id", "campo", "original")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, values = table(spark, sf_dir, "ventas_colombia_raw"), _values(spark, sf_dir)
    model = corpus_model(values, "valor", _reference_names(spark, sf_dir), "n")
    out = [map_to_reference(raw, "fila_id", c, table(spark, sf_dir, ref), places, model, values=values.filter(F.col("campo") == c).select("valor", "n")) for c, ref, places in (("region", "regiones_ref", ["departamento"]), ("canal", "canales_ref", []))]
    return out[0].unionAll(out[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("fila_id", "campo", "ref_id")


def p3_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of what met no entry."""
    return _mapped(spark, sf_dir).filter("ref_id = 0").groupBy("campo", "valor").agg(F.count("*").alias("filas"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "evaluacion_items"), "item_id", "text", question="pregunta")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items leaked, into how many documents, into how many with their question, and the longest stretch."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documentos"), F.count_if(F.col("pregunta") >= 0.8).alias("con_pregunta"), F.max("palabras").alias("palabras"))


LEAF = ["dominio", "idioma", "source"]


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All documents are patents: one domain; then language (as natural in each source) and source.
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    docs = table(spark, sf_dir, "documents").filter("source is not null").select(
        "doc_id", "text", F.lit("patentes").alias("dominio"), F.when(lang.isin("en", "es", "de"), lang).otherwise("otra").alias("idioma"), "source",
    )
    # Counted once: the sizes are needed for the budget and for the selection.
    return reliable_checkpoint(count_tokens(docs, "text", "tokens").drop("text"))


def _goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mezcla_objetivo").select("source", F.col("peso_objetivo").alias("peso"), "max_repeticiones")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(_sized(spark, sf_dir), "doc_id", "tokens", LEAF, _goal(spark, sf_dir), seed=20260101)


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0].select("doc_id", "source", "tokens", "copias")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p8_shortage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of nine tenths of all that the sources may give, at which some run out and others take over: what must hold, in one row."""
    sized, goal = _sized(spark, sf_dir), _goal(spark, sf_dir)
    supply = sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).join(goal, "source").select("source", "peso", "max_repeticiones", (F.col("tokens") * F.col("max_repeticiones")).alias("tope"))
    budget = 0.9 * (supply.agg(F.sum("tope")).first()[0] or 0)
    chosen = mix_sources(sized, "doc_id", "tokens", LEAF, goal, seed=20260101, budget=budget)[0]
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copias")).alias("usados"), F.max("copias").alias("mas"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("distintos"))
    by = supply.join(used, "source", "left").select("*", F.coalesce("usados", F.lit(0)).alias("u"))
    one = lambda c: F.coalesce(c, F.lit(0))
    return by.agg(
        one(F.count_if(F.col("u") > F.col("tope"))).alias("sobre_tope"), one(F.count_if(F.col("mas") > F.col("max_repeticiones"))).alias("repetidas_de_mas"), one(F.count_if(F.col("n") > F.col("distintos"))).alias("documentos_dobles"),
        (F.abs(F.sum("u") - budget) <= 0.001 * budget).alias("presupuesto"),
        # Whoever gives less than its share has run out; some have, and others give more.
        one(F.count_if((F.col("u") < 0.99 * F.col("peso") * budget) & (F.col("u") < 0.99 * F.col("tope")))).alias("cortas_sin_agotarse"),
        (F.count_if(F.col("u") < 0.99 * F.col("peso") * budget) > 0).alias("hay_cortas"), (F.count_if(F.col("u") > 1.01 * F.col("peso") * budget) > 0).alias("hay_sustitutas"),
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_documents(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_misses, p7_found, p7_items, p8_selection, p8_shares, p8_shortage, p9_found)}

ORACLE_SQL = {
    "p8_shortage": "SELECT 0::BIGINT AS sobre_tope, 0::BIGINT AS repetidas_de_mas, 0::BIGINT AS documentos_dobles, true AS presupuesto, 0::BIGINT AS cortas_sin_agotarse, true AS hay_cortas, true AS hay_sustitutas",
}
