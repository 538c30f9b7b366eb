"""Word counts and their relatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.functions.values import tokens

# Words that say nothing in the corpus languages.
STOPWORDS = "a al an and as at be by con das de del der die e el en es for from in is it la las lo los o of on or para por que se the to un una und von with y zu".split()


def word_count(df: DataFrame, text: str, stopwords: list[str] | None = None) -> DataFrame:
    out = df.select(F.explode(tokens(F.col(text))).alias("palabra"))
    if stopwords:
        out = out.filter(~F.col("palabra").isin(stopwords))
    return out.groupBy("palabra").agg(F.count("*").alias("veces"))


def average_words(df: DataFrame, text: str) -> DataFrame:
    return df.agg(F.round(F.avg(F.size(tokens(F.col(text)))), 4).alias("promedio"))


def bigram_count(df: DataFrame, text: str) -> DataFrame:
    t = df.select(tokens(F.col(text)).alias("t")).filter(F.size("t") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.element_at("t", i), F.element_at("t", i + 1)))
    return t.select(F.explode(pairs).alias("bigrama")).groupBy("bigrama").agg(F.count("*").alias("veces"))
