"""Joins by order: as-of, and intervals without equal keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` (as ``asof_<name>``) of the last row of ``right`` with the same ``by`` at or before its time.

    Both sides are laid out along time together and the last right row is carried on, so no pair is formed. Of right
    rows of one time the greatest values hold. Null keys or times match nothing. Names of ``values`` may clash with the left's.
    """
    found = F.struct(*[F.col(v).alias(f"asof_{v}") for v in values])
    ok = lambda at: F.col(at).isNotNull() & ~F.greatest(*[F.col(b).isNull() for b in by], F.lit(False))
    a = left.filter(ok(left_at)).select(F.struct("*").alias("l"), *[F.col(b).alias(f"k{i}") for i, b in enumerate(by)], F.col(left_at).alias("at"))
    b = right.filter(ok(right_at)).groupBy(*by, right_at).agg(F.max(found).alias("r")).select("r", *[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.col(right_at).alias("at"))
    both = a.unionByName(b, allowMissingColumns=True)
    # At the same time the right row comes first.
    w = Window.partitionBy(*[f"k{i}" for i in range(len(by))]).orderBy("at", F.col("l").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = both.withColumn("r", F.last("r", ignorenulls=True).over(w)).filter("l is not null").select("l.*", "r.*")
    return got.unionByName(left.filter(~ok(left_at)), allowMissingColumns=True)


def band_join(points: DataFrame, bands: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``points`` with each band [low, high) that holds their value. Both meet in bins of ``width``, so that the join
    is one of equal keys; a band has a row in every bin it touches. Nulls match nothing; columns have different names."""
    bin_of = lambda c: F.floor(F.col(c) / width)
    spread = bands.filter(F.col(low) < F.col(high)).withColumn("__bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    return points.withColumn("__bin", bin_of(at)).join(spread, "__bin").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__bin")
