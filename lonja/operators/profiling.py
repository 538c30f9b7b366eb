"""Column profiles of the loads of a table, and the loads in which a column departs from its habit (problem 4).

Values are unpivoted, counted by column, load and value, and range-sorted by column: the counts of the partitions before
a partition are its offset, and running counts inside it finish the curves. From these cumulative curves come exact
quantiles, distinct counts and exact Kolmogorov-Smirnov distances: of each load's values from all others, and, on the axis
of rarity, of each load from the habit of the column. A heavy value is one row for each load by then, so no range is large.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.session import reliable_checkpoint

#: A value that fills this share of any one load is a category of its own; other values are known by their form.
HEAVY_SHARE = 0.01
#: Categories at most this common in the median load are rare.
RARE_SHARE = 0.05
#: The steps of the axis of rarity.
RARE_STEP = 1e-4
#: The share of a load's rows that makes a departure.
DEPARTURE = 1.0 / 6.0
#: The distance of a load's values from all others that makes a shift, and the chance of a greater one without any.
SHIFT, CHANCE = 0.2, 1e-6

# The patterns that clean values of known kinds follow.
PATTERNS = {"numeric": r"^\s*-?\d+(\.\d+)?\s*$", "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "seller": r"^(?:VEN-|v)?\d+$", "text": r"\S"}


def unpivot_counts(df: DataFrame, load_col: str, columns: list[str]) -> DataFrame:
    """Rows by column, load and value: ``columna``, ``carga``, ``valor`` (string, null for null) and ``n``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), F.col(c).cast("string").alias("valor")) for c in columns]))
    return df.select(F.col(load_col).cast("long").alias("carga"), pairs.alias("v")).groupBy(F.col("v.columna").alias("columna"), "carga", F.col("v.valor").alias("valor")).agg(F.count("*").alias("n"))


def cumulative_curves(counts: DataFrame, order: str, partitions: int | None = None) -> DataFrame:
    """Adds to rows (columna, carga, <order>, n) the exact cumulative counts on the column's axis.

    ``acum`` and ``total`` are of the load, up to and with this row's point and altogether; ``acum_todas``,
    ``en_punto`` and ``total_todas`` of all loads: up to and with the point, at the point, altogether.
    ``distintos_antes`` counts the distinct points of the load up to this one. A null point isn't on the axis. The
    range-sorted rows are kept in the checkpoint folder, as their partitions must stay what they are.
    """
    n_ranges = partitions or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = counts.filter(F.col(order).isNotNull()).groupBy("columna", "carga", order).agg(F.sum("n").alias("n"))
    # Equal points share a partition, and partitions follow the axis.
    rows = reliable_checkpoint(rows.repartitionByRange(n_ranges, "columna", order).withColumn("rango", F.spark_partition_id()))
    by_range = rows.groupBy("columna", "rango", "carga").agg(F.sum("n").alias("n"), F.count("*").alias("d"))
    before = Window.partitionBy("columna", "carga").orderBy("rango").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("columna", "carga")
    loads = by_range.select("columna", "rango", "carga", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("total"), F.coalesce(F.sum("d").over(before), F.lit(0)).alias("base_d"))
    all_ = by_range.groupBy("columna", "rango").agg(F.sum("n").alias("n"))
    w1 = Window.partitionBy("columna").orderBy("rango").rowsBetween(Window.unboundedPreceding, -1)
    all_ = all_.select("columna", "rango", F.coalesce(F.sum("n").over(w1), F.lit(0)).alias("base_todas"), F.sum("n").over(Window.partitionBy("columna")).alias("total_todas"))
    bases = loads.join(all_, ["columna", "rango"]).withColumnRenamed("carga", "de")
    in_range = Window.partitionBy("columna", "rango").orderBy(order)
    at_point = Window.partitionBy("columna", "rango", order)
    in_load = Window.partitionBy("columna", "rango", "carga").orderBy(order)
    run = rows.withColumns({
        "acum_todas": F.sum("n").over(in_range.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "en_punto": F.sum("n").over(at_point),
        "acum": F.sum("n").over(in_load), "d": F.row_number().over(in_load),
    })
    # A null load is one too.
    got = run.alias("r").join(bases.alias("b"), (F.col("r.columna") == F.col("b.columna")) & (F.col("r.rango") == F.col("b.rango")) & F.col("carga").eqNullSafe(F.col("de")))
    return got.select(
        "r.columna", "carga", order, "n", (F.col("acum") + F.col("base")).alias("acum"), "total", (F.col("acum_todas") + F.col("base_todas")).alias("acum_todas"),
        "en_punto", "total_todas", (F.col("d") + F.col("base_d")).alias("distintos_antes"),
    )


def ks_distances(curves: DataFrame, habit: str | None = None) -> DataFrame:
    """Exact Kolmogorov-Smirnov distance of each load from all others, by column.

    Between two points of a load its own curve is flat, so the extremes lie at its points or just before them.
    ``ks`` is the distance, ``ks_bajo`` the greatest excess of the load's curve over the rest's. A load without others is at
    0. With ``habit``, a column with another curve at the same points, ``ks_bajo`` is the greatest excess over that, and the only result.
    """
    mine = F.col("acum") / F.col("total")
    if habit is not None:
        return curves.groupBy("columna", "carga").agg(F.max(mine - F.col(habit)).alias("ks_bajo"))
    rest = F.col("total_todas") - F.col("total")
    theirs = (F.col("acum_todas") - F.col("acum")) / rest
    mine0, theirs0 = (F.col("acum") - F.col("n")) / F.col("total"), (F.col("acum_todas") - F.col("en_punto") - F.col("acum") + F.col("n")) / rest
    over, under = F.max(F.when(rest > 0, mine - theirs).otherwise(0.0)), F.max(F.when(rest > 0, theirs0 - mine0).otherwise(0.0))
    return curves.groupBy("columna", "carga").agg(F.greatest(over, under).alias("ks"), over.alias("ks_bajo"), F.max("total").alias("valores"), F.max(rest).alias("otros"))


def quantiles(curves: DataFrame, order: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles (the least point whose cumulative share reaches q) and the distinct count of each column and load."""
    picks = [F.min(F.when(F.col("acum") >= F.lit(q) * F.col("total"), F.col(order))).alias(name) for name, q in at.items()]
    return curves.groupBy("columna", "carga").agg(*picks, F.min(order).alias("minimo"), F.max(order).alias("maximo"), F.max("distintos_antes").alias("distintos_num"))


def value_form(c: Column) -> Column:
    """The form of a written value: every digit 9, runs of lower or upper case letters one letter, runs of space one space."""
    s = F.regexp_replace(c, r"\p{Nd}", "9")
    s = F.regexp_replace(F.regexp_replace(s, r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    return F.substring(F.regexp_replace(s, r"\s+", " "), 1, 64)


def _blank() -> Column:
    return F.col("valor").isNull() | (F.trim("valor") == "")


def _value_curves(counts: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The curves of the numeric columns over their numbers (``x``), and of the others over their texts that aren't blank (``valor``)."""
    numeric = [c for c, k in columns.items() if k == "numeric"]
    numbers = counts.filter(F.col("columna").isin(numeric)).withColumn("x", F.col("valor").try_cast("double")).filter("x is not null and not isnan(x)")
    texts = counts.filter(~F.col("columna").isin(numeric) & ~_blank())
    return cumulative_curves(numbers, "x"), cumulative_curves(texts, "valor")


def profile_loads(df: DataFrame, load_col: str, columns: dict[str, str]) -> DataFrame:
    """One row for each load and column: rows, nulls (null or blank), distinct values, violations of the column's pattern,
    exact quartiles and range of the numeric values or the range of the texts, and the exact KS distance of the load's
    values from all other loads (texts in the order of their bytes).

    ``columns`` maps a column to a kind of PATTERNS. A null load is a load of its own. Columns with no number in a load have
    null quantiles; a load without values has no distance. An empty table gives an empty result. The table is read once.
    """
    counts = reliable_checkpoint(unpivot_counts(df, load_col, list(columns)))
    pattern = F.create_map(*[F.lit(x) for c, k in columns.items() for x in (c, PATTERNS[k])])
    bad = ~_blank() & ~F.expr("valor rlike patron")
    basic = counts.withColumn("patron", pattern[F.col("columna")]).groupBy("columna", "carga").agg(
        F.sum("n").alias("filas"), F.sum(F.when(_blank(), F.col("n")).otherwise(0)).alias("nulos"), F.sum(F.when(~_blank(), 1).otherwise(0)).alias("distintos"),
        F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("violaciones"),
    )
    by_number, by_text = _value_curves(counts, columns)
    quarters = {"q25": 0.25, "mediana": 0.5, "q75": 0.75}
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    found = []
    for curves, order in ((by_number, "x"), (by_text, "valor")):
        q = quantiles(curves, order, quarters).withColumnsRenamed({"columna": "c", "carga": "g"})
        k = ks_distances(curves)
        r = k.join(q, (F.col("columna") == F.col("c")) & F.col("carga").eqNullSafe(F.col("g")))
        ranges = ["minimo", *quarters, "maximo", *none("string", "minimo_texto", "maximo_texto")] if order == "x" else [*none("double", "minimo", *quarters, "maximo"), F.col("minimo").alias("minimo_texto"), F.col("maximo").alias("maximo_texto")]
        found.append(r.select(F.col("columna").alias("c"), F.col("carga").alias("g"), *ranges, "ks"))
    values = found[0].unionByName(found[1])
    out = basic.join(values, (F.col("columna") == F.col("c")) & F.col("carga").eqNullSafe(F.col("g")), "left")
    return out.select(F.col("carga").alias(load_col), "columna", "filas", "nulos", "distintos", "violaciones", "minimo", "q25", "mediana", "q75", "maximo", "minimo_texto", "maximo_texto", "ks")


def shifted_loads(df: DataFrame, load_col: str, columns: dict[str, str], shift: float = SHIFT, chance: float = CHANCE) -> DataFrame:
    """Loads and columns whose values lie elsewhere than those of all other loads: ``load_col``, ``columna`` and ``ks``.

    The exact KS distance of the values is ``shift`` at least, and greater than it is by ``chance`` for two samples of
    one distribution. Nulls and blanks don't count. With a single load nothing shifts.
    """
    counts = reliable_checkpoint(unpivot_counts(df, load_col, list(columns)))
    both = [ks_distances(c) for c in _value_curves(counts, columns)]
    critical = F.sqrt(F.lit(math.log(2 / chance) / 2) * (1 / F.col("valores") + 1 / F.col("otros")))
    out = both[0].unionByName(both[1]).filter((F.col("otros") > 0) & (F.col("ks") >= shift) & (F.col("ks") > critical))
    return out.select(F.col("carga").alias(load_col), "columna", "ks")


def rarity_counts(df: DataFrame, load_col: str, columns: list[str], heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Rows by column, load and rarity: the share that their category has in the median load, in steps of RARE_STEP.

    The category of a value is the value itself where some load holds it in at least ``heavy_share`` of its rows
    (at most 1/heavy_share values for each load and column), else its form; nulls and blanks are one category. The median
    over all loads counts loads without the category as 0. The table is read once.
    """
    counts = reliable_checkpoint(unpivot_counts(df.filter(F.col(load_col).isNotNull()), load_col, columns))
    counts = counts.select("columna", "carga", "n", F.when(~_blank(), F.col("valor")).alias("valor"))
    sizes = counts.groupBy("columna", "carga").agg(F.sum("n").alias("filas"))
    n_loads = sizes.groupBy("columna").agg(F.count("*").alias("cargas"))
    heavy = counts.filter("valor is not null and n >= 3").join(sizes, ["columna", "carga"]).filter(F.col("n") >= heavy_share * F.col("filas")).select("columna", "valor").distinct().withColumn("propio", F.lit(True))
    cat = F.when(F.col("valor").isNull(), F.lit("nulo")).when(F.col("propio"), F.concat(F.lit("valor:"), "valor")).otherwise(F.concat(F.lit("forma:"), value_form(F.col("valor"))))
    # Categories by load: few rows, needed twice.
    cats = reliable_checkpoint(counts.join(heavy, ["columna", "valor"], "left").groupBy("columna", "carga", cat.alias("cat")).agg(F.sum("n").alias("n")))
    shares = cats.join(sizes, ["columna", "carga"]).join(n_loads, "columna").withColumn("parte", F.col("n") / F.col("filas"))
    # The median load's share: a row for each load at most is put in order.
    place = F.row_number().over(Window.partitionBy("columna", "cat").orderBy(F.desc("parte")))
    habit = shares.withColumn("puesto", place).filter(F.col("puesto") == F.floor(F.col("cargas") / 2) + 1).select("columna", "cat", F.col("parte").alias("rareza"))
    rarity = F.round(F.coalesce("rareza", F.lit(0.0)) / RARE_STEP) * RARE_STEP
    return cats.join(habit, ["columna", "cat"], "left").groupBy("columna", "carga", rarity.alias("rareza")).agg(F.sum("n").alias("n"))


def departing_loads(df: DataFrame, load_col: str, columns: list[str], departure: float = DEPARTURE, rare: float = RARE_SHARE) -> DataFrame:
    """Loads and columns in which at least ``departure`` of the rows hold nulls, values or forms that are rare elsewhere.

    Rows are laid on the axis of rarity (:func:`rarity_counts`), and each load's curve is set against the habit, the curve
    of the median of the other loads, which doesn't follow other departing or large loads. Up to a rarity of ``rare`` the
    load's own cumulative share must be ``departure`` at least, and lie above the habit by four standard errors of what the
    others hold, which a few odd rows of a small load don't, and by ``departure`` or by as much again as the habit. With a
    single load nothing departs. Returns ``load_col``, ``columna``, ``exceso`` (the one-sided KS distance from the habit there).
    """
    rows = reliable_checkpoint(rarity_counts(df, load_col, columns))
    # Every load has a point at every rarity that counts (rare / RARE_STEP at most), so that the curves of all can be set side by side.
    points = rows.filter(F.col("rareza") <= rare).select("columna", "rareza").distinct()
    dense = rows.select("columna", "carga").distinct().join(points, "columna").select("columna", "carga", "rareza", F.lit(0).cast("long").alias("n"))
    curves = cumulative_curves(rows.unionByName(dense), "rareza")
    rest = F.col("total_todas") - F.col("total")
    low = curves.filter((F.col("rareza") <= rare) & (rest > 0)).withColumns({"p": F.col("acum") / F.col("total"), "resto": (F.col("acum_todas") - F.col("acum")) / rest})
    at = Window.partitionBy("columna", "rareza")
    low = low.withColumns({"puesto": F.row_number().over(at.orderBy("p", "carga")), "m": F.count("*").over(at)})
    # The two middle places of the others, and the places after them for loads that stand before.
    k1, k2 = F.floor(F.col("m") / 2), F.floor((F.col("m") - 1) / 2) + 1
    pick = lambda k, name: F.max(F.when(F.col("puesto") == k, F.col("p"))).alias(name)
    middle = low.groupBy("columna", "rareza").agg(pick(k1, "a1"), pick(k1 + 1, "a2"), pick(k2, "b1"), pick(k2 + 1, "b2"))
    low = low.join(middle, ["columna", "rareza"])
    own = F.col("puesto")
    low = low.withColumn("habito", (F.when(k1 >= own, F.col("a2")).otherwise(F.col("a1")) + F.when(k2 >= own, F.col("b2")).otherwise(F.col("b1"))) / 2)
    p, q, resto = F.col("p"), F.col("habito"), F.col("resto")
    sure = p - q > 4 * F.sqrt(F.greatest(resto * (1 - resto), F.lit(0.01)) / F.col("total"))
    found = ks_distances(low.filter((p >= departure) & sure & ((p - q >= departure) | (p > 2 * q))), "habito")
    return found.select(F.col("carga").alias(load_col), "columna", F.col("ks_bajo").alias("exceso"))
