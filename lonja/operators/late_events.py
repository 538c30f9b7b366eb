"""Per-period aggregates by event time that late records correct (problem 6).

Each source (partition of the broker) keeps its own counter for each period and group: a grow-only state with a
version taken from the sequence of landed batches. Merging keeps the greatest version of each source and sums the
sources. Retries write a version that is already there and reordered states lose to greater versions, so neither
changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_instant_us(c: Column) -> Column:
    """Microseconds since 1970-01-01 UTC of an ISO 8601 writing that carries Z or an offset; null for anything else."""
    t = F.trim(c)
    full = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?\s*(?:Z|[+-]\d{2}:?\d{2})$"
    return F.when(t.rlike(full), F.unix_micros(F.translate(t, ",", ".").try_cast("timestamp")))


def counter_states(events: DataFrame, period: str, group: str, source: str, sequence: str, amount: str, counted: Column | None = None) -> DataFrame:
    """Cumulative states: one row for each period, group, source and version with ``total`` and ``records`` of the counted
    rows up to it, and ``others``, the number of the other rows.

    Rows of one version are summed before anything is sorted, so a period that holds a third of all rows costs
    one row for each source and version.
    """
    yes = F.lit(True) if counted is None else counted
    one = events.groupBy(period, group, source, sequence).agg(F.sum(F.when(yes, F.col(amount))).alias("add"), F.count_if(yes).alias("n"), F.count_if(~yes).alias("m"))
    w = Window.partitionBy(period, group, source).orderBy(sequence).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return one.select(period, group, source, F.col(sequence).alias("version"), F.coalesce(F.sum("add").over(w), F.lit(0.0)).alias("total"), F.sum("n").over(w).alias("records"), F.sum("m").over(w).alias("others"))


def merge_states(states: DataFrame, period: str, group: str, source: str, early: Column | None = None) -> DataFrame:
    """The join of any states, repeated or in any order: greatest version of each source, then the sum of the sources.

    ``early`` picks versions whose join is given as well, as ``early_total`` and ``early_records``.
    """
    more = [c for c in ("others",) if c in states.columns]
    best = [F.max(F.struct("version", "records", "total", *more)).alias("__best")]
    if early is not None:
        best.append(F.max(F.when(early, F.struct("version", "records", "total"))).alias("__early"))
    out = [F.sum("__best.total").alias("total"), F.sum("__best.records").alias("records"), *[F.sum(f"__best.{c}").alias(c) for c in more]]
    if early is not None:
        out += [F.sum("__early.total").alias("early_total"), F.sum("__early.records").alias("early_records")]
    return states.groupBy(period, group, source).agg(*best).groupBy(period, group).agg(*out)


def late_corrected_sums(df: DataFrame, event_col: str, arrival_col: str, group_col: str, amount_col: str, source_col: str, sequence_col: str, period_s: int = 3600, grace_s: int = 600, cutoff_s: int = 86_400) -> DataFrame:
    """One row for each period of event time and group: ``periodo`` (start, ISO 8601 UTC), ``grupo``, ``suma_inicial`` and
    ``n_inicial`` (what had arrived ``grace_s`` after the period's end), ``suma`` and ``n`` (corrected until ``cutoff_s`` after
    it), ``n_tarde`` (records that corrected it) and ``n_fuera`` (records after the cut-off, in no sum).

    Rows with a null or unreadable event time, a null arrival or a null group don't count. A null amount counts as a
    record and adds nothing. Periods seen only after the cut-off appear with sums of 0. Arrivals before the event
    count at once. ``source_col`` and ``sequence_col`` may be null; null is a source, and version 0. Other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    e = event_instant_us(F.col(event_col))
    rows = df.select(
        e.alias("at"), F.unix_micros(F.col(arrival_col).cast("timestamp")).alias("arrived"), F.col(group_col).cast("string").alias("grupo"),
        F.col(amount_col).cast("double").alias("amount"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(sequence_col).cast("long"), F.lit(0)).alias("seq"),
    ).filter("at is not null and arrived is not null and grupo is not null")
    rows = rows.withColumn("p", F.floor(F.col("at") / F.lit(period_s * 1_000_000)).cast("long"))
    delay = F.col("arrived") - (F.col("p") + 1) * F.lit(period_s * 1_000_000)
    # Phase 0: in time, 1: corrects, 2: after the cut-off. The phase leads the version: what arrives later is a later version.
    rows = rows.withColumn("phase", F.when(delay <= grace_s * 1_000_000, 0).when(delay <= cutoff_s * 1_000_000, 1).otherwise(2))
    states = counter_states(rows.withColumn("ver", F.struct("phase", "seq")), "p", "grupo", "source", "ver", "amount", F.col("phase") < 2)
    out = merge_states(states, "p", "grupo", "source", F.col("version.phase") == 0)
    start = F.date_format(F.timestamp_seconds(F.col("p") * period_s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    early_n = F.coalesce("early_records", F.lit(0))
    return out.select(
        start.alias("periodo"), "grupo", F.coalesce("early_total", F.lit(0.0)).alias("suma_inicial"), early_n.alias("n_inicial"),
        F.col("total").alias("suma"), F.col("records").alias("n"), (F.col("records") - early_n).alias("n_tarde"), F.col("others").alias("n_fuera"),
    )
