"""Exactly one copy of messages that were delivered at least once (problem 5).

A Bloom filter for each time bucket says which identifiers are definitely new; only the rest is compared exactly,
and only with the stored identifiers of the buckets whose filters matched. Filters are cut into shards by a hash of the
identifier and lie where the rows of their shard lie, so neither the driver nor a broadcast holds them, and each is sized
by what its bucket and shard hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.session import reliable_checkpoint

#: Bits for each identifier of a filter, at least, and number of probes: about 1 in 400 unique identifiers is compared in vain for each bucket.
BITS_PER_ID = 16
PROBES = 4
#: Rows of a shard, about: what one task holds at a time.
SHARD_ROWS = 500_000
#: Messages with this share of all deliveries are looked up by a broadcast: there are at most 1 / HEAVY of them.
HEAVY = 1e-3
_NEVER = -(1 << 40)


def message_key(c: Column) -> Column:
    """The hexadecimal digits of an identifier in lower case; null where there are none."""
    k = F.lower(F.regexp_replace(c, "[^0-9A-Fa-f]", ""))
    return F.when(k != "", k)


class BloomFilter:
    """A filter over 64-bit hashes whose size is a power of two; it also knows what was set twice."""

    def __init__(self, h: np.ndarray):
        self.mask = np.uint64((1 << max(10, int(len(h) * BITS_PER_ID - 1).bit_length())) - 1)
        hits = np.zeros(int(self.mask) + 1, np.uint8)
        for at in self._places(h):
            # Two rows at one place make it at least 2, whatever else is there.
            np.add.at(hits, at, 1) if len(at) < 64 else self._add(hits, at)
        self.once, self.twice = hits >= 1, hits >= 2

    @staticmethod
    def _add(hits: np.ndarray, at: np.ndarray) -> None:
        hits += np.minimum(np.bincount(at, minlength=len(hits)), 2).astype(np.uint8)
        np.minimum(hits, 2, out=hits)

    def _places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        a, b = h.astype(np.uint64), (h.astype(np.uint64) >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            yield ((a + np.uint64(i) * b) & self.mask).astype(np.int64)

    def hit(self, h: np.ndarray, twice: bool = False) -> np.ndarray:
        """Which of the hashes may be in the filter (set by two rows)."""
        of, plane = np.arange(len(h)), self.twice if twice else self.once
        for i in range(PROBES):
            x = h[of].astype(np.uint64)
            of = of[plane[((x + np.uint64(i) * ((x >> np.uint64(32)) | np.uint64(1))) & self.mask).astype(np.int64)]]
            if not len(of):
                break
        return of

    def packed(self) -> bytes:
        return np.packbits(self.once).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> BloomFilter:
        out = cls.__new__(cls)
        out.once = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
        out.twice, out.mask = out.once, np.uint64(len(out.once) - 1)
        return out


_ROW = "shard int, bucket long, key string, h long, first_id long, n long"
_MATCHED = "bucket long, key string, first_id long, n long, matches array<long>"


def _collapsed(rows: DataFrame) -> DataFrame:
    """Rows (shard, bucket, key, h, id) with the copies that lie side by side made one, so that no message fills a shard."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if pdf["h"].is_unique:
                yield pdf.rename(columns={"id": "first_id"}).assign(n=1)
            else:
                yield pdf.groupby(["shard", "bucket", "key", "h"], sort=False, as_index=False).agg(first_id=("id", "min"), n=("id", "size"))

    return rows.select("shard", "bucket", "key", "h", "id").mapInPandas(run, _ROW)


def _screen(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of a shard that may have a copy, with the buckets whose filters say so; all others are definitely new."""
    h, own, n = pdf["h"].to_numpy(), pdf["bucket"].to_numpy(), pdf["n"].to_numpy()
    rows, hits = [], []
    for bucket in np.unique(own):
        inside, outside = np.flatnonzero(own == bucket), np.flatnonzero(own != bucket)
        bloom = BloomFilter(h[inside])
        again = np.union1d(inside[bloom.hit(h[inside], twice=True)], inside[n[inside] > 1])
        for found in (again, outside[bloom.hit(h[outside])]):
            rows.append(found)
            hits.append(np.full(len(found), bucket))
    at, match = np.concatenate(rows), np.concatenate(hits)
    by = np.argsort(at, kind="stable")
    at, match = at[by], match[by]
    edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    out = pdf.iloc[at[edge]][["bucket", "key", "first_id", "n"]].copy()
    out["matches"] = np.split(match, edge[1:]) if len(at) else []
    return out


def _keyed(df: DataFrame, id_col: str, message_col: str, time_col: str, bucket_seconds: int) -> DataFrame:
    return df.select(
        F.col(id_col).cast("long").alias("id"), message_key(F.col(message_col)).alias("key"),
        F.coalesce(F.floor(F.unix_seconds(F.col(time_col).cast("timestamp")) / bucket_seconds), F.lit(_NEVER)).cast("long").alias("bucket"),
    ).filter("key is not null")


def _sharded(keyed: DataFrame, shards: int) -> DataFrame:
    return keyed.withColumn("h", F.xxhash64("key")).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))


def _first_copies(rest: DataFrame) -> DataFrame:
    """``key``, ``kept`` and ``n`` (deliveries) of the messages among ``rest`` (_MATCHED) that the buckets they matched do hold."""
    # Stored identifiers by bucket; one row for each message and bucket, so that no message swells the join.
    stored = rest.groupBy(F.col("bucket").alias("match"), "key").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))
    probes = rest.select(F.explode("matches").alias("match"), "key").distinct()
    return probes.join(stored, ["match", "key"]).groupBy("key").agg(F.min("first_id").alias("kept"), F.sum("n").alias("n"))


def repeated_messages(df: DataFrame, id_col: str, message_col: str, time_col: str, bucket_seconds: int = 86_400, max_buckets: int = 32) -> tuple[DataFrame, int]:
    """``key``, ``kept`` and ``n`` of every message that may have been delivered again, among them all that were; and the rows of ``df``."""
    spark = df.sparkSession
    at = F.floor(F.unix_seconds(F.col(time_col).cast("timestamp")) / bucket_seconds)
    span = df.agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("n")).first()
    wide = max(1, -(-((span["high"] or 0) - (span["low"] or 0) + 1) // max_buckets))
    keyed = _keyed(df, id_col, message_col, time_col, bucket_seconds * wide)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-span["n"] // SHARD_ROWS))
    rest = _collapsed(_sharded(keyed, shards)).groupBy("shard").applyInPandas(_screen, _MATCHED)
    return reliable_checkpoint(_first_copies(reliable_checkpoint(rest))), span["n"]


def _looked_up(df: DataFrame, key: Column, first: DataFrame, total: int, name: str) -> DataFrame:
    """``df`` with the delivery that stays of each row's message in ``name``, null where there is none. A message may hold any
    share of the rows: the heavy ones come by a broadcast of at most 1 / HEAVY rows; the rows of the others spread evenly."""
    least = max(2.0, HEAVY * total)
    k, light_k, heavy_k = f"{name}_k", f"{name}_light", f"{name}_heavy"
    heavy = F.broadcast(first.filter(F.col("n") >= least).select(F.col("key").alias(heavy_k), F.col("kept").alias(f"{name}_h")))
    light = first.filter(F.col("n") < least).select(F.col("key").alias(light_k), F.col("kept").alias(f"{name}_l"))
    got = df.withColumn(k, key).join(heavy, F.col(k) == F.col(heavy_k), "left")
    # What is looked up no more gets a key of its own that no message has.
    spread = F.coalesce(F.when(F.col(heavy_k).isNull(), F.col(k)), F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string")))
    got = got.withColumn(k, spread).join(light, F.col(k) == F.col(light_k), "left")
    return got.select(*[got[c] for c in df.columns], F.coalesce(F.col(f"{name}_h"), F.col(f"{name}_l")).alias(name))


def repeated_deliveries(df: DataFrame, id_col: str, message_col: str, time_col: str, **options) -> DataFrame:
    """The deliveries to drop: ``id_col`` and ``kept`` (the delivery that stays) of every row that isn't the one with the smallest id among those of its message.

    ``message_col`` is compared by :func:`message_key`; a null or digitless identifier is no message, and its
    rows all stay. ``id_col`` is a long; rows with the same id and the same message count as one delivery, of
    which nothing is dropped. A null time forms a bucket of its own. Other columns are ignored, whatever their
    names; an empty table gives an empty result. Buckets are ``bucket_seconds`` wide, or the least multiple that
    makes at most ``max_buckets`` of them, so that the probes for each row don't grow with the time covered. They bound the
    filters, not the search: copies are found however far apart.
    """
    first, total = repeated_messages(df, id_col, message_col, time_col, **options)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(message_col).alias("m"))
    got = _looked_up(rows, message_key(F.col("m")), first, total, "kept")
    return got.filter("id > kept").select(F.col("id").alias(id_col), "kept").distinct()


def kept_deliveries(df: DataFrame, id_col: str, message_col: str, time_col: str, **options) -> DataFrame:
    """The rows of ``df`` that stay: all but the :func:`repeated_deliveries`; every column is kept."""
    first, total = repeated_messages(df, id_col, message_col, time_col, **options)
    name = "__kept"
    while any(c.startswith(name) for c in df.columns):
        name += "_"
    got = _looked_up(df, message_key(F.col(message_col)), first, total, name)
    return got.filter(~F.coalesce(F.col(id_col) > F.col(name), F.lit(False))).drop(name)


class DeliveryStore:
    """What was delivered so far, for batches that arrive one after another: identifiers by time bucket, and a Bloom filter
    for each batch, bucket and shard beside them. A new batch reads the filters, and identifiers of the matching buckets only.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_seconds: int = 86_400, shards: int = 64):
        self.spark, self.path, self.bucket_seconds, self.shards = spark, path.rstrip("/"), bucket_seconds, shards
        #: The buckets whose identifiers the last batch was compared with.
        self.read_buckets: list[int] = []

    def _stored(self, what: str, schema: str) -> DataFrame | None:
        from lonja.sources.storage import Files

        path = f"{self.path}/{what}"
        return self.spark.read.schema(schema).parquet(path) if Files(self.spark, path).names(path) else None

    def take(self, df: DataFrame, id_col: str, message_col: str, time_col: str, batch_id: int) -> DataFrame:
        """The deliveries of the batch to drop: ``id_col`` and ``kept``, the first delivery in this batch or an earlier one. The
        batch is stored under its number; taken again it gives the same and overwrites itself. Batches come in order of id."""
        keyed = _sharded(_keyed(df, id_col, message_col, time_col, self.bucket_seconds), self.shards)
        rows = reliable_checkpoint(_collapsed(keyed))
        filters = self._stored("filters", "batch long, shard int, bucket long, plane binary")
        ids = self._stored("ids", "batch long, bucket long, key string, first_id long")
        mine = rows.groupBy("key").agg(F.min("first_id").alias("kept"), F.sum("n").alias("n"))
        if filters is not None:

            def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                h, found = left["h"].to_numpy(), []
                for bucket, raw in zip(right["bucket"], right["plane"]):
                    hits = BloomFilter.unpacked(raw).hit(h) if len(h) else []
                    found.append(pd.DataFrame({"match": bucket, "key": left["key"].to_numpy()[hits]}))
                return pd.concat(found).drop_duplicates() if found else pd.DataFrame({"match": [], "key": []})

            old = filters.filter(F.col("batch") < batch_id)
            maybe = reliable_checkpoint(rows.select("shard", "key", "h").groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(probe, "match long, key string"))
            # As many as there are time buckets.
            self.read_buckets = sorted(r[0] for r in maybe.select("match").distinct().collect())
            before = ids.filter(F.col("bucket").isin(self.read_buckets) & (F.col("batch") < batch_id)).withColumnRenamed("bucket", "match")
            known = before.join(maybe.distinct(), ["match", "key"]).groupBy("key").agg(F.min("first_id").alias("kept"), F.lit(0).cast("long").alias("n"))
            mine = mine.unionByName(known).groupBy("key").agg(F.min("kept").alias("kept"), F.sum("n").alias("n"))
        mine = reliable_checkpoint(mine)

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            parts = [(pdf["shard"].iloc[0], b, BloomFilter(p["h"].unique()).packed()) for b, p in pdf.groupby("bucket")]
            return pd.DataFrame(parts, columns=["shard", "bucket", "plane"])

        dynamic = lambda out, what: out.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        dynamic(rows.groupBy("bucket", "key").agg(F.min("first_id").alias("first_id")), "ids").partitionBy("batch", "bucket").parquet(f"{self.path}/ids")
        dynamic(rows.groupBy("shard").applyInPandas(build, "shard int, bucket long, plane binary"), "filters").partitionBy("batch").parquet(f"{self.path}/filters")
        total = mine.agg(F.sum("n")).first()[0] or 0
        got = _looked_up(keyed.select("id", "key"), F.col("key"), mine, total, "kept").filter("id > kept")
        return got.select(F.col("id").alias(id_col), "kept").distinct()
