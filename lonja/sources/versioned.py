"""Tables of Parquet files with a commit log: appends, overwrites, upserts, time travel, history, compaction and Z-order.

A snapshot is the set of files that commits up to a version have added and not removed. A commit creates its log
entry exclusively; of two writers of one version the second starts again from the newer snapshot, and sees there whether
its batch was applied meanwhile. Every few commits the snapshot is written down, so that a reader opens few entries.
Entries hold the least and greatest values of the table's statistics columns in each file: upserts read only files
that may hold matching keys, reads by range only files that may hold the range. Upserts rewrite only the files that do.
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lonja.session import reliable_checkpoint
from lonja.sources.storage import Files

HISTORY_SCHEMA = "version long, timestamp timestamp, operation string, files_added long, files_removed long"


#: Kinds of columns that ranges are kept for: what JSON and comparison keep as they are, or as text in the same order.
_RANGED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampNTZType)
TRIES = 10


def _plain(v):
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


class CommitConflict(RuntimeError):
    """Another writer committed the same version again and again."""


#: Commits between written snapshots.
SNAPSHOT_EVERY = 10


class State(NamedTuple):
    """What the log says at a version: live files with their statistics, the schema, the last batch of each stream."""

    version: int
    files: dict[str, dict]
    schema: T.StructType | None
    batches: dict[str, int]


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, stats: list[str] | None = None):
        """``stats``: columns whose range is kept for each file, beside the keys of upserts and the columns of Z-orders."""
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        self.log = f"{self.path}/_log"
        self.stats = list(stats or [])

    # -- reading -----------------------------------------------------------------------------------------------
    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return bool(Files(spark, path).names(f"{path.rstrip('/')}/_log"))

    def _entry(self, name: str) -> dict:
        return json.loads(self.files.read(f"{self.log}/{name}"))

    def version(self) -> int:
        names = [n for n in self.files.names(self.log) if n.endswith(".json")]
        return int(names[-1][:20]) if names else -1

    def _state(self, upto: int | None = None) -> State:
        names = [n for n in self.files.names(self.log) if n.endswith(".json") or n.endswith(".snapshot")]
        names = [n for n in names if upto is None or int(n[:20]) <= upto]
        commits, snapshots = [n for n in names if n.endswith(".json")], [n for n in names if n.endswith(".snapshot")]
        version, live, schema, batches = -1, {}, None, {}
        if snapshots:
            s = self._entry(snapshots[-1])
            version, live, batches, schema = s["version"], s["files"], s["batches"], T.StructType.fromJson(s["schema"])
        for n in commits:
            if int(n[:20]) <= version:
                continue
            c = self._entry(n)
            for f in c["remove"]:
                live.pop(f, None)
            live.update(c["add"])
            version, schema = c["version"], T.StructType.fromJson(c["schema"])
            if c["txn"]:
                batches[c["txn"][0]] = max(c["txn"][1], batches.get(c["txn"][0], -1))
        return State(version, live, schema, batches)

    def _read_files(self, names: list[str], schema: T.StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def read(self, version: int | None = None, between: dict[str, tuple] | None = None) -> DataFrame:
        """The rows as of a version, or the latest ones. ``between`` maps columns to least and greatest values: only
        files that may hold such rows are read, and only such rows given."""
        if version is not None and not 0 <= version <= self.version():
            raise ValueError(f"no version {version} of {self.path}")
        state = self._state(version)
        if state.schema is None:
            raise FileNotFoundError(f"no table at {self.path}")
        out = self._read_files(self._may_hold(state.files, between or {}), state.schema)
        for c, (low, high) in (between or {}).items():
            out = out.filter(F.col(c).between(low, high))
        return out

    @staticmethod
    def _may_hold(files: dict[str, dict], between: dict[str, tuple]) -> list[str]:
        """Files without statistics of a column may hold anything."""

        def may(stats: dict) -> bool:
            return all(c not in stats or (stats[c][0] is not None and stats[c][0] <= _plain(high) and _plain(low) <= stats[c][1]) for c, (low, high) in between.items())

        return [n for n, stats in files.items() if may(stats)]

    def history(self) -> DataFrame:
        """One row for each commit, read in parallel."""
        if not self.exists(self.spark, self.path):
            return self.spark.createDataFrame([], HISTORY_SCHEMA)
        log = self.spark.read.schema("version long, timestamp double, operation string, add map<string,string>, remove array<string>").json(f"{self.log}/*.json")
        return log.select("version", F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("long")).alias("timestamp"), "operation", F.size("add").cast("long").alias("files_added"), F.size("remove").cast("long").alias("files_removed"))

    # -- writing -----------------------------------------------------------------------------------------------
    def _write(self, df: DataFrame, columns: list[str] | None = None) -> dict[str, dict]:
        """The files written, each with the ranges of the statistics columns."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        names = [f"{name}/{n}" for n in self.files.names(f"{self.path}/{name}") if n.endswith(".parquet")]
        kept = [c for c in dict.fromkeys([*self.stats, *(columns or [])]) if c in df.columns and isinstance(df.schema[c].dataType, _RANGED)]
        ranges: dict[str, dict] = {}
        if kept and names:
            # A row for each file.
            read = self._read_files(names, df.schema).groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("f")).agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(kept) for p, f in (("a", F.min), ("b", F.max))])
            ranges = {r["f"]: {c: [_plain(r[f"a{i}"]), _plain(r[f"b{i}"])] for i, c in enumerate(kept)} for r in read.collect()}
        return {n: ranges.get(n.rsplit("/", 1)[1], {}) for n in names}

    def _commit(self, state: State, operation: str, add: dict[str, dict], remove: list[str], schema: T.StructType, txn: tuple[str, int] | None) -> bool:
        self.files.make(self.log)
        version = state.version + 1
        entry = {"version": version, "timestamp": time.time(), "operation": operation, "schema": schema.jsonValue(), "add": add, "remove": remove, "txn": list(txn) if txn else None}
        if not self.files.create_once(f"{self.log}/{version:020d}.json", json.dumps(entry)):
            return False
        if version and version % SNAPSHOT_EVERY == 0:
            now = self._state(version)
            self.files.create_once(f"{self.log}/{version:020d}.snapshot", json.dumps({"version": version, "files": now.files, "batches": now.batches, "schema": now.schema.jsonValue()}))
        return True

    @staticmethod
    def _applied(state: State, txn: tuple[str, int] | None) -> bool:
        """Whether a batch of a stream is in the table already; the batches of a stream come in order."""
        return txn is not None and state.batches.get(txn[0], -1) >= txn[1]

    def applied(self, txn: tuple[str, int] | None) -> bool:
        return self._applied(self._state(), txn)

    @staticmethod
    def _merged(old: T.StructType | None, new: T.StructType) -> T.StructType:
        fields = {f.name: T.StructField(f.name, f.dataType, True) for f in (old.fields if old else [])}
        for f in new.fields:
            if f.name in fields and fields[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
            fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
        return T.StructType(list(fields.values()))

    def append(self, df: DataFrame, txn: tuple[str, int] | None = None) -> int:
        """Adds rows without comparing; new columns widen the schema."""
        add = None
        for _ in range(TRIES):
            state = self._state()
            if self._applied(state, txn):
                return state.version
            add = self._write(df) if add is None else add
            if self._commit(state, "APPEND", add, [], self._merged(state.schema, df.schema), txn):
                return state.version + 1
        raise CommitConflict(self.path)

    def overwrite(self, df: DataFrame, merge_schema: bool = False) -> int:
        """Replaces all rows in one commit; older versions stay readable."""
        add = self._write(df)
        for _ in range(TRIES):
            state = self._state()
            if self._commit(state, "OVERWRITE", add, list(state.files), self._merged(state.schema if merge_schema else None, df.schema), None):
                return state.version + 1
        raise CommitConflict(self.path)

    def upsert(self, source: DataFrame, keys: list[str], null_safe: bool = False, accumulate: list[str] | None = None, txn: tuple[str, int] | None = None, delete_unmatched: bool = False) -> int:
        """Matched rows take the source's values, others are inserted; the first write creates the table.

        ``accumulate`` columns of matched rows are added up instead. A null key matches nothing unless ``null_safe``. Keys
        repeated in the source are an error, as an upsert by them would be ambiguous. ``txn`` (stream, batch) makes a
        replayed batch do nothing, also when another writer replays it at the same time. ``delete_unmatched`` drops target
        rows without a source row. The source is evaluated once.
        """
        if self.applied(txn):
            return self.version()
        source = reliable_checkpoint(source)
        twice = source.filter(reduce(lambda a, b: a & b, [F.lit(True) if null_safe else F.col(k).isNotNull() for k in keys])).groupBy(*keys).count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"several source rows with the key {twice[0].asDict()}")
        ranged = [k for k in keys if isinstance(source.schema[k].dataType, _RANGED)]
        span = source.agg(*[f(k).alias(f"{p}{i}") for i, k in enumerate(ranged) for p, f in (("a", F.min), ("b", F.max))], F.max(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).alias("nulls")).first()
        between = {k: (span[f"a{i}"], span[f"b{i}"]) for i, k in enumerate(ranged) if span[f"a{i}"] is not None}
        for _ in range(TRIES):
            state = self._state()
            if self._applied(state, txn):
                return state.version
            schema = self._merged(state.schema, source.schema)
            names = list(state.files)
            # A null key may match in a file whatever its range.
            near = names if delete_unmatched or (null_safe and span["nulls"]) else self._may_hold(state.files, between)
            add, remove = self._merge_files(near, source, keys, null_safe, accumulate or [], delete_unmatched, schema)
            if self._commit(state, "UPSERT", add, remove, schema, txn):
                return state.version + 1
        raise CommitConflict(self.path)

    def _merge_files(self, names, source, keys, null_safe, accumulate, delete_unmatched, schema) -> tuple[dict[str, dict], list[str]]:
        wide = source.select(*[F.col(f.name) if f.name in source.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        if not names:
            return self._write(wide, keys), []
        target = self._read_files(names, schema).withColumn("__file", F.col("_metadata.file_path"))
        on = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) if null_safe else a[k] == b[k] for k in keys])
        only_keys = source.select(*[F.col(k) for k in keys])
        if delete_unmatched:
            touched = names
        else:
            # As many entries as files.
            hit = {r[0].rsplit("/", 2)[-2] + "/" + r[0].rsplit("/", 1)[-1] for r in target.join(only_keys, on(target, only_keys), "left_semi").select("__file").distinct().collect()}
            touched = [n for n in names if n.split("/", 1)[1] in hit]
        if not touched:
            return self._write(wide, keys), []
        old = self._read_files(touched, schema)
        kept = old.join(only_keys, on(old, only_keys), "left_anti")
        if accumulate:
            prior = old.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(a).alias(f"__a_{a}") for a in accumulate], F.lit(1).alias("__hit"))
            cond = reduce(lambda x, y: x & y, [wide[k].eqNullSafe(prior[f"__k_{k}"]) if null_safe else wide[k] == prior[f"__k_{k}"] for k in keys])
            wide = wide.join(prior, cond, "left").select(*[(F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"__a_{c}"), F.lit(0))).cast(schema[c].dataType).alias(c) if c in accumulate else F.col(c) for c in schema.names])
        return self._write(wide if delete_unmatched else kept.unionByName(wide), keys), touched

    # -- layout ------------------------------------------------------------------------------------------------
    def optimize(self, n_files: int = 1, zorder: list[str] | None = None, bits: int = 8) -> int:
        """The same rows in ``n_files`` files, along a Z-order curve of the given columns if there are any."""
        for _ in range(TRIES):
            state = self._state()
            df = self._read_files(list(state.files), state.schema)
            df = z_ordered(df, zorder, n_files, bits) if zorder else df.repartition(n_files)
            # The keys of earlier upserts keep their statistics.
            add = self._write(df, [*(zorder or []), *sorted({c for stats in state.files.values() for c in stats})])
            if self._commit(state, "OPTIMIZE", add, list(state.files), state.schema, None):
                return state.version + 1
        raise CommitConflict(self.path)


def _below(x: Column):
    return lambda e: e < x


def z_ordered(df: DataFrame, columns: list[str], n_files: int, bits: int = 8) -> DataFrame:
    """Rows range-partitioned and sorted by the interleaved bits of each column's quantile rank.

    Ranks come from approximate quantiles: ``2**bits`` cuts for each column, whatever the rows. Strings rank by their
    first eight bytes; nulls come first.
    """
    ranked = {}
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType):
            ranked[c] = F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(c), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
        elif isinstance(kind, T.DateType):
            ranked[c] = F.unix_date(F.col(c)).cast("double")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            ranked[c] = F.unix_micros(F.col(c).cast("timestamp")).cast("double")
        else:
            ranked[c] = F.col(c).cast("double")
    probs = [i / 2**bits for i in range(1, 2**bits)]
    cuts = df.agg(*[F.percentile_approx(e, probs, 10_000).alias(c) for c, e in ranked.items()]).first()
    z = F.lit(0).cast("long")
    for k, c in enumerate(columns):
        edges = sorted(set(cuts[c] or []))
        rank = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), _below(ranked[c]))) if edges else F.lit(0)
        rank = F.when(ranked[c].isNull(), 0).otherwise(rank)
        for bit in range(bits):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(columns) + k))
    return df.withColumn("__z", z).repartitionByRange(n_files, "__z").sortWithinPartitions("__z").drop("__z")
