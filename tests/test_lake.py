import pytest
from pyspark.sql import functions as F

from lonja.operators import quality, runner
from lonja.sources.storage import Files, scratch_dir
from lonja.sources.versioned import CommitConflict, VersionedTable


def frame(spark, rows, schema="k long, v string"):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_and_time_travel(spark):
    t = VersionedTable(spark, scratch_dir(spark))
    assert not VersionedTable.exists(spark, t.path)
    t.upsert(frame(spark, [(1, "a"), (2, "b"), (None, "n")]), ["k"])
    change = frame(spark, [(2, "B"), (3, "c")])
    t.upsert(change, ["k"])
    once = rows(t.read())
    t.upsert(change, ["k"])
    assert rows(t.read()) == once and (1, "a") in once and (2, "B") in once and len(once) == 4
    assert rows(t.read(0)) == rows(frame(spark, [(1, "a"), (2, "b"), (None, "n")]))
    assert [r["operation"] for r in t.history().orderBy("version").collect()] == ["UPSERT"] * 3
    with pytest.raises(ValueError):
        t.read(9)


def test_upsert_null_keys(spark):
    for safe, n in ((False, 2), (True, 1)):
        t = VersionedTable(spark, scratch_dir(spark))
        for _ in range(2):
            t.upsert(frame(spark, [(None, "x")]), ["k"], null_safe=safe)
        assert t.read().count() == n


def test_upsert_rejects_repeated_keys_and_replays(spark):
    t = VersionedTable(spark, scratch_dir(spark))
    with pytest.raises(ValueError):
        t.upsert(frame(spark, [(1, "a"), (1, "b")]), ["k"])
    n = frame(spark, [(1, 2)], "k long, n long")
    for _ in range(3):
        t.upsert(n, ["k"], accumulate=["n"], txn=("s", 0))
    assert rows(t.read()) == [(1, 2)]
    t.upsert(n, ["k"], accumulate=["n"], txn=("s", 1))
    assert rows(t.read()) == [(1, 4)]
    t.upsert(frame(spark, [(7, 1)], "k long, n long"), ["k"], delete_unmatched=True)
    assert rows(t.read()) == [(7, 1)]


def test_upsert_rewrites_only_touched_files(spark):
    t = VersionedTable(spark, scratch_dir(spark))
    t.append(frame(spark, [(1, "a")]).coalesce(1))
    t.append(frame(spark, [(2, "b")]).coalesce(1))
    before = set(t._state().files)
    t.upsert(frame(spark, [(2, "B")]), ["k"])
    assert len(before & set(t._state().files)) == 1 and rows(t.read()) == [(1, "a"), (2, "B")]


def test_commit_is_exclusive(spark, monkeypatch):
    t = VersionedTable(spark, scratch_dir(spark))
    t.append(frame(spark, [(1, "a")]))
    assert not t.files.create_once(f"{t.log}/{0:020d}.json", "{}")
    nothing = VersionedTable(spark, scratch_dir(spark))._state()
    monkeypatch.setattr(t, "_state", lambda upto=None: nothing)
    with pytest.raises(CommitConflict):
        t.append(frame(spark, [(2, "b")]))


def test_log_entries_appear_whole_and_once(spark):
    files, folder = Files(spark, scratch_dir(spark)), scratch_dir(spark)
    files.make(folder)
    assert files.create_once(f"{folder}/a.json", "{}") and not files.create_once(f"{folder}/a.json", "[]")
    assert files.names(folder) == ["a.json"] and files.read(f"{folder}/a.json") == "{}"
    one, two = files._path(f"{folder}/one"), files._path(f"{folder}/two")
    files.fs.create(one).close()
    files._rename_once(one, two)
    files.fs.create(one).close()
    with pytest.raises(Exception, match="(?i)exist"):
        files._rename_once(one, two)


def test_a_batch_is_applied_once_by_rival_writers(spark, monkeypatch):
    path, n = scratch_dir(spark), frame(spark, [(1, 2)], "k long, n long")
    VersionedTable(spark, path).upsert(n, ["k"], accumulate=["n"], txn=("s", 0))
    slow, real = VersionedTable(spark, path), VersionedTable._merge_files

    def overtaken(self, *a):
        monkeypatch.setattr(VersionedTable, "_merge_files", real)
        VersionedTable(spark, path).upsert(n, ["k"], accumulate=["n"], txn=("s", 1))
        return real(self, *a)

    monkeypatch.setattr(VersionedTable, "_merge_files", overtaken)
    slow.upsert(n, ["k"], accumulate=["n"], txn=("s", 1))
    assert rows(slow.read()) == [(1, 4)] and slow.version() == 1


def test_the_source_of_an_upsert_is_evaluated_once(spark):
    from pyspark.sql.types import LongType

    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    source = frame(spark, [(k, k) for k in range(10)], "k long, n long").withColumn("n", F.udf(count, LongType())("n"))
    t = VersionedTable(spark, scratch_dir(spark))
    t.append(frame(spark, [(3, 0), (77, 0)], "k long, n long"))
    t.upsert(source, ["k"], accumulate=["n"])
    assert seen.value == 10 and t.read().count() == 11


def test_snapshots_and_ranges_of_files(spark):
    t = VersionedTable(spark, scratch_dir(spark), stats=["k"])
    for v in range(12):
        t.append(frame(spark, [(100 * v + i, str(v)) for i in range(3)]).coalesce(1))
    assert t.files.names(t.log)[-3].endswith("10.snapshot") or any(n.endswith(".snapshot") for n in t.files.names(t.log))
    opened = []
    entry = t._entry
    t._entry = lambda n: opened.append(n) or entry(n)
    assert t.read().count() == 36 and len(opened) == 2
    assert t.read(4).count() == 15 and t.history().count() == 12
    assert len(t._may_hold(t._state().files, {"k": (250, 402)})) == 2 and rows(t.read(between={"k": (250, 401)})) == [(300, "3"), (301, "3"), (302, "3"), (400, "4"), (401, "4")]
    # An upsert leaves files alone that can't hold its keys.
    t._read_files, read = lambda names, schema: looked.append(len(names)) or read(names, schema), t._read_files
    looked = []
    t.upsert(frame(spark, [(500, "X")]), ["k"])
    assert looked[:2] == [1, 1] and ("500", "X") in [(str(k), v) for k, v in rows(t.read())]


def test_zorder_prunes_files(spark):
    t = VersionedTable(spark, scratch_dir(spark))
    t.append(spark.range(4000).select((F.col("id") * 7919 % 4000).alias("a"), (F.col("id") * 104729 % 3989).alias("b")))
    t.optimize(16, ["a", "b"])
    files = t._state().files
    assert len(files) == 16
    for c in "ab":
        assert len(t._may_hold(files, {c: (100, 200)})) <= 9 and t.read(between={c: (100, 200)}).count() == t.read().filter(F.col(c).between(100, 200)).count()


def test_consumer_passes_gaps(spark):
    from lonja.streaming.pipeline import consume

    log = [(f"o{p}-{o}", p, o) for p in (0, 1) for o in [*range(10), *range(1000 + 400 * p, 1010 + 400 * p)]]
    df = spark.createDataFrame(log, "pedido_id string, partition int, offset long").select(
        F.lit("k").alias("key"), F.to_json(F.struct("pedido_id")).cast("binary").alias("value"), F.lit("t").alias("topic"), "partition", "offset", F.current_timestamp().alias("timestamp"))
    t = VersionedTable(spark, scratch_dir(spark))
    assert consume(spark, df, t, {}, 300) == {0: 1010, 1: 1410} and t.read().count() == 40
    assert consume(spark, df, t, {0: 1010, 1: 1410}, 300) == {0: 1010, 1: 1410}


def test_optimize_keeps_rows(spark):
    t = VersionedTable(spark, scratch_dir(spark))
    df = spark.range(500).select("id", F.concat(F.lit("s"), F.col("id") % 7).alias("s"), F.when(F.col("id") % 5 > 0, F.rand(1)).alias("x"))
    t.append(df)
    want = rows(t.read())
    t.optimize(3, ["s", "x"])
    assert rows(t.read()) == want and len(t._state().files) <= 3
    t.overwrite(frame(spark, [(1, "a")]))
    assert rows(t.read()) == [(1, "a")] and rows(t.read(1)) == want


def test_gold_waits_for_silver(spark):
    path = scratch_dir(spark)
    tasks = [runner.Task("gold", lambda c: runner.require_table(spark, path)), runner.Task("informe", lambda c: 1)]
    assert runner.run_chain(tasks, "2025-01-01").states == {"gold": "skipped", "informe": "skipped"}
    VersionedTable(spark, path).append(frame(spark, [(1, "a")]))
    assert runner.run_chain(tasks, "2025-01-01").states == {"gold": "ok", "informe": "ok"}


def test_processing_time_trigger_and_ingestion_time(spark, small):
    from lonja.operators.medallion import BUSINESS, to_bronze
    from lonja.streaming import pipeline

    path, t = scratch_dir(spark), VersionedTable(spark, scratch_dir(spark))
    frame(spark, [(1, "a"), (2, "b")]).write.parquet(path)
    q = pipeline.run_available(spark.readStream.schema("k long, v string").parquet(path), pipeline.append_sink(t, "s"), scratch_dir(spark), "append", processing_time="1 second")
    q.processAllAvailable()
    q.stop()
    assert rows(t.read()) == [(1, "a"), (2, "b")]
    bronze = to_bronze(spark.read.parquet(f"{small}/ventas_colombia_raw.parquet"))
    assert bronze.columns == [*BUSINESS, "_ingested_at", "_source_file"] and bronze.filter("_ingested_at is null or not _source_file like '%ventas_colombia_raw%'").count() == 0
    assert runner.timed(lambda: bronze.select("total"), 2)["median_s"] > 0


def test_ordered_joins(spark):
    from lonja.operators.joins import asof_join, band_join

    a = frame(spark, [(1, 5), (1, 9), (None, 5), (2, None), (2, 1)], "k long, at long")
    b = frame(spark, [(1, 5, "x"), (1, 5, "y"), (1, 7, "z"), (2, 2, "w"), (None, 1, "n")], "k long, at long, v string")
    assert rows(asof_join(a, b, ["k"], "at", "at", ["v"])) == sorted([(1, 5, "y"), (1, 9, "z"), (None, 5, None), (2, None, None), (2, 1, None)], key=str)
    p, q = frame(spark, [(1, 0.0), (2, 9.9), (3, 10.0), (4, None)], "i long, x double"), frame(spark, [("a", 0.0, 10.0), ("b", 9.0, 30.0), ("c", 5.0, 5.0)], "b string, lo double, hi double")
    assert rows(band_join(p, q, "x", "lo", "hi", 7.0).select("i", "b")) == [(1, "a"), (2, "a"), (2, "b"), (3, "b")]


def test_quality_gates(spark):
    s = "pedido_id string, producto string, total double"
    quality.check_critical_nulls(frame(spark, [("a", "b", 1.0)] * 19 + [(None, "b", 1.0)], s), ["pedido_id", "producto", "total"])
    quality.check_critical_nulls(frame(spark, [], s), ["pedido_id"])
    with pytest.raises(ValueError, match="pedido_id"):
        quality.check_critical_nulls(frame(spark, [("a", "b", 1.0)] * 9 + [(None, "b", 1.0)], s), ["pedido_id"])
    with pytest.raises(ValueError, match="1 rows"):
        quality.check_positive(frame(spark, [("a", "b", 1.0), ("a", "b", -1.0), ("a", "b", None)], s), "total")
    assert quality.check_cardinality(frame(spark, [(str(i), "b", 1.0) for i in range(5)], s), "pedido_id", 4) == 5


def test_runner():
    tries = []

    def flaky(ctx):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return ctx["day"]

    def empty(ctx):
        raise runner.Skip

    out = runner.run_chain([runner.Task("a", flaky), runner.Task("b", lambda c: c["a"] + "!")], "2025-01-01", wait_s=0)
    assert out.results["b"] == "2025-01-01!" and len(tries) == 3
    skipped = runner.run_chain([runner.Task("a", empty), runner.Task("b", lambda c: 1), runner.Task("gold", lambda c: 2, always=True)], "2025-01-01")
    assert skipped.states == {"a": "skipped", "b": "skipped", "gold": "ok"}
    with pytest.raises(ZeroDivisionError):
        runner.run_chain([runner.Task("a", lambda c: 1 / 0)], "2025-01-01", wait_s=0)
    assert [r.day for r in runner.backfill([runner.Task("a", lambda c: 1)], "2025-01-30", "2025-02-01")] == ["2025-01-30", "2025-01-31", "2025-02-01"]


def test_messages_are_numbered_without_gaps(spark):
    from lonja.sources.sinks import as_messages

    df = spark.createDataFrame([(i, "a" if i % 3 else f"k{i % 7}") for i in range(500)], "id long, region string").withColumn("id", F.when(F.col("id") != 4, F.col("id")))
    got = as_messages(df, "region", "t", 4, "id", ranges=8).withColumn("id", F.get_json_object(F.col("value").cast("string"), "$.id").cast("long"))
    by = {}
    for r in got.collect():
        by.setdefault(r["partition"], []).append((r["offset"], -1 if r["id"] is None else r["id"]))
    assert sum(map(len, by.values())) == 500
    for rows_ in by.values():
        rows_.sort()
        assert [o for o, _ in rows_] == list(range(len(rows_))) and [i for _, i in rows_] == sorted(i for _, i in rows_)
    assert as_messages(df.limit(0), "region", "t", 4, "id").count() == 0


def test_partition_overwrite_keeps_every_month(spark, small):
    from lonja.plans import registry

    got = registry.queries()["snk4_partition_overwrite"](spark, small).agg(F.sum("n")).first()[0]
    assert got == spark.read.parquet(f"{small}/orders.parquet").count()


def test_consumer_reads_the_whole_topic(spark, small):
    from lonja.plans import registry

    got = [r["pedido_id"] for r in registry.queries()["stm7_at_least_once_consumer"](spark, small).collect()]
    log = spark.read.parquet(f"{small}/pedidos_ventas.parquet").filter("pedido_id is not null")
    assert sorted(got) == sorted(r[0] for r in log.select("pedido_id").distinct().collect()) and log.select("_kafka_partition").distinct().count() == 4
