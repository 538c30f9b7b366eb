"""The general data problems on small frames: brute force, edge cases, skew."""

import datetime as dt
import random
import zoneinfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from lonja.operators.late_events import event_instant_us, late_corrected_sums, merge_states
from lonja.operators.profiling import cumulative_curves, departing_loads, ks_distances, profile_loads, quantiles, shifted_loads
from lonja.operators.redelivery import BloomFilter, DeliveryStore, kept_deliveries, repeated_deliveries
from lonja.operators.timestamps import normalise_timestamps

UTC = dt.timezone.utc


def us(*a, tz="UTC"):
    return int((dt.datetime(*a, tzinfo=zoneinfo.ZoneInfo(tz)) - dt.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1e6)


BOG, MAD, NYC = "America/Bogota", "Europe/Madrid", "America/New_York"
CASES = [
    ("2025-01-20T04:59:56Z", BOG, "DMY", us(2025, 1, 20, 4, 59, 56)),
    ("2025-01-20T04:59:56.123456Z", BOG, "DMY", us(2025, 1, 20, 4, 59, 56) + 123456),
    (" 03/04/2025 10:00 ", BOG, "DMY", us(2025, 4, 3, 10, tz=BOG)),
    ("03/04/2025", NYC, "MDY", us(2025, 3, 4, tz=NYC)),
    ("25/01/2025 12:17:36 a. m.", BOG, "DMY", us(2025, 1, 25, 0, 17, 36, tz=BOG)),
    ("01/25/2025 12:17:36 PM", NYC, "MDY", us(2025, 1, 25, 12, 17, 36, tz=NYC)),
    ("7 de febrero de 2025", MAD, "DMY", us(2025, 2, 7, tz=MAD)),
    ("Feb 7, 2025", NYC, "MDY", us(2025, 2, 7, tz=NYC)),
    ("27-ene-2025 12:19", BOG, "DMY", us(2025, 1, 27, 12, 19, tz=BOG)),
    ("Wed, 29 Jan 2025 01:39:09 -0500", MAD, "DMY", us(2025, 1, 29, 6, 39, 9)),
    ("2025-01-29 05:36:50 CLST", BOG, "DMY", us(2025, 1, 29, 8, 36, 50)),
    ("2025-01-29 05:36:50 America/New_York", BOG, "DMY", us(2025, 1, 29, 5, 36, 50, tz=NYC)),
    ("2025-01-24 20:40:00,930819 -05:00", MAD, "DMY", us(2025, 1, 25, 1, 40) + 930819),
    ("20250129T130738Z", BOG, "DMY", us(2025, 1, 29, 13, 7, 38)),
    ("20250129130738", BOG, "DMY", us(2025, 1, 29, 13, 7, 38, tz=BOG)),
    ("20250129", BOG, "DMY", us(2025, 1, 29, tz=BOG)),
    ("1738034921", BOG, "DMY", 1738034921 * 10**6),
    ("1738265804964", BOG, "DMY", 1738265804964 * 1000),
    ("45681", BOG, "DMY", us(2025, 1, 24, tz=BOG)),
    ("1969-06-01", BOG, "DMY", us(1969, 6, 1, tz=BOG)), ("01/06/2041", BOG, "DMY", us(2041, 6, 1, tz=BOG)), ("2041-07-01 10:00", MAD, "DMY", us(2041, 7, 1, 10, tz=MAD)), ("1850-01-01", BOG, "DMY", us(1850, 1, 1, tz=BOG)),
    ("1944-07-01 10:00", MAD, "DMY", us(1944, 7, 1, 10, tz=MAD)), ("2530-12-31 23:00", NYC, "MDY", us(2530, 12, 31, 23, tz=NYC)), ("2301-07-04 08:00", NYC, "MDY", us(2301, 7, 4, 8, tz=NYC)), ("1500-01-01", MAD, "DMY", us(1500, 1, 1, tz=MAD)),
    ("2400-03-26 02:30:00", MAD, "DMY", "never"), ("2400-10-29 02:30:00", MAD, "DMY", "twice"), ("99999", BOG, "DMY", us(2173, 10, 13, tz=BOG)),
    ("2025-10-26 02:30:00", MAD, "DMY", "twice"),
    ("2025-03-30 02:30:00", MAD, "DMY", "never"),
    ("31/02/2025", BOG, "DMY", "unreadable"), ("2025-13-01", BOG, "DMY", "unreadable"), ("ayer", BOG, "DMY", "unreadable"), ("semana 14", BOG, "DMY", "unreadable"),
    ("2025-01-01 25:00:00", BOG, "DMY", "unreadable"), ("2025-01-01", None, "DMY", "unreadable"), ("03/04/2025", BOG, None, "unreadable"), ("x" * 100_000, BOG, "DMY", "unreadable"),
    ("", BOG, "DMY", "missing"), (None, BOG, "DMY", "missing"), ("2025-01-20T04:59:56Z", None, None, us(2025, 1, 20, 4, 59, 56)),
]


def test_timestamps(spark):
    # Columns with clashing names change nothing.
    rows = [(i, v, z, o, "x", "y") for i, (v, z, o, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id long, v string, z string, o string, status string, t string")
    got = {r["id"]: (r["instant_us"], r["status"]) for r in normalise_timestamps(df, "id", "v", "z", "o").collect()}
    for i, (v, _, _, want) in enumerate(CASES):
        assert got[i] == ((None, want) if isinstance(want, str) else (want, "ok")), v
    assert normalise_timestamps(df.limit(0), "id", "v", "z", "o").count() == 0
    assert normalise_timestamps(df.union(df), "id", "v", "z", "o").count() == 2 * len(CASES)


def test_intervals_against_the_zone_database(spark):
    rng, rows = random.Random(9), []
    for name in (BOG, MAD, NYC, "America/Santiago", "Africa/Casablanca", "Australia/Lord_Howe", "Asia/Kathmandu", "UTC"):
        for _ in range(60):
            at = dt.datetime(rng.randint(1800, 2300), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.choice([0, 30]))
            rows.append((len(rows), at.isoformat(sep=" ", timespec="seconds"), name, "DMY"))
    got = {r["id"]: r for r in normalise_timestamps(spark.createDataFrame(rows, "id long, v string, z string, o string"), "id", "v", "z", "o").collect()}
    for i, v, name, _ in rows:
        local, zone = dt.datetime.fromisoformat(v), zoneinfo.ZoneInfo(name)
        utc = {local.replace(tzinfo=zone, fold=f).astimezone(UTC) for f in (0, 1)}
        real = {u for u in utc if u.astimezone(zone).replace(tzinfo=None) == local}
        want = {0: "never", 1: "ok", 2: "twice"}[len(real)]
        assert got[i]["status"] == want, (v, name)
        if want == "ok":
            assert got[i]["instant_us"] == (real.pop() - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(microseconds=1), (v, name)


def deliveries(spark, rows):
    return spark.createDataFrame(rows, "id long, m string, t timestamp, key string, bucket int")


@pytest.mark.parametrize("buckets", [32, 3])
def test_redelivery(spark, buckets):
    rng, t0 = random.Random(5), dt.datetime(2026, 1, 1)
    ids = [f"{rng.getrandbits(128):032x}" for _ in range(300)]
    rows = []
    for i in range(1, 1201):
        m = ids[0] if i % 3 == 0 else rng.choice(ids)
        m = rng.choice([m, m.upper(), "{" + m + "} ", m[:8] + "-" + m[8:]])
        rows.append((i, rng.choice([m, m, m, m, None]), rng.choice([t0 + dt.timedelta(hours=i), None]), "k", 1))
    rows += [(2000, "--", t0, "k", 1), (2001, "--", t0, "k", 1), rows[5]]
    df = deliveries(spark, rows)
    first, gone = {}, set()
    for i, m, *_ in sorted(rows, key=lambda r: r[0]):
        k = "".join(c for c in (m or "").lower() if c in "0123456789abcdef")
        if k and first.setdefault(k, i) != i:
            gone.add(i)
    got = repeated_deliveries(df, "id", "m", "t", max_buckets=buckets).collect()
    assert sorted(r["id"] for r in got) == sorted(gone)
    assert kept_deliveries(df, "id", "m", "t", max_buckets=buckets).count() == len(rows) - len(gone) - (rows[5][0] in gone)
    assert repeated_deliveries(df.limit(0), "id", "m", "t").count() == 0


def test_redelivery_with_a_full_bucket_and_a_hot_message(spark):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, f"{i:08x}", t0 if i % 2 else t0 + dt.timedelta(days=i % 31)) for i in range(1, 4001)]
    rows += [(5000 + i, "ABCDEF", t0) for i in range(2000)] + [(8000, f"{17:08X}", t0 + dt.timedelta(days=40)), (8001, f"{18:08x}", None)]
    df = spark.createDataFrame(rows, "id long, m string, t timestamp").repartition(3).withColumn("__kept", F.lit("clash")).withColumn("kept", F.lit(1))
    want = {*range(5001, 7000), 8000, 8001}
    assert {r["id"] for r in repeated_deliveries(df, "id", "m", "t").collect()} == want
    kept = kept_deliveries(df, "id", "m", "t")
    assert kept.columns == df.columns and {r["id"] for r in kept.collect()} == {r[0] for r in rows} - want


def test_bloom_filter():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, 5000)
    f = BloomFilter(h)
    assert len(f.hit(h)) == 5000 and len(f.hit(rng.integers(-(2**63), 2**63 - 1, 20000))) < 200 and len(f.hit(h, twice=True)) < 100
    assert len(BloomFilter(np.r_[h, h[:10]]).hit(h[:10], twice=True)) == 10
    assert len(BloomFilter.unpacked(f.packed()).hit(h)) == 5000 and BloomFilter.unpacked(f.packed()).mask == f.mask
    # The work and the filter follow the rows.
    assert len(BloomFilter(h[:50]).once) == 1024


def test_a_new_batch_reads_matching_buckets_only(spark):
    from lonja.sources.storage import scratch_dir

    t0 = dt.datetime(2026, 1, 1)
    store = DeliveryStore(spark, scratch_dir(spark), shards=4)
    one = deliveries(spark, [(i, f"{i:06x}", t0 + dt.timedelta(days=i % 20), "k", 1) for i in range(1, 201)] + [(300, "00000A", t0, "k", 1)])
    assert [tuple(r) for r in store.take(one, "id", "m", "t", 0).collect()] == [(300, 10)]
    two = deliveries(spark, [(400, "{00000B}", t0 + dt.timedelta(days=50), "k", 1), (401, "ffff01", t0, "k", 1), (402, "FFFF01", t0, "k", 1), (403, None, t0, "k", 1)])
    for _ in range(2):  # a batch that comes again changes nothing
        assert sorted(tuple(r) for r in store.take(two, "id", "m", "t", 1).collect()) == [(400, 11), (402, 401)]
    first_day = int(t0.replace(tzinfo=UTC).timestamp()) // 86400
    assert first_day + 11 in store.read_buckets and len(store.read_buckets) <= 3
    three = deliveries(spark, [(500, "ffff01", t0, "k", 1)])
    assert [tuple(r) for r in store.take(three, "id", "m", "t", 2).collect()] == [(500, 401)]
    assert store.take(deliveries(spark, []), "id", "m", "t", 3).count() == 0


def test_late_events(spark):
    hour = "2026-01-31T05:10:00.500Z"
    at = dt.datetime(2026, 1, 31, 6, 0)
    rows = [
        (hour, at + dt.timedelta(minutes=10), "A", 1.0, 0, 1), (hour, at + dt.timedelta(minutes=10, microseconds=1), "A", 2.0, 0, 2), (hour, at + dt.timedelta(hours=24), "A", None, 1, 2),
        (hour, at + dt.timedelta(hours=24, microseconds=1), "A", 8.0, 1, 3), ("2026-01-31T00:10:00-05:00", at, "A", 16.0, None, None), (None, at, "A", 1.0, 0, 1), ("pronto", at, "A", 1.0, 0, 1),
        (hour, None, "A", 1.0, 0, 1), (hour, at, None, 1.0, 0, 1), (hour, at + dt.timedelta(days=3), "B", 5.0, 0, 9),
    ]
    df = spark.createDataFrame(rows, "e string, a timestamp, g string, x double, s int, q long").withColumn("p", F.lit("clash"))
    got = {r["grupo"]: r for r in late_corrected_sums(df, "e", "a", "g", "x", "s", "q").collect()}
    a, b = got["A"], got["B"]
    assert (a["periodo"], a["suma_inicial"], a["n_inicial"], a["suma"], a["n"], a["n_tarde"], a["n_fuera"]) == ("2026-01-31T05:00:00Z", 17.0, 2, 19.0, 4, 2, 1)
    assert (b["suma"], b["n"], b["n_tarde"], b["n_fuera"]) == (0.0, 0, 0, 1)
    assert late_corrected_sums(df.limit(0), "e", "a", "g", "x", "s", "q").count() == 0


def test_merging_states_is_idempotent(spark):
    s = spark.createDataFrame([(1, "A", "x", 1, 5.0, 2), (1, "A", "x", 2, 7.0, 3), (1, "A", "y", 1, 1.0, 1)], "p int, g string, s string, version int, total double, records long")
    want = merge_states(s, "p", "g", "s").collect()
    assert want[0]["total"] == 8.0
    assert merge_states(s.union(s).orderBy(F.rand(3)).union(s.filter("version = 1")), "p", "g", "s").collect() == want


def test_event_instant(spark):
    df = spark.createDataFrame([("2026-01-04T19:00:01.687-05:00",), ("2026-01-05 00:00:01Z",), ("2026-01-05",), ("2026-02-30T00:00:00Z",), (None,)], "t string")
    got = [r[0] for r in df.select(event_instant_us(F.col("t"))).collect()]
    assert got == [us(2026, 1, 5, 0, 0, 1) + 687000, us(2026, 1, 5, 0, 0, 1), None, None, None]


def test_curves_against_brute_force(spark):
    rng = random.Random(1)
    data = [(c, load, float(rng.choice([0, 1, 2, 3, rng.randint(0, 500)]) + 5 * load)) for c in "ab" for load in range(4) for _ in range(200 if load else 5)]
    counts = spark.createDataFrame(data, "columna string, carga long, x double").groupBy("columna", "carga", "x").agg(F.count("*").alias("n"))
    curves = cumulative_curves(counts, "x", partitions=7)
    ks = {(r["columna"], r["carga"]): r["ks"] for r in ks_distances(curves).collect()}
    q = {(r["columna"], r["carga"]): r for r in quantiles(curves, "x", {"m": 0.5}).collect()}
    for c in "ab":
        for load in range(4):
            mine, rest = sorted(x for k, i, x in data if k == c and i == load), [x for k, i, x in data if k == c and i != load]
            points = {x for k, _, x in data if k == c}
            want = max(abs(sum(v <= p for v in mine) / len(mine) - sum(v <= p for v in rest) / len(rest)) for p in points)
            assert ks[c, load] == pytest.approx(want)
            assert q[c, load]["m"] == mine[-(-len(mine) // 2) - 1] and q[c, load]["distintos_num"] == len(set(mine))


def test_departing_loads(spark):
    rng, rows = random.Random(2), []
    for load in range(1, 9):
        for k in range(120 if load != 8 else 4):
            amount = f"{rng.randint(10_000, 99_999)}.0"
            mail = f"a{rng.randint(1, 9999)}@x.test"
            if load == 3 and k % 5 < 2:
                amount = None
            if load == 5 and k % 3 == 0:
                mail = "nadie@x.test"
            if load == 6 and k % 2:
                amount = "-" + amount
            if load == 8 and k == 0:
                amount = ""
            rows.append((load, amount, mail, "z"))
    df = spark.createDataFrame(rows, "carga long, total string, correo string, columna string")
    got = {(r["carga"], r["columna"]) for r in departing_loads(df, "carga", ["total", "correo"]).collect()}
    assert got == {(3, "total"), (6, "total"), (5, "correo")}
    assert departing_loads(df.limit(0), "carga", ["total"]).count() == 0
    assert departing_loads(df.filter("carga = 3"), "carga", ["total"]).count() == 0
    p = {(r["carga"], r["columna"]): r for r in profile_loads(df, "carga", {"total": "numeric", "correo": "email"}).collect()}
    assert p[3, "total"]["nulos"] == 48 and p[8, "total"]["nulos"] == 1 and p[5, "correo"]["violaciones"] == 0
    assert p[6, "total"]["ks"] > 0.4 and p[5, "correo"]["ks"] > 0.3 and p[5, "correo"]["maximo_texto"] == "nadie@x.test"


def test_shifted_loads(spark):
    rng = random.Random(3)
    rows = [(load, str(rng.randint(20, 30 if load == 4 else 99)), f"{rng.randint(1, 9)}v") for load in range(1, 9) for _ in range(300)] + [(9, None, ""), (None, "50", "5v")]
    df = spark.createDataFrame(rows, "carga long, total string, vendedor string").withColumn("columna", F.lit("clash"))
    kinds = {"total": "numeric", "vendedor": "text"}
    got = [(r["carga"], r["columna"], r["ks"]) for r in shifted_loads(df, "carga", kinds).collect()]
    assert [x[:2] for x in got] == [(4, "total")] and got[0][2] > 0.8
    # Nothing is rare in it, so it is no departure.
    assert departing_loads(df, "carga", ["total", "vendedor"]).filter("carga = 4").count() == 0
    p = {(r["carga"], r["columna"]): r for r in profile_loads(df, "carga", kinds).collect()}
    assert p[4, "total"]["ks"] == pytest.approx(got[0][2]) and p[9, "total"]["ks"] is None and p[9, "vendedor"]["nulos"] == 1 and p[None, "total"]["mediana"] == 50.0
    assert shifted_loads(df.limit(0), "carga", kinds).count() == 0 and profile_loads(df.limit(0), "carga", kinds).count() == 0


def test_departing_loads_do_not_hide_each_other(spark):
    rng, rows = random.Random(6), []
    for load in range(1, 13):
        for k in range(3300 if load == 1 else 600):
            odd = {1: 0.7, 2: 0.4, 3: 0.19}.get(load, 0.02)
            rows.append((load, None if rng.random() < odd else f"{rng.randint(10_000, 99_999)}.0"))
    df = spark.createDataFrame(rows, "carga long, total string")
    assert {r["carga"] for r in departing_loads(df, "carga", ["total"]).collect()} == {1, 2, 3}


def test_late_counts_come_from_the_merged_counters(spark):
    df = spark.createDataFrame([], "e string, a timestamp, g string, x double, s int, q long")
    late = late_corrected_sums(df, "e", "a", "g", "x", "s", "q").filter("n_tarde > 0").select("periodo", "grupo")
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "max(struct(version" in plan
