"""Curves, scalars, learning, sources and sinks on small inputs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from wattline.functions import curves as V
from wattline.functions import scalars as S
from wattline.operators import learning as L
from wattline.operators import series as R
from wattline.sources import exports, readings


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalars(spark):
    texts = ["12,5", "3.5", "x", "", None, "NaN", "inf"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(S.safe_float(F.col("t"), -1.0)).collect()] == [12.5, 3.5, -1.0, -1.0, -1.0, -1.0, -1.0]
    labels = spark.createDataFrame([("fridge",), ("My washing machine",), ("Oma Erna",), ("unknown_x",), (None,)], "l string")
    assert [r[0] for r in labels.select(S.public_label(F.col("l"))).collect()] == ["fridge", "washing_machine", "custom_user_label", "unknown", "unknown"]
    r = one(spark, S.rel(F.lit(0.2), F.lit(0.4)).alias("small"), S.rel(F.lit(100.0), F.lit(50.0)).alias("half"), S.parse_power(F.lit("12,5 W")).alias("w"), S.parse_power(F.lit("unavailable")).alias("n"), S.circular_hours(F.lit(23.0), F.lit(1.0)).alias("h"))
    assert (r.small, r.half, r.w, r.n, r.h) == (pytest.approx(0.2), 0.5, 12.5, None, 2.0)


def model_dtw(a, b, band=6):
    n = len(a)
    d = [[math.inf] * (n + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(1, n + 1):
        for j in range(1, n + 1):
            if abs(i - j) <= band:
                d[i][j] = abs(a[i - 1] - b[j - 1]) + min(d[i - 1][j], d[i][j - 1], d[i - 1][j - 1])
    mean = (sum(map(abs, a)) + sum(map(abs, b))) / (2 * n)
    return max(0.0, 1 - d[n][n] / (max(80.0, mean) * n))


def test_curves(spark):
    a, b = [float(10 * k % 170) for k in range(20)], [float(13 * k % 150) for k in range(20)]
    x, y = F.array(*map(F.lit, a)), F.array(*map(F.lit, b))
    r = one(spark, V.dtw(x, y).alias("dtw"), V.dtw(x, x).alias("same"), V.cosine(x, x).alias("cos"), V.euclidean(x, x).alias("euc"), V.resample(x, 39).alias("up"), V.resample(F.array().cast("array<double>"), 3).alias("none"), V.median(y).alias("m"), V.upper_median(y).alias("u"))
    assert r.dtw == pytest.approx(model_dtw(a, b)) and r.same == 1.0 and r.cos == pytest.approx(1.0) and r.euc == 1.0
    assert r.up[::2] == pytest.approx(a) and r.up[1] == pytest.approx((a[0] + a[1]) / 2) and r.none == [0.0] * 3
    assert r.m == (sorted(b)[9] + sorted(b)[10]) / 2 and r.u == sorted(b)[10]
    levels = one(spark, V.cluster_levels(F.array(*map(F.lit, [10.0, 11.0, 50.0, 52.0, 200.0])), 5.0).alias("l")).l
    assert levels == [10.5, 51.0, 200.0]
    points = F.array(*(F.struct(F.lit(t).alias("t_norm"), F.lit(p).alias("power_w")) for t, p in ((0.0, 0.0), (0.5, 100.0), (1.0, 0.0))))
    assert one(spark, V.resample_by_time(points, 5).alias("r")).r == [0.0, 50.0, 100.0, 50.0, 0.0]
    rising, wave = [float(k) for k in range(30)], [100 * (1 + 0.6 * math.sin(k)) for k in range(30)]
    r = one(spark, V.rising_start(F.array(*map(F.lit, rising))).alias("h"), V.oscillates(F.array(*map(F.lit, wave))).alias("m"), V.oscillates(F.array(*map(F.lit, [5.0] * 30))).alias("f"))
    assert r.h and r.m and not r.f


def cycles(spark, rows):
    return spark.createDataFrame(rows, "user_id long, cycle long, phase string, label string, avg_w double, peak_w double, duration_s double, energy_wh double, variance double, duty double, start_s double, end_s double")


def test_learning(spark):
    patterns = spark.createDataFrame([("L1", "pump", 4, 100.0, 60.0, 2.0, 1.0, 0.5, 120.0, 0.0, 60.0)], "phase string, label string, seen long, avg_w double, duration_s double, energy_wh double, variance double, duty double, peak_w double, first_s double, last_s double")
    new = cycles(spark, [(1, 1, "L1", "other", 100.0, 120.0, 60.0, 2.0, 1.0, 0.5, 100.0, 160.0), (1, 2, "L1", "kettle", 2000.0, 2100.0, 90.0, 50.0, 4.0, 0.9, 300.0, 390.0)])
    got = {r.label: (r.seen, r.avg_w, r.last_s) for r in L.learn(patterns, new).collect()}
    assert got == {"pump": (5, 100.0, 160.0), "kettle": (1, 2000.0, 390.0)}
    done, waiting = L.promoted(L.learn(patterns, new))
    assert [r.label for r in done.collect()] == ["pump"] and [r.label for r in waiting.collect()] == ["kettle"]
    many = cycles(spark, [(1, k, "L1", "x", w, w, 60.0, 2.0, 1.0, 0.5, 0.0, 1.0) for k, w in enumerate((100.0, 101.0, 300.0, 302.0, 900.0))])
    assert sorted((r.cycle, r.into) for r in L.merge_plan(many, "phase", "cycle", 0.05).collect()) == [(1, 0), (3, 2)]
    modes = F.array(*(F.struct(F.lit(w).alias("avg_w"), F.lit(60.0).alias("duration_s"), F.lit(w).alias("peak_w")) for w in (100.0, 500.0, 104.0)))
    found = one(spark, L.operating_modes(modes).alias("m")).m
    assert [(m.avg_w, m.seen) for m in found] == [(102.0, 2), (500.0, 1)]


def test_edges_and_segments(spark):
    watts = [40] * 10 + [300] * 5 + [40] * 5 + [310] * 4
    df = spark.createDataFrame([(1, k, 1_000_000 + k, float(w)) for k, w in enumerate(watts)], "user_id long, event_id long, s long, value double").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = [(r.start_s - 1_000_000, r.end_s - 1_000_000) for r in L.edge_cycles(df, 100.0, 30.0, 90.0, R.EVENTS).orderBy("start_s").collect()]
    assert got == [(10.0, 15.0), (20.0, 23.0)]
    segments = L.segment_modes(df, ("user_id",), R.EVENTS).orderBy("segment").collect()
    assert segments[0].kind == "standby" and any(s.kind == "operating" for s in segments) and sum(s.n for s in segments) <= len(watts)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps({"readings": [{"ts": 1, "value": "12,5"}, {"ts": 2, "value": "-3"}, {"ts": 3, "value": "x"}], "patterns": [{"id": "a"}]}))
    found, patterns = readings.read_json(spark, str(tmp_path / "in.json"))
    assert [(r.t, r.power_w) for r in readings.named_readings(found).orderBy("t").collect()] == [(1.0, 12.5), (2.0, 0.0)] and patterns.count() == 1
    df = spark.createDataFrame([(1, [1.0, 2.0], "a")], "id long, levels array<double>, name string")
    exports.write_csv(df, str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [("1", "1.0|2.0", "a")]
    exports.write_json_lines(df, str(tmp_path / "jsonl"))
    assert spark.read.json(str(tmp_path / "jsonl")).first().name == "a"
    rows = spark.sql("SELECT 1L AS event_id, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS ts UNION ALL SELECT 2L, TIMESTAMP_NTZ '2024-01-02 10:00:00'")
    exports.append_readings(rows, str(tmp_path / "table"))
    stored = spark.read.parquet(str(tmp_path / "table"))
    assert stored.where("day = '2024-01-02'").count() == 1 and exports.import_readings(rows, stored, ("event_id",)).count() == 0
    sim = readings.simulate(spark.createDataFrame([("p", [5.0, 6.0], 2)], "pattern_id string, profile array<double>, seen int"))
    assert sim.count() == 2 * (20 + 2 + 8) and sim.agg(F.max("power_w")).first()[0] == 96.0
    entities = spark.createDataFrame([("sensor.power_total", "power", "W"), ("sensor.temp", "temperature", "C"), ("sensor.house", "power", "kW")], "entity_id string, device_class string, unit string")
    assert readings.discover_entity(entities).first().entity_id == "sensor.power_total" and readings.discover_entity(entities, "sensor.house").first().entity_id == "sensor.house"
