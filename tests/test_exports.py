"""Exports read back, reviews, labels and cut-off flags on small rows."""

from pyspark.sql import functions as F

from wattline.functions import labels as L
from wattline.operators import phases as E
from wattline.operators import profiles as A
from wattline.operators.series import hysteresis, learned_baseline
from wattline.sources import exports as X


def test_export_and_import_replace_rows_of_a_key(spark, tmp_path):
    new = spark.createDataFrame([("a", 5, 1.5), ("c", 1, None)], "label string, seen long, avg_w double")
    X.export_all({"patterns": new}, str(tmp_path))
    old = spark.createDataFrame([("a", 2, 1.0), ("b", 9, 3.0)], "label string, seen long, avg_w double")
    got = X.import_all(spark, str(tmp_path), {"patterns": old}, {"patterns": ("label",)})["patterns"]
    assert sorted(tuple(r) for r in got.select("label", "seen", "avg_w").collect()) == [("a", 5, 1.5), ("b", 9, 3.0), ("c", 1, None)]


def test_review_bundle_keeps_limits_and_hides_names(spark):
    p = spark.createDataFrame([(f"My pump of {k}", float(k), 2.0, 3.0, k) for k in range(5)], "label string, avg_w double, peak_w double, duration_s double, seen long")
    e = spark.createDataFrame([(float(k), k) for k in range(9)], "start_s double, id long")
    got = X.review_bundle(p, e, e, (2, 3))
    assert {r.label for r in got["patterns"].collect()} == {"pump"} and got["patterns"].count() == 2
    assert [r.id for r in got["events"].orderBy("id").collect()] == [6, 7, 8] and "readings" not in got


def phased(spark, watts):
    rows = spark.createDataFrame([(1, i, float(i), float(w)) for i, w in enumerate(watts)], "cycle int, i int, t double, w double")
    df = A.profiles(rows, ("cycle",), F.col("t"), "i", "w").withColumn("avg_w", F.lit(sum(watts) / len(watts)))
    return E.event_phases(E.with_parts(A.with_baseline_delta(df)), ("cycle",)).orderBy("phase_index").collect()


def test_inrush_run_and_cooldown(spark):
    watts = [45.0] * 5 + [250.0] + [165.0] * 12 + [45.0] * 5
    got = phased(spark, watts)
    assert [r.kind for r in got] == ["baseline", "inrush", "steady_run", "cooldown"]
    run = got[2]
    assert run.delta_peak_w == 120.0 and run.start_s == 6.0 and run.end_s == 17.0 and got[1].delta_peak_w == 205.0


def test_flat_and_modulated_profiles(spark):
    assert phased(spark, [50.0] * 12) == []
    watts = [40.0] * 4 + [100.0, 300.0, 100.0, 300.0, 100.0, 300.0, 100.0, 300.0] + [40.0] * 4
    assert "modulated_run" in [r.kind for r in phased(spark, watts)]


def flags(spark, before, inside, after):
    rows = spark.createDataFrame([(before, inside, after)], "b array<struct<t:double,p:double>>, x array<struct<t:double,p:double>>, a array<struct<t:double,p:double>>")
    out = E.cut_off(F.col("b"), F.col("x"), F.col("a"), F.lit(1.0), F.lit(45.0), 30.0, 12.0, 20.0, 30.0)
    return tuple(rows.select(*(c.alias(n) for n, c in out.items())).first())


def test_cut_off_flags(spark):
    idle = [(float(t), 45.0) for t in range(20)]
    run = [(20.0 + t, p) for t, p in enumerate([200.0, 165.0, 160.0, 100.0, 60.0])]
    after = [(25.0 + t, 45.0) for t in range(30)]
    assert flags(spark, idle, run, after) == (False, False)
    assert flags(spark, [], run, after) == (True, False)
    assert flags(spark, [(19.0, 160.0)], run, after) == (True, False)
    assert flags(spark, idle, run, []) == (False, True)
    assert flags(spark, idle, [*run[:-1], (24.0, 46.0)], after[:2]) == (False, True)


def test_labels_without_text(spark):
    row = spark.createDataFrame([(None,), ("",)], "s string").select(
        L.forest_label(F.col("s")).alias("f"), L.inferred_label(F.col("s")).alias("i"), L.public_name(F.col("s"), F.col("s"), F.col("s")).alias("p"), F.size(L.signature_values(F.col("s"))).alias("n")
    )
    assert {tuple(r) for r in row.collect()} == {("unknown", "unknown", "unknown", 0)}


def test_a_scan_over_many_chunks_keeps_every_row(spark):
    df = spark.range(1000).selectExpr("1L user_id", "id event_id", "timestamp_micros(id * 1000000) ts", "cast(id % 7 as double) value")
    got = [r.corrected for r in learned_baseline(df, most=3).orderBy("event_id").collect()]
    assert len(got) == 1000 and got[:4] == [0.0, 1.0, 2.0, 3.0] and got[700:707] == [1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]


def test_a_switch_stays_on_for_its_least_time(spark):
    watts = [0.0, 50.0, 0.0, 0.0, 0.0, 0.0, 50.0, 0.0]
    df = spark.createDataFrame([(1, i, i, w) for i, w in enumerate(watts)], "user_id long, event_id long, s long, value double").selectExpr("user_id", "event_id", "timestamp_seconds(s) ts", "value")
    at = lambda least: [(int(r.t), r.state) for r in hysteresis(df, 40.0, 10.0, least_s=least).orderBy("t").collect()]
    assert at(0.0) == [(1, "on"), (2, "off"), (6, "on"), (7, "off")]
    assert at(3.0) == [(1, "on"), (4, "off"), (6, "on")]
