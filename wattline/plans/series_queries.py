"""Registered queries over the events table as readings: (Spark query, SQL) by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.functions import scalars as S
from wattline.operators import cycles as C
from wattline.operators import patterns as P
from wattline.operators import series as R

E = R.EVENTS
ON, OFF = 300.0, 150.0  # watts of the switch in these queries
HOUR = 3600.0
#: Readings lie hours apart in the events table, so seconds of the rules are scaled by this where a query needs them.
SCALE = 600.0

T = "epoch_us(ts) / 1e6"
W = "PARTITION BY user_id ORDER BY ts, event_id"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@query("w01_moving_average", f"SELECT event_id, user_id, round(avg(value) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM events")
def w01(spark, sf_dir):
    return R.moving_average(events(spark, sf_dir)).select("event_id", "user_id", *r6("smoothed"))


@query("w02_noise_gate", f"""SELECT event_id, round(CASE WHEN abs(a - value) <= 20 THEN a ELSE value END, 6) AS filtered
FROM (SELECT *, avg(value) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a FROM events)""")
def w02(spark, sf_dir):
    return R.noise_gate(events(spark, sf_dir), most=20.0).select("event_id", *r6("filtered"))


@query("w03_learned_baseline", f"""WITH RECURSIVE s AS (SELECT event_id, user_id, value, row_number() OVER ({W}) AS rn FROM events),
f AS (SELECT user_id, event_id, rn, value, CASE WHEN value <= 200.0 THEN value ELSE 0.0 END AS base, CASE WHEN value <= 200.0 THEN 1 ELSE 0 END AS n FROM s WHERE rn = 1
UNION ALL SELECT s.user_id, s.event_id, s.rn, s.value, CASE WHEN s.value <= f.base + 200.0 AND f.n < 50 THEN f.base + (s.value - f.base) / (f.n + 1) ELSE f.base END,
CASE WHEN s.value <= f.base + 200.0 AND f.n < 50 THEN f.n + 1 ELSE f.n END FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1)
SELECT event_id, user_id, round(greatest(value, base), 6) AS corrected, round(base, 6) AS baseline FROM f""")
def w03(spark, sf_dir):
    return R.learned_baseline(events(spark, sf_dir), band=200.0).select("event_id", "user_id", *r6("corrected", "baseline"))


@query("w04_median_filter", f"""SELECT event_id, round(CASE WHEN count(value) OVER w < 3 THEN avg(value) OVER w ELSE median(value) OVER w END, 6) AS filtered
FROM events WINDOW w AS ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def w04(spark, sf_dir):
    return R.median_filter(events(spark, sf_dir)).select("event_id", *r6("filtered"))


@query("w06_primed_baseline", f"""WITH s AS (SELECT user_id, value, row_number() OVER ({W}) AS rn FROM events),
v AS (SELECT user_id, list_sort(list(value)) AS v FROM s WHERE rn <= 60 GROUP BY user_id) SELECT user_id, v[len(v) // 2 + 1] AS baseline, CAST(len(v) AS BIGINT) AS n_seed FROM v""")
def w06(spark, sf_dir):
    return R.primed_baseline(events(spark, sf_dir))


DIFF = f"""SELECT *, coalesce({T} - lag({T}) OVER ({W}), 0.0) AS dt, coalesce(value - lag(value) OVER ({W}), 0.0) AS dp FROM events"""


@query("w07_differences", f"SELECT event_id, round(dt, 6) AS dt, round(dp, 6) AS dp, round(CASE WHEN dt > 0 THEN dp / dt ELSE 0.0 END, 9) AS dpdt FROM ({DIFF})")
def w07(spark, sf_dir):
    return R.differences(events(spark, sf_dir)).select("event_id", *r6("dt", "dp"), F.round("dpdt", 9).alias("dpdt"))


@query("w08_start_signals", f"""WITH d AS ({DIFF}), s AS (SELECT event_id, value - 100.0 >= 250.0 AS by_delta, (CASE WHEN dt > 0 THEN dp / dt ELSE 0.0 END) >= 0.05 AS by_slope, dp >= 180.0 AS by_step,
value / 100.0 >= 2.5 AND (CASE WHEN dt > 0 THEN dp / dt ELSE 0.0 END) >= 0 AS by_inrush FROM d)
SELECT *, CAST(by_delta AS INT) + CAST(by_slope AS INT) + CAST(by_step AS INT) + CAST(by_inrush AS INT) AS n_signals,
by_delta OR by_slope OR CAST(by_delta AS INT) + CAST(by_slope AS INT) + CAST(by_step AS INT) + CAST(by_inrush AS INT) >= 2 AS starts FROM s""")
def w08(spark, sf_dir):
    out = R.start_signals(events(spark, sf_dir), F.lit(100.0), delta_on=250, slope=0.05, step=180, inrush=2.5)
    return out.select("event_id", "by_delta", "by_slope", "by_step", "by_inrush", "n_signals", "starts")


@query("w10_cycle_transitions")
def w10(spark, sf_dir):
    base = P_BASE(events(spark, sf_dir))
    rules = C.CycleRules(delta_on=200, delta_off=80, slope=0.05, step=150, inrush=3.0, spread=60, shutdown=0.05, debounce=1, grace_s=HOUR, hold_s=2 * HOUR)
    return C.cycle_transitions(base, "base_w", rules)


def P_BASE(df: DataFrame) -> DataFrame:
    """Each reading with its series' 20th percentile as baseline."""
    return df.withColumn("base_w", F.percentile("value", F.lit(0.2)).over(Window.partitionBy("user_id")))


@query("w20_offline_events")
def w20(spark, sf_dir):
    return C.offline_events(events(spark, sf_dir), threshold=100.0, least_s=HOUR)


@query("w21_merge_gaps")
def w21b(spark, sf_dir):
    return C.merge_gaps(w20(spark, sf_dir), gap_s=12 * HOUR)


GAPS = f"""SELECT *, sum(new) OVER ({W} ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, {T} AS t, CASE WHEN {T} - lag({T}) OVER ({W}) <= 7200 THEN 0 ELSE 1 END AS new FROM events)"""


@query("w21_gap_sessions", f"SELECT user_id, CAST(session AS BIGINT) AS session, min(t) AS start_s, max(t) AS end_s, count(*) AS n, round(avg(value), 6) AS avg_w FROM ({GAPS}) GROUP BY user_id, session")
def w21(spark, sf_dir):
    return R.gap_sessions(events(spark, sf_dir), 2 * HOUR).select("user_id", "session", "start_s", "end_s", "n", *r6("avg_w"))


@query("w24_device_power", f"SELECT event_id, round(least(greatest(value - min(value) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 0.0), 400.0), 6) AS device_w FROM events")
def w24(spark, sf_dir):
    return R.device_power(events(spark, sf_dir)).select("event_id", *r6("device_w"))


@query("w25_recent_stats", """SELECT event_id, round(avg(value) OVER w, 6) AS avg_w, max(value) OVER w AS max_w, min(value) OVER w AS min_w, count(*) OVER w AS n_recent
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""")
def w25(spark, sf_dir):
    return R.recent_stats(events(spark, sf_dir), 24 * HOUR).select("event_id", *r6("avg_w"), "max_w", "min_w", "n_recent")


@query("w28_steadiness", f"""SELECT event_id, round(var_pop(value) OVER w, 6) AS variance, count(*) OVER w = 5 AND var_pop(value) OVER w < 9000 AS stable, coalesce(value > lag(value, 2) OVER ({W}), false) AS rising
FROM events WINDOW w AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def w28(spark, sf_dir):
    return R.steadiness(events(spark, sf_dir), most=9000.0).select("event_id", F.round("variance", 6).alias("variance"), "stable", "rising")


@query("w30_window_slope")
def w30(spark, sf_dir):
    return R.window_slope(events(spark, sf_dir), 12 * HOUR).select("event_id", F.round("slope", 9).alias("slope"))


STATE = "CASE WHEN value < 50 THEN 'idle' WHEN value < 300 THEN 'low' WHEN value < 1000 THEN 'medium' ELSE 'high' END"
RUNS = f"""SELECT user_id, CAST(island AS BIGINT) AS island, state, min(t) AS start_s, max(t) AS end_s, max(value) AS peak_w, avg(value) AS avg_w, count(*) AS n FROM (
SELECT *, sum(CASE WHEN state = prev THEN 0 ELSE 1 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, {T} AS t, {STATE} AS state, lag({STATE}) OVER ({W}) AS prev FROM events)) GROUP BY user_id, island, state"""


@query("w32_state_runs", f"SELECT user_id, island, state, start_s, end_s, peak_w, round(avg_w, 6) AS avg_w, n, end_s - start_s AS duration_s FROM ({RUNS})")
def w32(spark, sf_dir):
    return R.state_runs(events(spark, sf_dir), S.power_state(F.col("value"))).select("user_id", "island", "state", "start_s", "end_s", "peak_w", *r6("avg_w"), "n", "duration_s")


@query("w32_state_summary", f"""SELECT user_id, string_agg(state, '>' ORDER BY island) AS sequence, count(*) AS n_runs, round(avg(avg_w), 6) AS mean_of_means,
{", ".join(f"round(sum(CASE WHEN state = '{v}' THEN end_s - start_s ELSE 0.0 END), 3) AS {v}_s" for v in ("idle", "low", "medium", "high"))} FROM ({RUNS}) GROUP BY user_id""")
def w32s(spark, sf_dir):
    out = R.state_summary(R.state_runs(events(spark, sf_dir), S.power_state(F.col("value"))))
    return out.select("user_id", "sequence", "n_runs", *r6("mean_of_means"), *(F.round(f"{v}_s", 3).alias(f"{v}_s") for v in ("idle", "low", "medium", "high")))


SWITCH = f"""s AS (SELECT event_id, user_id, value, {T} AS t, row_number() OVER ({W}) AS rn FROM events),
f AS (SELECT user_id, event_id, rn, t, value >= {ON} AS on_now, false AS was FROM s WHERE rn = 1
UNION ALL SELECT s.user_id, s.event_id, s.rn, s.t, CASE WHEN f.on_now THEN s.value > {OFF} ELSE s.value >= {ON} END, f.on_now FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1)"""


@query("w33_hysteresis", f"WITH RECURSIVE {SWITCH} SELECT user_id, t, event_id, CASE WHEN on_now THEN 'on' ELSE 'off' END AS state FROM f WHERE on_now <> was")
def w33(spark, sf_dir):
    return R.hysteresis(events(spark, sf_dir), ON, OFF)


@query("w34_daily_counters", f"""WITH RECURSIVE {SWITCH} SELECT user_id, CAST(make_timestamp(CAST(t * 1e6 AS BIGINT)) AS DATE) AS day, count(*) FILTER (WHERE on_now) AS starts, count(*) AS changes
FROM f WHERE on_now <> was GROUP BY user_id, day""")
def w34(spark, sf_dir):
    return R.daily_counters(w33(spark, sf_dir))


@query("w36_above_baseline", "SELECT event_id, round(least(greatest(value - q, 0.0), 400.0), 6) AS device_w FROM events JOIN (SELECT user_id, quantile_cont(value, 0.2) AS q FROM events GROUP BY user_id) USING (user_id)")
def w36(spark, sf_dir):
    return R.above_baseline(P_BASE(events(spark, sf_dir)), F.col("base_w")).select("event_id", *r6("device_w"))


@query("s08_carried_forward", f"""SELECT * FROM (SELECT event_id, round({" + ".join(f"coalesce(last_value(CASE WHEN event_type = '{p}' THEN value END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 0.0)" for p in ("click", "view", "error"))}, 6) AS total_w FROM events) WHERE total_w > 0""")
def s08(spark, sf_dir):
    return R.carried_forward(events(spark, sf_dir), "event_type", ["click", "view", "error"]).select("event_id", *r6("total_w"))


@query("s16_warm_start", """WITH c AS (SELECT max(ts) - INTERVAL 2 HOUR AS cut FROM events), r AS (SELECT event_id, ts, value FROM events, c WHERE ts >= cut ORDER BY ts DESC, event_id DESC LIMIT 100),
l AS (SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 20) SELECT event_id, value FROM r UNION ALL SELECT event_id, value FROM l WHERE NOT EXISTS (SELECT 1 FROM r)""")
def s16(spark, sf_dir):
    from wattline.sources.readings import warm_start

    return warm_start(events(spark, sf_dir), 2 * HOUR, 100, 20).select("event_id", "value")


@query("s17_recent_values", "SELECT event_id, value FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM events) ORDER BY ts DESC, event_id DESC LIMIT 500")
def s17(spark, sf_dir):
    from wattline.sources.readings import recent_values

    return recent_values(events(spark, sf_dir), 24 * HOUR, 500).select("event_id", "value")


@query("s18_range_scan", "SELECT event_id, user_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'")
def s18(spark, sf_dir):
    from wattline.sources.readings import range_scan

    return range_scan(events(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-09 12:00:00").select("event_id", "user_id", "value")


@query("s11_normalized_readings", f"""WITH s AS (SELECT user_id, event_id, greatest(value - 250.0, 0.0) AS power_w, floor({T} / 86400) AS t0 FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t0, event_id) AS i FROM s)
SELECT user_id, event_id, power_w, CAST(max(t0 - i) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS UNBOUNDED PRECEDING) + i AS DOUBLE) AS t FROM n""")
def s11(spark, sf_dir):
    from wattline.sources.readings import normalize_readings

    day = F.floor(R.EVENTS.seconds() / 86400).cast("double")
    return normalize_readings(events(spark, sf_dir), day, F.col("value") - 250.0).select("user_id", "event_id", "power_w", "t")


@query("a01_summary", "SELECT count(*) AS n, round(coalesce(avg(value), 0), 6) AS avg_w, coalesce(min(value), 0) AS min_w, coalesce(max(value), 0) AS max_w FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 24 HOUR FROM events)")
def a01(spark, sf_dir):
    from wattline.sources.readings import since

    out = since(events(spark, sf_dir), 24 * HOUR)
    return out.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("avg_w"), F.coalesce(F.min("value"), F.lit(0.0)).alias("min_w"), F.coalesce(F.max("value"), F.lit(0.0)).alias("max_w"))


@query("summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_w, min(value) AS min_w, max(value) AS max_w, round(sum(value), 4) AS sum_w FROM events GROUP BY event_type")
def summary(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_w"), F.min("value").alias("min_w"), F.max("value").alias("max_w"), F.round(F.sum("value"), 4).alias("sum_w"))


@query("a02_power_series", """SELECT hour_s, round(sum(w), 6) AS total_w, count(*) AS n_phases, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(floor(epoch_us(ts) / 3.6e9) * 3600 AS BIGINT) AS hour_s, event_type, avg(value) AS w, count(*) AS n FROM events GROUP BY 1, 2)
GROUP BY hour_s ORDER BY hour_s DESC LIMIT 500""")
def a02(spark, sf_dir):
    hour = (F.floor(R.EVENTS.seconds() / 3600) * 3600).cast("long").alias("hour_s")
    by_phase = events(spark, sf_dir).groupBy(hour, "event_type").agg(F.avg("value").alias("w"), F.count("*").alias("n"))
    return by_phase.groupBy("hour_s").agg(F.round(F.sum("w"), 6).alias("total_w"), F.count("*").alias("n_phases"), F.sum("n").alias("n")).orderBy(F.desc("hour_s")).limit(500)


@query("a20_confidence_vote", """WITH d AS (SELECT user_id, CASE WHEN value >= 300 THEN 'on' ELSE 'off' END AS s, value / 500.0 AS c FROM events), m AS (SELECT user_id, avg(c) AS m, max({'c': c, 's': s}) AS b FROM d GROUP BY user_id)
SELECT user_id, CASE WHEN m < 0.2 THEN 'off' ELSE b.s END AS state, round(CASE WHEN m < 0.2 THEN greatest(0.2, 0.7 * m) ELSE m END, 6) AS confidence FROM m""")
def a20(spark, sf_dir):
    d = events(spark, sf_dir).select("user_id", F.when(F.col("value") >= 300, "on").otherwise("off").alias("s"), (F.col("value") / 500.0).alias("c"))
    return P.vote(d, ("user_id",), "s", "c", 0.2).select("user_id", "state", *r6("confidence"))


@query("a25_percentile_by_index", "WITH v AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY user_id) SELECT user_id, v[CAST(round_even((len(v) - 1) * 0.2, 0) AS BIGINT) + 1] AS baseline FROM v")
def a25(spark, sf_dir):
    from wattline.functions.curves import percentile_by_index

    return events(spark, sf_dir).groupBy("user_id").agg(F.collect_list("value").alias("v")).select("user_id", percentile_by_index(F.col("v"), 0.2).alias("baseline"))


@query("a26_starvation", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, count(*) = 8 AND bool_and(value < 400) AS starved FROM n WHERE rn <= 8 GROUP BY user_id""")
def a26(spark, sf_dir):
    t = events(spark, sf_dir).select("user_id", "ts", "event_id", (F.col("value") >= 400).alias("accepted"), F.lit("segmentation_quality_gate").alias("reason"))
    return P.starved(t, ("user_id",), ("ts", "event_id"))


@query("a28_median_step", f"SELECT user_id, round(greatest(0.1, median(dt)), 6) AS dt FROM ({DIFF}) WHERE dt > 0 GROUP BY user_id")
def a28(spark, sf_dir):
    return R.differences(events(spark, sf_dir)).where("dt > 0").groupBy("user_id").agg(F.round(F.greatest(F.lit(0.1), F.median("dt")), 6).alias("dt"))


@query("p01_parse_power", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN round(value, 2) WHEN 2 THEN NULL ELSE 1000.0 * value END AS watts FROM events""")
def p01(spark, sf_dir):
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.concat(F.col("value").cast("string"), F.lit(" W"))).when(kind == 1, F.replace(F.round("value", 2).cast("string"), F.lit("."), F.lit(","))).when(kind == 2, "unavailable").otherwise(F.col("value").cast("string"))
    return events(spark, sf_dir).select("event_id", S.to_watts(S.parse_power(text), F.when(kind == 3, "kW").otherwise("W")).alias("watts"))


@query("p09_buckets", f"""SELECT event_id, CASE WHEN value < 20 THEN 'short' WHEN value < 180 THEN 'medium' WHEN value < 1800 THEN 'long' ELSE 'very_long' END AS duration_bucket,
CASE WHEN 10 * value < 40 THEN 'very_low' WHEN 10 * value < 150 THEN 'low' WHEN 10 * value < 800 THEN 'medium' WHEN 10 * value < 2200 THEN 'high' ELSE 'very_high' END AS load_bucket, {STATE} AS power_state, round(least(greatest(value / 400, 0.0), 1.0), 9) AS clamped FROM events""")
def p09(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).select("event_id", S.duration_bucket(v).alias("duration_bucket"), S.load_bucket(10 * v).alias("load_bucket"), S.power_state(v).alias("power_state"), F.round(S.clamp(v / 400), 9).alias("clamped"))


@query("p03_phase_mode", """WITH p AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'click') AS a, avg(value) FILTER (WHERE event_type = 'view') AS b, avg(value) FILTER (WHERE event_type = 'error') AS c FROM events GROUP BY user_id),
v AS (SELECT user_id, list_filter([coalesce(a, 0), coalesce(b, 0), coalesce(c, 0)], lambda x: x >= 120) AS v, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS total FROM p)
SELECT user_id, round(total, 6) AS total_w, CAST(len(v) AS INTEGER) AS n_active, CASE WHEN total < 120 OR len(v) = 0 THEN 'idle' WHEN len(v) = 3 AND list_max(v) / total < 0.60 AND list_min(v) / total > 0.15 THEN 'multi_phase' ELSE 'single_phase' END AS phase_mode FROM v""")
def p03(spark, sf_dir):
    named = [x for p in ("click", "view", "error") for x in (F.lit(p), F.coalesce(F.avg(F.when(F.col("event_type") == p, F.col("value"))), F.lit(0.0)))]
    out = events(spark, sf_dir).groupBy("user_id").agg(F.create_map(*named).alias("m"))
    return out.select("user_id", F.round(S.phase_total(F.col("m")), 6).alias("total_w"), F.size(S.active_phases(F.col("m"), 120.0)).alias("n_active"), S.phase_mode(F.col("m"), 120.0).alias("phase_mode"))


@query("p12_labels", """WITH l AS (SELECT doc_id, upper(substr(source, 1, 3)) || '_like ' || lang AS label FROM documents)
SELECT doc_id, replace(trim(replace(lower(trim(label)), '_like', '')), '_', ' ') AS label, doc_id % 2 = 0 AS locked FROM l""")
def p12(spark, sf_dir):
    label = F.concat(F.upper(F.substring("source", 1, 3)), F.lit("_like "), F.col("lang"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", S.normalize_label(label).alias("label"), (F.col("doc_id") % 2 == 0).alias("locked"))


@query("c19_offline_pipeline")
def c19(spark, sf_dir):
    from wattline.plans.offline import run

    _, patterns = run(events(spark, sf_dir), threshold=100.0, least_s=HOUR, gap_s=12 * HOUR)
    return patterns.select("user_id", "pattern_no", "seen", *r6("avg_w", "peak_w", "duration_s", "energy_wh", "stability", "score"), "best_type", "quality")


@query("a11_event_features")
def a11(spark, sf_dir):
    from wattline.plans.offline import event_features

    return event_features(w21b(spark, sf_dir), events(spark, sf_dir)).select("user_id", "event_no", "n", *r6("start_s", "end_s", "avg_w", "peak_w", "duration_s", "energy_wh", "variance"), "plateaus", "jumps")
