"""Registered queries over cycles and patterns found in the events table: (Spark query, SQL) by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.functions import curves as V
from wattline.functions import scalars as S
from wattline.operators import classify as K
from wattline.operators import cycles as C
from wattline.operators import maintenance as M
from wattline.operators import matching as J
from wattline.operators import patterns as P
from wattline.operators import series as R
from wattline.plans.cycle_tables import CYC, LEVEL, PAT, STAGED, STAGED_PATTERNS, cycles, patterns, staged, staged_patterns
from wattline.plans.series_queries import SCALE, events, r6
from wattline.sources import exports as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def rel(a: str, b: str) -> str:
    return f"(abs({a} - {b}) / greatest(abs({a}), abs({b}), 1.0))"


def distance(a: str, b: str) -> str:
    parts = " + ".join(f"{w} * {rel(f'{a}.{c}', f'{b}.{c}')}" for w, c in ((0.40, "avg_w"), (0.25, "peak_w"), (0.25, "duration_s"), (0.10, "energy_wh")))
    return f"least(1.0, {parts})"


FEATURES = ("avg_w", "variance", "std_w", "energy_wh", "duty", "duration_s", "peak_to_avg")


@query("a07_cycle_features", f"WITH {CYC} SELECT user_id, cycle, n, start_s, end_s, peak_w, phase, label, {', '.join(f'round({c}, 5) AS {c}' for c in FEATURES)} FROM cyc")
def a07(spark, sf_dir):
    return cycles(spark, sf_dir).select("user_id", "cycle", "n", "start_s", "end_s", "peak_w", "phase", "label", *(F.round(c, 5).alias(c) for c in FEATURES))


@query("a09_rise_and_fall", f"WITH {CYC} SELECT user_id, cycle, round(rise_rate, 5) AS rise_rate, round(fall_rate, 5) AS fall_rate FROM cyc")
def a09(spark, sf_dir):
    return cycles(spark, sf_dir).select("user_id", "cycle", F.round("rise_rate", 5).alias("rise_rate"), F.round("fall_rate", 5).alias("fall_rate"))


@query("a12_patterns", f"WITH {PAT} SELECT phase, label, seen, peak_w, {', '.join(f'round({c}, 5) AS {c}' for c in ('avg_w', 'duration_s', 'energy_wh', 'duty', 'per_day'))} FROM pat")
def a12(spark, sf_dir):
    return patterns(spark, sf_dir).select("phase", "label", "seen", "peak_w", *(F.round(c, 5).alias(c) for c in ("avg_w", "duration_s", "energy_wh", "duty", "per_day")))


@query("a03_group_sizes", f"WITH {PAT} SELECT phase, label, count(*) OVER (PARTITION BY label) AS group_size FROM pat")
def a03(spark, sf_dir):
    return patterns(spark, sf_dir).select("phase", "label", F.count("*").over(Window.partitionBy("label")).alias("group_size"))


@query("a04_representatives", f"WITH {PAT} SELECT label, round(confidence, 6) AS confidence, seen, round(avg_w, 6) AS avg_w, phase FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, seen DESC, avg_w DESC, phase DESC) AS rn FROM pat) WHERE rn = 1")
def a04(spark, sf_dir):
    return P.representatives(patterns(spark, sf_dir)).select("label", *r6("confidence"), "seen", *r6("avg_w"), "phase")


@query("a15_hour_profile", f"WITH {CYC} SELECT phase, label, CAST(CAST(floor(start_s / 3600) AS BIGINT) % 24 AS INTEGER) AS hour, count(*) AS n FROM cyc GROUP BY ALL")
def a15(spark, sf_dir):
    return P.hour_profile(cycles(spark, sf_dir))


GAP = f"WITH {CYC}, gaps AS (SELECT * FROM (SELECT *, start_s - lag(start_s) OVER (PARTITION BY phase, label ORDER BY start_s, user_id, cycle) AS gap FROM cyc) WHERE gap > 0)"


@query("a15_last_intervals", f"{GAP} SELECT phase, label, round(avg(gap), 5) AS typical_interval_s, count(*) AS n_intervals FROM (SELECT *, row_number() OVER (PARTITION BY phase, label ORDER BY start_s DESC, user_id DESC, cycle DESC) AS rn FROM gaps) WHERE rn <= 24 GROUP BY phase, label")
def a15i(spark, sf_dir):
    return P.last_intervals(cycles(spark, sf_dir)).select("phase", "label", F.round("typical_interval_s", 5).alias("typical_interval_s"), "n_intervals")


@query("a16_typical_frequency", f"{GAP} SELECT phase, label, round(86400.0 / median(gap), 6) AS per_day FROM gaps GROUP BY phase, label")
def a16(spark, sf_dir):
    return P.typical_frequency(cycles(spark, sf_dir)).select("phase", "label", *r6("per_day"))


@query("a18_devices", f"WITH {CYC} SELECT label, phase, round(avg(duty), 6) AS confidence, count(*) AS times_seen, bool_or(peak_w > 480) AS confirmed, max(end_s) AS updated_s FROM cyc GROUP BY label, phase")
def a18(spark, sf_dir):
    return cycles(spark, sf_dir).groupBy("label", "phase").agg(F.round(F.avg("duty"), 6).alias("confidence"), F.count("*").alias("times_seen"), F.bool_or(F.col("peak_w") > 480).alias("confirmed"), F.max("end_s").alias("updated_s"))


@query("a19_device_cycles", f"""WITH {STAGED} SELECT label, phase, phase || ':' || CAST(n_substates AS VARCHAR) || ':' || CASE WHEN duration_s < 90 THEN 'short' WHEN duration_s > 900 THEN 'long' ELSE 'mid' END || ':' || CASE WHEN duty < 0.2 THEN 'low' WHEN duty > 0.8 THEN 'high' ELSE 'mid' END AS cycle_type,
count(*) AS n_cycles, round(avg(duration_s), 5) AS duration_s, round(avg(energy_wh), 5) AS energy_wh, round(avg(avg_w), 5) AS avg_w FROM staged GROUP BY ALL""")
def a19(spark, sf_dir):
    mode = S.mode_key(F.col("phase"), F.col("n_substates"), F.col("duration_s"), F.col("duty"))
    return staged(spark, sf_dir).groupBy("label", "phase", mode.alias("cycle_type")).agg(F.count("*").alias("n_cycles"), *(F.round(F.avg(c), 5).alias(c) for c in ("duration_s", "energy_wh", "avg_w")))


@query("p22_pattern_scores", f"""WITH {PAT} SELECT phase, label, stability, round(confidence, 6) AS confidence, CASE WHEN per_day > 50 AND avg_w <= 350 THEN 'fridge' WHEN per_day > 50 THEN 'pump' WHEN per_day < 5 AND label = 'unknown' THEN 'manual_device' ELSE label END AS refined,
round(least(greatest(0.45 * least(greatest(seen / 12.0, 0), 1) + 0.40 * least(greatest(stability / 100.0, 0), 1) + 0.15 * least(greatest(per_day / 8.0, 0), 1), 0), 1), 6) AS repeatability FROM pat""")
def p22(spark, sf_dir):
    return patterns(spark, sf_dir).select("phase", "label", "stability", *r6("confidence"), S.refine_by_frequency(F.col("label"), F.col("avg_w"), F.col("per_day")).alias("refined"), F.round(S.repeatability(F.col("seen"), F.col("stability") / 100.0, F.col("per_day")), 6).alias("repeatability"))


@query("p29_training_filter", f"""WITH {CYC} SELECT user_id, cycle, CASE WHEN avg_w < 30 THEN 'power_too_low' WHEN duration_s < 10 THEN 'duration_too_short' WHEN duty < 0.7 THEN 'quality_too_low' WHEN duration_s / n > 120 THEN 'sample_spacing_too_large' END AS fault FROM cyc""")
def p29(spark, sf_dir):
    fault = S.training_fault(F.col("avg_w"), F.col("duration_s"), F.lit(0.0), F.col("duty"), F.col("duration_s") / F.col("n"), F.lit(None).cast("string"))
    return cycles(spark, sf_dir).select("user_id", "cycle", fault.alias("fault"))


@query("p34_auto_confirm", f"WITH {PAT} SELECT phase, label, (seen >= 3 AND confidence / 100 > 0.92 AND duty > 0.6) OR (seen >= 5 AND confidence / 100 > 0.88) AS confirmed FROM pat")
def p34(spark, sf_dir):
    return patterns(spark, sf_dir).select("phase", "label", S.auto_confirm(F.col("seen"), F.col("confidence") / 100, F.col("duty")).alias("confirmed"))


UNKNOWN_CLASS = """CASE WHEN n_substates >= 2 OR steps >= 2 THEN 'unknown_multistage' WHEN avg_w < 70 AND duration_s >= 300 AND nv <= 3.5 AND inrush < 1.15 THEN 'always_on_low_power' WHEN avg_w < 180 AND duration_s >= 120 AND nv <= 5 AND inrush < 1.2 THEN 'psu_constant_load'
WHEN avg_w < 240 AND duration_s >= 90 AND nv <= 7 AND inrush < 1.25 THEN 'electronics_cluster' WHEN avg_w < 120 AND duration_s >= 120 AND nv <= 6 THEN 'constant_low_power' WHEN avg_w >= 120 AND avg_w < 450 AND duration_s >= 90 AND nv <= 8 THEN 'constant_medium_power'
WHEN inrush >= 1.7 AND avg_w <= 400 THEN 'compressor_low_power' WHEN inrush >= 1.7 THEN 'compressor_high_power' WHEN motor AND avg_w <= 220 AND inrush < 1.6 THEN 'fan_small' WHEN motor AND avg_w <= 450 AND inrush < 1.7 THEN 'pump_small' WHEN motor AND nv <= 9 THEN 'pump_constant' WHEN motor THEN 'pump_variable'
WHEN rise_rate > 100 AND nv <= 6 THEN 'heater_resistive' WHEN duration_s <= 20 THEN 'unknown_short_pulse' WHEN duration_s >= 1800 AND avg_w <= 160 THEN 'unknown_low_power_long' WHEN nv >= 12 OR std_w > greatest(0.08 * avg_w, 15.0) THEN 'unknown_variable_load' ELSE 'unknown_cluster' END"""


@query("p36_unknown_subclass", f"""WITH {STAGED}, r AS (SELECT *, variance / avg_w AS nv, peak_to_avg AS inrush, peak_to_avg >= 1.25 AS motor FROM staged)
SELECT user_id, cycle, {UNKNOWN_CLASS} AS subclass FROM r""")
def p36(spark, sf_dir):
    c = {"avg": F.col("avg_w"), "dur": F.col("duration_s"), "nv": F.col("variance") / F.col("avg_w"), "inrush": F.col("peak_to_avg"), "motor": F.col("peak_to_avg") >= 1.25, "heating": F.col("rise_rate") > 100, "multi": (F.col("n_substates") >= 2) | (F.col("steps") >= 2), "flat": F.col("std_w") <= F.greatest(0.08 * F.col("avg_w"), F.lit(15.0))}
    return staged(spark, sf_dir).select("user_id", "cycle", K.unknown_subclass(c).alias("subclass"))


def rule_columns() -> dict:
    return {"heating": F.col("rise_rate") > 100, "motor": F.col("peak_to_avg") >= 1.25, "rise": F.col("rise_rate"), "peak": 4 * F.col("peak_w"), "dur": F.col("duration_s"), "var": F.col("variance"), "avg": 4 * F.col("avg_w"), "duty": F.col("duty"), "substates": F.col("n_substates"), "energy": F.col("energy_wh"), "three": F.col("phase") == "L3", "modes": F.col("n_substates")}


@query("c01_first_level", f"""WITH {STAGED}, r AS (SELECT *, 4 * peak_w AS p4, 4 * avg_w AS a4, rise_rate > 100 AS heating, peak_to_avg >= 1.25 AS motor, variance / greatest(16 * avg_w * avg_w, 1.0) AS ratio FROM staged)
SELECT user_id, cycle, CASE WHEN heating AND rise_rate > 100 AND p4 >= 1400 AND duration_s BETWEEN 30 AND 900 AND ratio < 0.08 THEN 'kettle' WHEN motor AND p4 < 350 AND duration_s BETWEEN 120 AND 3600 AND duty < 0.7 THEN 'fridge'
WHEN n_substates >= 2 AND motor AND p4 BETWEEN 400 AND 1600 AND duration_s BETWEEN 1200 AND 10800 THEN 'washing_machine' WHEN heating AND p4 BETWEEN 700 AND 2600 AND duration_s BETWEEN 1200 AND 14400 THEN 'dishwasher'
WHEN p4 >= 800 AND duration_s BETWEEN 30 AND 600 AND ratio < 0.05 AND p4 / greatest(a4, 1e-9) < 1.35 THEN 'microwave' ELSE 'unknown' END AS device FROM r""")
def c01(spark, sf_dir):
    return staged(spark, sf_dir).select("user_id", "cycle", K.first_level(rule_columns()).alias("device"))


@query("c02_fallback_rules", f"WITH {CYC} SELECT user_id, cycle, left(label, len(label) - 2) AS device FROM cyc")
def c02(spark, sf_dir):
    return cycles(spark, sf_dir).select("user_id", "cycle", K.fallback_rules(F.col("peak_w"), F.col("duration_s")).alias("device"))


def _signature_sql() -> str:
    rows = ", ".join("(" + ", ".join([str(-k), f"'{s[0]}'", *map(str, s[1:7]), str(s[7]).lower(), f"'{s[8]}'", str(s[9])]) + ")" for k, s in enumerate(K.SIGNATURES))
    has = lambda f: f"list_contains(string_split(f, ' '), '{f}')"
    bonus = {"heating": "rise_rate > 100", "motor": "peak_to_avg >= 1.25", "stable": "variance < 0.3", "short_cycles": "duration_s < 600", "high_power_stable": "p4 > 700 AND ratio < 0.08", "always_on": "duration_s > 3600", "variable_power": "ratio > 0.3 AND ratio < 1", "multiple_modes": "n_substates > 1"}
    size = {"heating": 0.10, "motor": 0.10, "stable": 0.08, "short_cycles": 0.08, "high_power_stable": 0.12, "always_on": 0.08, "variable_power": 0.08, "multiple_modes": 0.12}
    extra = " + ".join(f"CASE WHEN {has(f)} AND {c} THEN {size[f]} ELSE 0 END" for f, c in bonus.items())
    return f"""WITH {STAGED}, sig(o, device, p0, p1, d0, d1, e0, e1, three, f, base) AS (VALUES {rows}), r AS (SELECT *, 4 * peak_w AS p4, variance / (16 * avg_w * avg_w) AS ratio FROM staged),
sc AS (SELECT user_id, cycle, o, device, CASE WHEN p4 < 0.7 * p0 OR p4 > 1.3 * p1 THEN 0.0 ELSE least(1.0, base + CASE WHEN p4 BETWEEN p0 AND p1 THEN 0.15 ELSE -0.10 END + CASE WHEN duration_s BETWEEN d0 AND d1 THEN 0.12 WHEN duration_s < 0.5 * d0 OR duration_s > 2.0 * d1 THEN -0.15 ELSE 0 END
+ CASE WHEN energy_wh BETWEEN e0 AND e1 THEN 0.10 ELSE 0 END + CASE WHEN phase <> 'L3' OR three THEN 0.08 ELSE -0.20 END + {extra}) END AS score FROM r, sig),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, cycle ORDER BY round(score, 9) DESC, o DESC) AS rn FROM sc)
SELECT user_id, cycle, CASE WHEN score > 0.3 THEN device ELSE 'unknown' END AS device, CAST(round(CASE WHEN score > 0.3 THEN least(score, 0.99) ELSE 0.0 END, 6) AS DOUBLE) AS score FROM b WHERE rn = 1"""


@query("c04_signatures", _signature_sql())
def c04(spark, sf_dir):
    best = K.best_signature(rule_columns())
    return staged(spark, sf_dir).select("user_id", "cycle", best.alias("b")).select("user_id", "cycle", "b.device", F.round("b.score", 6).alias("score"))


def _quality_sql() -> str:
    """Plausibility, stability and quality label of each pattern."""
    inside = lambda x: f"least(greatest({x}, 0.0), 1.0)"
    pick = lambda condition, yes, no: f"CASE WHEN {condition} THEN {yes} ELSE {no} END"
    types = {
        "fridge": [pick("avg_w BETWEEN 70 AND 350", 0.2, -0.18), pick("duration_s BETWEEN 300 AND 3600", 0.18, -0.15), pick("cv <= 0.25", 0.1, -0.08), pick("rep >= 0.5", 0.08, -0.05)],
        "pump": [pick("avg_w BETWEEN 120 AND 1800", 0.2, -0.15), pick("duration_s BETWEEN 45 AND 5400", 0.16, -0.12), pick("cv <= 0.2", 0.16, -0.1)],
        "kettle": [pick("avg_w BETWEEN 1200 AND 3200", 0.24, -0.26), pick("duration_s BETWEEN 20 AND 420", 0.22, -0.28), pick("plateaus <= 2", 0.08, -0.08)],
        "microwave": [pick("avg_w BETWEEN 700 AND 2200", 0.2, -0.18), pick("duration_s BETWEEN 30 AND 1800", 0.16, -0.2), pick("plateaus <= 3", 0.06, -0.05)],
        "oven": [pick("avg_w BETWEEN 900 AND 4200", 0.2, -0.15), pick("duration_s BETWEEN 600 AND 14400", 0.2, -0.16), pick("plateaus >= 2", 0.1, -0.06)],
        "heater": [pick("avg_w BETWEEN 400 AND 3500", 0.18, -0.14), pick("duration_s >= 300", 0.2, -0.18), pick("peak_w / avg_w <= 1.45", 0.1, -0.08)],
    }
    ranked = " UNION ALL ".join(f"SELECT phase, label, {-k} AS o, '{t}' AS best_type, CAST({inside('0.5 + ' + ' + '.join(parts))} AS DOUBLE) AS plausibility FROM q" for k, (t, parts) in enumerate(types.items()))
    rep = f"0.45 * {inside('seen / 12.0')} + 0.35 * {inside('1 - sqrt(variance) / greatest(70.0, avg_w)')} + 0.20 * {inside('per_day / 8.0')}"
    return f"""WITH {STAGED_PATTERNS}, q AS (SELECT *, sqrt(variance) / greatest(1.0, avg_w) AS cv, {rep} AS rep FROM staged_pat), t AS ({ranked}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phase, label ORDER BY round(plausibility, 9) DESC, o DESC) AS rn FROM t) WHERE rn = 1),
r AS (SELECT q.phase, q.label, seen, plateaus, jumps, best_type, plausibility, round(0.55 * {inside('1 - cv')} + 0.45 * rep, 4) AS stability, {inside('0.7 * q.confidence / 100 + 0.3 * plausibility')} AS confidence FROM q JOIN b ON q.phase = b.phase AND q.label = b.label),
c AS (SELECT *, CASE WHEN seen >= 7 THEN 0.28 WHEN seen >= 4 THEN 0.16 ELSE -0.12 END + 0.5 * (stability - 0.5) + 0.7 * (plausibility - 0.5) + 0.6 * (confidence - 0.5) - CASE WHEN plateaus >= 5 AND jumps >= 7 THEN 0.2 ELSE 0 END AS score FROM r),
quality AS (SELECT phase, label, best_type, CASE WHEN score >= 0.55 AND confidence >= 0.65 THEN 'sehr_gut' WHEN score >= 0.20 AND confidence >= 0.45 THEN 'brauchbar' WHEN score >= -0.10 AND confidence >= 0.25 THEN 'unsicher' ELSE 'verwerfen' END AS quality, CAST(round(stability, 6) AS DOUBLE) AS stability, CAST(round(confidence, 6) AS DOUBLE) AS confidence, CAST(round(score, 6) AS DOUBLE) AS score FROM c)"""


@query("c20_pattern_quality", f"{_quality_sql()} SELECT * FROM quality")
def c20(spark, sf_dir):
    p = staged_patterns(spark, sf_dir).select("phase", "label", "seen", "avg_w", F.sqrt("variance").alias("std_w"), "duration_s", "per_day", "plateaus", "jumps", (F.col("peak_w") / F.col("avg_w")).alias("peak_to_avg"), (F.col("confidence") / 100).alias("confidence"))
    return K.pattern_quality(p).select("phase", "label", "best_type", "quality", *r6("stability", "confidence", "score"))


@query("a23_quality_counts", f"{_quality_sql()} SELECT quality, best_type, count(*) AS n FROM quality GROUP BY quality, best_type")
def a23(spark, sf_dir):
    return c20(spark, sf_dir).groupBy("quality", "best_type").agg(F.count("*").alias("n"))


@query("j01_best_pattern", f"""WITH {PAT}, m AS (SELECT c.user_id, c.cycle, p.label, 1 - {distance('c', 'p')} AS similarity FROM cyc c JOIN pat p ON c.phase = p.phase)
SELECT user_id, cycle, label AS matched_label, round(similarity, 6) AS similarity, CASE WHEN similarity >= 0.94 THEN 'update_existing' WHEN similarity >= 0.88 THEN 'merge_mode' ELSE 'create_new' END AS action
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, cycle ORDER BY similarity DESC, label DESC) AS rn FROM m) WHERE rn = 1""")
def j01(spark, sf_dir):
    best = J.best_pattern(cycles(spark, sf_dir), patterns(spark, sf_dir))
    return best.select("user_id", "cycle", "matched_label", *r6("similarity"), J.dedup_action(F.col("similarity")).alias("action"))


@query("j02_weighted_vote")
def j02(spark, sf_dir):
    return J.weighted_vote(cycles(spark, sf_dir), patterns(spark, sf_dir)).select("user_id", "cycle", "label", *r6("confidence"))


SIMILAR_PAIRS = f"""WITH {CYC}, k AS (SELECT *, user_id * 4294967296 + cycle AS id FROM cyc) SELECT a.phase, a.id AS id_a, b.id AS id_b, round({distance('a', 'b')}, 6) AS distance FROM k a JOIN k b ON a.phase = b.phase AND a.id < b.id WHERE {distance('a', 'b')} <= 0.05"""


@query("j05_similar_pairs", SIMILAR_PAIRS)
def j05(spark, sf_dir):
    k = cycles(spark, sf_dir).withColumn("id", F.shiftleft(F.col("user_id"), 32) + F.col("cycle"))
    return J.similar_pairs(k, "phase", "id", 0.05).select("phase", "id_a", "id_b", *r6("distance"))


@query("j06_latest_cycle", f"WITH {CYC} SELECT phase, label, end_s, user_id, cycle, round(avg_w, 6) AS avg_w FROM (SELECT *, row_number() OVER (PARTITION BY phase, label ORDER BY end_s DESC, user_id DESC, cycle DESC) AS rn FROM cyc) WHERE rn = 1")
def j06(spark, sf_dir):
    return J.latest_per_key(cycles(spark, sf_dir), ("phase", "label"), ("end_s", "user_id", "cycle"), ("avg_w",)).select("phase", "label", "end_s", "user_id", "cycle", *r6("avg_w"))


@query("j07_interval_context", f"WITH {CYC} SELECT c.user_id, c.cycle, e.event_id, epoch_us(e.ts) / 1e6 AS t, e.value FROM cyc c JOIN events e ON c.user_id = e.user_id AND epoch_us(e.ts) / 1e6 BETWEEN c.start_s - 36000 AND c.end_s + 18000")
def j07(spark, sf_dir):
    c = cycles(spark, sf_dir).select("user_id", "cycle", "start_s", "end_s")
    out = J.interval_context(c, events(spark, sf_dir).select("user_id", "event_id", "ts", "value"), "user_id", 36000, 18000, R.EVENTS.seconds(), 86400.0)
    return out.select("user_id", "cycle", "event_id", "t", "value")


@query("j08_event_phases", f"""WITH {CYC}, m AS (SELECT * FROM i WHERE active), u AS (SELECT *, coalesce(value >= lag(value) OVER (PARTITION BY user_id, cycle ORDER BY ts, event_id), true) AS up FROM m),
v AS (SELECT *, CASE WHEN up = lag(up) OVER (PARTITION BY user_id, cycle ORDER BY ts, event_id) THEN 0 ELSE 1 END AS turn FROM u),
p AS (SELECT *, CAST(sum(turn) OVER (PARTITION BY user_id, cycle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS phase_index FROM v)
SELECT user_id, cycle, phase_index, up AS rising, count(*) AS n, round(avg(value), 6) AS avg_w, max(value) AS peak_w FROM p GROUP BY user_id, cycle, phase_index, up""")
def j08(spark, sf_dir):
    """Each cycle's readings as phases of rising and falling power, one row for each."""
    samples = C.island_cycles(events(spark, sf_dir), LEVEL).withColumn("__up", F.coalesce(F.col("value") >= F.lag("value").over(Window.partitionBy("user_id", "cycle").orderBy("ts", "event_id")), F.lit(True)))
    runs = R.islands(samples, F.col("__up"), R.Series(key=("user_id", "cycle")), "phase_index")
    return runs.groupBy("user_id", "cycle", "phase_index", "active").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_w"), F.max("value").alias("peak_w")).withColumnRenamed("active", "rising")


@query("j10_phase_locks", f"""WITH {CYC}, locks(label, phase) AS (VALUES ('fridge_1', 'L1'), ('Unknown_3', 'L2'), ('washing machine 0', 'L3')) SELECT c.user_id, c.cycle, c.label, c.phase FROM cyc c LEFT JOIN locks l ON replace(c.label, '_', ' ') = lower(replace(l.label, '_', ' ')) WHERE l.phase IS NULL OR l.phase = c.phase""")
def j10(spark, sf_dir):
    locks = spark.createDataFrame([("fridge_1", "L1"), ("Unknown_3", "L2"), ("washing machine 0", "L3")], "label string, phase string")
    return J.with_lock(cycles(spark, sf_dir), locks).select("user_id", "cycle", "label", "phase")


@query("j11_load_allocation")
def j11(spark, sf_dir):
    p = patterns(spark, sf_dir).withColumn("confidence", F.col("confidence") / 100)
    seen = events(spark, sf_dir).where(F.col("value") >= LEVEL).groupBy(F.concat(F.lit("L"), (F.col("user_id") % 3 + 1).cast("string")).alias("phase")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("observed_w"))
    return J.allocate(p, seen, "phase").select("phase", "label", *r6("taken_w"))


@query("j13_session_duplicates", f"""WITH {CYC} SELECT user_id, cycle, coalesce(start_s <= max(end_s) OVER (PARTITION BY phase, label ORDER BY start_s, user_id, cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 120, false) AS duplicate FROM cyc""")
def j13(spark, sf_dir):
    return J.session_duplicates(cycles(spark, sf_dir), ("phase", "label"), ("user_id", "cycle")).select("user_id", "cycle", "duplicate")


PATTERN_ORDER = "seen DESC, last_s DESC, phase, label"


@query("o01_list_patterns", f"WITH {PAT} SELECT phase, label, seen, last_s, stability, round(confidence, 6) AS confidence FROM pat ORDER BY {PATTERN_ORDER} LIMIT 20")
def o01(spark, sf_dir):
    return patterns(spark, sf_dir).orderBy(F.desc("seen"), F.desc("last_s"), "phase", "label").limit(20).select("phase", "label", "seen", "last_s", "stability", *r6("confidence"))


@query("o02_list_devices", f"WITH {CYC} SELECT label, phase, count(*) AS times_seen, max(end_s) AS updated_s FROM cyc GROUP BY label, phase ORDER BY times_seen DESC, updated_s DESC, label, phase LIMIT 10")
def o02(spark, sf_dir):
    return a18(spark, sf_dir).orderBy(F.desc("times_seen"), F.desc("updated_s"), "label", "phase").limit(10).select("label", "phase", "times_seen", "updated_s")


@query("o03_list_events", f"WITH {CYC} SELECT user_id, cycle, start_s, label FROM cyc ORDER BY start_s DESC, user_id, cycle LIMIT 50")
def o03(spark, sf_dir):
    return cycles(spark, sf_dir).orderBy(F.desc("start_s"), "user_id", "cycle").limit(50).select("user_id", "cycle", "start_s", "label")


@query("o05_device_cycles", f"WITH {CYC} SELECT user_id, cycle, duration_s, n FROM cyc WHERE label = 'unknown_3' ORDER BY duration_s DESC, user_id, cycle LIMIT 30")
def o05(spark, sf_dir):
    return cycles(spark, sf_dir).where("label = 'unknown_3'").orderBy(F.desc("duration_s"), "user_id", "cycle").limit(30).select("user_id", "cycle", "duration_s", "n")


@query("o07_page", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 100 OFFSET 200")
def o07(spark, sf_dir):
    return events(spark, sf_dir).orderBy("ts", "event_id").offset(200).limit(100).select("event_id", "value")


@query("m01_label_overlay", f"""WITH {PAT}, u(phase, label, user_label) AS (VALUES ('L1', 'unknown_3', 'Pump A'), ('L2', 'unknown_0', ' ')) SELECT p.phase, p.label, coalesce(nullif(trim(u.user_label), ''), nullif(trim(p.label), ''), 'unknown') AS effective FROM pat p LEFT JOIN u ON p.phase = u.phase AND p.label = u.label""")
def m01(spark, sf_dir):
    given = spark.createDataFrame([("L1", "unknown_3", "Pump A"), ("L2", "unknown_0", " ")], "phase string, label string, user_label string")
    return M.with_user_labels(patterns(spark, sf_dir), given, ("phase", "label")).select("phase", "label", S.effective_label(F.col("user_label"), F.lit(""), F.col("label")).alias("effective"))


@query("m03_delete", f"WITH {PAT} SELECT phase, label, seen FROM pat WHERE NOT (phase = 'L1' AND label = 'unknown_3')")
def m03(spark, sf_dir):
    gone = spark.createDataFrame([("L1", "unknown_3")], "phase string, label string")
    return M.without_rows(patterns(spark, sf_dir), gone, ("phase", "label")).select("phase", "label", "seen")


@query("m04_pattern_from_range", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS avg_w, max(value) AS peak_w FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 00:00:00' GROUP BY user_id")
def m04(spark, sf_dir):
    from wattline.sources.readings import range_scan

    return range_scan(events(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-06 00:00:00").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_w"), F.max("value").alias("peak_w"))


@query("m05_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 10 DAY FROM events)")
def m05(spark, sf_dir):
    return M.retained(events(spark, sf_dir), 10.0).select("event_id")


@query("m07_seen_bounds", f"WITH {PAT} SELECT phase, label, least(last_s, first_s) AS first_s, greatest(last_s, first_s) AS last_s FROM pat")
def m07(spark, sf_dir):
    return M.repaired_bounds(patterns(spark, sf_dir).select("phase", "label", F.col("last_s").alias("first_s"), F.col("first_s").alias("last_s")), "first_s", "last_s").select("phase", "label", "first_s", "last_s")


@query("k04_pattern_pack", f"""WITH {PAT}, r AS (SELECT phase, CASE WHEN label LIKE 'unknown%' THEN 'unknown' WHEN label LIKE '%fridge%' THEN 'fridge' WHEN label LIKE '%wash%' THEN 'washing_machine' WHEN label LIKE '%kettle%' THEN 'kettle' ELSE 'custom_user_label' END AS label, CAST(round(avg_w) AS BIGINT) AS avg_w, CAST(round(peak_w) AS BIGINT) AS peak_w, CAST(round(duration_s) AS BIGINT) AS duration_s, seen FROM pat)
SELECT label, avg_w, peak_w, duration_s, seen FROM r""")
def k04(spark, sf_dir):
    return X.pattern_pack(patterns(spark, sf_dir)).select("label", "avg_w", "peak_w", "duration_s", "seen")


@query("k06_training_jsonl")
def k06(spark, sf_dir):
    return X.json_lines(cycles(spark, sf_dir).orderBy(F.desc("start_s"), "user_id", "cycle").limit(200), ("user_id", "cycle", "label", "phase"))


EMB = "e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 100) AS v FROM embeddings), p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"


def pairs(spark, sf_dir):
    """Neighbouring vectors as pairs of curves."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 100).alias("v"))
    return e.select("vec_id", F.col("v").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b")), "vec_id")


@query("r10_curve_similarity", f"""WITH {EMB}, s AS (SELECT *, sqrt(list_sum(list_transform(a, lambda x: x * x))) AS na, sqrt(list_sum(list_transform(b, lambda x: x * x))) AS nb, list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) AS dot, sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM p)
SELECT vec_id, round(CASE WHEN na * nb > 1e-9 THEN dot / (na * nb) ELSE 0.0 END, 6) AS cosine, round(greatest(0.0, 1 - d / greatest(80.0, na, nb)), 6) AS euclidean FROM s""")
def r10(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"), F.round(V.euclidean(F.col("a"), F.col("b")), 6).alias("euclidean"))


@query("r12_dtw")
def r12(spark, sf_dir):
    both = pairs(spark, sf_dir).select("vec_id", V.resample(F.col("a"), 16).alias("a"), V.resample(F.col("b"), 16).alias("b"))
    return both.select("vec_id", F.round(V.dtw(F.col("a"), F.col("b")), 6).alias("dtw"), F.round(V.shape_distance(F.col("a"), F.col("b")), 6).alias("shape_distance"))


@query("r03_resample", f"""WITH {EMB}, g AS (SELECT vec_id, a, len(a) AS n, i FROM p, range(0, 8) t(i)), q AS (SELECT vec_id, a, n, i, i * (n - 1) / 7.0 AS pos FROM g)
SELECT vec_id, i AS point, round(a[CAST(floor(pos) AS INTEGER) + 1] * (1 - (pos - floor(pos))) + a[least(n - 1, CAST(floor(pos) AS INTEGER) + 1) + 1] * (pos - floor(pos)), 6) AS value FROM q""")
def r03(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", F.posexplode(V.resample(F.col("a"), 8)).alias("point", "value")).select("vec_id", F.col("point").cast("long").alias("point"), *r6("value"))


@query("r20_curve_features", f"""WITH {EMB} SELECT vec_id, round((list_position(a, list_max(a)) - 1) / (len(a) - 1), 6) AS peak_position, round(greatest(0.0, list_max(a) - list_avg(a[1:greatest(1, len(a) // 5)])), 6) AS incremental_rise, round(list_median(a), 6) AS median FROM p""")
def r20(spark, sf_dir):
    a = F.col("a")
    return pairs(spark, sf_dir).select("vec_id", F.round(V.peak_position(a), 6).alias("peak_position"), F.round(V.incremental_rise(a), 6).alias("incremental_rise"), F.round(V.median(a), 6).alias("median"))


@query("r32_level_clusters")
def r32(spark, sf_dir):
    a = F.col("a")
    return pairs(spark, sf_dir).select("vec_id", F.posexplode(V.cluster_levels(a, 5.0)).alias("level_no", "level")).select("vec_id", "level_no", *r6("level"))


@query("r28_curve_patterns")
def r28(spark, sf_dir):
    a = F.transform("a", F.abs)
    return pairs(spark, sf_dir).select("vec_id", V.rising_start(a).alias("heating"), V.oscillates(a).alias("motor"), V.count_jumps(a, 10.0).alias("jumps"), F.round(V.overlap_score(a), 6).alias("overlap"))


@query("s12_simulated")
def s12(spark, sf_dir):
    from wattline.sources.readings import fallback_profile, simulate

    p = patterns(spark, sf_dir).select(F.concat_ws(":", "phase", "label").alias("pattern_id"), fallback_profile(F.col("avg_w"), F.col("peak_w"), F.col("duration_s")).alias("profile"), "seen")
    return simulate(p).select("pattern_id", "t", *r6("power_w"))


FRIDGE = f"""WITH RECURSIVE s AS (SELECT event_id, user_id, value > 200 AS high, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, event_id, rn, t, CASE WHEN high THEN 'starting' ELSE 'off' END AS state, CASE WHEN high THEN t ELSE 0.0 END AS since, CASE WHEN high THEN 0.65 END AS confidence FROM s WHERE rn = 1
UNION ALL SELECT s.user_id, s.event_id, s.rn, s.t,
CASE f.state WHEN 'off' THEN CASE WHEN high THEN 'starting' ELSE 'off' END WHEN 'starting' THEN CASE WHEN high AND s.t - f.since >= 3600 THEN 'on' WHEN high THEN 'starting' ELSE 'off' END ELSE CASE WHEN NOT high AND s.t - f.since >= 86400 THEN 'off' ELSE 'on' END END,
CASE WHEN f.state = 'off' AND high THEN s.t ELSE f.since END,
CASE f.state WHEN 'off' THEN CASE WHEN high THEN 0.65 END WHEN 'starting' THEN CASE WHEN high AND s.t - f.since >= 3600 THEN 0.82 WHEN high THEN 0.55 ELSE 0.40 END ELSE CASE WHEN high THEN 0.88 WHEN s.t - f.since >= 86400 THEN 0.75 ELSE 0.66 END END
FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1)"""


@query("w23_fridge_detector", f"{FRIDGE} SELECT user_id, event_id, t, state, CAST(confidence AS DOUBLE) AS confidence FROM f WHERE confidence IS NOT NULL")
def w23(spark, sf_dir):
    from wattline.operators.detectors import fridge

    return fridge(events(spark, sf_dir), 200.0, 3600.0, 86400.0)


@query("w26_adaptive_detector")
def w26(spark, sf_dir):
    from wattline.operators.detectors import adaptive_load

    w = R.EVENTS.rows(-59)
    calm = F.when(F.col("value") < 200, F.col("value"))
    base = events(spark, sf_dir).withColumn("b", F.coalesce(F.avg(calm).over(w), F.lit(0.0))).withColumn("sd", F.greatest(F.coalesce(F.stddev_pop(calm).over(w), F.lit(2.0)), F.lit(2.0)))
    return adaptive_load(base, F.col("b"), F.col("sd"), 3600.0, 86400.0, 9000.0)


@query("w29_inverter_detector")
def w29(spark, sf_dir):
    from wattline.operators.detectors import inverter

    return inverter(events(spark, sf_dir), F.lit(100.0), 86400.0, 0.001, 86400.0, 15000.0)


@query("w39_routed_detectors")
def w39(spark, sf_dir):
    return w23(spark, sf_dir).withColumn("detector", F.lit("fridge")).unionByName(w26(spark, sf_dir).withColumn("detector", F.lit("adaptive"))).unionByName(w29(spark, sf_dir).withColumn("detector", F.lit("inverter")))


def summary_columns() -> dict:
    c = {"avg": F.col("avg_w"), "peak": F.col("peak_w"), "var": F.col("variance"), "dur": F.col("duration_s"), "points": F.col("n"), "plateau_std": F.col("std_w"), "substates": F.col("n_substates"), "steps": F.col("steps"), "pre_s": F.col("pre_s"), "post_s": F.col("post_s"), "cut_start": F.col("pre_s") <= 0, "cut_end": F.col("post_s") <= 0}
    from wattline.operators.decision import waveform_summary

    return {**c, **waveform_summary(c), "motor": F.col("peak_to_avg") >= 1.25, "heating": F.col("rise_rate") > 100, "cut": c["cut_start"] | c["cut_end"]}


SUM = f"""WITH {STAGED}, w AS (SELECT *, CASE WHEN pre_s > 0 THEN least(pre_s / 3.0, 1.0) ELSE 0.25 END AS pre, CASE WHEN post_s > 0 THEN least(post_s / 3.0, 1.0) ELSE 0.25 END AS post, std_w <= greatest(0.08 * avg_w, 15.0) AS flat FROM staged),
v AS (SELECT *, least(greatest(0.24 * pre + 0.24 * post + 0.18 * CASE WHEN pre_s > 0 THEN 1.0 ELSE 0.25 END + 0.18 * CASE WHEN post_s > 0 THEN 1.0 ELSE 0.25 END + 0.16 * least(n / 18.0, 1.0), 0), 1) AS completeness, CASE WHEN flat AND duration_s >= 90 THEN 1.0 WHEN duration_s >= 45 THEN 0.78 ELSE 0.55 END AS plateau FROM w),
u AS (SELECT *, least(greatest(0.24 * pre + 0.24 * post + 0.34 * completeness + 0.18 * plateau - CASE WHEN pre_s <= 0 THEN 0.08 ELSE 0 END - CASE WHEN post_s <= 0 THEN 0.06 ELSE 0 END, 0), 1) AS seg FROM v)"""


@query("r36_waveform_summary", f"{SUM} SELECT user_id, cycle, round(completeness, 6) AS completeness, round(seg, 6) AS seg, flat, CASE WHEN seg >= 0.60 THEN 'stable' WHEN seg >= 0.28 THEN 'provisional' ELSE 'blocked' END AS tier FROM u")
def r36(spark, sf_dir):
    c = summary_columns()
    return staged(spark, sf_dir).select("user_id", "cycle", F.round(c["completeness"], 6).alias("completeness"), F.round(c["seg"], 6).alias("seg"), c["flat"].alias("flat"), c["tier"].alias("tier"))


def temporal(spark, sf_dir) -> DataFrame:
    from wattline.operators.decision import temporal_scores

    c = cycles(spark, sf_dir)
    hours = c.groupBy("phase", "label").agg(F.avg(F.pmod(F.col("start_s") / 3600, F.lit(24.0))).alias("mean_hour"))
    return temporal_scores(c, patterns(spark, sf_dir), hours, ("user_id", "cycle"))


@query("c06_temporal_score", f"""WITH {PAT}, h AS (SELECT phase, label, avg(start_s / 3600 - 24 * floor(start_s / 3600 / 24)) AS mh FROM cyc GROUP BY phase, label), j AS (SELECT c.user_id, c.cycle, p.seen AS occ, 1 - least(abs(p.duration_s - c.duration_s) / greatest(p.duration_s, 1.0), 1.0) AS dm, least(ln(1 + p.seen) / 4, 1.0) AS lg,
abs(c.start_s / 3600 - 24 * floor(c.start_s / 3600 / 24) - mh) AS d FROM cyc c JOIN pat p USING (phase, label) JOIN h USING (phase, label))
SELECT user_id, cycle, occ, round(least(0.45 * least(0.65 * dm + 0.35 * lg, 1.0) + 0.35 * (1 - least(least(d, 24 - d) / 12, 1.0)) + 0.20 * lg, 1.0), 6) AS temporal FROM j""")
def c06(spark, sf_dir):
    return temporal(spark, sf_dir).select("user_id", "cycle", "occ", *r6("temporal"))


def decided(spark, sf_dir) -> DataFrame:
    from wattline.operators.decision import candidates, decide

    c = {**summary_columns(), "occ": F.col("occ"), "temporal": F.col("temporal")}
    out = staged(spark, sf_dir).join(temporal(spark, sf_dir), ["user_id", "cycle"]).withColumn("found", candidates(c))
    d = decide(F.col("found"), c, F.lit(0.5))
    return out.withColumns({"decided": d["label"], "confidence": d["confidence"], "source": d["source"]})


@query("c07_candidates")
def c07(spark, sf_dir):
    return decided(spark, sf_dir).select("user_id", "cycle", F.inline("found")).select("user_id", "cycle", "label", "score")


@query("c22_analyzer_quality")
def c22(spark, sf_dir):
    from wattline.operators.decision import analyzer_quality

    p = staged_patterns(spark, sf_dir)
    stable = F.col("stability") / 100.0
    q = analyzer_quality({"rep": S.repeatability(F.col("seen"), stable, F.col("per_day")), "stability": stable, "seen": F.col("seen"), "cv": F.sqrt("variance") / F.col("avg_w"), "plateaus": F.col("plateaus"), "jumps": F.col("jumps"), "mixed": F.col("seen") % 11 == 0, "risk": F.col("seen") % 7 == 0, "energy_ratio": F.col("energy_wh") / F.greatest(F.col("avg_w") * F.col("duration_s") / 3600, F.lit(1e-9)), "conf": F.col("confidence") / 100, "best": F.lit(0.7), "label_fit": F.lit(0.6)})
    return p.select("phase", "label", q["quality"].alias("quality"), F.round(q["total"], 6).alias("total"), F.round(q["adjusted"], 6).alias("adjusted"))


@query("a05_row_counts", "SELECT 'events' AS table_name, count(*) AS n FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def a05(spark, sf_dir):
    from functools import reduce

    parts = [spark.read.parquet(f"{sf_dir}/{t}.parquet").agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in ("events", "documents", "embeddings")]
    return reduce(DataFrame.unionByName, parts)


@query("a14_blended_profiles")
def a14(spark, sf_dir):
    """Vectors of one label blended in order, each counting 0.22."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    ordered = e.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("x"))
    blended = V.ema_profiles(F.transform(F.col("x"), lambda r: V.resample(r["v"], 8)))
    return ordered.select("label", F.posexplode(blended).alias("point", "value")).select("label", "point", *r6("value"))


@query("m12_history_snapshot", f"WITH {PAT} SELECT phase, label, seen, sha1(phase || '|' || label || '|' || CAST(seen AS VARCHAR)) AS version FROM pat")
def m12(spark, sf_dir):
    return patterns(spark, sf_dir).select("phase", "label", "seen", F.sha1(F.concat_ws("|", "phase", "label", F.col("seen").cast("string"))).alias("version"))


@query("c18_merged_patterns", f"""WITH {PAT}, m AS (SELECT *, phase || ':' || split_part(label, '_', 1) AS k FROM pat) SELECT k AS "into", CAST(sum(seen) AS BIGINT) AS seen, round(sum(avg_w * seen) / sum(seen), 5) AS avg_w, round(sum(duration_s * seen) / sum(seen), 5) AS duration_s, max(peak_w) AS peak_w FROM m GROUP BY k""")
def c18(spark, sf_dir):
    p = patterns(spark, sf_dir).withColumn("id", F.concat_ws(":", "phase", "label"))
    groups = p.select("id", F.concat_ws(":", "phase", F.substring_index("label", "_", 1)).alias("into"))
    out = M.merged_patterns(p, groups, "id")
    return out.select("into", "seen", F.round("avg_w", 5).alias("avg_w"), F.round("duration_s", 5).alias("duration_s"), "peak_w")


@query("w12_pre_and_post_roll", f"WITH {CYC} SELECT c.user_id, c.cycle, count(*) FILTER (WHERE epoch_us(e.ts) / 1e6 < c.start_s) AS n_pre, count(*) FILTER (WHERE epoch_us(e.ts) / 1e6 > c.end_s) AS n_post FROM cyc c JOIN events e ON c.user_id = e.user_id AND epoch_us(e.ts) / 1e6 BETWEEN c.start_s - 86400 AND c.end_s + 86400 GROUP BY c.user_id, c.cycle")
def w12(spark, sf_dir):
    c = cycles(spark, sf_dir).select("user_id", "cycle", "start_s", "end_s")
    out = J.interval_context(c, events(spark, sf_dir).select("user_id", "event_id", "ts", "value"), "user_id", 86400, 86400, R.EVENTS.seconds(), 86400.0)
    return out.groupBy("user_id", "cycle").agg(F.count_if(F.col("t") < F.col("start_s")).alias("n_pre"), F.count_if(F.col("t") > F.col("end_s")).alias("n_post"))


@query("w16_synchronized_rise", """WITH f AS (SELECT user_id, event_type, min(epoch_us(ts) / 1e6) FILTER (WHERE value > 100) AS t FROM events GROUP BY user_id, event_type)
SELECT user_id, count(t) AS n_phases, count(t) >= 2 AND max(t) - min(t) <= 259200 AS synchronized FROM f GROUP BY user_id""")
def w16(spark, sf_dir):
    first = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min(F.when(F.col("value") > 100, R.EVENTS.seconds())).alias("t"))
    return first.groupBy("user_id").agg(F.count("t").alias("n_phases"), F.coalesce((F.count("t") >= 2) & (F.max("t") - F.min("t") <= 259200), F.lit(False)).alias("synchronized"))


@query("w22_edge_cycles")
def w22(spark, sf_dir):
    from wattline.operators.learning import edge_cycles

    return edge_cycles(events(spark, sf_dir), 150.0, 60.0, 86400.0, R.EVENTS)


@query("r33_mode_segments")
def r33(spark, sf_dir):
    from wattline.operators.learning import segment_modes

    return segment_modes(C.island_cycles(events(spark, sf_dir), LEVEL), ("user_id", "cycle"), R.EVENTS).select("user_id", "cycle", "segment", "kind", "n", *r6("avg_w"))


@query("a17_operating_modes")
def a17(spark, sf_dir):
    """Modes of each phase from its cycles in order."""
    from wattline.operators.learning import operating_modes

    c = cycles(spark, sf_dir)
    ordered = c.groupBy("phase").agg(F.array_sort(F.collect_list(F.struct("start_s", "user_id", "cycle", "avg_w", "duration_s", "peak_w"))).alias("x"))
    return ordered.select("phase", F.posexplode(operating_modes(F.col("x"))).alias("mode_no", "m")).select("phase", "mode_no", "m.seen", F.round("m.avg_w", 6).alias("avg_w"))


@query("c15_learned_patterns")
def c15(spark, sf_dir):
    """Patterns of the first cycles after a batch of the later ones."""
    from wattline.operators.learning import learn

    c = cycles(spark, sf_dir)
    first = P.patterns_of(c.where("cycle <= 6"))
    return learn(first, c.where("cycle > 6")).select("phase", "label", "seen", "peak_w", *r6("avg_w", "duration_s"))


@query("c17_promoted_patterns", f"WITH {PAT} SELECT phase, label, seen, CASE WHEN seen >= 10 THEN 'promoted' ELSE 'weak_pattern' END AS status FROM pat")
def c17(spark, sf_dir):
    from wattline.operators.learning import promoted

    done, waiting = promoted(P.patterns_of(cycles(spark, sf_dir)), 10)
    return done.select("phase", "label", "seen", F.lit("promoted").alias("status")).unionByName(waiting.select("phase", "label", "seen", F.lit("weak_pattern").alias("status")))
