"""Cycles, profiles and patterns of the events table, as frames and as SQL, for the registered queries.

A cycle is a run of at least three readings of LEVEL watts or more of one user; its phase is the user's number modulo three, its times are scaled
down because readings lie hours apart. Its profile is those readings and the ones of a day around."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions import curves as V
from wattline.functions import scalars as S
from wattline.operators import classify as K
from wattline.operators import cycles as C
from wattline.operators import matching as J
from wattline.operators import patterns as P
from wattline.operators import profiles as A
from wattline.operators import series as R
from wattline.plans.series_queries import SCALE, events

#: The readings of the events table have a median of 35 W and a 90th percentile of 113 W.
LEVEL = 40.0
DAY = 86400.0


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.cycle_features(C.island_cycles(events(spark, sf_dir), LEVEL))
    scaled = out.withColumns({"duration_s": F.col("duration_s") / SCALE, "energy_wh": F.col("energy_wh") / SCALE, "rise_rate": F.col("rise_rate") * SCALE, "fall_rate": F.col("fall_rate") * SCALE})
    label = K.fallback_rules(F.col("peak_w"), F.col("duration_s"))
    return scaled.withColumn("phase", F.concat(F.lit("L"), (F.col("user_id") % 3 + 1).cast("string"))).withColumn("label", F.concat_ws("_", label, (F.col("n") % 4).cast("string")))


CYC = f"""s AS (SELECT *, epoch_us(ts) / 1e6 AS t, value >= {LEVEL} AS active FROM events),
g AS (SELECT *, CASE WHEN active = lag(active) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM s),
i AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cycle FROM g),
x AS (SELECT *, (value + lag(value) OVER w) / 2 * (t - lag(t) OVER w) AS e, min(value) OVER (PARTITION BY user_id, cycle) AS low, max(value) OVER (PARTITION BY user_id, cycle) AS high FROM i WHERE active WINDOW w AS (PARTITION BY user_id, cycle ORDER BY ts, event_id)),
y AS (SELECT user_id, cycle, count(*) AS n, min(t) AS start_s, max(t) AS end_s, avg(value) AS avg_w, max(value) AS peak_w, var_pop(value) AS variance, stddev_pop(value) AS std_w, coalesce(sum(e), 0) / 3600 / {SCALE} AS energy_wh,
avg(CASE WHEN value >= 0.5 * high THEN 1.0 ELSE 0.0 END) AS duty, min(CASE WHEN value >= low + 0.1 * (high - low) THEN t END) AS r10, min(CASE WHEN value >= low + 0.8 * (high - low) THEN t END) AS r80,
max(CASE WHEN value >= low + 0.8 * (high - low) THEN t END) AS f80, max(CASE WHEN value <= low + 0.1 * (high - low) THEN t END) AS f10, max(high - low) AS band FROM x GROUP BY user_id, cycle HAVING count(*) >= 3),
z AS (SELECT *, (end_s - start_s) / {SCALE} AS duration_s, peak_w / greatest(avg_w, 1e-9) AS peak_to_avg, CASE WHEN r80 >= r10 THEN 0.7 * band / greatest(r80 - r10, 0.1) ELSE 0.0 END * {SCALE} AS rise_rate,
CASE WHEN f10 IS NOT NULL AND f80 IS NOT NULL THEN 0.7 * band / greatest(f10 - f80, 0.1) ELSE 0.0 END * {SCALE} AS fall_rate, 'L' || CAST(user_id % 3 + 1 AS VARCHAR) AS phase FROM y),
cyc AS (SELECT *, CASE WHEN peak_w < 350 AND duration_s BETWEEN 120 AND 3600 THEN 'fridge' WHEN peak_w BETWEEN 400 AND 1600 AND duration_s BETWEEN 1200 AND 10800 THEN 'washing_machine' WHEN peak_w BETWEEN 700 AND 2600 AND duration_s BETWEEN 1200 AND 14400 THEN 'dishwasher'
WHEN peak_w >= 1400 AND duration_s <= 900 THEN 'kettle' ELSE 'unknown' END || '_' || CAST(n % 4 AS VARCHAR) AS label FROM z)"""
PAT = CYC + """, pat0 AS (SELECT phase, label, count(*) AS seen, avg(avg_w) AS avg_w, max(peak_w) AS peak_w, avg(duration_s) AS duration_s, avg(energy_wh) AS energy_wh, avg(variance) AS variance, avg(duty) AS duty, min(start_s) AS first_s, max(end_s) AS last_s FROM cyc GROUP BY phase, label),
pat1 AS (SELECT *, seen / greatest((last_s - first_s) / 86400.0, 1.0 / 24.0) AS per_day, CAST(trunc(CASE WHEN avg_w > 10 THEN least(greatest(100 - 100 * variance / (avg_w * avg_w), 0), 100) ELSE 50.0 END) AS INTEGER) AS stability FROM pat0),
pat AS (SELECT *, 100 * (0.7 * (stability / 100.0) + 0.3 * (1 - exp(-seen / 8.0))) AS confidence FROM pat1)"""


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.patterns_of(cycles(spark, sf_dir)).withColumn("stability", S.stability_score(F.col("variance"), F.col("avg_w")))
    return P.scored(out, F.col("stability") / 100.0)


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles with their profiles, in scaled seconds."""
    found = cycles(spark, sf_dir)
    readings = events(spark, sf_dir).select("user_id", "event_id", "ts", "value")
    around = J.interval_context(found.select("user_id", "cycle", "start_s", "end_s"), readings, "user_id", DAY, DAY, R.EVENTS.seconds(), DAY)
    return found.join(A.profiles(around, ("user_id", "cycle"), F.col("t") / SCALE, "event_id", "value"), ["user_id", "cycle"])


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles with everything that the distances compare."""
    out = A.with_shape(A.with_substates(A.with_baseline_delta(profiled(spark, sf_dir))))
    v = F.transform("points", lambda x: x["p"])
    return out.withColumns({"n_substates": F.size("substates"), "heating": V.rising_start(v), "motor": V.oscillates(v), "phases": F.lit(1.0)})


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles with n_substates, steps and the scaled seconds seen before and after them, pre_s and post_s."""
    out = A.with_substates(profiled(spark, sf_dir))
    return out.withColumns({"n_substates": F.size("substates"), "pre_s": F.col("start_s") / SCALE - F.col("from_t"), "post_s": F.col("to_t") - F.col("end_s") / SCALE})


def staged_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns with the mean number of levels and jumps of their cycles."""
    held = staged(spark, sf_dir).groupBy("phase", "label").agg(F.avg("n_substates").alias("plateaus"), F.avg("steps").alias("jumps"))
    return patterns(spark, sf_dir).join(held, ["phase", "label"])


CONTEXT = f""",
ctx AS (SELECT c.user_id, c.cycle, c.avg_w, e.value AS p, epoch_us(e.ts) / 1e6 / {SCALE} AS t, e.event_id FROM cyc c JOIN events e
ON c.user_id = e.user_id AND epoch_us(e.ts) / 1e6 BETWEEN c.start_s - {DAY} AND c.end_s + {DAY}),
prof0 AS (SELECT user_id, cycle, any_value(avg_w) AS avg_w, count(*) AS n, list(p ORDER BY t, event_id) AS v, list(t ORDER BY t, event_id) AS t0 FROM ctx GROUP BY user_id, cycle),
prof AS (SELECT user_id, cycle, avg_w, n, v, list_transform(t0, lambda x: x - t0[1]) AS t, t0[n] - t0[1] AS span, t0[1] AS from_t, t0[n] AS to_t FROM prof0)"""
PROFILE = CYC + CONTEXT

BLEND = "{'level': (A.level * A.seconds + B.level * B.seconds) / (A.seconds + B.seconds), 'seconds': A.seconds + B.seconds}"
HELD = f""",
held_a AS (SELECT *, list_max(v) - list_min(v) AS amp FROM prof),
held_j AS (SELECT *, greatest(15.0, 0.06 * amp) AS near, list_filter(range(2, n + 1), lambda i: abs(v[i] - v[i - 1]) > greatest(25.0, 0.12 * amp)) AS breaks FROM held_a),
held_p AS (SELECT *, list_transform(list_zip([1] || breaks, list_transform(breaks, lambda i: i - 1) || [n]),
lambda z: {{'level': list_avg(v[z[1]:z[2]]), 'seconds': CASE WHEN z[2] - z[1] + 1 >= CASE WHEN z[2] = n THEN 2 ELSE greatest(2, CAST(floor(n * 0.03) AS BIGINT)) END THEN t[z[2]] - t[z[1]] ELSE 0.0 END}}) AS pl FROM held_j),
held_plateau AS (SELECT *, list_transform(list_filter(pl, lambda x: x.seconds > 0), lambda x: [x]) AS held FROM held_p),
held_m AS (SELECT *, CASE WHEN len(held) = 0 THEN [] ELSE list_reduce(held, lambda d, x: CASE WHEN abs(d[-1].level - x[1].level) <= near
THEN d[1:len(d) - 1] || [{BLEND.replace("A.", "d[-1].").replace("B.", "x[1].")}] ELSE d || x END) END AS merged FROM held_plateau),
held_lasting AS (SELECT *, list_filter(merged, lambda x: x.seconds >= greatest(2.0, 0.03 * span)) AS long FROM held_m),
held_k AS (SELECT *, list_transform(CASE WHEN len(long) > 0 THEN long ELSE merged END, lambda x: [x]) AS kept FROM held_lasting),
held_l AS (SELECT *, CASE WHEN len(kept) = 0 THEN [] ELSE list_reduce(kept, lambda d, x: CASE WHEN len(list_filter(d, lambda y: abs(x[1].level - y.level) <= near)) > 0
THEN list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i = list_filter(range(1, len(d) + 1), lambda q: abs(x[1].level - d[q].level) <= near)[1] THEN {BLEND.replace("A.", "d[i].").replace("B.", "x[1].")} ELSE d[i] END)
ELSE d || x END) END AS levels FROM held_k),
sub AS (SELECT user_id, cycle, from_t, to_t, CASE WHEN n < 5 THEN 0 WHEN amp < 10 THEN 1 ELSE len(levels) END AS n_substates, CASE WHEN n < 5 OR amp < 10 THEN 0 ELSE len(breaks) END AS steps,
CASE WHEN n < 5 THEN NULL WHEN amp < 10 THEN list_avg(v) ELSE list_max(list_transform(levels, lambda x: x.level)) END AS highest_w,
CASE WHEN n < 5 THEN NULL WHEN amp < 10 THEN span ELSE list_max(list_transform(levels, lambda x: x.seconds)) END AS longest_s FROM held_l),
staged AS (SELECT cyc.*, n_substates, steps, start_s / {SCALE} - from_t AS pre_s, to_t - end_s / {SCALE} AS post_s FROM cyc JOIN sub ON cyc.user_id = sub.user_id AND cyc.cycle = sub.cycle)"""
STAGED = PROFILE + HELD
STAGED_PATTERNS = PAT + CONTEXT + HELD + """, held AS (SELECT phase, label, avg(n_substates) AS plateaus, avg(steps) AS jumps FROM staged GROUP BY phase, label),
staged_pat AS (SELECT pat.*, plateaus, jumps FROM pat JOIN held ON pat.phase = held.phase AND pat.label = held.label)"""
