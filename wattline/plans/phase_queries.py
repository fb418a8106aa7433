"""Registered queries over the parts of cycles: (Spark query, SQL) by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.operators import phases as E
from wattline.operators import profiles as A
from wattline.plans.cycle_tables import HELD, PROFILE, profiled
from wattline.plans.profile_queries import DELTA_STEPS
from wattline.plans.series_queries import SCALE, r6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = ("user_id", "cycle")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def parts(spark, sf_dir):
    return E.with_parts(A.with_baseline_delta(profiled(spark, sf_dir)))


PARTS = f"""{DELTA_STEPS},
on0 AS (SELECT *, greatest(5.0, 0.12 * delta_peak_w, 0.2 * delta_avg_w) AS low_w FROM f),
on1 AS (SELECT *, list_filter(range(1, n + 1), lambda i: r[i] >= low_w) AS act, greatest(steady_w, delta_avg_w, low_w) AS lvl, list_position(r, delta_peak_w) AS pk FROM on0),
on2 AS (SELECT *, act[1] AS a, act[-1] AS z FROM on1 WHERE len(act) > 0),
on3 AS (SELECT *, pk <= a + greatest(1, (z - a + 1) // 4) AND delta_peak_w >= greatest(1.2 * lvl, lvl + 12) AS surge,
coalesce(list_filter(range(pk, z), lambda i: r[i] <= greatest(1.12 * lvl, low_w))[1], z) AS settle FROM on2),
on4 AS (SELECT *, CASE WHEN surge AND settle > a THEN settle ELSE a END AS run FROM on3),
on5 AS (SELECT *, list_filter(range(run + 1, z + 1), lambda i: r[i] <= greatest(low_w, 0.35 * lvl)) AS fallen FROM on4),
on6 AS (SELECT *, CASE WHEN len(fallen) > 0 THEN greatest(run + 1, fallen[-1] - 1) END AS shut FROM on5),
on7 AS (SELECT *, coalesce(shut, z) AS stop FROM on6),
on8 AS (SELECT *, list_avg(r[run:stop]) AS m FROM on7),
on9 AS (SELECT *, list_avg(list_transform(r[run:stop], lambda x: (x - m) * (x - m))) > greatest(0.08 * m * m, 25.0) AS wavy FROM on8),
part0 AS (SELECT *, unnest(list_filter([{{'kind': 'baseline', 'low': 1, 'high': a, 'ok': a > 1}}, {{'kind': 'inrush', 'low': a, 'high': settle, 'ok': surge AND settle > a}},
{{'kind': CASE WHEN wavy THEN 'modulated_run' ELSE 'steady_run' END, 'low': run, 'high': stop, 'ok': stop > run}}, {{'kind': 'shutdown', 'low': shut, 'high': z, 'ok': coalesce(shut <= z, false)}},
{{'kind': 'cooldown', 'low': z, 'high': n, 'ok': z < n}}], lambda x: x.ok)) AS x FROM on9),
part1 AS (SELECT *, x.kind AS kind, x.low AS lo, x.high AS hi, row_number() OVER (PARTITION BY user_id, cycle ORDER BY x.low, x.high, list_position(['baseline', 'inrush', 'steady_run', 'modulated_run', 'shutdown', 'cooldown'], x.kind)) - 1 AS phase_index FROM part0),
part2 AS (SELECT *, t[lo] AS start_s, t[hi] + CASE WHEN lo = hi AND n > 1 THEN greatest(t[least(lo + 1, n)] - t[lo], 0.0) ELSE 0.0 END AS end_s,
CASE WHEN lo > 1 THEN r[lo - 1] ELSE 0.0 END AS prior, CASE WHEN hi < n THEN r[hi + 1] ELSE 0.0 END AS nxt FROM part1),
phases AS (SELECT user_id, cycle, phase_index, kind, start_s, end_s, greatest(end_s - start_s, 0.0) AS duration_s, list_avg(v[lo:hi]) AS avg_w, list_max(v[lo:hi]) AS peak_w, CASE WHEN kind = 'cooldown' THEN after_w ELSE before_w END AS baseline_w,
list_avg(r[lo:hi]) AS delta_avg_w, list_max(r[lo:hi]) AS delta_peak_w, r[lo] - prior AS step_in_w, nxt - r[hi] AS step_out_w,
CASE WHEN end_s > start_s THEN (r[hi] - r[lo]) / (end_s - start_s) ELSE 0.0 END AS slope_in, (nxt - r[hi]) / greatest(end_s - start_s, 1.0) AS slope_out FROM part2)"""
FIGURES = ("start_s", "end_s", "duration_s", "avg_w", "peak_w", "baseline_w", "delta_avg_w", "delta_peak_w", "step_in_w", "step_out_w", "slope_in", "slope_out")


@query("r25_event_phases", f"{PARTS} SELECT user_id, cycle, phase_index, kind, {', '.join(f'round({c}, 6) AS {c}' for c in FIGURES)} FROM phases")
def r25(spark, sf_dir):
    return E.event_phases(parts(spark, sf_dir), KEY).select(*KEY, "phase_index", "kind", *r6(*FIGURES))


@query("r26_cycle_summaries", f"""{PARTS}, sums AS (SELECT user_id, cycle, sum(CASE WHEN kind = 'inrush' THEN duration_s ELSE 0.0 END) AS inrush_s, sum(CASE WHEN kind IN ('steady_run', 'modulated_run') THEN duration_s ELSE 0.0 END) AS run_s,
sum(CASE WHEN kind IN ('shutdown', 'cooldown') THEN duration_s ELSE 0.0 END) AS shutdown_s, avg(CASE WHEN kind IN ('steady_run', 'modulated_run') THEN delta_avg_w END) AS run_w, bool_or(kind = 'modulated_run') AS wavy FROM phases GROUP BY user_id, cycle),
typed AS (SELECT c.user_id, c.cycle, label, s.*EXCLUDE (user_id, cycle), CASE WHEN inrush_s > 0 THEN 'inrush_' ELSE '' END || CASE WHEN wavy THEN 'modulated' ELSE 'steady' END || CASE WHEN duration_s >= 600 THEN '_long' WHEN duration_s <= 120 THEN '_short' ELSE '_normal' END AS cycle_type
FROM cyc c LEFT JOIN sums s ON c.user_id = s.user_id AND c.cycle = s.cycle)
SELECT user_id, cycle, label || '_' || cycle_type AS cycle_name, cycle_type, {', '.join(f'round(coalesce({c}, 0), 6) AS {c}' for c in ('inrush_s', 'run_s', 'shutdown_s', 'run_w'))} FROM typed""")
def r26(spark, sf_dir):
    found = parts(spark, sf_dir)
    out = E.cycle_summaries(found, E.event_phases(found, KEY), KEY)
    return out.select(*KEY, "cycle_name", "cycle_type", *r6("inrush_s", "run_s", "shutdown_s", "run_w"))


@query("o04_event_phases", f"{PARTS}, newest AS (SELECT user_id, cycle FROM cyc ORDER BY start_s DESC, user_id, cycle LIMIT 20) SELECT user_id, cycle, phase_index, kind, round(duration_s, 6) AS duration_s FROM phases JOIN newest USING (user_id, cycle)")
def o04(spark, sf_dir):
    """The parts of the 20 newest cycles: the list's own limit."""
    found = parts(spark, sf_dir)
    newest = found.select(*KEY, "start_s").orderBy(F.desc("start_s"), *KEY).limit(20).select(*KEY)
    return E.event_phases(found.join(newest, list(KEY), "left_semi"), KEY).select(*KEY, "phase_index", "kind", *r6("duration_s"))


@query("a21_feature_snapshot", f"""{DELTA_STEPS}{HELD},
snap AS (SELECT f.*, s.steps, c.variance, list_avg(r) AS m FROM f JOIN sub s USING (user_id, cycle) JOIN cyc c USING (user_id, cycle)),
snap1 AS (SELECT *, sqrt(list_avg(list_transform(r, lambda x: (x - m) * (x - m)))) AS delta_std FROM snap)
SELECT user_id, cycle, round(list_max(v) - list_min(v), 6) AS power_range, round(sqrt(variance), 6) AS power_std, round(sqrt(variance) / greatest(avg_w, 1.0), 6) AS power_cv, round(delta_std, 6) AS delta_std,
round(delta_std / greatest(abs(m), 1.0), 6) AS delta_cv, round(list_max(r) - list_min(r), 6) AS delta_range, round(CASE WHEN steps > 0 THEN (list_max(v) - list_min(v)) / steps ELSE 0.0 END, 6) AS avg_step_w FROM snap1""")
def a21(spark, sf_dir):
    out = E.feature_snapshot(A.with_substates(parts(spark, sf_dir)))
    return out.select(*KEY, *r6("power_range", "power_std", "power_cv", "delta_std", "delta_cv", "delta_range", "avg_step_w"))


#: The supplied readings lie hours apart: what is asked for before and after a cycle, in scaled seconds.
ROLL = 43200.0 / SCALE
ON, OFF = 30.0, 12.0
AROUND = f"""{DELTA_STEPS},
cut0 AS (SELECT f.user_id, f.cycle, before_w, c.avg_w AS level, c.duration_s / (c.n - 1) AS step, list_transform(range(1, f.n + 1), lambda i: {{'t': t[i], 'p': v[i]}}) AS pts, c.start_s / {SCALE} - from_t AS s0, c.end_s / {SCALE} - from_t AS e0 FROM f JOIN cyc c USING (user_id, cycle)),
cut1 AS (SELECT *, list_filter(pts, lambda x: x.t < s0 - 1e-6) AS pre, list_filter(pts, lambda x: x.t BETWEEN s0 - 1e-6 AND e0 + 1e-6) AS inside, list_filter(pts, lambda x: x.t > e0 + 1e-6) AS post FROM cut0),
cut2 AS (SELECT *, CASE len(pre) WHEN 0 THEN 0.0 WHEN 1 THEN step ELSE (pre[-1].t - pre[1].t) * len(pre) / (len(pre) - 1) END AS pre_s, CASE len(post) WHEN 0 THEN 0.0 WHEN 1 THEN step ELSE (post[-1].t - post[1].t) * len(post) / (len(post) - 1) END AS post_s FROM cut1)"""


def around(spark, sf_dir):
    """Cycles with their profile cut into the points before, inside and after them."""
    out = A.with_baseline_delta(profiled(spark, sf_dir))
    low, high = F.col("start_s") / SCALE - F.col("from_t") - 1e-6, F.col("end_s") / SCALE - F.col("from_t") + 1e-6
    side = lambda test: F.filter("points", test)
    return out.withColumns({
        "pre": side(lambda x: x["t"] < low), "inside": side(lambda x: (x["t"] >= low) & (x["t"] <= high)), "post": side(lambda x: x["t"] > high),
        "step": F.col("duration_s") / (F.col("n") - 1),
    })


@query("w13_roll_seconds", f"{AROUND} SELECT user_id, cycle, len(pre) AS n_pre, len(post) AS n_post, round(pre_s, 6) AS pre_s, round(post_s, 6) AS post_s FROM cut2")
def w13(spark, sf_dir):
    seconds = lambda c: F.round(E.span_seconds(F.transform(c, lambda x: x["t"]), F.col("step")), 6)
    out = around(spark, sf_dir)
    return out.select(*KEY, F.size("pre").cast("long").alias("n_pre"), F.size("post").cast("long").alias("n_post"), seconds("pre").alias("pre_s"), seconds("post").alias("post_s"))


@query("w15_cut_off", f"""{AROUND} SELECT user_id, cycle, (len(pre) = 0 AND pre_s < greatest(0.5 * {ROLL}, 0.5)) OR len(inside) < 2 OR
(coalesce(list_max(list_transform(pre[greatest(len(pre) - 2, 1):], lambda x: x.p)), before_w) - before_w >= greatest(0.6 * {ON}, 15.0) AND inside[1].p - before_w >= greatest(0.8 * {ON}, 20.0)) AS cut_start,
(post_s <= 0 AND len(post) <= 1) OR (len(inside) >= 3 AND inside[-2].p - inside[-1].p >= greatest(2.5 * {OFF}, 20.0) AND inside[-1].p <= before_w + {OFF} AND post_s < greatest(0.5 * {ROLL}, 0.5)) AS cut_end FROM cut2""")
def w15(spark, sf_dir):
    flags = E.cut_off(F.col("pre"), F.col("inside"), F.col("post"), F.col("step"), F.col("before_w"), ON, OFF, ROLL, ROLL)
    return around(spark, sf_dir).select(*KEY, *(c.alias(name) for name, c in flags.items()))


@query("w17_accepted_cycles", f"""{AROUND} SELECT user_id, cycle, len(inside) >= 3 AND (e0 - s0) BETWEEN 3 AND 28800 / {SCALE} * 10 AND len(list_filter(inside, lambda x: x.p >= before_w + {ON})) >= 2 AS accepted FROM cut2""")
def w17(spark, sf_dir):
    """The builder's gates and the failsafe for long runs (ten times 8 hours, as readings lie hours apart)."""
    above = F.size(F.filter("inside", lambda x: x["p"] >= F.col("before_w") + ON))
    lasts = F.col("end_s") / SCALE - F.col("start_s") / SCALE
    return around(spark, sf_dir).select(*KEY, E.accepted(F.size("inside"), lasts, above, longest=28800.0 / SCALE * 10).alias("accepted"))


@query("r30_profile_plateaus", f"""WITH {PROFILE}, a AS (SELECT *, greatest(12.0, 0.08 * abs(list_median(v))) AS near, greatest(20.0, 0.1 * list_max(v)) AS jump, list_transform(range(2, n + 1), lambda i: abs(v[i] - v[i - 1])) AS moves FROM prof),
b AS (SELECT *, list_filter(range(2, n + 1), lambda i: moves[i - 1] > near) AS breaks, CASE WHEN n >= 3 THEN list_filter(moves, lambda m: m >= jump) ELSE [] END AS jumps FROM a),
c AS (SELECT *, CASE WHEN n >= 3 THEN list_filter(list_transform(list_zip([1] || breaks, list_transform(breaks, lambda i: i - 1) || [n]), lambda z: {{'level': list_avg(v[z[1]:z[2]]), 'points': z[2] - z[1] + 1}}), lambda x: x.points >= 2) ELSE [] END AS held FROM b),
d AS (SELECT *, list_transform(list_sort(list_transform(held, lambda x: x.level)), lambda x: [{{'s': x, 'k': 1}}]) AS lv FROM c),
e AS (SELECT *, CASE WHEN len(lv) = 0 THEN 0 ELSE len(list_reduce(lv, lambda q, x: CASE WHEN abs(x[1].s - q[-1].s / q[-1].k) <= greatest(18.0, 1.4 * near) THEN q[1:len(q) - 1] || [{{'s': q[-1].s + x[1].s, 'k': q[-1].k + 1}}] ELSE q || x END)) END AS n_levels FROM d)
SELECT user_id, cycle, len(held) AS n_plateaus, n_levels, len(jumps) AS n_jumps, round(coalesce(list_max(jumps), 0), 6) AS max_jump_w, round(coalesce(list_avg(jumps), 0), 6) AS mean_jump_w, greatest(len(held) - 1, 0) AS n_transitions FROM e""")
def r30(spark, sf_dir):
    out = E.with_plateaus(profiled(spark, sf_dir))
    sizes = {"n_plateaus": F.size("stretches"), "n_levels": F.size("levels"), "n_jumps": F.col("n_jumps"), "n_transitions": F.greatest(F.size("stretches") - 1, F.lit(0))}
    return out.select(*KEY, *(c.cast("long").alias(name) for name, c in sizes.items()), *r6("max_jump_w", "mean_jump_w"))
