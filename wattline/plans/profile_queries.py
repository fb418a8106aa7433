"""Registered queries over the profiles of cycles (their readings and a day around): (Spark query, SQL) by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.operators import profiles as A
from wattline.plans.cycle_tables import PROFILE, STAGED, profiled, shaped, staged
from wattline.plans.pattern_queries import SUM, summary_columns
from wattline.plans.series_queries import r6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


DELTA_STEPS = f"""WITH {PROFILE},
h AS (SELECT *, greatest(1, least(n // 5, 6)) AS k FROM prof),
b AS (SELECT *, list_median(v[1:k]) AS before_w, list_median(v[n - k + 1:n]) AS after_w FROM h),
q AS (SELECT *, greatest(list_median(list_transform(v[1:k], lambda x: abs(x - before_w))), list_median(list_transform(v[n - k + 1:n], lambda x: abs(x - after_w)))) AS noise_w,
abs(after_w - before_w) AS drift_w, greatest(abs(before_w), abs(after_w), 40.0) AS scale,
list_transform(range(1, n + 1), lambda i: v[i] - before_w - (after_w - before_w) * CASE WHEN span > 0 THEN t[i] / span ELSE 0.0 END) AS d FROM b),
o AS (SELECT *, list_transform(d, lambda x: greatest(x, 0.0)) AS over, list_transform(d, lambda x: round(x, 3)) AS r, CASE WHEN n >= 5 THEN n // 5 ELSE 0 END AS cut FROM q),
steady AS (SELECT *, list_max(r) AS delta_peak_w, avg_w - before_w AS delta_avg_w, greatest(list_median(over[cut + 1:n - cut]), 0.0) AS steady_w, list_max(over) AS inrush_w,
coalesce(list_sum(list_transform(range(2, n + 1), lambda i: (over[i - 1] + over[i]) / 2 * (t[i] - t[i - 1]))), 0.0) / 3600 AS delta_wh FROM o),
f AS (SELECT *, list_filter(range(list_position(r, delta_peak_w), n + 1), lambda i: abs(r[i] - steady_w) <= greatest(0.15 * steady_w, 8.0)) AS settled,
list_transform(over, lambda x: abs(x - steady_w) <= greatest(0.12 * steady_w, 6.0)) AS held FROM steady)"""
DELTA = f"""{DELTA_STEPS}
SELECT user_id, cycle, n, round(before_w, 6) AS before_w, round(after_w, 6) AS after_w, round(noise_w, 6) AS noise_w,
round(greatest(0.0, 1 - noise_w / scale - drift_w / (2.5 * scale)), 6) AS baseline_quality, round(delta_avg_w, 6) AS delta_avg_w, round(delta_peak_w, 3) AS delta_peak_w,
round(delta_wh, 6) AS delta_wh, round(steady_w, 6) AS steady_w, round(inrush_w / greatest(CASE WHEN steady_w > 0 THEN steady_w ELSE abs(delta_avg_w) END, 1.0), 6) AS inrush_ratio,
round(CASE WHEN steady_w > 0 AND len(settled) > 0 THEN t[settled[1]] ELSE 0.0 END, 6) AS settling_s,
CASE WHEN steady_w > 0 THEN len(list_filter(range(1, n + 1), lambda i: held[i] AND (i = 1 OR NOT held[i - 1]))) ELSE 0 END AS plateaus FROM f"""


@query("r24_baseline_delta", DELTA)
def r24(spark, sf_dir):
    out = A.with_baseline_delta(profiled(spark, sf_dir))
    figures = ("before_w", "after_w", "noise_w", "baseline_quality", "delta_avg_w", "delta_wh", "steady_w", "inrush_ratio", "settling_s")
    return out.select("user_id", "cycle", F.size("points").cast("long").alias("n"), *r6(*figures), F.round("delta_peak_w", 3).alias("delta_peak_w"), F.col("plateaus").cast("long").alias("plateaus"))


SUBSTATES = f"WITH {STAGED} SELECT user_id, cycle, n_substates, steps, round(highest_w, 5) AS highest_w, round(longest_s, 5) AS longest_s FROM sub"


@query("r27_substates", SUBSTATES)
def r27(spark, sf_dir):
    out = A.with_substates(profiled(spark, sf_dir))
    highest, longest = (F.array_max(F.col("substates")[f]) for f in ("level", "seconds"))
    return out.select("user_id", "cycle", F.size("substates").cast("long").alias("n_substates"), F.col("steps").cast("long").alias("steps"), F.round(highest, 5).alias("highest_w"), F.round(longest, 5).alias("longest_s"))


@query("r18_pattern_distances")
def r18(spark, sf_dir):
    """All pairs of patterns of a phase; a phase has as many patterns as labels."""
    p = A.shaped_patterns(shaped(spark, sf_dir))
    both = p.alias("a").join(p.alias("b"), (F.col("a.phase") == F.col("b.phase")) & (F.col("a.label") < F.col("b.label")))
    a, b = A.columns("a", p), A.columns("b", p)
    return both.select(F.col("a.phase").alias("phase"), F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"), F.round(A.pattern_distance(a, b), 6).alias("distance"), A.one_cluster(a, b).alias("one_cluster"))




@query("p30_learning_quality", f"""{SUM}, d AS (SELECT user_id, cycle, baseline_quality AS bq, delta_wh AS dwh FROM ({DELTA}) x),
q AS (SELECT u.*, bq, dwh, CAST(1.0 AS DOUBLE) - CASE WHEN avg_w < 30 THEN 0.22 ELSE 0 END - CASE WHEN duration_s < 8 THEN 0.25 ELSE 0 END - CASE WHEN peak_to_avg > 6 THEN 0.18 ELSE 0 END - CASE WHEN duration_s > 600 AND (duty < 0.02 OR duty > 0.98) THEN 0.12 ELSE 0 END
- CASE WHEN n_substates > 10 THEN 0.10 ELSE 0 END - CASE WHEN n < 6 THEN 0.08 ELSE 0 END - CASE WHEN dwh < 0.002 THEN 0.20 ELSE 0 END - CASE WHEN pre_s <= 0 THEN 0.18 ELSE 0 END - CASE WHEN post_s <= 0 THEN 0.18 ELSE 0 END
- CASE WHEN bq < 0.22 THEN 0.30 WHEN bq < 0.45 THEN 0.14 ELSE 0 END AS quality FROM u JOIN d ON u.user_id = d.user_id AND u.cycle = d.cycle)
SELECT user_id, cycle, round(least(greatest(quality, 0), 1), 6) AS quality, CASE WHEN duration_s < 20 OR n < 4 THEN 'blocked' WHEN seg >= 0.70 AND completeness >= 0.45 THEN 'stable' WHEN completeness >= 0.10 THEN 'provisional' ELSE 'blocked' END AS tier FROM q""")
def p30(spark, sf_dir):
    """How good each cycle is to learn from, and on which tier."""
    from wattline.functions import scalars as S

    rows = A.with_baseline_delta(staged(spark, sf_dir)).withColumns({"bq": F.round("baseline_quality", 6), "dwh": F.round("delta_wh", 6)})
    c = {**summary_columns(), "peak_to_avg": F.col("peak_to_avg"), "duty": F.col("duty"), "baseline_quality": F.col("bq"), "delta_energy": F.col("dwh")}
    return rows.select("user_id", "cycle", F.round(S.learning_quality(c), 6).alias("quality"), S.learning_tier(c["dur"], c["points"], c["seg"], c["completeness"]).alias("tier"))
