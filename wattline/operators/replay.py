"""Replay of stored readings: two passes of the live learner, then edges, each only for series that gave nothing before.

The first pass begins at the upper median of a series' first readings and leaves those out; the second begins at nothing and
takes all; the last looks for edges over a low quantile. A series with a cycle in one pass isn't looked at again, so what a
later pass reads shrinks to the series that are left. The passes are written steps and depend on the readings alone: a run that
is repeated gives the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.operators.learning import edge_cycles
from wattline.operators.live import LiveRules, built_cycles, segment
from wattline.operators.matching import interval_context
from wattline.operators.series import EVENTS, Series, primed_baseline
from wattline.sources.steps import written

#: Readings that prime a series, and how many it must have at least for another try.
SEED, RETRY, EDGES = 60, 20, 6


def replay_rules(rules: LiveRules = LiveRules()) -> LiveRules:
    """Stored readings are sparse: no median, and one reading starts a cycle."""
    return replace(rules, median=1, machine=replace(rules.machine, debounce=1))


def replayed_cycles(df: DataFrame, rules: LiveRules = LiveRules(), s: Series = EVENTS, gap_s: float = 150.0) -> DataFrame:
    """The cycles of `built_cycles` for every series of a table of readings, with `replay`, the pass that found them: 1, 2 or 3.

    Edges close after `gap_s` without a reading while low; their cycles have no rolls and need two samples and half the duration."""
    rules, key = replay_rules(rules), list(s.key)
    order = s.window()
    rows = df.where(F.col(s.ts).isNotNull() & F.col(s.value).isNotNull()).select(*key, s.ts, s.tie, s.value)
    numbered = rows.withColumn("__n", F.row_number().over(order))
    base = primed_baseline(rows, s, SEED).select(*key, F.col("baseline").alias("__base"))
    first = numbered.where(F.col("__n") > SEED).join(base, key)
    one = written(built_cycles(segment(first, rules, s, primed=F.col("__base")), rules).withColumn("replay", F.lit(1)), "replay")
    counts = rows.groupBy(*key).agg(F.count("*").alias("__count"))
    left = counts.join(one.select(*key).distinct(), key, "left_anti")
    again = rows.join(left.where(F.col("__count") > RETRY).select(*key), key, "left_semi")
    two = written(built_cycles(segment(again, rules, s), rules).withColumn("replay", F.lit(2)), "replay")
    left = left.join(two.select(*key).distinct(), key, "left_anti").where(F.col("__count") >= EDGES)
    rest = rows.join(left.select(*key), key, "left_semi")
    return one.unionByName(two).unionByName(edge_built(rest, rules, s, gap_s))


def edge_built(rows: DataFrame, rules: LiveRules, s: Series, gap_s: float) -> DataFrame:
    """The cycles between edges, as built cycles."""
    found = edge_cycles(rows, rules.machine.delta_on, rules.machine.delta_off, gap_s, s)
    key = s.key[0]
    inside = interval_context(found, rows.select(*s.key, s.ts, s.tie, s.value), key, 0.0, 0.0, s.seconds(), max(rules.longest_s / 8, 1.0))
    sample = F.struct(F.col("t"), F.col(s.tie).alias("tie"), F.col(s.value).cast("double").alias("p"))
    held = inside.groupBy(*s.key, "start_s", "end_s").agg(F.array_sort(F.collect_list(sample)).alias("inside"))
    plain = F.transform("inside", lambda x: F.struct(x["t"].alias("t"), x["p"].alias("p")))
    none = F.slice(plain, 1, 0)
    zero = F.lit(0.0)
    raw = held.select(
        *s.key, "start_s", "end_s", F.lit("edge").alias("start_reason"), F.lit("edge").alias("end_reason"), F.lit(1).alias("start_signals"), zero.alias("start_delta_w"), zero.alias("start_slope"),
        zero.alias("baseline_start_w"), zero.alias("baseline_end_w"), zero.alias("end_stable_s"), none.alias("pre"), plain.alias("inside"), none.alias("post"),
    )
    loose = replace(rules, least_samples=2, shortest_s=max(5.0, 0.5 * rules.shortest_s))
    return built_cycles(raw, loose, least_high=0).withColumns({"cut_start": F.lit(False), "cut_end": F.lit(False), "replay": F.lit(3)})
