"""Cycles: value-driven segmentation as folds over a series, and features of the cycles found."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions import curves as V
from wattline.operators.series import EVENTS, Series


@dataclass(frozen=True)
class CycleRules:
    """Thresholds of the segmentation; the defaults are the detector's own."""

    delta_on: float = 30.0
    delta_off: float = 12.0
    slope: float = 120.0
    step: float = 18.0
    inrush: float = 1.6
    spread: float = 10.0
    shutdown: float = 40.0
    debounce: int = 2
    grace_s: float = 12.0
    hold_s: float = 6.0
    least_points: int = 3


IDLE, MAYBE_ON, ACTIVE, MAYBE_OFF = "idle", "possible_start", "active", "possible_end"


def cycle_transitions(df: DataFrame, baseline: str, rules: CycleRules = CycleRules(), s: Series = EVENTS) -> DataFrame:
    """Starts and ends of cycles, one row for each: (key, t, tie, kind, reason, since).

    A fold over the samples of a series in order; its accumulator holds the state, what led to it and the transitions so
    far, so its size follows the number of transitions and not that of samples."""
    none = "array<struct<t:double,tie:bigint,kind:string,reason:string,since:double>>"
    zero, no_time = F.lit(0.0), F.lit(None).cast("double")
    start = F.struct(
        F.lit(IDLE).alias("state"), no_time.alias("t"), zero.alias("p"), no_time.alias("candidate"), F.lit("").alias("reason"), F.lit(0).alias("count"), no_time.alias("on"), no_time.alias("ending"), F.array().cast("array<double>").alias("powers"), F.array().cast(none).alias("rows")
    )

    def step(a: Column, x: Column) -> Column:
        delta, dt, moved = x["p"] - x["base"], x["t"] - a["t"], F.when(a["t"].isNotNull(), x["p"] - a["p"]).otherwise(0.0)
        slope = F.when(dt > 0, moved / dt).otherwise(0.0)
        by_slope, by_step, by_delta = slope >= rules.slope, moved >= rules.step, delta >= rules.delta_on
        by_inrush = (x["p"] / F.greatest(x["base"], F.lit(1.0)) >= rules.inrush) & (slope >= 0)
        starts = by_slope | by_delta | (by_step & by_inrush)  # either strong signal, or both of the weak ones
        why = F.when(by_slope, "derivative_spike").when(by_step, "step_jump").when(by_inrush, "inrush_ratio").otherwise("delta_threshold")
        near, shut = delta <= rules.delta_off, slope <= -rules.shutdown
        mean = F.aggregate(a["powers"], zero, lambda m, v: m + v) / F.size(a["powers"])
        spread = F.aggregate(a["powers"], zero, lambda m, v: m + F.abs(v - mean)) / F.size(a["powers"])
        calm = (F.size(a["powers"]) > 0) & (spread <= rules.spread)
        ends = near.cast("int") + calm.cast("int") + shut.cast("int") >= 2
        state, count = a["state"], a["count"]
        leaving = (state == ACTIVE) & (x["t"] - a["on"] >= rules.grace_s) & (near | shut)
        lasting = (state == MAYBE_OFF) & (near | ends)
        stable = x["t"] - a["ending"]
        done = lasting & (count + 1 >= rules.debounce) & (stable >= max(1.0, rules.hold_s)) & (F.size(a["powers"]) + 1 >= max(2, rules.least_points)) & near
        back = (state == MAYBE_OFF) & ~(near | ends) & starts
        first = (state == IDLE) & starts
        again = (state == MAYBE_ON) & starts
        begun = (first & F.lit(rules.debounce <= 1)) | (again & (count + 1 >= rules.debounce))
        gone = (state == MAYBE_ON) & ~starts & (delta <= max(0.5 * rules.delta_off, 0.0))
        now = F.when(begun | back, ACTIVE).when(done | gone, IDLE).when(first, MAYBE_ON).when(leaving, MAYBE_OFF).otherwise(state)
        counted = F.when(first | leaving, 1).when(again | (lasting & ~done), count + 1).when((state == MAYBE_ON) & ~gone, count).when((state == MAYBE_OFF) & ~done & ~back, count).otherwise(0)
        candidate = F.when(first, x["t"]).when(done | gone, no_time).otherwise(a["candidate"])
        reason = F.when(first, why).otherwise(a["reason"])
        on = F.when(begun, F.coalesce(candidate, x["t"])).when(done, no_time).otherwise(a["on"])
        ending = F.when(leaving, x["t"]).when(done | back, no_time).otherwise(a["ending"])
        kept = F.slice(a["powers"], F.greatest(F.size(a["powers"]) - 22, F.lit(1)), 23)
        powers = F.when(leaving, F.array(x["p"])).when(done | back, F.array().cast("array<double>")).when(state == MAYBE_OFF, F.concat(kept, F.array(x["p"]))).otherwise(a["powers"])
        row = F.struct(x["t"].alias("t"), x["tie"].alias("tie"), F.when(begun, "started").otherwise("ended").alias("kind"), F.when(begun, reason).otherwise("stable_near_baseline").alias("reason"), F.when(begun, on).otherwise(a["on"]).alias("since"))
        rows = F.when(begun | done, F.concat(a["rows"], F.array(row))).otherwise(a["rows"])
        return F.struct(now.alias("state"), x["t"].alias("t"), x["p"].alias("p"), candidate.alias("candidate"), reason.alias("reason"), counted.alias("count"), on.alias("on"), ending.alias("ending"), powers.alias("powers"), rows.alias("rows"))

    with_base = df.withColumn("base", F.col(baseline).cast("double"))
    return s.fold(with_base, start, step, lambda a: a["rows"], ("base",)).select(*s.key, F.inline("out")).withColumnRenamed("tie", s.tie)


def cycles_of(transitions: DataFrame, s: Series = EVENTS) -> DataFrame:
    """(key, start_s, end_s, reason) of every finished cycle."""
    w = Window.partitionBy(*s.key).orderBy("t", s.tie)
    paired = transitions.withColumn("start_reason", F.lag("reason").over(w)).where(F.col("kind") == "ended")
    return paired.select(*s.key, F.col("since").alias("start_s"), F.col("t").alias("end_s"), "start_reason")


def offline_events(df: DataFrame, threshold: float = 25.0, least_s: float = 8.0, window: int = 120, seed: int = 40, s: Series = EVENTS) -> DataFrame:
    """(key, start_s, end_s, baseline) of every excursion above a rolling median of the samples outside of events.

    The median looks back on a state-dependent history, so this is a fold; an event still open at the end is closed there."""
    none = "array<struct<start_s:double,end_s:double,baseline:double>>"
    sample = F.struct(s.seconds().alias("t"), F.col(s.tie).alias("tie"), F.col(s.value).cast("double").alias("p"))
    arrays = df.groupBy(*s.key).agg(F.array_sort(F.collect_list(sample)).alias("x"))
    first = F.transform(F.slice("x", 1, seed), lambda v: v["p"])
    start = F.struct(first.alias("seen"), V.median(first).alias("now"), F.lit(False).alias("on"), F.lit(0.0).alias("since"), F.lit(0.0).alias("base"), F.lit(0.0).alias("t"), F.array().cast(none).alias("rows"))

    def step(a: Column, x: Column) -> Column:
        base = a["now"]
        fresh = ~a["on"] & (x["p"] > base + threshold)
        on = a["on"] | fresh
        since, at = F.when(fresh, x["t"]).otherwise(a["since"]), F.when(fresh, base).otherwise(a["base"])
        ends = on & (x["p"] <= base + 0.55 * threshold)
        row = F.struct(since.alias("start_s"), x["t"].alias("end_s"), at.alias("baseline"))
        rows = F.when(ends & (x["t"] - since >= least_s), F.concat(a["rows"], F.array(row))).otherwise(a["rows"])
        idle = ends | ~on
        kept = F.slice(a["seen"], F.greatest(F.size(a["seen"]) - (window - 2), F.lit(1)), window - 1)
        seen = F.concat(kept, F.array(x["p"]))
        # The median is carried along and computed anew only when a sample joins the window.
        return F.struct(
            F.when(idle, seen).otherwise(a["seen"]).alias("seen"), F.when(idle, V.median(seen)).otherwise(base).alias("now"),
            (on & ~ends).alias("on"), since.alias("since"), at.alias("base"), x["t"].alias("t"), rows.alias("rows"),
        )

    def finish(a: Column) -> Column:
        row = F.struct(a["since"].alias("start_s"), a["t"].alias("end_s"), a["base"].alias("baseline"))
        return F.when(a["on"] & (a["t"] - a["since"] >= least_s), F.concat(a["rows"], F.array(row))).otherwise(a["rows"])

    return arrays.select(*s.key, F.inline(F.aggregate("x", start, step, finish)))


def merge_gaps(events: DataFrame, gap_s: float = 6.0, key: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Events no more than gap_s apart become one: a running maximum of the ends and a running number of the gaps."""
    w = Window.partitionBy(*key).orderBy("start_s", "end_s")
    before = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = events.withColumn("__new", F.coalesce((F.greatest(F.col("start_s") - before, F.lit(0.0)) > gap_s).cast("long"), F.lit(1)))
    out = out.withColumn("event_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return out.groupBy(*key, "event_no").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.min_by("baseline", F.struct("start_s", "end_s")).alias("baseline"), F.count("*").alias("n_merged"))


def island_cycles(df: DataFrame, threshold: float, s: Series = EVENTS) -> DataFrame:
    """Runs of samples at or above a threshold as cycles: (key, cycle, sample columns), for the feature operators below."""
    from wattline.operators.series import islands

    return islands(df, F.col(s.value) >= threshold, s, "cycle").where("active").drop("active")


def cycle_features(samples: DataFrame, key: tuple[str, ...] = ("user_id", "cycle"), s: Series = EVENTS, least: int = 3) -> DataFrame:
    """Features of each cycle with at least `least` samples: power statistics, energy by trapezoids, duty, rise and fall rates."""
    w = Window.partitionBy(*key).orderBy(s.ts, s.tie)
    p, t = F.col(s.value), s.seconds()
    rows = samples.withColumn("__t", t).withColumn("__e", (p + F.lag(p).over(w)) / 2 * (F.col("__t") - F.lag("__t").over(w)))
    stats = F.col("__low"), F.col("__high")
    whole = Window.partitionBy(*key)
    rows = rows.withColumn("__low", F.min(p).over(whole)).withColumn("__high", F.max(p).over(whole))
    band = stats[1] - stats[0]
    at10, at80 = stats[0] + 0.1 * band, stats[0] + 0.8 * band
    out = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("__t").alias("start_s"), F.max("__t").alias("end_s"), F.avg(p).alias("avg_w"), F.max(p).alias("peak_w"), F.var_pop(p).alias("variance"), F.stddev_pop(p).alias("std_w"),
        (F.coalesce(F.sum("__e"), F.lit(0.0)) / 3600.0).alias("energy_wh"), F.avg(F.when(p >= 0.5 * stats[1], 1.0).otherwise(0.0)).alias("duty"),
        F.min(F.when(p >= at10, F.col("__t"))).alias("rise10"), F.min(F.when(p >= at80, F.col("__t"))).alias("rise80"), F.max(F.when(p >= at80, F.col("__t"))).alias("fall80"), F.max(F.when(p <= at10, F.col("__t"))).alias("fall10"),
        F.max(band).alias("band"),
    )
    out = out.where(F.col("n") >= least).withColumn("duration_s", F.col("end_s") - F.col("start_s")).withColumn("peak_to_avg", F.col("peak_w") / F.greatest(F.col("avg_w"), F.lit(1e-9)))
    rise = F.when(F.col("rise80") >= F.col("rise10"), 0.7 * F.col("band") / F.greatest(F.col("rise80") - F.col("rise10"), F.lit(0.1))).otherwise(0.0)
    fall = F.when(F.col("fall10").isNotNull() & F.col("fall80").isNotNull(), 0.7 * F.col("band") / F.greatest(F.col("fall10") - F.col("fall80"), F.lit(0.1))).otherwise(0.0)
    return out.withColumn("rise_rate", rise).withColumn("fall_rate", fall).drop("rise10", "rise80", "fall10", "fall80", "band")
