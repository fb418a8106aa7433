"""Profiles of cycles: power over the local baseline, levels held, and distances of patterns that take the curve into account.

A profile is `points`, an array of (t, tie, p) in order with t in seconds. Each step is a column of its own, so that an
intermediate result is computed once; a profile is as long as its cycle and its context, never a whole series."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions import curves as V
from wattline.functions import scalars as S

LEVELS = "array<struct<level:double,seconds:double>>"


def profiles(readings: DataFrame, key: tuple[str, ...], t: Column, tie: str, value: str) -> DataFrame:
    """(key, points, from_t, to_t): the readings of each key in order, t counted from the first, and the times of both ends."""
    sample = F.struct(t.cast("double").alias("t"), F.col(tie).alias("tie"), F.col(value).cast("double").alias("p"))
    ordered = readings.groupBy(*key).agg(F.array_sort(F.collect_list(sample)).alias("points"))
    ordered = ordered.withColumns({"from_t": F.element_at("points", 1)["t"], "to_t": F.element_at("points", -1)["t"]})
    first = F.col("from_t")
    return ordered.withColumn("points", F.transform("points", lambda x: F.struct((x["t"] - first).alias("t"), x["tie"].alias("tie"), x["p"].alias("p"))))


def with_baseline_delta(df: DataFrame) -> DataFrame:
    """Baselines before and after from the ends of a profile, and what lies above the line between them.

    Adds before_w, after_w, noise_w, drift_w, baseline_quality, delta_avg_w (from avg_w), delta_peak_w, delta_wh, steady_w,
    inrush_w, inrush_ratio, settling_s and plateaus. A row without points is left out."""
    v, n = F.transform("points", lambda x: x["p"]), F.size("points")
    ends = F.greatest(F.lit(1), F.least(F.floor(n / 5).cast("int"), F.lit(6)))
    span = F.element_at("points", -1)["t"]
    out = df.where(n > 0).withColumns({"__head": F.slice(v, 1, ends), "__tail": F.slice(v, n - ends + 1, ends)})
    out = out.withColumns({"before_w": V.median(F.col("__head")), "after_w": V.median(F.col("__tail"))})
    off = lambda end, base: V.median(F.transform(end, lambda x: F.abs(x - F.col(base))))
    out = out.withColumns({"noise_w": F.greatest(off("__head", "before_w"), off("__tail", "after_w")), "drift_w": F.abs(F.col("after_w") - F.col("before_w"))})
    scale = F.greatest(F.abs("before_w"), F.abs("after_w"), F.lit(40.0))
    out = out.withColumn("baseline_quality", F.greatest(F.lit(0.0), 1 - F.col("noise_w") / scale - F.col("drift_w") / (2.5 * scale)))

    def above(x: Column) -> Column:
        share = F.when(span > 0, x["t"] / span).otherwise(0.0)
        return F.struct(x["t"].alias("t"), (x["p"] - F.col("before_w") - (F.col("after_w") - F.col("before_w")) * share).alias("p"))

    out = out.withColumn("__delta", F.transform("points", above))
    out = out.withColumns({
        "__over": F.transform("__delta", lambda x: F.greatest(x["p"], F.lit(0.0))),
        "__rounded": F.transform("__delta", lambda x: F.struct(x["t"].alias("t"), F.round(x["p"], 3).alias("p"))),
    })
    area = F.zip_with(
        F.slice("__delta", 2, F.greatest(n - 1, F.lit(1))), F.slice("__delta", 1, F.greatest(n - 1, F.lit(1))),
        lambda b, a: (F.greatest(a["p"], F.lit(0.0)) + F.greatest(b["p"], F.lit(0.0))) / 2 * (b["t"] - a["t"]),
    )
    cut = F.when(n >= 5, F.floor(n / 5).cast("int")).otherwise(0)
    out = out.withColumns({
        "delta_avg_w": F.col("avg_w") - F.col("before_w"),
        "delta_peak_w": F.array_max(F.transform("__rounded", lambda x: x["p"])),
        "delta_wh": F.aggregate(area, F.lit(0.0), lambda m, x: m + F.coalesce(x, F.lit(0.0))) / 3600.0,
        "steady_w": F.greatest(V.median(F.slice("__over", cut + 1, n - 2 * cut)), F.lit(0.0)),
        "inrush_w": F.array_max("__over"),
    })
    steady = F.col("steady_w")
    out = out.withColumn("inrush_ratio", F.col("inrush_w") / F.greatest(F.when(steady > 0, steady).otherwise(F.abs("delta_avg_w")), F.lit(1.0)))
    peak = F.array_position(F.transform("__rounded", lambda x: x["p"]), F.col("delta_peak_w")).cast("int")
    settled = F.filter(F.slice("__rounded", peak, n), lambda x: F.abs(x["p"] - steady) <= F.greatest(0.15 * steady, F.lit(8.0)))
    out = out.withColumn("settling_s", F.when(steady > 0, F.coalesce(F.try_element_at(settled, F.lit(1))["t"], F.lit(0.0))).otherwise(0.0))
    out = out.withColumn("__held", F.transform("__over", lambda x: F.abs(x - steady) <= F.greatest(0.12 * steady, F.lit(6.0))))
    entered = F.filter(F.transform("__held", lambda x, i: x & ((i == 0) | ~F.element_at("__held", F.greatest(i, F.lit(1))))), lambda x: x)
    out = out.withColumn("plateaus", F.when(steady > 0, F.size(entered)).otherwise(0))
    return out.drop("__head", "__tail", "__delta", "__rounded", "__over", "__held")


def with_substates(df: DataFrame) -> DataFrame:
    """The distinct power levels that a profile holds, longest first, and its number of jumps: `substates` and `steps`.

    A jump ends a plateau; neighbours of nearly one level are joined, short ones go unless all are short, and levels that
    come back count once. Below five points there are none; a flat profile is one level."""
    n, span = F.size("points"), F.element_at("points", -1)["t"]
    out = df.withColumn("__v", F.transform("points", lambda x: x["p"]))
    out = out.withColumn("__amp", F.array_max("__v") - F.array_min("__v"))
    out = out.withColumns({"__jump": F.greatest(F.lit(25.0), 0.12 * F.col("__amp")), "__near": F.greatest(F.lit(15.0), 0.06 * F.col("__amp"))})
    moved = lambda i: F.abs(F.element_at("__v", i) - F.element_at("__v", i - 1)) > F.col("__jump")
    out = out.withColumn("__breaks", F.when(n >= 5, F.filter(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), moved)))

    def plateau(first: Column, last: Column) -> Column:
        length = last - first + 1
        seconds = F.element_at("points", last)["t"] - F.element_at("points", first)["t"]
        kept = length >= F.when(last == n, 2).otherwise(F.greatest(F.lit(2), F.floor(n * 0.03).cast("int")))
        return F.struct(V.mean(F.slice("__v", first, length)).alias("level"), F.when(kept, seconds).otherwise(0.0).alias("seconds"))

    held = F.zip_with(F.concat(F.array(F.lit(1)), F.col("__breaks")), F.concat(F.transform("__breaks", lambda i: i - 1), F.array(n)), plateau)
    out = out.withColumn("__held", F.filter(held, lambda x: x["seconds"] > 0))
    joined = lambda a, b: F.struct(
        ((a["level"] * a["seconds"] + b["level"] * b["seconds"]) / (a["seconds"] + b["seconds"])).alias("level"), (a["seconds"] + b["seconds"]).alias("seconds")
    )
    near = lambda a, b: F.abs(a["level"] - b["level"]) <= F.col("__near")

    def to_last(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        return F.when(F.coalesce(near(x, last), F.lit(False)), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined(last, x)))).otherwise(F.concat(done, F.array(x)))

    def to_level(done: Column, x: Column) -> Column:
        at = F.array_position(F.transform(done, lambda d: near(x, d)), F.lit(True))
        return F.when(at > 0, F.transform(done, lambda d, i: F.when(i == at - 1, joined(d, x)).otherwise(d))).otherwise(F.concat(done, F.array(x)))

    out = out.withColumn("__held", F.aggregate("__held", F.array().cast(LEVELS), to_last))
    out = out.withColumn("__long", F.filter("__held", lambda x: x["seconds"] >= F.greatest(F.lit(2.0), 0.03 * span)))
    out = out.withColumn("__long", F.when(F.size("__long") > 0, F.col("__long")).otherwise(F.col("__held")))
    levels = F.aggregate("__long", F.array().cast(LEVELS), to_level)
    longest = F.transform(F.array_sort(F.transform(levels, lambda x: F.struct((-x["seconds"]).alias("s"), x["level"].alias("l")))), lambda x: F.struct(x["l"].alias("level"), (-x["s"]).alias("seconds")))
    flat = F.array(F.struct(V.mean(F.col("__v")).alias("level"), span.alias("seconds")))
    some, moving = n >= 5, F.col("__amp") >= 10
    out = out.withColumns({
        "substates": F.when(some & moving, longest).when(some, flat).otherwise(F.array().cast(LEVELS)),
        "steps": F.when(some & moving, F.size("__breaks")).otherwise(0),
    })
    return out.drop("__v", "__amp", "__jump", "__near", "__breaks", "__held", "__long")


def with_shape(df: DataFrame) -> DataFrame:
    """`curve` (16 points by time), `peak_at` in [0, 1] and `rise_w`, what the peak adds to the first fifth."""
    span = F.element_at("points", -1)["t"]
    timed = F.transform("points", lambda x: F.struct(F.when(span > 0, x["t"] / span).otherwise(0.0).alias("t_norm"), x["p"].alias("power_w")))
    v = F.transform("points", lambda x: x["p"])
    top = F.element_at("points", F.array_position(v, F.array_max(v)).cast("int"))["t"]
    some = F.size("points") >= 3
    return df.withColumns({
        "curve": V.resample_by_time(timed),
        "peak_at": F.when(some, F.when(span > 0, top / span).otherwise(0.0)),
        "rise_w": F.when(some, V.incremental_rise(v)).otherwise(F.greatest(F.lit(0.0), F.col("peak_w") - 0.75 * F.col("avg_w"))),
    })


Row = Mapping[str, Column]


def pattern_distance(a: Row, b: Row, shape: Column | None = None) -> Column:
    """Distance in [0, 1] of two rows by power, rates, steadiness, substates and curve. Both hold avg_w, peak_w, duration_s,
    energy_wh, rise_w, phases, rise_rate, fall_rate, duty, variance, peak_to_avg, n_substates, heating, motor, curve, peak_at;
    a curve or peak that one of them lacks adds a constant. shape: the curves' `shape_distance`, if it is known already."""
    rel = lambda c: S.rel(a[c].cast("double"), b[c].cast("double"))
    weights = (
        ("avg_w", 0.20), ("peak_w", 0.15), ("duration_s", 0.14), ("rise_w", 0.12), ("energy_wh", 0.03), ("phases", 0.02),
        ("rise_rate", 0.08), ("fall_rate", 0.07), ("variance", 0.05), ("peak_to_avg", 0.04),
    )
    out = sum((w * rel(c) for c, w in weights), F.lit(0.0))
    out = out + 0.06 * F.abs(a["duty"] - b["duty"]) + 0.05 * F.abs(a["n_substates"] - b["n_substates"]) / 5.0
    out = out + F.when(a["heating"] != b["heating"], 0.03).otherwise(0.0) + F.when(a["motor"] != b["motor"], 0.02).otherwise(0.0)
    out = out + F.coalesce(0.12 * (V.shape_distance(a["curve"], b["curve"]) if shape is None else shape), F.lit(0.05)) + F.coalesce(0.05 * F.abs(a["peak_at"] - b["peak_at"]), F.lit(0.02))
    return F.least(out, F.lit(1.0))


def dedup_similarity(a: Row, b: Row) -> Column:
    """How surely two rows are one pattern: curve, duration, added power, peak and settling time, in [0, 1]. Equal rounded
    curves or prototypes (`curve_hash`, `prototype_hash`, where both rows have them) add to it."""
    alike = lambda c: 1 - S.rel(a[c], b[c])
    shape = F.coalesce(1 - V.shape_distance(a["curve"], b["curve"]), F.lit(0.0))
    out = 0.50 * shape + 0.20 * S.clamp(alike("duration_s")) + 0.20 * S.clamp(alike("delta_avg_w"))
    out = out + 0.10 * (0.7 * S.clamp(alike("peak_w")) + 0.3 * S.clamp(alike("settling_s")))
    for name, bonus in (("curve_hash", 0.10), ("prototype_hash", 0.08)):
        if name in a and name in b:
            out = out + F.coalesce(F.when((a[name] != "") & (a[name] == b[name]), bonus), F.lit(0.0))
    return S.clamp(out)


def one_cluster(a: Row, b: Row) -> Column:
    """Close in curve, power, duration and plateaus; false without both curves."""
    close = (1 - V.shape_distance(a["curve"], b["curve"]) >= 0.92) & (S.rel(a["avg_w"], b["avg_w"]) <= 0.25)
    close = close & (S.rel(a["duration_s"], b["duration_s"]) <= 0.40) & (S.rel(a["plateaus"].cast("double"), b["plateaus"].cast("double")) <= 0.75)
    return F.coalesce(close, F.lit(False))


#: What a pattern's running means are taken of.
MEANS = ("avg_w", "duration_s", "energy_wh", "rise_w", "rise_rate", "fall_rate", "duty", "variance", "peak_to_avg", "delta_avg_w", "settling_s", "peak_at")


def mean_curve(length: int = 16) -> Column:
    """The mean of the curves of a group, point by point; null where it has none."""
    return F.when(F.count("curve") > 0, F.array(*(F.avg(F.get("curve", F.lit(i))) for i in range(length))))


def shaped_patterns(cycles: DataFrame, key: tuple[str, ...] = ("phase", "label"), length: int = 16) -> DataFrame:
    """Patterns with the fields that the distances need; all of them are partial aggregates."""
    return cycles.groupBy(*key).agg(
        F.count("*").alias("seen"), F.max("peak_w").alias("peak_w"), *(F.avg(c).alias(c) for c in MEANS), F.lit(1.0).alias("phases"),
        F.avg("n_substates").alias("n_substates"), F.avg("plateaus").alias("plateaus"), F.bool_or("heating").alias("heating"), F.bool_or("motor").alias("motor"),
        mean_curve(length).alias("curve"),
    )


def columns(name: str, df: DataFrame) -> Row:
    return {c: F.col(f"{name}.{c}") for c in df.columns}
