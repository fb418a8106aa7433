"""Parts of a cycle's profile: baseline, inrush, run, shutdown and cooldown, their figures, and what follows from them.

All of it is arithmetic on arrays as long as one profile; each step is a column of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions import curves as V
from wattline.operators import classify as K

RUNS = ("steady_run", "modulated_run")


def added_load(points: Column, before: Column, after: Column) -> Column:
    """Power over the line from the baseline before to the one after, to three digits."""
    span = F.element_at(points, -1)["t"]
    return F.transform(points, lambda x: F.round(x["p"] - before - (after - before) * F.when(span > 0, x["t"] / span).otherwise(0.0), 3))


def with_parts(df: DataFrame) -> DataFrame:
    """Adds `parts`, array<struct<kind, low, high>> (positions from 1), to rows of `with_baseline_delta`; empty without added load.

    Neighbouring parts share a point. The run is modulated where its variance exceeds 8 % of its squared mean and 25."""
    n, d = F.size("points"), F.col("delta")
    out = df.withColumn("delta", added_load(F.col("points"), F.col("before_w"), F.col("after_w")))
    out = out.withColumn("__least", F.greatest(F.lit(5.0), 0.12 * F.col("delta_peak_w"), 0.20 * F.col("delta_avg_w")))
    positions = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    out = out.withColumn("__on", F.filter(positions, lambda i: F.try_element_at(d, i) >= F.col("__least")))
    first, last = F.try_element_at("__on", F.lit(1)), F.try_element_at("__on", F.lit(-1))
    out = out.withColumns({
        "__first": first, "__last": last, "__peak": F.array_position(d, F.array_max(d)).cast("int"),
        "__steady": F.greatest(F.col("steady_w"), F.col("delta_avg_w"), F.col("__least")),
    })
    first, last, peak, steady, least = (F.col(f"__{c}") for c in ("first", "last", "peak", "steady", "least"))
    surge = (peak <= first + F.greatest(F.lit(1), F.floor((last - first + 1) / 4).cast("int"))) & (F.array_max(d) >= F.greatest(1.2 * steady, steady + 12))
    calm = F.filter("__on", lambda i: (i >= peak) & (F.element_at(d, i) <= F.greatest(1.12 * steady, least)))
    # A point below the threshold also ends the surge, so positions between first and last count, not only active ones.
    low = F.filter(positions, lambda i: (i >= peak) & (i < last) & (F.element_at(d, i) <= F.greatest(1.12 * steady, least)))
    out = out.withColumn("__settled", F.coalesce(F.least(F.try_element_at(low, F.lit(1)), F.try_element_at(calm, F.lit(1))), last)).withColumn("__surge", surge)
    out = out.withColumn("__run", F.when(F.col("__surge") & (F.col("__settled") > first), F.col("__settled")).otherwise(first))
    run = F.col("__run")
    fallen = F.filter(positions, lambda i: (i > run) & (i <= last) & (F.element_at(d, i) <= F.greatest(least, 0.35 * steady)))
    out = out.withColumn("__shut", F.greatest(run + 1, F.try_element_at(fallen, F.lit(-1)) - 1) * F.when(F.size(fallen) > 0, 1))
    shut = F.col("__shut")
    out = out.withColumn("__end", F.coalesce(shut, last))
    out = out.withColumn("__values", F.slice(d, F.coalesce(run, F.lit(1)), F.coalesce(F.col("__end") - run + 1, F.lit(0))))
    out = out.withColumn("__mean", V.mean(F.col("__values")))
    out = out.withColumn("__spread", F.try_divide(F.aggregate("__values", F.lit(0.0), lambda m, x: m + (x - F.col("__mean")) * (x - F.col("__mean"))), F.size("__values")))
    modulated = F.col("__spread") > F.greatest(0.08 * F.col("__mean") * F.col("__mean"), F.lit(25.0))

    def part(kind: Column, low: Column, high: Column, there: Column) -> Column:
        return F.struct(kind.alias("kind"), low.alias("low"), high.alias("high"), F.coalesce(there, F.lit(False)).alias("there"))

    parts = F.array(
        part(F.lit("baseline"), F.lit(1), first, first > 1),
        part(F.lit("inrush"), first, F.col("__settled"), F.col("__surge") & (F.col("__settled") > first)),
        part(F.when(modulated, "modulated_run").otherwise("steady_run"), run, F.col("__end"), F.col("__end") > run),
        part(F.lit("shutdown"), shut, last, shut <= last),
        part(F.lit("cooldown"), last, n, last < n),
    )
    none = "array<struct<kind:string,low:int,high:int>>"
    kept = F.transform(F.filter(parts, lambda x: x["there"]), lambda x: F.struct(x["kind"].alias("kind"), x["low"].alias("low"), x["high"].alias("high")))
    out = out.withColumn("parts", F.when(F.size("__on") > 0, kept).otherwise(F.array().cast(none)))
    return out.drop(*(f"__{c}" for c in "least on first last peak steady settled surge run shut end values mean spread".split()))


def event_phases(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One row for each part of rows of `with_parts`: times, powers, added load, steps and slopes in and out of it."""
    # The outer form, filtered afterwards: the plain one's implied filter would be pushed below and repeat every step above it.
    out = df.select(*key, "points", "delta", "before_w", "after_w", F.posexplode_outer("parts").alias("phase_index", "x")).where(F.col("x").isNotNull())
    low, high, n, d = F.col("x.low"), F.col("x.high"), F.size("points"), F.col("delta")
    at = lambda i: F.element_at("points", i)["t"]
    step = F.when((low == high) & (n > 1), at(F.least(low + 1, n)) - at(low)).otherwise(0.0)
    span = lambda a: F.slice(a, low, high - low + 1)
    out = out.withColumns({
        "kind": F.col("x.kind"), "start_s": at(low), "end_s": at(high) + F.greatest(step, F.lit(0.0)),
        "watts": F.transform(span(F.col("points")), lambda p: p["p"]), "added": span(d),
        "prior": F.when(low > 1, F.try_element_at(d, F.greatest(low - 1, F.lit(1)))).otherwise(0.0), "next": F.when(high < n, F.try_element_at(d, F.least(high + 1, n))).otherwise(0.0),
    })
    begins, ends, lasts = F.element_at("added", 1), F.element_at("added", -1), F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0))
    return out.select(
        *key, F.col("phase_index").cast("long").alias("phase_index"), "kind", "start_s", "end_s", lasts.alias("duration_s"),
        V.mean(F.col("watts")).alias("avg_w"), F.array_max("watts").alias("peak_w"), F.when(F.col("kind") == "cooldown", F.col("after_w")).otherwise(F.col("before_w")).alias("baseline_w"),
        V.mean(F.col("added")).alias("delta_avg_w"), F.array_max("added").alias("delta_peak_w"), (begins - F.col("prior")).alias("step_in_w"), (F.col("next") - ends).alias("step_out_w"),
        F.when(lasts > 0, (ends - begins) / lasts).otherwise(0.0).alias("slope_in"), ((F.col("next") - ends) / F.greatest(lasts, F.lit(1.0))).alias("slope_out"),
    )


def cycle_summaries(cycles: DataFrame, phases: DataFrame, key: tuple[str, ...], label: str = "label") -> DataFrame:
    """(key, cycle_name, cycle_type, inrush_s, run_s, shutdown_s, run_w) of each cycle from its phases, also where it has none."""
    seconds = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("duration_s"))), F.lit(0.0))
    sums = phases.groupBy(*key).agg(
        seconds("inrush").alias("inrush_s"), seconds(*RUNS).alias("run_s"), seconds("shutdown", "cooldown").alias("shutdown_s"),
        F.coalesce(F.avg(F.when(F.col("kind").isin(*RUNS), F.col("delta_avg_w"))), F.lit(0.0)).alias("run_w"), F.bool_or(F.col("kind") == "modulated_run").alias("modulated"),
    )
    out = cycles.select(*key, label, "duration_s").join(sums, list(key), "left").fillna(0.0, ["inrush_s", "run_s", "shutdown_s", "run_w"]).fillna(False, ["modulated"])
    kind = F.concat_ws(
        "_", F.when(F.col("inrush_s") > 0, "inrush"), F.when(F.col("modulated"), "modulated").otherwise("steady"),
        F.when(F.col("duration_s") >= 600, "long").when(F.col("duration_s") <= 120, "short").otherwise("normal"),
    )
    name = F.replace(F.lower(F.trim(F.coalesce(F.col(label), F.lit("device")))), F.lit(" "), F.lit("_"))
    return out.select(*key, F.concat_ws("_", name, kind).alias("cycle_name"), kind.alias("cycle_type"), "inrush_s", "run_s", "shutdown_s", "run_w")


def device_subclass(label: Column, c: dict[str, Column]) -> Column:
    """A finer class by label first, then motor and heating flags. c: as for `unknown_subclass`, and delta_avg."""
    low = F.replace(F.lower(F.trim(F.coalesce(label, F.lit("unknown")))), F.lit(" "), F.lit("_"))
    return (
        F.when(low.contains("fridge") | low.contains("kühlschrank"), "fridge_compressor")
        .when(low.isin("compressor_candidate", "compressor_small", "compressor_large", "small_pump_motor", "large_pump_motor"), low)
        .when(c["motor"] & (c["inrush"] >= 1.35), F.when(c["avg"] >= 700, "large_pump_motor").otherwise("compressor_candidate"))
        .when(c["motor"], F.when(c["delta_avg"] < 800, "small_pump_motor").otherwise("large_pump_motor"))
        .when(c["heating"], "heater_resistive")
        .when(low.startswith("unknown"), K.unknown_subclass(c))
        .otherwise(F.when(low == "", "unknown_device").otherwise(low))
    )


def span_seconds(times: Column, alone: Column) -> Column:
    """The span of samples with a mean step added; one sample lasts `alone`, none nothing."""

    def span(a: Column) -> Column:
        n = F.size(a)
        return F.when(n == 0, 0.0).when(n == 1, F.greatest(alone, F.lit(0.0))).otherwise((F.element_at(a, -1) - F.element_at(a, 1)) * n / F.greatest(n - 1, F.lit(1)))

    return V.once(times, span)


def cut_off(before: Column, inside: Column, after: Column, step: Column, base: Column, on: float, off: float, pre_s: float, post_s: float) -> dict[str, Column]:
    """Whether a cycle lacks its start or its end. before, inside and after are arrays of (t, p), step the usual distance of samples.

    Without a sample before, or with fewer than two inside, the start is missing; also where both sides of it are high already.
    Without a span after, the end is; also where a steep fall to the baseline is followed by less than half of the time wanted."""
    p = lambda a, i: F.try_element_at(a, F.lit(i))["p"]
    pre, post = (span_seconds(F.transform(a, lambda x: x["t"]), step) for a in (before, after))
    none, wanted = F.size(before) == 0, max(0.5 * pre_s, 0.5)
    high = F.coalesce(F.array_max(F.transform(F.slice(before, F.greatest(F.size(before) - 2, F.lit(1)), 3), lambda x: x["p"])), base)
    start = (none & (pre < wanted)) | (F.size(inside) < 2) | ((high - base >= max(0.6 * on, 15.0)) & (p(inside, 1) - base >= max(0.8 * on, 20.0)))
    steep = (p(inside, -2) - p(inside, -1) >= max(2.5 * off, 20.0)) & (p(inside, -1) <= base + off)
    late = F.size(after) <= 1 if post_s <= 0 else steep & (post < max(0.5 * post_s, 0.5))
    end = ((post <= 0) & (F.size(after) <= 1)) | ((F.size(inside) >= 3) & late)
    return {"cut_start": F.coalesce(start, F.lit(True)), "cut_end": F.coalesce(end, F.lit(True))}


def accepted(samples: Column, duration: Column, above: Column, least: int = 3, shortest: float = 3.0, longest: float = 28800.0) -> Column:
    """Whether a run of samples may become a cycle: enough of them, two of them high, neither short nor longer than the failsafe."""
    return (samples >= least) & (duration >= shortest) & (duration <= longest) & (above >= 2)


def feature_snapshot(df: DataFrame) -> DataFrame:
    """Spread, variation and range of power and added load, and the mean step, of rows with points, delta, variance, avg_w and steps."""
    v = F.transform("points", lambda x: x["p"])
    spread = F.array_max(v) - F.array_min(v)
    mean = V.mean(F.col("delta"))
    std = F.sqrt(F.aggregate("delta", F.lit(0.0), lambda m, x: m + (x - F.col("__mean")) * (x - F.col("__mean"))) / F.greatest(F.size("delta"), F.lit(1)))
    out = df.withColumn("__mean", mean).withColumn("delta_std", std)
    return out.withColumns({
        "power_range": spread, "power_std": F.sqrt("variance"), "power_cv": F.sqrt("variance") / F.greatest(F.col("avg_w"), F.lit(1.0)),
        "delta_cv": F.col("delta_std") / F.greatest(F.abs("__mean"), F.lit(1.0)), "delta_range": F.array_max("delta") - F.array_min("delta"),
        "avg_step_w": F.when(F.col("steps") > 0, spread / F.col("steps")).otherwise(0.0),
    }).drop("__mean")


def with_plateaus(df: DataFrame) -> DataFrame:
    """Stretches of a profile whose steps stay small, two points at least: adds `stretches` (level, points), `levels` (their levels
    joined), n_jumps, max_jump_w and mean_jump_w. Below three points there is nothing."""
    out = df.withColumn("__v", F.transform("points", lambda x: x["p"]))
    n, v = F.size("__v"), F.col("__v")
    out = out.withColumn("__near", F.greatest(F.lit(12.0), 0.08 * F.abs(V.median(v)))).withColumn("__jump", F.greatest(F.lit(20.0), 0.1 * F.array_max(v)))
    moves = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.abs(F.try_element_at(v, i) - F.element_at(v, i - 1)))
    out = out.withColumn("__moves", F.when(n >= 3, moves).otherwise(F.array().cast("array<double>")))
    out = out.withColumn("__breaks", F.filter(F.transform("__moves", lambda m, i: F.when(m > F.col("__near"), i + 2)), lambda i: i.isNotNull()))
    stretch = lambda a, b: F.struct(V.mean(F.slice(v, a, b - a + 1)).alias("level"), (b - a + 1).alias("points"))
    cut = F.zip_with(F.concat(F.array(F.lit(1)), F.col("__breaks")), F.concat(F.transform("__breaks", lambda i: i - 1), F.array(n)), stretch)
    out = out.withColumn("stretches", F.when(n >= 3, F.filter(cut, lambda x: x["points"] >= 2)).otherwise(F.filter(cut, lambda x: F.lit(False))))
    out = out.withColumn("levels", V.cluster_levels(F.transform("stretches", lambda x: x["level"]), F.greatest(F.lit(18.0), 1.4 * F.col("__near"))))
    jumps = F.filter("__moves", lambda m: m >= F.col("__jump"))
    out = out.withColumn("__jumps", jumps)
    return out.withColumns({
        "n_jumps": F.size("__jumps"), "max_jump_w": F.coalesce(F.array_max("__jumps"), F.lit(0.0)), "mean_jump_w": F.coalesce(V.mean(F.col("__jumps")), F.lit(0.0)),
    }).drop("__v", "__near", "__jump", "__moves", "__breaks", "__jumps")
