"""Scalar expressions: every function takes and gives columns, so all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def rel(a: Column, b: Column) -> Column:
    """Relative distance of two powers; differences below one watt count as they are."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def safe_float(text: Column, default: float = 0.0) -> Column:
    """A number from text with a decimal comma or point; anything else, NaN and infinities give the default."""
    number = F.replace(F.trim(text.cast("string")), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number), F.lit(default))


def safe_int(text: Column, default: int = 0) -> Column:
    number = safe_float(text, float("nan"))
    return F.when(F.isnan(number), F.lit(default)).otherwise(number.cast("long"))


def safe_bool(text: Column, default: bool = False) -> Column:
    low = F.lower(F.trim(text.cast("string")))
    return F.when(low.isin("1", "true", "yes", "on", "ja"), True).when(low.isin("0", "false", "no", "off", "nein"), False).otherwise(F.lit(default))


def parse_power(text: Column) -> Column:
    """Watts from a sensor's state text; null where the sensor says that it doesn't know."""
    plain = F.trim(F.replace(F.lower(F.trim(text)), F.lit("w"), F.lit("")))
    return F.when(~F.lower(F.trim(text)).isin("unknown", "unavailable", "none", "null", ""), F.replace(plain, F.lit(","), F.lit(".")).try_cast("double"))


def to_watts(power: Column, unit: Column) -> Column:
    return F.when(F.lower(F.trim(unit)) == "kw", power * 1000.0).otherwise(power)


def phase_total(phases: Column) -> Column:
    return F.aggregate(F.map_values(phases), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def active_phases(phases: Column, least: float = 20.0) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(phases, lambda _, v: v >= least)))


def phase_mode(phases: Column, least: float = 20.0) -> Column:
    """idle, single_phase or multi_phase (three active phases, none above 60 % and none below 15 % of the sum)."""
    values = F.filter(F.map_values(phases), lambda v: v >= least)
    total = phase_total(phases)
    balanced = (F.array_max(values) / total < 0.60) & (F.array_min(values) / total > 0.15)
    return F.when((total < least) | (F.size(values) == 0), "idle").when((F.size(values) == 3) & balanced, "multi_phase").otherwise("single_phase")


def duration_bucket(seconds: Column) -> Column:
    return F.when(seconds < 20, "short").when(seconds < 180, "medium").when(seconds < 1800, "long").otherwise("very_long")


def load_bucket(watts: Column) -> Column:
    return F.when(watts < 40, "very_low").when(watts < 150, "low").when(watts < 800, "medium").when(watts < 2200, "high").otherwise("very_high")


def power_state(watts: Column) -> Column:
    return F.when(watts < 50, "idle").when(watts < 300, "low").when(watts < 1000, "medium").otherwise("high")


def guess_device(watts: Column) -> Column:
    """The first range that fits, by power alone."""
    return F.when(watts.between(50, 200), "fridge").when(watts.between(200, 500), "pump").when(watts.between(500, 1500), "microwave").when(watts.between(1500, 2500), "washing_machine").when(watts > 2500, "heater").otherwise("unknown")


def normalize_label(label: Column) -> Column:
    plain = F.trim(F.replace(F.regexp_replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), "_like", ""), F.lit("_"), F.lit(" ")))
    return F.when(plain == "", "unbekannt").otherwise(plain)


def effective_label(user: Column, candidate: Column, suggestion: Column) -> Column:
    filled = [F.when(F.trim(c) != "", F.trim(c)) for c in (user, candidate, suggestion)]
    return F.coalesce(*filled, F.lit("unknown"))


def mode_key(phase: Column, substates: Column, seconds: Column, duty: Column) -> Column:
    length = F.when(seconds < 90, "short").when(seconds > 900, "long").otherwise("mid")
    share = F.when(duty < 0.2, "low").when(duty > 0.8, "high").otherwise("mid")
    return F.concat_ws(":", phase, substates.cast("string"), length, share)


def device_group(label: Column, phase: Column) -> Column:
    return F.concat_ws(":", normalize_label(label), phase)


def shared_id(*parts: Column) -> Column:
    """A stable name from rounded features: the first 16 letters of the SHA-1 of the joined parts."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def frequency_per_day(seen: Column, first_micros: Column, last_micros: Column) -> Column:
    return seen / F.greatest((last_micros - first_micros) / 86_400_000_000, F.lit(1.0 / 24.0))


def refine_by_frequency(label: Column, watts: Column, per_day: Column) -> Column:
    return F.when((per_day > 50) & (watts <= 350), "fridge").when(per_day > 50, "pump").when((per_day < 5) & (label == "unknown"), "manual_device").otherwise(label)


def frequency_label(per_day: Column) -> Column:
    return F.when(per_day >= 1.5, F.concat(F.round(per_day).cast("long").cast("string"), F.lit("x taeglich"))).when(per_day >= 0.5, "taeglich").when(per_day >= 0.2, "mehrmals pro Woche").when(per_day >= 0.05, "woechentlich").otherwise("selten")


def stability_score(variance: Column, watts: Column) -> Column:
    return F.when(watts > 10, clamp(100 - 100 * variance / (watts * watts), 0, 100)).otherwise(50.0).cast("int")


def confidence_score(quality: Column, seen: Column) -> Column:
    return 100 * (0.7 * quality + 0.3 * (1 - F.exp(-seen / 8.0)))


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Closed intervals that share a point."""
    return F.greatest(start_a, start_b) <= F.least(end_a, end_b)


def learning_quality(c: dict[str, Column]) -> Column:
    """1 less the penalties of a cycle. c: avg, dur, peak_to_avg, duty, substates, points, baseline_quality, delta_energy, cut_start, cut_end."""
    out = F.lit(1.0)
    for condition, penalty in (
        (c["avg"] < 30, 0.22), (c["dur"] < 8, 0.25), (c["peak_to_avg"] > 6, 0.18), ((c["dur"] > 600) & ((c["duty"] < 0.02) | (c["duty"] > 0.98)), 0.12),
        (c["substates"] > 10, 0.10), (c["points"] < 6, 0.08), (c["delta_energy"] < 0.002, 0.20), (c["cut_start"], 0.18), (c["cut_end"], 0.18),
    ):
        out = out - F.when(condition, penalty).otherwise(0.0)
    low = c["baseline_quality"]
    return clamp(out - F.when(low < 0.22, 0.30).when(low < 0.45, 0.14).otherwise(0.0))


def learning_tier(dur: Column, samples: Column, seg: Column, wave: Column) -> Column:
    return (
        F.when((dur < 20) | (samples < 4), "blocked").when((seg >= 0.70) & (wave >= 0.45), "stable").when((seg >= 0.40) & (wave >= 0.20), "provisional").when(wave >= 0.10, "provisional").otherwise("blocked")
    )


def training_fault(avg: Column, dur: Column, overlap: Column, quality: Column, spacing: Column, upstream: Column) -> Column:
    """The first reason against training on an event, or null."""
    return F.coalesce(
        F.when(avg < 30, "power_too_low"), F.when(dur < 10, "duration_too_short"), F.when(overlap > 0.3, "overlap_too_high"), F.when(quality < 0.7, "quality_too_low"), F.when(spacing > 120, "sample_spacing_too_large"), upstream
    )


def auto_confirm(seen: Column, shape: Column, temporal: Column) -> Column:
    return ((seen >= 3) & (shape > 0.92) & (temporal > 0.60)) | ((seen >= 5) & (shape > 0.88))


def ordered_bounds(first: Column, last: Column) -> tuple[Column, Column]:
    """First and last sighting, swapped where they were stored the wrong way round."""
    return F.least(first, last), F.greatest(first, last)


def repeatability(seen: Column, stability: Column, per_day: Column) -> Column:
    return clamp(0.45 * clamp(seen / 12.0) + 0.40 * clamp(stability) + 0.15 * clamp(per_day / 8.0))


def circular_hours(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 24 - d)


# Labels that may be published, and the keywords, in order, that lead to one of them.
PUBLIC_LABELS = (
    "fridge", "freezer", "kettle", "microwave", "washing_machine", "dishwasher", "oven", "toaster", "clothes_dryer", "space_heater", "immersion_heater", "hot_water_tank",
    "ac_unit", "induction_cooktop", "electric_stove", "tv", "pump", "pump_candidate", "small_pump_motor", "large_pump_motor", "motor_candidate", "fridge_candidate",
    "compressor_candidate", "compressor_small", "compressor_large", "heater", "motor", "electronics", "long_running", "unknown", "unknown_motor", "unknown_constant_load",
    "unknown_variable_load", "unknown_low_power_long", "unknown_high_inrush", "unknown_multistage", "unknown_motor_like", "unknown_heater_like", "unknown_short_pulse",
    "unknown_long_running", "unknown_low_power_cycle", "unknown_electronics", "always_on_low_power", "electronics_cluster", "psu_constant_load", "fan_small", "pump_small", "unknown_cluster",
)
PUBLIC_KEYWORDS = (
    ("fridge", "fridge"), ("kühlschrank", "fridge"), ("freezer", "freezer"), ("gefrier", "freezer"), ("pump", "pump"), ("pumpe", "pump"), ("washer", "washing_machine"),
    ("washing", "washing_machine"), ("dishwasher", "dishwasher"), ("oven", "oven"), ("microwave", "microwave"), ("kettle", "kettle"),
)


def public_label(label: Column) -> Column:
    """A label without anything private: allowed ones stay, known words lead to theirs, other unknown ones become unknown and
    the rest custom_user_label."""
    low = F.replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), F.lit(" "), F.lit("_"))
    out = F.when(low == "", "unknown").when(low.isin(*PUBLIC_LABELS), low)
    for word, plain in PUBLIC_KEYWORDS:
        out = out.when(low.contains(word), plain)
    return out.when(low.startswith("unknown"), "unknown").otherwise("custom_user_label")
