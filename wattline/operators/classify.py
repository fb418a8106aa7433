"""Explainable classification: ordered rules and scores as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions import scalars as S
from wattline.functions.curves import once

# Appliance signatures (name, peak W, duration s, energy Wh, three phases too?, features, base confidence).
SIGNATURES = (
    ("oven", 2000, 4500, 300, 7200, 1500, 2500, True, "", 0.88),
    ("microwave", 700, 1300, 10, 600, 150, 400, False, "short_cycles high_power_stable", 0.92),
    ("toaster", 800, 1600, 30, 300, 80, 200, False, "heating stable", 0.85),
    ("kettle", 1400, 3000, 30, 600, 150, 400, False, "heating", 0.90),
    ("immersion_heater", 1500, 3500, 60, 3600, 500, 1500, False, "heating stable", 0.80),
    ("hot_water_tank", 1500, 9000, 300, 14400, 3000, 8000, True, "heating", 0.75),
    ("washing_machine", 300, 3000, 600, 7200, 1000, 2500, False, "multiple_modes heating motor", 0.85),
    ("dishwasher", 1200, 4000, 1200, 18000, 1800, 3500, False, "heating motor multiple_modes", 0.82),
    ("clothes_dryer", 2000, 6000, 900, 5400, 2000, 5000, True, "heating motor", 0.85),
    ("ac_unit", 1000, 6000, 60, 86400, 500, 3000, True, "motor variable_power", 0.75),
    ("space_heater", 1000, 3000, 300, 86400, 300, 2000, False, "heating stable", 0.70),
    ("fridge", 150, 400, 60, 3600, 20, 150, False, "motor", 0.88),
    ("freezer", 150, 500, 60, 3600, 30, 200, False, "motor", 0.85),
    ("induction_cooktop", 1400, 7000, 60, 3600, 200, 1500, True, "heating variable_power", 0.80),
    ("electric_stove", 3000, 8000, 300, 7200, 1000, 3000, True, "heating stable", 0.85),
    ("tv", 50, 400, 3600, 86400, 50, 400, False, "stable always_on", 0.65),
    ("desktop_computer", 100, 600, 1800, 86400, 100, 500, False, "variable_power always_on", 0.60),
    ("server", 50, 800, 3600, 86400, 100, 1000, False, "always_on stable", 0.60),
    ("pool_pump", 500, 3000, 900, 36000, 500, 3000, True, "motor stable", 0.75),
    ("pump", 100, 5000, 60, 36000, 100, 2000, True, "motor stable", 0.70),
    ("vacuum_cleaner", 1000, 2200, 60, 3600, 100, 800, False, "motor variable_power", 0.70),
    ("drill", 500, 1500, 10, 1800, 50, 200, False, "motor variable_power short_cycles", 0.65),
    ("ev_charger", 3000, 22000, 900, 86400, 5000, 50000, True, "stable", 0.80),
)


def first_level(c: dict[str, Column]) -> Column:
    """c: heating, motor, rise, peak, dur, var, avg, duty, substates."""
    ratio = c["var"] / F.greatest(c["avg"] * c["avg"], F.lit(1.0))
    return (
        F.when(c["heating"] & (c["rise"] > 100) & (c["peak"] >= 1400) & c["dur"].between(30, 900) & (ratio < 0.08), "kettle")
        .when(c["motor"] & (c["peak"] < 350) & c["dur"].between(120, 3600) & (c["duty"] < 0.7), "fridge")
        .when((c["substates"] >= 2) & c["motor"] & c["peak"].between(400, 1600) & c["dur"].between(1200, 10800), "washing_machine")
        .when(c["heating"] & c["peak"].between(700, 2600) & c["dur"].between(1200, 14400), "dishwasher")
        .when((c["peak"] >= 800) & c["dur"].between(30, 600) & (ratio < 0.05) & (c["peak"] / F.greatest(c["avg"], F.lit(1e-9)) < 1.35), "microwave")
        .otherwise("unknown")
    )


def fallback_rules(peak: Column, dur: Column) -> Column:
    """By peak and duration alone, the first range that fits."""
    return (
        F.when((peak < 350) & dur.between(120, 3600), "fridge").when(peak.between(400, 1600) & dur.between(1200, 10800), "washing_machine").when(peak.between(700, 2600) & dur.between(1200, 14400), "dishwasher").when((peak >= 1400) & (dur <= 900), "kettle").otherwise("unknown")
    )


def signature_score(sig: Column, c: dict[str, Column]) -> Column:
    """How well a cycle fits a signature (a struct); 0 where its peak is far outside."""
    ratio = c["var"] / F.nullif(c["avg"] * c["avg"], F.lit(0.0))
    out = sig["base"] + F.when(c["peak"].between(sig["p0"], sig["p1"]), 0.15).otherwise(-0.10)
    out = out + F.when(c["dur"].between(sig["d0"], sig["d1"]), 0.12).when((c["dur"] < 0.5 * sig["d0"]) | (c["dur"] > 2.0 * sig["d1"]), -0.15).otherwise(0.0)
    out = out + F.when(c["energy"].between(sig["e0"], sig["e1"]), 0.10).otherwise(0.0) + F.when(~c["three"] | sig["three"], 0.08).otherwise(-0.20)
    bonus = {
        "heating": (c["heating"], 0.10), "motor": (c["motor"], 0.10), "stable": (c["var"] < 0.3, 0.08), "short_cycles": (c["dur"] < 600, 0.08), "high_power_stable": ((c["peak"] > 700) & (ratio < 0.08), 0.12),
        "always_on": (c["dur"] > 3600, 0.08), "variable_power": ((ratio > 0.3) & (ratio < 1), 0.08), "multiple_modes": (c["modes"] > 1, 0.12),
    }
    for name, (holds, size) in bonus.items():
        out = out + F.when(F.array_contains(sig["features"], name) & holds, size).otherwise(0.0)
    return F.when((c["peak"] < 0.7 * sig["p0"]) | (c["peak"] > 1.3 * sig["p1"]), 0.0).otherwise(F.least(out, F.lit(1.0)))


def signatures() -> Column:
    """The signatures as an array of structs, a literal that is folded once."""
    names = ("p0", "p1", "d0", "d1", "e0", "e1")
    rows = []
    for k, s in enumerate(SIGNATURES):
        features = F.split(F.lit(s[8]), " ")
        rows.append(F.struct(F.lit(-k).alias("order"), F.lit(s[0]).alias("device"), *(F.lit(float(v)).alias(n) for n, v in zip(names, s[1:7], strict=True)), F.lit(s[7]).alias("three"), features.alias("features"), F.lit(s[9]).alias("base")))
    return F.array(*rows)


def best_signature(c: dict[str, Column]) -> Column:
    """struct(device, score): the first of the best scores above 0.3, equal to nine digits. The 23 signatures are one array that
    a lambda scores, so there is neither a join nor a method too long to compile."""
    scores = F.transform(signatures(), lambda s: F.struct(F.round(signature_score(s, c), 9).alias("score"), s["order"].alias("order"), s["device"].alias("device")))

    def told(best: Column) -> Column:
        return F.when(best["score"] > 0.3, F.struct(best["device"].alias("device"), F.least(best["score"], F.lit(0.99)).alias("score"))).otherwise(F.struct(F.lit("unknown").alias("device"), F.lit(0.0).alias("score")))

    return once(F.array_max(scores), told)


def unknown_subclass(c: dict[str, Column]) -> Column:
    """c: avg, dur, nv (variance over average), inrush, motor, heating, multi, flat."""
    avg, dur, nv, inrush = c["avg"], c["dur"], c["nv"], c["inrush"]
    return (
        F.when(c["multi"], "unknown_multistage")
        .when((avg < 70) & (dur >= 300) & (nv <= 3.5) & (inrush < 1.15), "always_on_low_power").when((avg < 180) & (dur >= 120) & (nv <= 5) & (inrush < 1.20), "psu_constant_load")
        .when((avg < 240) & (dur >= 90) & (nv <= 7) & (inrush < 1.25), "electronics_cluster").when((avg < 120) & (dur >= 120) & (nv <= 6), "constant_low_power")
        .when((avg >= 120) & (avg < 450) & (dur >= 90) & (nv <= 8), "constant_medium_power").when((inrush >= 1.7) & (avg <= 400), "compressor_low_power").when(inrush >= 1.7, "compressor_high_power")
        .when(c["motor"] & (avg <= 220) & (inrush < 1.6), "fan_small").when(c["motor"] & (avg <= 450) & (inrush < 1.7), "pump_small").when(c["motor"] & (nv <= 9), "pump_constant").when(c["motor"], "pump_variable")
        .when(c["heating"] & (nv <= 6), "heater_resistive").when(dur <= 20, "unknown_short_pulse").when((dur >= 1800) & (avg <= 160), "unknown_low_power_long").when((nv >= 12) | ~c["flat"], "unknown_variable_load").otherwise("unknown_cluster")
    )


def _steps(start: float, *parts: tuple[Column, float, float]) -> Column:
    out = F.lit(start)
    for condition, yes, no in parts:
        out = out + F.when(condition, yes).otherwise(no)
    return S.clamp(out)


def device_plausibility(p: dict[str, Column]) -> dict[str, Column]:
    """How plausible each type is for a pattern. p: power, dur, cv, rep, plateaus, peak_to_avg."""
    power, dur = p["power"], p["dur"]
    return {
        "fridge": _steps(0.5, (power.between(70, 350), 0.2, -0.18), (dur.between(300, 3600), 0.18, -0.15), (p["cv"] <= 0.25, 0.1, -0.08), (p["rep"] >= 0.5, 0.08, -0.05)),
        "pump": _steps(0.5, (power.between(120, 1800), 0.2, -0.15), (dur.between(45, 5400), 0.16, -0.12), (p["cv"] <= 0.2, 0.16, -0.1)),
        "kettle": _steps(0.5, (power.between(1200, 3200), 0.24, -0.26), (dur.between(20, 420), 0.22, -0.28), (p["plateaus"] <= 2, 0.08, -0.08)),
        "microwave": _steps(0.5, (power.between(700, 2200), 0.2, -0.18), (dur.between(30, 1800), 0.16, -0.2), (p["plateaus"] <= 3, 0.06, -0.05)),
        "oven": _steps(0.5, (power.between(900, 4200), 0.2, -0.15), (dur.between(600, 14400), 0.2, -0.16), (p["plateaus"] >= 2, 0.1, -0.06)),
        "heater": _steps(0.5, (power.between(400, 3500), 0.18, -0.14), (dur >= 300, 0.2, -0.18), (p["peak_to_avg"] <= 1.45, 0.1, -0.08)),
    }


def pattern_quality(patterns: DataFrame) -> DataFrame:
    """patterns: seen, avg_w, std_w, duration_s, per_day, plateaus, jumps, peak_to_avg, confidence. Adds stability, best_type,
    adjusted confidence, score and the quality label."""
    seen, avg, std = F.col("seen"), F.col("avg_w"), F.col("std_w")
    rep = 0.45 * S.clamp(seen / 12.0) + 0.35 * S.clamp(1 - std / F.greatest(F.lit(70.0), avg)) + 0.20 * S.clamp(F.col("per_day") / 8.0)
    cv = std / F.greatest(F.lit(1.0), avg)
    out = patterns.withColumn("rep", rep).withColumn("cv", cv).withColumn("stability", F.round(0.55 * S.clamp(1 - F.col("cv")) + 0.45 * F.col("rep"), 4))
    plausible = device_plausibility({"power": avg, "dur": F.col("duration_s"), "cv": F.col("cv"), "rep": F.col("rep"), "plateaus": F.col("plateaus"), "peak_to_avg": F.col("peak_to_avg")})
    ranked = F.array_max(F.array(*(F.struct(F.round(v, 9).alias("score"), F.lit(-k).alias("order"), F.lit(n).alias("type")) for k, (n, v) in enumerate(plausible.items()))))
    out = out.withColumn("__best", ranked).withColumn("best_type", F.col("__best.type")).withColumn("plausibility", F.col("__best.score"))
    out = out.withColumn("confidence", S.clamp(0.7 * F.col("confidence") + 0.3 * F.col("plausibility")))
    score = F.when(seen >= 7, 0.28).when(seen >= 4, 0.16).otherwise(-0.12) + 0.5 * (F.col("stability") - 0.5) + 0.7 * (F.col("plausibility") - 0.5) + 0.6 * (F.col("confidence") - 0.5) - F.when((F.col("plateaus") >= 5) & (F.col("jumps") >= 7), 0.2).otherwise(0.0)
    out = out.withColumn("score", score)
    label = F.when((F.col("score") >= 0.55) & (F.col("confidence") >= 0.65), "sehr_gut").when((F.col("score") >= 0.20) & (F.col("confidence") >= 0.45), "brauchbar").when((F.col("score") >= -0.10) & (F.col("confidence") >= 0.25), "unsicher").otherwise("verwerfen")
    return out.withColumn("quality", label).drop("__best")
