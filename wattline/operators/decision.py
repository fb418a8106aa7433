"""From waveform summary to a final label: support scores, candidates, temporal context and the decision, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions import scalars as S
from wattline.operators.classify import unknown_subclass


def waveform_summary(c: dict[str, Column]) -> dict[str, Column]:
    """c: avg, peak, var, dur, points, plateau_std, substates, steps, pre_s, post_s, cut_start, cut_end."""
    inrush = c["peak"] / F.greatest(c["avg"], F.lit(1e-9))
    flat = c["plateau_std"] <= F.greatest(0.08 * c["avg"], F.lit(15.0))
    pre, post = (F.when(c[k] > 0, S.clamp(c[k] / 3)).otherwise(0.25) for k in ("pre_s", "post_s"))
    edge = lambda seen: F.when(seen, 1.0).otherwise(0.25)
    plateau = F.when(flat & (c["dur"] >= 90), 1.0).when(c["dur"] >= 45, 0.78).otherwise(0.55)
    completeness = S.clamp(0.24 * pre + 0.24 * post + 0.18 * edge(c["pre_s"] > 0) + 0.18 * edge(c["post_s"] > 0) + 0.16 * S.clamp(c["points"] / 18))
    seg = S.clamp(0.24 * pre + 0.24 * post + 0.34 * completeness + 0.18 * plateau - F.when(c["cut_start"], 0.08).otherwise(0.0) - F.when(c["cut_end"], 0.06).otherwise(0.0))
    return {
        "inrush": inrush, "nv": c["var"] / F.greatest(c["avg"], F.lit(1e-9)), "flat": flat, "spike": inrush >= 1.35, "multi": (c["substates"] >= 2) | (c["steps"] >= 2), "completeness": completeness, "seg": seg,
        "tier": F.when(seg >= 0.60, "stable").when(seg >= 0.28, "provisional").otherwise("blocked"),
    }


def temporal_scores(cycles: DataFrame, patterns: DataFrame, hours: DataFrame, cycle_id: tuple[str, ...]) -> DataFrame:
    """(cycle, occ, temporal): how well a cycle fits the sightings of its own label and phase. hours: mean hour by (phase, label)."""
    p = patterns.select("phase", "label", F.col("seen").alias("__seen"), F.col("duration_s").alias("__typical")).join(hours, ["phase", "label"], "left")
    out = cycles.join(p, ["phase", "label"], "left")
    dm = 1 - F.least(F.abs(F.col("__typical") - F.col("duration_s")) / F.greatest(F.col("__typical"), F.lit(1.0)), F.lit(1.0))
    lg = S.clamp(F.log(1 + F.col("__seen")) / 4)
    hour = 1 - F.least(S.circular_hours(F.pmod(F.col("start_s") / 3600, F.lit(24.0)), F.col("mean_hour")) / 12, F.lit(1.0))
    score = S.clamp(0.45 * S.clamp(0.65 * dm + 0.35 * lg) + 0.35 * hour + 0.20 * lg)
    return out.select(*cycle_id, F.coalesce("__seen", F.lit(0)).alias("occ"), F.coalesce(score, F.lit(0.0)).alias("temporal"))


def candidates(c: dict[str, Column]) -> Column:
    """array<struct<score, order, label>> of the rules that fit. c: avg, dur, nv, inrush, flat, seg, completeness, motor, heating, multi, cut, occ, temporal."""
    avg, dur, motor, flat, seg = c["avg"], c["dur"], c["motor"] | (c["inrush"] >= 1.25), c["flat"], c["seg"]
    compressor = F.when(avg <= 550, F.when(c["inrush"] < 1.30, F.when(avg <= 180, "fan_small").otherwise("pump_small")).when(c["occ"] >= 4, "compressor_small").otherwise("small_pump_motor")).when(c["occ"] >= 3, "compressor_large").otherwise("large_pump_motor")
    rules = (
        (flat & (c["nv"] <= 8) & (dur >= 180) & ~motor, F.when(avg <= 220, "electronics_cluster").otherwise("constant_load_pattern"), F.when(seg >= 0.4, 0.62).otherwise(0.52)),
        (c["cut"] & motor & (dur <= 90), F.when(avg <= 700, "compressor_candidate").otherwise("motor_candidate"), F.lit(0.66)),
        ((seg < 0.55) & motor & (avg <= 900), F.when(flat, "pump_candidate").otherwise("motor_candidate"), F.lit(0.58)),
        (motor & (dur <= 45) & ~flat, F.lit("compressor_candidate"), F.lit(0.54)),
        (motor & flat & (dur >= 90) & (seg >= 0.55) & (c["completeness"] >= 0.50), compressor, F.when(compressor.startswith("compressor"), 0.60).otherwise(0.57)),
        (avg.between(80, 420) & dur.between(240, 3600) & flat & (c["occ"] >= 5) & (c["temporal"] >= 0.55) & ~c["cut"] & (seg >= 0.7), F.lit("fridge"), F.lit(0.72)),
        (avg.between(80, 420) & flat & (c["occ"] >= 3) & (c["temporal"] >= 0.45) & (seg < 0.7), F.lit("fridge_candidate"), F.lit(0.60)),
        (F.lit(True), unknown_subclass(c), F.lit(0.40)),
    )
    found = [F.when(fits, F.struct(score.cast("double").alias("score"), F.lit(-k).alias("order"), label.alias("label"))) for k, (fits, label, score) in enumerate(rules)]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def decide(found: Column, c: dict[str, Column], shape: Column) -> dict[str, Column]:
    """Label and confidence from the candidates and scores; weak evidence lowers strong labels. c as above, and tier."""
    best = F.array_max(found)
    raw = S.clamp(0.30 * best["score"] + 0.20 * shape + 0.20 * c["temporal"] + 0.30 * S.clamp((c["seg"] + c["completeness"]) / 2))
    weak = (c["tier"] != "stable") | (c["completeness"] < 0.5)
    label = best["label"]
    lowered = F.when(label == "fridge", "fridge_candidate").when(label.startswith("pump"), "pump_candidate").when((label == "constant_load_pattern") & (c["tier"] == "blocked"), "unknown_cluster").when(label.startswith("compressor"), F.when(c["motor"], "compressor_candidate").otherwise("unknown_cluster")).otherwise(label)
    label = F.when(weak, lowered).otherwise(label)
    rare = (label == "fridge") & (c["occ"] < 5)
    confidence = F.when(rare, F.least(raw, F.lit(0.58))).otherwise(raw)
    confidence = F.when(c["cut"], F.greatest(F.lit(0.2), 0.78 * confidence)).otherwise(confidence)
    label = F.when(rare, "fridge_candidate").otherwise(label)
    return {"label": label, "confidence": F.when(~label.startswith("unknown"), F.greatest(confidence, F.lit(0.35))).otherwise(confidence), "source": F.when(weak, "heuristic").otherwise("rules")}


def analyzer_quality(p: dict[str, Column]) -> dict[str, Column]:
    """Core score of a stored pattern. p: rep, stability, seen, cv, plateaus, jumps, mixed, risk, energy_ratio, conf, best, label_fit."""
    step = lambda *pairs: F.coalesce(*(F.when(c, v) for c, v in pairs), F.lit(0.0))
    core = step((p["rep"] >= 0.72, 0.22), (p["rep"] >= 0.45, 0.12)) + step((p["stability"] >= 0.75, 0.20), (p["stability"] >= 0.5, 0.10)) + step((p["seen"] >= 8, 0.16), (p["seen"] >= 4, 0.08)) + step((p["cv"] <= 0.15, 0.12), (p["cv"] <= 0.35, 0.07))
    core = core + step((p["plateaus"] >= 1, 0.08)) + step((p["jumps"] <= 4, 0.08)) + step((p["mixed"], -0.25)) + step((p["risk"], -0.15))
    core = core + step((p["energy_ratio"].between(0.75, 1.3), 0.12), ((p["energy_ratio"] < 0.45) | (p["energy_ratio"] > 1.9), -0.12)) + 0.18 * (p["conf"] - 0.5)
    core = S.clamp(core, -1.0, 1.0)
    adjusted = p["conf"] * (0.55 + 0.45 * p["label_fit"]) * F.when(p["mixed"], 0.72).otherwise(1.0) * F.when(p["risk"], 0.8).otherwise(1.0) * F.when(p["seen"] < 3, 0.75).otherwise(1.0)
    total = core + 0.8 * (p["best"] - 0.5) + 0.6 * (adjusted - 0.5)
    faults = sum(((c).cast("int") for c in (p["label_fit"] < 0.42, (p["energy_ratio"] < 0.42) | (p["energy_ratio"] > 2.1), p["mixed"], p["jumps"] >= 9)), F.lit(0))
    label = F.when((total >= 0.55) & (adjusted >= 0.65) & (faults == 0), "sehr_gut").when((total >= 0.20) & (adjusted >= 0.45) & (faults <= 1), "brauchbar").when((total >= -0.15) & (adjusted >= 0.25), "unsicher").otherwise("verwerfen")
    return {"total": total, "adjusted": adjusted, "faults": faults, "quality": label, "reported": (total + 1) / 2}
