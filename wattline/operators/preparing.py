"""From a built cycle to what learning and classification compare: baseline and added load, levels, shape, scores and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions import curves as V
from wattline.functions import labels as L
from wattline.functions import scalars as S
from wattline.operators import classify as K
from wattline.operators import profiles as A
from wattline.operators.decision import waveform_summary

#: Cycles whose baseline is worth less than this are unstable.
BASELINE_QUALITY = 0.22


def curve_hash(curve: Column) -> Column:
    """Equal for curves that are equal over their peaks to one digit; null without a curve."""
    top = F.greatest(F.array_max(F.transform(curve, F.abs)), F.lit(1e-9))
    text = V.once(top, lambda t: F.array_join(F.transform(curve, lambda v: F.format_number(v / t, 1)), ","))
    return F.when(curve.isNotNull(), F.substring(F.sha1(text), 1, 16))


def device_type(c: dict[str, Column]) -> Column:
    """The suggestion chain: first-level rules, then the best signature, then peak and duration alone."""
    known = lambda x: V.once(x, lambda v: F.nullif(v, F.lit("unknown")))
    return F.coalesce(known(K.first_level(c)), known(K.best_signature(c)["device"]), known(K.fallback_rules(c["peak"], c["dur"])), F.lit("unknown"))


def rule_inputs() -> dict[str, Column]:
    """What the rules, signatures and summaries ask for, from the columns that `prepared` has."""
    col = F.col
    return {
        "avg": col("avg_w"), "peak": col("peak_w"), "var": col("variance"), "dur": col("duration_s"), "energy": col("energy_wh"), "points": col("n"), "plateau_std": col("std_w"), "substates": col("n_substates"),
        "steps": col("steps"), "pre_s": col("pre_roll_s"), "post_s": col("post_roll_s"), "cut_start": col("cut_start"), "cut_end": col("cut_end"), "cut": col("cut_start") | col("cut_end"), "motor": col("motor"),
        "heating": col("heating"), "rise": col("rise_rate"), "duty": col("duty"), "three": F.lit(False), "modes": F.greatest(col("n_substates"), F.lit(1)), "peak_to_avg": col("peak_to_avg"),
        "baseline_quality": col("baseline_quality"), "delta_energy": col("delta_wh"),
    }


def prepared(cycles: DataFrame, phase_mode: str = "single_phase") -> DataFrame:
    """cycles: those of `built_cycles` and a phase. Adds points (the waveform from 0 s), the figures of R24, R27 and the shape, power
    statistics, rates, heating and motor flags, seg and completeness, quality, tier, unstable, device, label, group_id and mode_key."""
    first = F.element_at("waveform", 1)["t"]
    power = F.transform("inside", lambda x: x["p"])
    square = F.transform("inside", lambda x: (x["p"] - F.col("avg_w")) * (x["p"] - F.col("avg_w")))
    moves = F.zip_with(F.slice("inside", 2, F.col("n") - 1), F.slice("inside", 1, F.col("n") - 1), lambda b, a: F.when(b["t"] > a["t"], (b["p"] - a["p"]) / (b["t"] - a["t"])).otherwise(0.0))
    out = cycles.withColumns({
        "points": F.transform("waveform", lambda x, i: F.struct((x["t"] - first).alias("t"), i.alias("tie"), x["p"].alias("p"))),
        "variance": V.mean(square), "duty": V.mean(F.transform("inside", lambda x: F.when(x["p"] >= 0.5 * F.col("peak_w"), 1.0).otherwise(0.0))),
        "peak_to_avg": F.col("peak_w") / F.greatest(F.col("avg_w"), F.lit(1e-9)), "rise_rate": F.greatest(F.array_max(moves), F.lit(0.0)), "fall_rate": F.greatest(-F.array_min(moves), F.lit(0.0)),
        "heating": V.rising_start(power), "motor": V.oscillates(power),
    }).withColumn("std_w", F.sqrt("variance"))
    out = A.with_shape(A.with_substates(A.with_baseline_delta(out))).withColumn("n_substates", F.size("substates"))
    summary = waveform_summary(rule_inputs())
    out = out.withColumns({k: summary[k] for k in ("seg", "completeness", "flat", "inrush", "nv", "multi")})
    c = {**rule_inputs(), **{k: F.col(k) for k in ("seg", "completeness", "flat", "inrush", "nv", "multi")}}
    out = out.withColumns({
        "quality": S.learning_quality(c), "tier": S.learning_tier(c["dur"], c["points"], c["seg"], c["completeness"]), "unstable": F.col("baseline_quality") < BASELINE_QUALITY,
        "device": device_type(c), "curve_hash": curve_hash(F.col("curve")),
    })
    seed = F.when(F.col("device") == "unknown", K.unknown_subclass(c)).otherwise(F.col("device"))
    # A column of its own, as the label's rules name it many times.
    out = out.withColumn("__seed", seed).withColumn("label", L.learning_label(F.col("__seed"), {k: c[k] for k in ("avg", "dur", "inrush", "motor")})).drop("__seed")
    return out.withColumns({"group_id": S.device_group(F.col("label"), F.col("phase")), "mode_key": S.mode_key(F.lit(phase_mode), F.col("n_substates"), F.col("duration_s"), F.col("duty"))})
