"""Label suggestion: three independent matchers and the staged decision, fused behind gates.

A cycle is joined with the patterns of its site and phase, by equality; a site and phase has a bounded number of patterns, so the
pairs of a cycle are one bounded array. From it come the best shape, the temporal support and the hybrid vote of groups; the
staged decision weighs the rules with the first two, and `fused` settles between it, the vote and a trained classifier. A label
that is locked to another phase gives no evidence and is never suggested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions import curves as V
from wattline.functions import scalars as S
from wattline.operators.classify import unknown_subclass
from wattline.operators.decision import candidates
from wattline.operators.profiles import pattern_distance

COMPARED = (
    "avg_w", "peak_w", "duration_s", "energy_wh", "rise_w", "rise_rate", "fall_rate", "duty", "variance", "peak_to_avg", "n_substates", "heating", "motor", "curve",
)
#: Labels that say too much where only a part of a cycle was seen.
FULL_CYCLE = ("fridge", "compressor_small", "compressor_large", "small_pump_motor", "large_pump_motor", "constant_load_pattern")
UNKNOWN = ("unknown", "unbekannt")


def hour_of(end_s: Column) -> Column:
    return F.pmod(F.floor(end_s / 60) / 60, F.lit(24.0))


def matched(cycles: DataFrame, patterns: DataFrame, locks: DataFrame | None, ident: tuple[str, ...], key: tuple[str, ...] = ("site", "phase")) -> DataFrame:
    """cycles with `pairs`: one struct for each active pattern of the cycle's site and phase; null without any.

    patterns: key, id, status, name, seen, quality, hour and COMPARED. locks: (label, locked_phase), a label once. A pair holds id,
    label, seen, distance, shape (the blend of R13), match (C5), vote (C10), typical_s, hours_off; patterns of a label that is locked to
    another phase are left out, unless no other is there."""
    named = patterns.where(F.col("status") == "active").withColumn("group", S.normalize_label(F.col("name")))
    if locks is not None:
        named = named.join(locks.select(F.col("label").alias("group"), "locked_phase"), "group", "left")
    else:
        named = named.withColumn("locked_phase", F.lit(None).cast("string"))
    fields = ("id", "group", "seen", "quality", "hour", "locked_phase", *COMPARED)
    held = named.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__held"))
    # Pairs cost time and few bytes, so the number of parts is set and not left to their size.
    parts = int(cycles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = cycles.repartition(parts, *key).join(held, list(key), "left")
    free = F.filter("__held", lambda p: p["locked_phase"].isNull() | (p["locked_phase"] == F.col("phase")))
    out = out.withColumn("__held", F.when(F.size(free) > 0, free).otherwise(F.col("__held")))
    own = {c: F.col(c) for c in COMPARED} | {"phases": F.lit(1.0), "peak_at": F.lit(None).cast("double")}

    out = out.withColumn("__scores", V.curve_scores(F.col("curve"), F.transform("__held", lambda p: p["curve"])))

    def pair(p: Column, of: Column) -> Column:
        one = {c: p[c] for c in COMPARED} | {"phases": F.lit(1.0), "peak_at": F.lit(None).cast("double")}
        apart = F.least(S.rel(p["duration_s"], F.col("duration_s")) + S.rel(p["avg_w"], F.col("avg_w")), F.lit(1.0))
        return F.struct(
            p["id"].alias("id"), p["group"].alias("label"), p["seen"].alias("seen"), pattern_distance(one, own, of["apart"]).alias("distance"), p["quality"].alias("quality"),
            *(of[c].alias(c) for c in ("cosine", "euclid", "dtw")),
            apart.alias("apart"), p["duration_s"].alias("typical_s"), S.circular_hours(hour_of(F.col("end_s")), p["hour"]).alias("hours_off"), S.rel(p["duration_s"], F.col("duration_s")).alias("lengths"),
            S.rel(p["peak_to_avg"], F.col("peak_to_avg")).alias("spikes"),
        )

    def voted(x: Column) -> Column:
        shape = F.coalesce(0.42 * (x["cosine"] + 1) / 2 + 0.33 * x["euclid"] + 0.25 * x["dtw"], F.lit(0.0))
        weigh = lambda far: F.greatest(F.lit(0.75), 1 - 0.25 * F.least(far, F.lit(1.0)))
        vote = (0.72 * F.exp(-4 * F.greatest(x["distance"], F.lit(0.0))) + 0.28 * shape) * (1 + F.log1p(F.greatest(x["seen"], F.lit(1)))) * (0.6 + 0.8 * S.clamp(x["quality"]))
        return F.struct(
            x["id"].alias("id"), x["label"].alias("label"), x["seen"].alias("seen"), x["distance"].alias("distance"), shape.alias("shape"),
            S.clamp(0.48 * x["euclid"] + 0.42 * x["dtw"] + 0.10 * (1 - x["apart"])).alias("match"),
            (vote * weigh(x["hours_off"] / 12) * weigh(x["lengths"]) * weigh(x["spikes"])).alias("vote"), x["typical_s"].alias("typical_s"), x["hours_off"].alias("hours_off"),
        )

    return out.withColumn("__pairs", F.zip_with("__held", "__scores", pair)).withColumn("pairs", F.transform("__pairs", voted)).drop("__held", "__scores", "__pairs")


def hybrid_vote(pairs: Column, least: float = 0.60) -> Column:
    """struct(group, label, proto, shape, repeat, confidence, distance), the group of most votes; null without a vote. A group below `least`
    is called unknown; distance is that of the nearest pattern of all."""
    groups = F.array_distinct(F.transform(pairs, lambda x: x["label"]))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["vote"])

    def one(g: Column, k: Column) -> Column:
        own = F.filter(pairs, lambda x: x["label"] == g)
        nearest = F.array_min(F.transform(own, lambda x: F.struct(x["distance"].alias("distance"), x["seen"].alias("seen"))))
        return F.struct(F.aggregate(own, F.lit(0.0), lambda a, x: a + x["vote"]).alias("vote"), (-k).alias("order"), g.alias("group"), F.array_max(F.transform(own, lambda x: x["shape"])).alias("shape"), nearest["seen"].alias("seen"))

    def told(b: Column) -> Column:
        proto, repeat = b["vote"] / total, F.least(F.lit(1.0), F.log1p(b["seen"].cast("double")) / 3)
        confidence = S.clamp(0.62 * proto + 0.23 * b["shape"] + 0.15 * repeat)
        label = F.when((confidence < least) & ~F.lower(b["group"]).isin(*UNKNOWN), "unknown").otherwise(b["group"])
        nearest = F.array_min(F.transform(pairs, lambda x: x["distance"]))
        return F.struct(b["group"].alias("group"), label.alias("label"), proto.alias("proto"), b["shape"].alias("shape"), repeat.alias("repeat"), confidence.alias("confidence"), nearest.alias("distance"))

    return F.when((F.size(pairs) > 0) & (total > 0), V.once(F.array_max(F.transform(groups, one)), told))


def best_shape(pairs: Column) -> Column:
    """struct(score, label) of the pattern whose curve fits best (C5); null where no curve can be compared."""
    ranked = F.transform(F.filter(pairs, lambda x: x["match"].isNotNull()), lambda x: F.struct(x["match"].alias("score"), (-x["id"]).alias("order"), x["label"].alias("label")))
    return F.when(F.size(ranked) > 0, F.array_max(ranked))


def temporal_support(pairs: Column, label: Column, duration: Column) -> Column:
    """struct(occ, score) of the patterns of a label (C6): sightings, duration and hour of the day."""
    own = F.filter(pairs, lambda x: x["label"] == label)

    def told(a: Column) -> Column:
        n = F.size(a)
        occ = F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x["seen"])
        mean = lambda c: F.aggregate(a, F.lit(0.0), lambda s, x: s + x[c]) / n
        dm = 1 - F.least(F.abs(mean("typical_s") - duration) / F.greatest(mean("typical_s"), F.lit(1.0)), F.lit(1.0))
        lg = S.clamp(F.log1p(occ.cast("double")) / 4)
        score = S.clamp(0.45 * S.clamp(0.65 * dm + 0.35 * lg) + 0.35 * (1 - F.least(mean("hours_off") / 12, F.lit(1.0))) + 0.20 * lg)
        return F.when(n > 0, F.struct(occ.alias("occ"), score.alias("score"))).otherwise(F.struct(F.lit(0).cast("bigint").alias("occ"), F.lit(0.0).alias("score")))

    return V.once(own, told)


def final_decision(found: Column, shape: Column, temporal: Column, c: dict[str, Column]) -> Column:
    """struct(label, confidence, source, raw, rule): the best candidate, weak evidence lowering strong labels (C8).

    found: `candidates`; shape: `best_shape`; temporal: `temporal_support`; c: as for `candidates`, and tier."""
    motor = c["motor"] | (c["inrush"] >= 1.25)
    fits = shape.isNotNull() & (shape["score"] >= 0.55) & ~shape["label"].isin("", *UNKNOWN)
    strong = shape["label"].contains("compressor") | (shape["label"] == "fridge")
    score = F.least(F.lit(0.85), 0.35 + 0.55 * shape["score"])
    seen = F.struct(F.when(strong & ~motor, F.least(score, F.lit(0.52))).otherwise(score).alias("score"), F.lit(-99).alias("order"), shape["label"].alias("label"))
    ranked = F.concat(found, F.when(fits, F.array(seen)).otherwise(F.slice(found, 1, 0)))

    def decided(best: Column) -> Column:
        raw = S.clamp(0.30 * S.clamp(best["score"]) + 0.20 * S.clamp(F.coalesce(shape["score"], F.lit(0.0))) + 0.20 * S.clamp(temporal["score"]) + 0.30 * S.clamp((c["seg"] + c["completeness"]) / 2))
        source = F.when(best["order"] == -99, "shape_match").when(best["order"].isin(-5, -6), "temporal_match").otherwise("heuristic")
        weak = (c["tier"] != "stable") | (c["completeness"] < 0.5)
        lowered = (
            F.when(best["label"].contains("fridge"), "fridge_candidate").when(best["label"].contains("pump"), "pump_candidate")
            .when((best["label"] == "constant_load_pattern") & (c["tier"] == "blocked"), "unknown_cluster").when(motor, "compressor_candidate").otherwise("unknown_cluster")
        )
        label = F.when(weak & best["label"].isin(*FULL_CYCLE), lowered).otherwise(best["label"])
        rare = (label == "fridge") & (temporal["occ"] < 5)
        confidence = F.when(rare, F.least(raw, F.lit(0.58))).otherwise(raw)
        confidence = F.when(c["cut"], F.greatest(F.lit(0.2), 0.78 * confidence)).otherwise(confidence)
        confidence = F.when(c["tier"] == "blocked", F.least(confidence, F.lit(0.64))).otherwise(confidence)
        source = F.when(weak, "heuristic").when(rare, "hybrid").otherwise(source)
        label = F.when(rare, "fridge_candidate").otherwise(label)
        confidence = F.when(~label.isin(*UNKNOWN, "unknown_cluster", "unknown_electronics") | label.isin(*UNKNOWN), F.greatest(confidence, F.lit(0.35))).otherwise(confidence)
        label = F.when(label.isin(*UNKNOWN), unknown_subclass(c)).otherwise(label)
        return F.struct(label.alias("label"), confidence.alias("confidence"), source.alias("source"), best["label"].alias("raw"), best["score"].alias("rule"))

    return V.once(F.array_max(ranked), decided)


def enriched(df: DataFrame, c: dict[str, Column]) -> DataFrame:
    """Cycles of `matched` with shape, temporal, occ and `staged`, the staged decision (C9). c: as for `candidates`, and tier."""
    out = df.withColumn("shape", best_shape(F.col("pairs")))
    wanted = F.when(F.col("shape.score") >= 0.55, F.col("shape.label")).otherwise(S.normalize_label(F.col("label")))
    out = out.withColumn("temporal", temporal_support(F.col("pairs"), wanted, F.col("duration_s")))
    c = {**c, "occ": F.col("temporal.occ"), "temporal": F.col("temporal.score")}
    return out.withColumn("__found", candidates(c)).withColumn("staged", final_decision(F.col("__found"), F.col("shape"), F.col("temporal"), c)).drop("__found")


def fused(c: dict[str, Column], fallback: Column, threshold: float = 0.45, sure: float = 0.60, floor: float = 0.45) -> Column:
    """struct(label, confidence, source, reason): the suggestion for a cycle.

    c: patterns (whether the site has any), vote (`hybrid_vote`, or null), staged (label, confidence, source), seg, blocked, ml_label and
    ml_score (null without a trained model), phase, and locked_of: a function from a label column to the phase that it is locked to."""
    staged, vote = c["staged"], c["vote"]
    answer = lambda label, confidence, source, reason: F.struct(label.alias("label"), confidence.alias("confidence"), source.alias("source"), reason.alias("reason"))
    own = lambda reason: answer(staged["label"], staged["confidence"], staged["source"], F.lit(reason))
    takes = (staged["confidence"] >= F.greatest(vote["confidence"], F.lit(0.48))) & ~staged["label"].isin(*UNKNOWN, "unknown_electronics")
    known = F.when(staged["source"].isin("heuristic", "temporal_match", "shape_match", "hybrid"), staged["source"]).otherwise("hybrid")
    first = answer(
        F.when(takes, staged["label"]).otherwise(vote["label"]), F.when(takes, F.greatest(vote["confidence"], staged["confidence"])).otherwise(vote["confidence"]),
        F.when(takes, known).otherwise("hybrid_phase1_shape_proto"), F.when(takes, "staged_rule_selected").otherwise("shape_prototype_only"),
    )

    def with_model(f: Column) -> Column:
        valid = c["ml_label"].isNotNull() & (c["ml_label"] != "unknown") & (c["ml_score"] >= sure)
        confidence = F.greatest(f["confidence"], 0.45 * c["ml_score"] + 0.35 * vote["shape"] + 0.20 * vote["proto"])
        agree = (c["ml_label"] == vote["group"]) | (c["ml_label"] == vote["label"])
        override = (c["ml_score"] > vote["confidence"] + 0.12) & (vote["shape"] >= 0.40)
        label = F.when(agree, vote["label"]).when(override, c["ml_label"]).otherwise(vote["label"])
        source = F.when(agree, "hybrid_phase1_agreement").when(override, "hybrid_phase1_ml_override").otherwise("hybrid_phase1_shape_proto")
        reason = F.when(agree, "boosting_and_shape_agree").when(override, "boosting_strong_override").otherwise("shape_prototype_preferred")
        return F.when(valid, answer(label, confidence, source, reason)).otherwise(f)

    def gated(f: Column) -> Column:
        confidence = S.clamp(f["confidence"])
        locked = c["locked_of"](S.normalize_label(f["label"]))
        far = vote["distance"].isNull() | (vote["distance"] > threshold)
        enough = staged["confidence"] >= 0.4
        sure_of_stage = staged["confidence"] > confidence
        most = F.greatest(confidence, staged["confidence"])
        return (
            F.when(locked.isNotNull() & (locked != c["phase"]), answer(fallback, F.least(confidence, F.lit(0.2)), F.lit("phase_lock_reject"), F.lit("phase_lock_reject")))
            .when(F.lower(F.trim(f["label"])).isin("", *UNKNOWN), answer(staged["label"], F.least(confidence, F.lit(0.35)), F.lit("fallback_unknown_label"), F.lit("unknown_label_blocked")))
            .when(far, answer(F.when(enough, staged["label"]).otherwise(fallback), most, F.when(enough, staged["source"]).otherwise("fallback_distance_gate"), F.lit("distance_gate_reject")))
            .when(confidence < floor, answer(F.when(sure_of_stage, staged["label"]).otherwise(fallback), most, F.when(sure_of_stage, staged["source"]).otherwise("fallback_low_confidence"), F.lit("low_confidence_reject")))
            .otherwise(answer(f["label"], confidence, f["source"], f["reason"]))
        )

    return (
        F.when(~c["patterns"], own("no_pattern_history")).when((c["seg"] < 0.55) | c["blocked"], own("segmentation_quality_gate")).when(vote.isNull(), own("no_pattern_match"))
        .otherwise(V.once(V.once(first, with_model), gated))
    )
