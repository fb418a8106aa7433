"""Registered queries over the live chain: readings, live cycles, prepared cycles, sequential learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions import scalars as S
from wattline.operators import fusion as U
from wattline.operators import live as W
from wattline.operators import maintenance as M
from wattline.operators import matching as J
from wattline.operators import preparing as R
from wattline.operators import profiles as A
from wattline.operators import sequence as Q
from wattline.operators.series import EVENTS
from wattline.plans.series_queries import events, r6
from wattline.sources.steps import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Readings of the events table lie hours apart; so many of its seconds are one of the live learner's, about 3 between readings.
PACE = 9000.0
#: So many series are one site, one behind the other in time, SHIFT seconds apart; its phases are the series' numbers modulo three.
SERIES, SHIFT = 30, 600.0
#: A label is locked to a phase that holds so many percent of its patterns.
LOCKED = 50


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.live_cycles(events(spark, sf_dir), W.LiveRules(), EVENTS, EVENTS.seconds() / PACE)


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared cycles with a site; scores of shape and time are 0 until a pattern is there to compare with."""
    shift = SHIFT * (F.col("user_id") % SERIES)
    placed = live(spark, sf_dir).withColumns({"start_s": F.col("start_s") + shift, "end_s": F.col("end_s") + shift, "site": F.floor(F.col("user_id") / SERIES), "phase": F.concat(F.lit("L"), (F.col("user_id") % 3 + 1).cast("string"))})
    return R.prepared(placed).withColumns({"shape_score": F.lit(0.0), "temporal_score": F.lit(0.0), **{c: F.col(c).cast("int") for c in ("heating", "motor")}})


#: What only the preparing of a cycle reads.
SAMPLES = ("pre", "inside", "post", "waveform", "profile", "points", "substates")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared cycles, written once, without their samples."""
    return written(ready(spark, sf_dir).drop(*SAMPLES), "ready")


#: The table's month lasts 288 s at that pace, so the cooldown is cut; its powers are drawn independently of each other, so that no two
#: cycles are as alike as two runs of an appliance, and the similarities asked for are lowered.
RULES = Q.LearningRules(cooldown_s=5.0, update=0.80, merge=0.72, same_label=0.60)


def learned(rows: DataFrame) -> DataFrame:
    return Q.learn_in_order(rows, ident=("user_id", "start_s"), rules=RULES)


@query("w19_cycles")
def w19(spark, sf_dir):
    """Cycles of the composed live learner."""
    flat = ("user_id", "start_reason", "start_signals", "end_reason", "n", "cut_start", "cut_end")
    numbers = ("start_s", "end_s", "baseline_start_w", "baseline_end_w", "avg_w", "peak_w", "energy_wh", "pre_roll_s", "post_roll_s")
    return live(spark, sf_dir).select(*flat, *r6(*numbers), F.size("pre").alias("n_pre"), F.size("post").alias("n_post"))


@query("c13_prepared_cycles")
def c13(spark, sf_dir):
    numbers = ("start_s", "quality", "seg", "completeness", "baseline_quality", "delta_avg_w", "settling_s")
    return ready(spark, sf_dir).select("user_id", *r6(*numbers), "tier", "unstable", "device", "label", "group_id", "mode_key", "plateaus", "n_substates", "steps", "curve_hash")


@query("c15_learned_in_order")
def c15(spark, sf_dir):
    """What each cycle did to the patterns of its site and phase."""
    return Q.decisions(learned(ready(spark, sf_dir))).select("site", "phase", "user_id", *r6("start_s", "similarity"), "tier", "action", "reason", "pattern_id", "seen", "label")


@query("c16_learned_patterns")
def c16(spark, sf_dir):
    """The patterns of every site and phase after all cycles."""
    kept = ("avg_w", "peak_w", "duration_s", "energy_wh", "delta_avg_w", "quality", "hour")
    return Q.stored_patterns(learned(ready(spark, sf_dir))).select("site", "phase", "id", "status", "label", "name", "seen", "confirmed", *r6(*kept), F.size("gaps").alias("n_gaps"), F.size("modes").alias("n_modes"))


@query("j12_provisional_match")
def j12(spark, sf_dir):
    """Provisional cycles with the weak pattern that they joined or were promoted with, or the one that they began."""
    rows = Q.decisions(learned(ready(spark, sf_dir))).where(F.col("tier") == "provisional").where(F.col("action") != "skipped")
    return rows.select("site", "phase", "user_id", *r6("start_s", "similarity"), "action", "pattern_id", "seen")


@query("a24_learning_events")
def a24(spark, sf_dir):
    return Q.decisions(learned(ready(spark, sf_dir))).groupBy("tier", "action", "reason").agg(F.count("*").alias("n"))


@query("r21_dedup_match")
def r21(spark, sf_dir):
    """The most similar learned pattern of each cycle's site and phase, and what is to be done with the cycle."""
    rows = stored(spark, sf_dir)
    held = Q.stored_patterns(learned(rows)).where("status = 'active'").groupBy("site", "phase").agg(F.collect_list(F.struct("id", "group_id", "plateaus", "avg_w", *Q.COMPARED)).alias("held"))
    own = {c: F.col(c) for c in (*Q.COMPARED, "plateaus", "avg_w")}

    def compared(p):
        other = {c: p[c] for c in own}
        return F.struct(F.round(A.dedup_similarity(other, own), 6).alias("similarity"), (-p["id"]).alias("order"), A.one_cluster(other, own).alias("one_cluster"), (p["group_id"] == F.col("group_id")).alias("same_group"))

    best = rows.join(held, ["site", "phase"]).select("user_id", "start_s", F.array_max(F.transform("held", compared)).alias("b"))
    action = J.dedup_action(F.col("b.similarity"), RULES.update, RULES.merge)
    return best.select("user_id", *r6("start_s"), (-F.col("b.order")).alias("pattern_id"), "b.similarity", "b.one_cluster", "b.same_group", action.alias("action"))


def compared(cycles: DataFrame) -> DataFrame:
    """The vote and the staged decision of every cycle, by the patterns of its site and phase. A label is locked to the phase that half of its patterns lie on."""
    patterns = written(Q.stored_patterns(learned(cycles)), "patterns")
    shares = patterns.groupBy(S.normalize_label(F.col("name")).alias("label"), "phase").agg(F.count("*").alias("n"))
    whole = shares.groupBy("label").agg(F.max(F.struct("n", "phase")).alias("m"), F.sum("n").alias("all"))
    locks = whole.where(F.col("m.n") * 100 >= LOCKED * F.col("all")).select("label", F.col("m.phase").alias("locked_phase"))
    rows = U.matched(cycles, patterns, locks, ("user_id", "start_s"))
    c = {**R.rule_inputs(), **{k: F.col(k) for k in ("seg", "completeness", "flat", "inrush", "nv", "multi", "tier")}, "motor": F.col("motor") == 1, "heating": F.col("heating") == 1}
    held = locks.agg(F.map_from_entries(F.collect_list(F.struct("label", "locked_phase"))))  # one map, an entry a label
    out = U.enriched(rows, c).withColumns({"vote": U.hybrid_vote(F.col("pairs")), "paired": F.col("pairs").isNotNull()})
    # Written, as a filter on the vote would else be computed from the pairs anew, once for each of its terms.
    kept = written(out.select("user_id", "start_s", "phase", "seg", "tier", "paired", "vote", "staged"), "compared")
    return kept.withColumn("locks", held.scalar())


@query("c10_hybrid_vote")
def c10(spark, sf_dir):
    rows = compared(stored(spark, sf_dir)).where("vote is not null")
    return rows.select("user_id", *r6("start_s"), "vote.group", "vote.label", *(F.round(f"vote.{k}", 6).alias(k) for k in ("proto", "shape", "repeat", "confidence", "distance")))


@query("c08_decision")
def c08(spark, sf_dir):
    """The staged decision of every cycle by rules, shape and time."""
    return compared(stored(spark, sf_dir)).select("user_id", *r6("start_s"), "staged.label", "staged.source", "staged.raw", F.round("staged.confidence", 6).alias("confidence"), F.round("staged.rule", 6).alias("rule"))


def modelled(cycles: DataFrame) -> DataFrame:
    from wattline.operators.forest import predict, train

    rows = cycles.withColumn("active_phases", F.lit(1.0))  # a series is one phase
    model = train(rows)
    return predict(model, rows) if model is not None else rows.withColumns({"predicted": F.lit(None).cast("string"), "probability": F.lit(None).cast("double")})


@query("c11_random_forest")
def c11(spark, sf_dir):
    return modelled(stored(spark, sf_dir)).select("user_id", *r6("start_s"), "label", "predicted", "probability")


@query("c12_label_suggestion")
def c12(spark, sf_dir):
    """The label that is suggested for every cycle, by whom and why."""
    cycles = stored(spark, sf_dir)
    told = modelled(cycles).select("user_id", "start_s", S.normalize_label(F.col("predicted")).alias("ml_label"), F.col("probability").alias("ml_score"))
    rows = compared(cycles).join(told, ["user_id", "start_s"])
    c = {
        "patterns": F.col("paired"), "vote": F.col("vote"), "staged": F.col("staged"), "seg": F.col("seg"), "blocked": F.col("tier") == "blocked", "ml_label": F.col("ml_label"), "ml_score": F.col("ml_score"),
        "phase": F.col("phase"), "locked_of": lambda label: F.try_element_at("locks", label),
    }
    return rows.select("user_id", "phase", *r6("start_s"), U.fused(c, F.lit("unknown")).alias("f")).select("user_id", "phase", "start_s", "f.label", "f.source", "f.reason", F.round("f.confidence", 6).alias("confidence"))


@query("c18_nightly_merge")
def c18(spark, sf_dir):
    """The learned patterns of each site after a nightly pass over close pairs."""
    patterns = written(Q.stored_patterns(learned(ready(spark, sf_dir))), "patterns")
    numbered = patterns.withColumn("number", F.substring("phase", 2, 1).cast("long") * 1_000_000 + F.col("id"))
    return M.nightly_merge(numbered).select("site", "number", "seen", "merged", "name", *r6("avg_w", "peak_w", "duration_s", "energy_wh", "quality"))


@query("c23_replayed_cycles")
def c23(spark, sf_dir):
    """The cycles of a replay of all stored readings, at the live learner's pace, by the pass that found them."""
    from wattline.operators.replay import replayed_cycles

    paced = events(spark, sf_dir).withColumn("ts", F.timestamp_micros((EVENTS.seconds() / PACE * 1e6).cast("long")))
    return replayed_cycles(paced).select("user_id", "replay", "n", "start_reason", "cut_start", "cut_end", *r6("start_s", "end_s", "avg_w", "peak_w", "energy_wh"))
