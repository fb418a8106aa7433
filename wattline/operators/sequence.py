"""Sequential learning: cycles in order, each of which updates, begins or promotes a pattern of its site and phase.

What a cycle does depends on all cycles before it, so a site and phase is a fold over its cycles; sites are independent of each
other and are what the work is spread over. The fold's state is one row: the patterns (active ones and weak ones that wait for
more sightings), the runtime windows of recent cycles, and the next number. It can be stored and taken up again, so a batch at
a time gives what all cycles at once give, and a replayed batch overwrites its own version.

A cycle is passed over when its quality or its baseline is too low, when the same device of the phase ran until shortly before,
or when its segmentation is blocked. A stable cycle is held against the active patterns of its phase: it updates the most
similar one, joins it as another mode, joins it by the looser rule for clusters, or begins a pattern. A provisional cycle is
held against the weak patterns in the same way; with enough sightings and waveform a weak pattern is promoted.

cycles: site, phase, start_s, end_s, label, group_id, mode_key, tier (stable, provisional, blocked), unstable, quality, seg, completeness,
avg_w, peak_w, duration_s, energy_wh, delta_avg_w, settling_s, variance, duty, peak_to_avg, rise_w, rise_rate, fall_rate, plateaus,
n_substates, steps, heating and motor (0 or 1), curve (16 points or null), curve_hash, shape_score and temporal_score, and whatever `ident` names. Ties of the start are ordered by the
end, then by ident.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions import scalars as S
from wattline.functions.curves import once
from wattline.operators.learning import joined_mode
from wattline.operators.profiles import dedup_similarity, one_cluster


@dataclass(frozen=True)
class LearningRules:
    """Thresholds of sequential learning; the defaults are the surveyed system's."""

    quality: float = 0.28
    cooldown_s: float = 120.0
    update: float = 0.94
    merge: float = 0.88
    same_label: float = 0.78
    segmentation: float = 0.40
    waveform: float = 0.20
    promotion: int = 3
    gaps: int = 24
    modes: int = 6
    mode_distance: float = 0.30


BLENDED = ("avg_w", "peak_w", "duration_s", "energy_wh", "delta_avg_w", "settling_s", "variance", "duty", "peak_to_avg", "rise_w", "rise_rate", "fall_rate", "quality", "seg")
LARGEST = ("plateaus", "n_substates", "steps", "heating", "motor")
MODE = "struct<avg_w:double,duration_s:double,peak_w:double,seen:int>"
PATTERN = (
    "struct<id:bigint,status:string,label:string,name:string,group_id:string,mode_key:string,seen:bigint,confirmed:boolean,"
    + ",".join(f"{c}:double" for c in BLENDED) + "," + ",".join(f"{c}:int" for c in LARGEST)
    + f",curve:array<double>,curve_hash:string,first_s:double,last_s:double,hour:double,gaps:array<double>,modes:array<{MODE}>>"
)
WINDOW = "struct<group_id:string,start_s:double,end_s:double>"
STORE = {"patterns": f"array<{PATTERN}>", "windows": f"array<{WINDOW}>", "next_id": "bigint"}
CYCLE = (
    "start_s", "end_s", "label", "group_id", "mode_key", "tier", "unstable", "completeness", *BLENDED, *LARGEST, "curve", "curve_hash", "shape_score", "temporal_score",
)
COMPARED = ("curve", "duration_s", "delta_avg_w", "peak_w", "settling_s", "curve_hash")


def _row(x: Column, names: tuple[str, ...]) -> dict[str, Column]:
    return {c: x[c] for c in names}


def _hour(x: Column) -> Column:
    return F.pmod(F.floor(x["end_s"] / 60) / 60, F.lit(24.0))


def _mode(x: Column) -> Column:
    return F.struct(x["avg_w"].alias("avg_w"), x["duration_s"].alias("duration_s"), x["peak_w"].alias("peak_w"))


def _pattern(**fields: Column) -> Column:
    names = [f.split(":")[0] for f in _top_level()]
    return F.struct(*(fields[c].alias(c) for c in names)).cast(PATTERN)


def _top_level() -> list[str]:
    """The fields of PATTERN, not those inside of its arrays."""
    out, depth, start, text = [], 0, 0, PATTERN[len("struct<") : -1]
    for k, letter in enumerate(text + ","):
        depth += (letter == "<") - (letter == ">")
        if letter == "," and not depth:
            out.append(text[start:k])
            start = k + 1
    return out


def _fresh(x: Column, number: Column, status: str, seen: Column, confirmed: Column, quality: Column) -> Column:
    """A pattern that begins with cycle x."""
    same = {c: x[c] for c in (*BLENDED, *LARGEST, "label", "group_id", "mode_key", "curve", "curve_hash")}
    first = F.array(F.struct(*(_mode(x)[c].alias(c) for c in ("avg_w", "duration_s", "peak_w")), F.lit(1).alias("seen")))
    return _pattern(**{
        **same, "id": number, "status": F.lit(status), "name": x["label"], "seen": seen, "confirmed": confirmed, "quality": quality, "first_s": x["start_s"], "last_s": x["end_s"],
        "hour": _hour(x), "gaps": F.array().cast("array<double>"), "modes": first,
    })


def _joined(p: Column, x: Column, rules: LearningRules) -> Column:
    """Pattern p after one more sighting, x: running means, largest counts, the newest curve, bounds, gaps, hours and modes."""
    seen = p["seen"] + 1
    share = 1.0 / seen
    mean = lambda old, new: old * (1 - share) + new * share
    gap = x["end_s"] - p["last_s"]
    gaps = F.when(gap > 0, F.concat(p["gaps"], F.array(gap))).otherwise(p["gaps"])
    first, last = F.least(p["first_s"], x["start_s"]), F.greatest(p["last_s"], x["end_s"])
    watts, per_day = mean(p["avg_w"], x["avg_w"]), seen / F.greatest((last - first) / 86_400, F.lit(1 / 24))
    return _pattern(**{
        **{c: mean(p[c], x[c]) for c in BLENDED}, **{c: F.greatest(p[c], x[c]) for c in LARGEST}, "id": p["id"], "status": p["status"], "label": p["label"],
        "name": S.refine_by_frequency(x["label"], watts, per_day), "group_id": F.coalesce(x["group_id"], p["group_id"]), "mode_key": F.coalesce(x["mode_key"], p["mode_key"]), "seen": seen,
        "confirmed": p["confirmed"] | S.auto_confirm(seen, x["shape_score"], x["temporal_score"]), "curve": F.coalesce(x["curve"], p["curve"]), "curve_hash": F.coalesce(x["curve_hash"], p["curve_hash"]),
        "first_s": first, "last_s": last, "hour": mean(p["hour"], _hour(x)),
        "gaps": F.slice(gaps, F.greatest(F.size(gaps) - rules.gaps + 1, F.lit(1)), rules.gaps), "modes": joined_mode(p["modes"], _mode(x), rules.modes, rules.mode_distance),
    })


def _step(a: Column, x: Column, ident: tuple[str, ...], rules: LearningRules, row_type: str) -> Column:
    """One cycle: the state after it, with a row on what it did."""
    ran = lambda w: (F.greatest(w["start_s"], x["start_s"]) <= F.least(w["end_s"], x["end_s"])) | (x["start_s"] - w["end_s"]).between(0, rules.cooldown_s)
    again = F.exists(a["windows"], lambda w: w["group_id"].eqNullSafe(x["group_id"]) & ran(w))
    early = F.when(x["quality"] < rules.quality, "low_quality_cycle").when(x["unstable"], "baseline_unstable").when(again, "session_duplicate_cycle")
    reason = F.coalesce(early, F.when(x["tier"] == "blocked", "segmentation_quality_gate"))
    window = F.struct(x["group_id"].alias("group_id"), x["start_s"].alias("start_s"), x["end_s"].alias("end_s")).cast(WINDOW)
    # Cycles come by start, so a window that ended before the cooldown can't matter again.
    open_windows = F.filter(a["windows"], lambda w: w["end_s"] >= x["start_s"] - rules.cooldown_s)
    windows = F.when(early.isNull(), F.concat(open_windows, F.array(window))).otherwise(open_windows)
    wanted = F.when(reason.isNotNull(), "").when(x["tier"] == "stable", "active").otherwise("weak_pattern")

    def held_against(given: Column) -> Column:
        def one(p: Column, k: Column) -> Column:
            similarity = dedup_similarity(_row(p, COMPARED), _row(x, COMPARED))
            fuzzy = one_cluster(_row(p, ("curve", "avg_w", "duration_s", "plateaus")), _row(x, ("curve", "avg_w", "duration_s", "plateaus")))
            return F.when(p["status"] == given["wanted"], F.struct(similarity.alias("similarity"), (-k).alias("order"), fuzzy.alias("fuzzy"), p.alias("p")))

        return F.array_max(F.filter(F.transform(a["patterns"], one), lambda m: m.isNotNull()))

    def decided(g: Column) -> Column:
        best, p = g["best"], g["best"]["p"]
        group, mode = p["group_id"].eqNullSafe(x["group_id"]), p["mode_key"].eqNullSafe(x["mode_key"])
        stable = (
            F.when(best.isNull(), "new").when((best["similarity"] >= rules.update) & group, "update_existing")
            .when((best["similarity"] >= rules.merge) & group & mode, "merge_mode").when(best["fuzzy"], "fuzzy_cluster_merge").otherwise("create_new")
        )
        enough = F.when(p["label"] == x["label"], min(rules.merge, rules.same_label)).otherwise(rules.merge)
        joins = best.isNotNull() & (best["similarity"] > 0) & ((best["similarity"] >= enough) | best["fuzzy"])
        seen = p["seen"] + 1
        seg = p["seg"] * (1 - 1.0 / seen) + x["seg"] / seen
        ripe = joins & (seen >= rules.promotion) & ((seg >= rules.segmentation) | (x["completeness"] >= rules.waveform))
        weak = F.when(ripe, "promoted").when(joins, "provisional_join").otherwise("provisional_new")
        action = F.when(g["wanted"] == "", "skipped").when(g["wanted"] == "active", stable).otherwise(weak)
        return F.struct(action.alias("action"), best.alias("best"), g["wanted"].alias("wanted"))

    def changed(d: Column) -> Column:
        action, best, number = d["action"], d["best"], a["next_id"]
        p, at = best["p"], -best["order"]
        joins = action.isin("update_existing", "merge_mode", "fuzzy_cluster_merge", "provisional_join")
        begins = action.isin("new", "create_new", "provisional_new", "promoted")
        seen = F.when(joins | (action == "promoted"), p["seen"] + 1).when(begins, F.lit(1).cast("bigint"))
        status = F.when(d["wanted"] == "active", "active").otherwise("weak_pattern")
        quality = F.when(action == "promoted", F.greatest(p["quality"] * (1 - 1.0 / seen) + x["quality"] / seen, x["quality"])).otherwise(x["quality"])
        confirmed = F.when(action == "promoted", S.auto_confirm(seen, x["shape_score"], x["temporal_score"])).otherwise(False)
        fresh = _fresh(x, number, "active", seen, confirmed, quality)
        fresh = F.transform(F.array(fresh), lambda f: f.withField("status", F.when(action == "promoted", "active").otherwise(status)))
        patterns = (
            F.when(joins, F.transform(a["patterns"], lambda q, k: F.when(k == at, _joined(q, x, rules)).otherwise(q)))
            .when(action == "promoted", F.concat(F.filter(a["patterns"], lambda q, k: k != at), fresh)).when(begins, F.concat(a["patterns"], fresh)).otherwise(a["patterns"])
        )
        row = F.struct(
            *(x[c].alias(c) for c in ident), x["tier"].alias("tier"), action.alias("action"), F.coalesce(reason, F.lit("")).alias("reason"),
            F.when(joins, p["id"]).when(begins, number).alias("pattern_id"), F.when(action != "skipped", F.coalesce(best["similarity"], F.lit(0.0))).alias("similarity"), seen.alias("seen"), x["label"].alias("label"),
        ).cast(row_type)
        return F.struct(patterns.alias("patterns"), windows.alias("windows"), (number + begins.cast("bigint")).alias("next_id"), F.concat(a["rows"], F.array(row)).alias("rows"))

    given = once(F.struct(wanted.alias("wanted")), lambda w: F.struct(w["wanted"].alias("wanted"), held_against(w).alias("best")))
    return once(once(given, decided), changed)


def learn_in_order(cycles: DataFrame, store: DataFrame | None = None, ident: tuple[str, ...] = ("event_id",), key: tuple[str, ...] = ("site", "phase"), rules: LearningRules = LearningRules()) -> DataFrame:
    """(key, patterns, windows, next_id, rows): the state of every site and phase after its cycles, and a row for each cycle.

    store: such a state (key, patterns, windows, next_id) to go on from; sites without new cycles keep theirs."""
    fields = dict.fromkeys(("start_s", "end_s", *ident, *CYCLE))  # in this order, each once
    grouped = cycles.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__cycles"))
    types = {f.name: f.dataType.simpleString() for f in cycles.schema}
    row_type = f"struct<{','.join(f'{c}:{types[c]}' for c in ident)},tier:string,action:string,reason:string,pattern_id:bigint,similarity:double,seen:bigint,label:string>"
    if store is None:
        joined = grouped.withColumns({c: F.lit(None).cast(t) for c, t in STORE.items()})
    else:
        same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
        both = grouped.alias("c").join(store.select(*key, *STORE).alias("s"), all_of(same), "full_outer")
        joined = both.select(*(F.coalesce(f"c.{k}", f"s.{k}").alias(k) for k in key), "__cycles", *STORE)
    start = F.struct(
        F.coalesce("patterns", F.array().cast(STORE["patterns"])).alias("patterns"), F.coalesce("windows", F.array().cast(STORE["windows"])).alias("windows"),
        F.coalesce("next_id", F.lit(1).cast("bigint")).alias("next_id"), F.array().cast(f"array<{row_type}>").alias("rows"),
    )
    folded = F.aggregate(F.coalesce("__cycles", F.array().cast(grouped.schema["__cycles"].dataType)), start, lambda a, x: _step(a, x, ident, rules, row_type))
    return joined.select(*key, folded.alias("__out")).select(*key, "__out.*")


def all_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def decisions(folded: DataFrame, key: tuple[str, ...] = ("site", "phase")) -> DataFrame:
    """A row for each cycle: key, ident, tier, action, reason, pattern_id, similarity, seen, label."""
    return folded.select(*key, F.inline("rows"))


def stored_patterns(folded: DataFrame, key: tuple[str, ...] = ("site", "phase")) -> DataFrame:
    return folded.select(*key, F.inline("patterns"))
