"""Sequential learning against a plain model, in one go, in batches and as a stream."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wattline.operators.sequence import BLENDED, LARGEST, LearningRules, decisions, learn_in_order, stored_patterns
from wattline.streaming.learner import learn_batches, learned_decisions, learned_state

RULES = LearningRules()
SCHEMA = (
    "event_id long, site long, phase string, start_s double, end_s double, label string, group_id string, mode_key string, tier string, unstable boolean, completeness double, "
    + ", ".join(f"{c} double" for c in BLENDED) + ", " + ", ".join(f"{c} int" for c in LARGEST) + ", curve array<double>, curve_hash string, shape_score double, temporal_score double"
)
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def rel(a, b):
    return abs(a - b) / max(abs(a), abs(b), 1.0)


def shape_distance(a, b):
    if a is None or b is None:
        return None
    top = lambda c: max(max(abs(v) for v in c), 1e-9)
    return min(1.0, sum(abs(x / top(a) - y / top(b)) for x, y in zip(a, b, strict=True)) / len(a))


def similarity(p, x):
    far = shape_distance(p["curve"], x["curve"])
    near = lambda c: min(max(1 - rel(p[c], x[c]), 0), 1)
    out = 0.5 * (0 if far is None else 1 - far) + 0.2 * near("duration_s") + 0.2 * near("delta_avg_w") + 0.1 * (0.7 * near("peak_w") + 0.3 * near("settling_s"))
    same = p["curve_hash"] is not None and p["curve_hash"] != "" and p["curve_hash"] == x["curve_hash"]
    return min(max(out + (0.1 if same else 0), 0), 1)


def fuzzy(p, x):
    far = shape_distance(p["curve"], x["curve"])
    return far is not None and 1 - far >= 0.92 and rel(p["avg_w"], x["avg_w"]) <= 0.25 and rel(p["duration_s"], x["duration_s"]) <= 0.4 and rel(p["plateaus"], x["plateaus"]) <= 0.75


def confirmed(seen, shape, temporal):
    return (seen >= 3 and shape > 0.92 and temporal > 0.6) or (seen >= 5 and shape > 0.88)


def hour(x):
    return math.floor(x["end_s"] / 60) / 60 % 24


def join_mode(modes, x):
    far = [0.55 * rel(m["avg_w"], x["avg_w"]) + 0.35 * rel(m["duration_s"], x["duration_s"]) + 0.1 * rel(m["peak_w"], x["peak_w"]) for m in modes]
    modes = [dict(m) for m in modes]
    if far and min(far) <= 0.3:
        m = modes[far.index(min(far))]
        for c in ("avg_w", "duration_s", "peak_w"):
            m[c] = (m[c] * m["seen"] + x[c]) / (m["seen"] + 1)
        m["seen"] += 1
    else:
        modes.append({c: x[c] for c in ("avg_w", "duration_s", "peak_w")} | {"seen": 1})
    return sorted(modes, key=lambda m: -m["seen"])[:6]


def begin(x, number, status, seen=1):
    return {c: x[c] for c in (*BLENDED, *LARGEST, "label", "group_id", "mode_key", "curve", "curve_hash")} | {
        "id": number, "status": status, "seen": seen, "name": x["label"], "confirmed": False, "first_s": x["start_s"], "last_s": x["end_s"], "hour": hour(x), "gaps": [], "modes": join_mode([], x),
    }


def join(p, x):
    p["seen"] += 1
    share = 1 / p["seen"]
    for c in BLENDED:
        p[c] = p[c] * (1 - share) + x[c] * share
    for c in LARGEST:
        p[c] = max(p[c], x[c])
    if x["end_s"] > p["last_s"]:
        p["gaps"] = (p["gaps"] + [x["end_s"] - p["last_s"]])[-24:]
    p["first_s"], p["last_s"] = min(p["first_s"], x["start_s"]), max(p["last_s"], x["end_s"])
    p["hour"] = p["hour"] * (1 - share) + hour(x) * share
    p["curve"], p["curve_hash"] = x["curve"] or p["curve"], x["curve_hash"] or p["curve_hash"]
    p["group_id"], p["mode_key"] = x["group_id"], x["mode_key"]
    p["confirmed"] = p["confirmed"] or confirmed(p["seen"], x["shape_score"], x["temporal_score"])
    p["modes"] = join_mode(p["modes"], x)
    day = p["seen"] / max((p["last_s"] - p["first_s"]) / 86_400, 1 / 24)
    p["name"] = "fridge" if day > 50 and p["avg_w"] <= 350 else "pump" if day > 50 else "manual_device" if day < 5 and x["label"] == "unknown" else x["label"]


def plain(cycles):
    """Decisions by event, and the patterns of each site and phase."""
    state, did = {}, {}
    for x in sorted(cycles, key=lambda c: (c["start_s"], c["end_s"], c["event_id"])):
        s = state.setdefault((x["site"], x["phase"]), {"patterns": [], "windows": [], "next": 1})
        again = any(g == x["group_id"] and (max(a, x["start_s"]) <= min(b, x["end_s"]) or 0 <= x["start_s"] - b <= RULES.cooldown_s) for g, a, b in s["windows"])
        reason = "low_quality_cycle" if x["quality"] < 0.28 else "baseline_unstable" if x["unstable"] else "session_duplicate_cycle" if again else ""
        if not reason:
            s["windows"].append((x["group_id"], x["start_s"], x["end_s"]))
            reason = "segmentation_quality_gate" if x["tier"] == "blocked" else ""
        if reason:
            did[x["event_id"]] = ("skipped", reason, None, None, None)
            continue
        stable = x["tier"] == "stable"
        held = [p for p in s["patterns"] if p["status"] == ("active" if stable else "weak_pattern")]
        scores = [similarity(p, x) for p in held]
        best = held[scores.index(max(scores))] if held else None
        score = max(scores, default=0.0)
        if stable:
            group = best and best["group_id"] == x["group_id"]
            mode = best and best["mode_key"] == x["mode_key"]
            action = (
                "new" if not best else "update_existing" if score >= 0.94 and group else "merge_mode" if score >= 0.88 and group and mode
                else "fuzzy_cluster_merge" if fuzzy(best, x) else "create_new"
            )
            if action in ("new", "create_new"):
                best = begin(x, s["next"], "active")
                s["patterns"].append(best)
                s["next"] += 1
            else:
                join(best, x)
        else:
            joins = best is not None and score > 0 and (score >= (0.78 if best["label"] == x["label"] else 0.88) or fuzzy(best, x))
            seen = best["seen"] + 1 if joins else 1
            if joins and seen >= 3 and (best["seg"] * (1 - 1 / seen) + x["seg"] / seen >= 0.4 or x["completeness"] >= 0.2):
                action = "promoted"
                s["patterns"].remove(best)
                old = best
                best = begin(x, s["next"], "active", seen)
                best["quality"] = max(old["quality"] * (1 - 1 / seen) + x["quality"] / seen, x["quality"])
                best["confirmed"] = confirmed(seen, x["shape_score"], x["temporal_score"])
                s["patterns"].append(best)
                s["next"] += 1
            elif joins:
                action = "provisional_join"
                join(best, x)
            else:
                action = "provisional_new"
                best = begin(x, s["next"], "weak_pattern")
                s["patterns"].append(best)
                s["next"] += 1
        did[x["event_id"]] = (action, "", best["id"], round(score, 9), best["seen"])
    return did, state


def cycles(seed, n=260):
    rnd = random.Random(seed)
    kinds = []
    for k in range(7):
        curve = [rnd.uniform(5, 100) for _ in range(16)]
        kinds.append((f"kind{k % 4}", rnd.uniform(30, 900), rnd.uniform(30, 2000), curve, rnd.choice(["stable", "stable", "provisional"])))
    out = []
    for k in range(n):
        label, watts, length, curve, tier = rnd.choice(kinds)
        noise = lambda x, by: x * rnd.uniform(1 - by, 1 + by)
        by = rnd.choice([0.01, 0.05, 0.3])
        start = 1000.0 * k + rnd.choice([0, 0, -950, -700])
        row = {
            "event_id": k, "site": rnd.randrange(2), "phase": rnd.choice(["L1", "L2"]), "start_s": start, "end_s": start + noise(length, by), "label": label, "mode_key": rnd.choice(["m1", "m1", "m2"]),
            "tier": rnd.choice([tier, tier, tier, "blocked"]), "unstable": rnd.random() < 0.04, "completeness": rnd.choice([0.1, 0.5, 0.9]), "curve": rnd.choice([None, *[[noise(v, by / 2) for v in curve]] * 9]),
            "curve_hash": rnd.choice([None, f"h{label}"]), "shape_score": rnd.choice([0.0, 0.95]), "temporal_score": rnd.choice([0.0, 0.7]), "avg_w": noise(watts, by), "peak_w": noise(2 * watts, by), "duration_s": noise(length, by),
            "energy_wh": noise(10, by), "delta_avg_w": noise(watts, by), "settling_s": noise(6, by), "variance": noise(50, by), "duty": rnd.random(), "peak_to_avg": noise(2, by), "quality": rnd.choice([0.1, 0.6, 0.8, 1.0]),
            "seg": rnd.choice([0.2, 0.6]), "plateaus": rnd.randrange(1, 4), "n_substates": rnd.randrange(4), "steps": rnd.randrange(5),
            "rise_w": noise(20, by), "rise_rate": noise(9, by), "fall_rate": noise(9, by), "heating": rnd.randrange(2), "motor": rnd.randrange(2),
        }
        out.append(row | {"group_id": f"{label}:{row['phase']}"})
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA)


def did(df):
    return {r.event_id: (r.action, r.reason, r.pattern_id, None if r.similarity is None else round(r.similarity, 9), r.seen) for r in df.collect()}


def check_store(df, state):
    got = {(r.site, r.phase, r.id): r for r in stored_patterns(df).collect()}
    want = {(*k, p["id"]): p for k, s in state.items() for p in s["patterns"]}
    assert set(got) == set(want)
    for k, p in want.items():
        r = got[k].asDict(recursive=True)
        for c in ("status", "label", "name", "group_id", "mode_key", "seen", "confirmed", *LARGEST, "curve_hash"):
            assert r[c] == p[c], (k, c, r[c], p[c])
        for c in (*BLENDED, "first_s", "last_s", "hour"):
            assert abs(r[c] - p[c]) < 1e-6 * max(1, abs(p[c])), (k, c)
        assert r["gaps"] == pytest.approx(p["gaps"]) and r["curve"] == (pytest.approx(p["curve"]) if p["curve"] else None)
        assert [m["seen"] for m in r["modes"]] == [m["seen"] for m in p["modes"]]
        assert [m["avg_w"] for m in r["modes"]] == pytest.approx([m["avg_w"] for m in p["modes"]])


def test_in_order_against_the_plain_model(spark):
    rows = cycles(3)
    want, state = plain(rows)
    folded = learn_in_order(frame(spark, rows).repartition(3)).cache()
    assert did(decisions(folded)) == want
    check_store(folded, state)
    actions = [v[0] for v in want.values()]
    assert {a for a in actions} == {"skipped", "new", "create_new", "update_existing", "merge_mode", "fuzzy_cluster_merge", "provisional_new", "provisional_join", "promoted"}
    assert {v[1] for v in want.values()} == {"", "low_quality_cycle", "baseline_unstable", "session_duplicate_cycle", "segmentation_quality_gate"}
    folded.unpersist()


def test_batches_and_stream_equal_one_go(spark, tmp_path):
    rows = cycles(4, 150)
    want, state = plain(rows)
    ordered = sorted(rows, key=lambda c: (c["start_s"], c["end_s"], c["event_id"]))
    for k in range(3):
        frame(spark, ordered[50 * k : 50 * k + 50]).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    learn_batches(stream, f"{tmp_path}/state", f"{tmp_path}/at").awaitTermination(240)
    assert did(learned_decisions(spark, f"{tmp_path}/state")) == want
    check_store(learned_state(spark, f"{tmp_path}/state"), state)
    # a replayed last batch starts from the version before it and changes nothing
    again = learn_in_order(frame(spark, ordered[100:]), learned_state(spark, f"{tmp_path}/state", before=2))
    check_store(again, state)


def test_empty_and_nulls(spark):
    none = frame(spark, [])
    assert learn_in_order(none).collect() == []
    rows = cycles(5, 20)
    for r in rows[:10]:
        r["curve"] = r["curve_hash"] = None
    rows = [r | {"site": None} for r in rows]
    assert did(decisions(learn_in_order(frame(spark, rows)))) == plain(rows)[0]
    store = learn_in_order(frame(spark, rows))
    assert learn_in_order(none, store).count() == store.count()
