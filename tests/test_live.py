"""The live learner against a plain model over whole traces, as a table and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from wattline.operators.live import LiveRules, built_cycles, live_cycles, segment
from wattline.operators.replay import replay_rules, replayed_cycles
from wattline.plans.learning_queries import SAMPLES, ready, stored
from wattline.streaming.learner import stream_live_cycles

RULES = LiveRules(silent_s=600.0, longest_s=900.0)
COLUMNS = "user_id long, event_id long, ts timestamp, value double"


def trace(rnd, n=400, silence=0.01):
    """Appliances that switch on and off over a drifting base, with spikes, repeated times and silences."""
    t, base, level, slow, out = 1_700_000_000.0, rnd.uniform(0, 60), 0.0, 0.0, []
    for _ in range(n):
        if rnd.random() < 0.06:
            level = rnd.choice([0.0, 0.0, 0.0, 25.0, 60.0, 75.0, 300.0, 2000.0])
        base = max(0.0, base + rnd.uniform(-0.5, 0.5))
        slow = min(level, slow + 12.0) if level == 75.0 else level
        p = base + slow + rnd.uniform(-3, 3) + (rnd.choice([0.0, 500.0]) if rnd.random() < 0.03 else 0.0)
        out.append((t, round(max(p, 0.0), 2)))
        t += rnd.choice([0.0, 1.0, 1.0, 2.0, 5.0]) if rnd.random() > silence else rnd.choice([50.0, 700.0])
    return out


def plain_learner(samples, rules=RULES, primed=0.0):
    """The rules over a whole trace, with positions into it in place of buffers."""
    m, out = rules.machine, []
    series, part = [], []
    for x in samples:
        if part and x[0] - part[-1][0] > rules.silent_s:
            series.append(part)
            part = []
        part.append(x)
    for part in [*series, part]:
        state, count, candidate, on, since, reason, tail = "idle", 0, None, None, None, "", []
        base, known, cycle, buffered, last, fresh = primed, [], None, [], None, 0
        primed = 0.0

        def learn(t, v, near):
            nonlocal base, known
            if base <= 0 or v <= base + near:
                known = (known + [(t, v)])[-60:]
            known = [k for k in known if t - k[0] <= rules.baseline_s]
            base = sum(k[1] for k in known) / len(known) if known else base

        for k, (t, p) in enumerate(part):
            seen = [x[1] for x in part[max(fresh, k + 1 - rules.median) : k + 1]]
            v = sorted(seen)[1] if len(seen) == 3 else sum(seen) / len(seen)
            pending = cycle is not None and "end" in cycle
            if state == "idle" and not pending:
                learn(t, v, 15.0)
            slope = (v - last[1]) / (t - last[0]) if last and t > last[0] else 0.0
            step, delta = (v - last[1] if last else 0.0), v - base
            signs = [delta >= m.delta_on, slope >= m.slope, step >= m.step, v / max(base, 1.0) >= m.inrush and slope >= 0]
            starts = signs[0] or signs[1] or sum(signs) >= 2
            near, shut = delta <= m.delta_off, slope <= -m.shutdown
            mean = sum(tail) / len(tail) if tail else 0.0
            calm = bool(tail) and sum(abs(x - mean) for x in tail) / len(tail) <= m.spread
            before, begun, done = state, False, False
            if state == "idle" and starts:
                candidate, count, state, begun = t, 1, "maybe on", m.debounce <= 1
                reason = "derivative_spike" if signs[1] else "step_jump" if signs[2] else "inrush_ratio" if signs[3] else "delta_threshold"
            elif state == "maybe on" and starts:
                count += 1
                begun = count >= m.debounce
            elif state == "maybe on" and delta <= m.delta_off / 2:
                state = "idle"
            elif state == "active" and t - on >= m.grace_s and (near or shut):
                state, since, count, tail = "maybe off", t, 1, [v]
            elif state == "maybe off":
                tail = (tail + [v])[-24:]
                if near or calm + shut >= 2:
                    count += 1
                    done = near and count >= m.debounce and t - since >= max(1.0, m.hold_s) and len(tail) >= 3
                elif starts:
                    state, tail = "active", []
            if begun:
                state, on = "active", candidate
            if done:
                state, tail = "idle", []
            if (before == "maybe on" or state == "maybe on") and not (buffered and buffered[-1][0] == t):
                buffered.append((t, p))
            if before == "maybe on" and state == "idle":
                buffered = []
            last = (t, v)
            if begun:
                if pending:
                    out.append(cycle)
                    buffered = []
                seed = buffered or [(t, p)]
                ring = [x for x in part[fresh : k + 1] if t - x[0] <= 25.0]
                cycle = {"start": seed[0][0], "reason": reason, "signals": sum(signs), "base": base, "inside": seed, "pre": [x for x in ring if 0 < seed[0][0] - x[0] <= 20.0]}
                buffered = []
                continue
            if cycle and before in ("active", "maybe off") and cycle["inside"][-1][0] != t:
                cycle["inside"].append((t, p))
            if done:
                cycle |= {"end": t, "post": [(t, p)], "stable": t - since, "base_end": base}
            elif state == "idle":
                learn(t, v, 15.0)
                if pending:
                    if cycle["post"][-1][0] != t:
                        cycle["post"].append((t, p))
                    times = [x[0] for x in cycle["post"]]
                    gaps = sorted(b[0] - a[0] for a, b in zip(cycle["inside"], cycle["inside"][1:], strict=False) if b[0] > a[0])
                    span = (times[-1] - times[0]) * len(times) / (len(times) - 1) if len(times) > 1 else gaps[len(gaps) // 2] if gaps else 0.0
                    if t >= cycle["end"] + rules.post_s or span >= rules.post_s:
                        out.append(cycle)
                        cycle, buffered = None, []
            elif cycle and t - cycle["start"] > rules.longest_s:
                state, tail, last, cycle, buffered, count = "idle", [], None, None, [], 0
        if cycle and "end" in cycle:
            out.append(cycle)
    return out


def table(traces):
    return [(u, k, t, p) for u, samples in traces.items() for k, (t, p) in enumerate(samples)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "user_id long, event_id long, t double, value double")
    return df.select("user_id", "event_id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "value")


@pytest.fixture(scope="module")
def traces():
    rnd = random.Random(21)
    out = {u: trace(rnd) for u in range(18)}
    # no silence at all: the failsafe; one reading; a cycle whose post-roll another start cuts short
    out[20] = [(1_700_000_000.0 + 2 * k, 10.0 if k < 20 or k > 700 else 500.0) for k in range(760)]
    out[21] = [(1_700_000_000.0, 5.0)]
    out[22] = [(1_700_000_000.0 + k, 400.0 if 20 <= k < 60 or k > 75 else 5.0) for k in range(140)] + [(1_700_000_140.0 + k, 5.0) for k in range(60)]
    return out


def key(r):
    return (r["start"], r["reason"], r["signals"], round(r["base"], 6), r["end"], round(r["base_end"], 6), r["stable"], r["pre"], r["inside"], r["post"])


def found(rows):
    pairs = lambda a: [(x.t, x.p) for x in a]
    return sorted((r.user_id, r.start_s, r.start_reason, r.start_signals, round(r.baseline_start_w, 6), r.end_s, round(r.baseline_end_w, 6), r.end_stable_s, pairs(r.pre), pairs(r.inside), pairs(r.post)) for r in rows)


def test_table_against_the_plain_model(spark, traces):
    want = sorted((u, *key(c)) for u, samples in traces.items() for c in plain_learner(samples))
    assert found(segment(frame(spark, table(traces)).repartition(5), RULES).collect()) == want
    reasons = {w[2] for w in want}
    assert len(want) > 60 and {"derivative_spike", "step_jump", "delta_threshold"} <= reasons
    # the failsafe drops what ran since 40 s and begins anew; a start cuts a post-roll short
    assert [w[1] for w in want if w[0] in (20, 21)] == [1_700_000_946.0] and [w for w in want if w[0] == 22 and len(w[10]) < 20]


def test_builder_gates_and_figures(spark, traces):
    raw = segment(frame(spark, table(traces)), RULES)
    rows = {(r.user_id, r.start_s): r for r in built_cycles(raw, RULES).collect()}
    counted = 0
    for u, samples in traces.items():
        for c in plain_learner(samples):
            p = [x[1] for x in c["inside"]]
            length = c["end"] - c["start"]
            counts = len(p) >= 4 and 5 <= length <= RULES.longest_s and sum(x > c["base"] + 10.5 for x in p) >= 2
            assert counts == ((u, c["start"]) in rows)
            if counts:
                counted += 1
                r = rows[u, c["start"]]
                energy = sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in zip(c["inside"], c["inside"][1:], strict=False)) / 3600
                assert (r.n, r.peak_w, r.duration_s) == (len(p), max(p), length)
                assert abs(r.energy_wh - energy) < 1e-6 and abs(r.avg_w - sum(p) / len(p)) < 1e-6
                assert len(r.waveform) == len(c["pre"]) + len(p) + len(c["post"])
                if not c["pre"]:
                    assert r.cut_start
    assert counted > 40 and {r.cut_start for r in rows.values()} == {True, False}


def test_stream_equals_table(spark, traces, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [r for r in table(traces) if r[0] in (0, 1, 2, 20, 22)]
    end = max(r[2] for r in rows)
    rows.sort(key=lambda r: (r[2], r[0], r[1]))
    parts = [rows[len(rows) * k // 4 : len(rows) * (k + 1) // 4] for k in range(4)]
    # two readings of another series push the watermark far enough for every timer
    parts += [[(99, 0, end + 5_000.0, 1.0)], [(99, 1, end + 10_000.0, 1.0)]]
    for k, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = stream_live_cycles(stream, RULES, delay="1 second").writeStream.format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(240)
    got, want = found(spark.table("live").collect()), found(live_cycles(frame(spark, rows), RULES).collect())
    assert got == want and len(want) > 10


def test_clashing_names_nulls_and_empty(spark):
    rows = frame(spark, [(1, k, 1_700_000_000.0 + k, 300.0 if 20 < k < 60 else 4.0) for k in range(120)]).withColumn("t", F.lit("x")).withColumn("p", F.lit(0)).withColumn("tie", F.lit(None))
    want = live_cycles(rows, RULES).count()
    odd = rows.unionByName(rows.limit(1).withColumn("value", F.lit(None).cast("double"))).unionByName(rows.limit(1).withColumn("ts", F.lit(None).cast("timestamp")))
    assert want == 1 == live_cycles(odd, RULES).count()
    assert live_cycles(rows.where("false"), RULES).collect() == []


def test_replay_tries_each_series_until_it_gives_something(spark, traces):
    rules = replay_rules(RULES)
    start = 1_700_000_000.0
    series = {u: traces[u] for u in (0, 1, 20, 21)}
    # all that happens lies in the readings that prime; only edges; too few readings for any pass
    series[30] = [(start + 2 * k, 400.0 if 15 <= k < 30 else 5.0) for k in range(60)]
    series[31] = [(start + 40 * k, p) for k, p in enumerate([5.0, 6.0, 5.0, 80.0, 90.0, 85.0, 5.0, 4.0, 6.0, 5.0])]
    series[32] = [(start + k, 300.0 * (k == 2)) for k in range(5)]

    def counts(c):
        p = [x[1] for x in c["inside"]]
        return len(p) >= 4 and 5 <= c["end"] - c["start"] <= rules.longest_s and sum(x > c["base"] + 10.5 for x in p) >= 2

    want = {}
    for u, samples in series.items():
        seed = sorted(p for _, p in samples[:60])
        first = [c for c in plain_learner(samples[60:], rules, seed[len(seed) // 2]) if counts(c)] if len(samples) > 60 else []
        second = [c for c in plain_learner(samples, rules) if counts(c)] if not first and len(samples) > 20 else []
        for number, found in ((1, first), (2, second)):
            want |= {(u, c["start"]): (number, c["end"], len(c["inside"])) for c in found}
    df = frame(spark, table(series))
    rows = replayed_cycles(df, RULES).collect()
    got = {(r.user_id, r.start_s): (r.replay, r.end_s, r.n) for r in rows}
    edges = {k: v for k, v in got.items() if v[0] == 3}
    assert {k: v for k, v in got.items() if v[0] < 3} == want and {v[0] for v in want.values()} == {1, 2}
    assert [k for k in edges] == [(31, start + 120)] and edges[31, start + 120][2] >= 3
    again = replayed_cycles(df, RULES).collect()
    assert {(r.user_id, r.start_s): (r.replay, r.end_s, r.n) for r in again} == got


def test_a_cycle_is_prepared_by_rules_that_are_computed_once(spark, sf_dir):
    """Each copy of the rules in the plan is another evaluation for every cycle."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = ready(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("always_on_low_power") == 1
    assert plan.count("washing_machine,") == 1  # the literal of the signatures
    # One search for each end of a step of the curve.
    assert next(line for line in plan.splitlines() if " AS curve#" in line).count("filter(") <= 3


def test_written_cycles_hold_no_samples(spark, sf_dir):
    rows, kept = ready(spark, sf_dir), stored(spark, sf_dir)
    assert set(rows.columns) - set(kept.columns) == set(SAMPLES)
    assert [f.name for f in kept.schema if "struct" in f.dataType.simpleString()] == []
    assert kept.count() == rows.count() > 0
