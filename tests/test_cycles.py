"""Segmentation against plain Python models, on made traces and on the events table; streaming against batch."""

import random
import statistics

from pyspark.sql import functions as F

from wattline.operators.cycles import CycleRules, cycle_transitions, cycles_of, offline_events
from wattline.operators.series import learned_baseline
from wattline.streaming.cycles import START, advance, append_batches, stream_cycles, stream_summary


def trace(spark, watts, user=1):
    rows = [(user, k, 1_775_476_800 + k, float(w)) for k, w in enumerate(watts)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, s long, value double")
    return df.select("user_id", "event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "value", F.lit(45.0).alias("base_w"))


def model(df, rules):
    out, states = [], {}
    for r in sorted(df.collect(), key=lambda r: (r.user_id, r.t, r.event_id)):
        states[r.user_id], found = advance(states.get(r.user_id, START), r.t, r.value, r.base_w, rules)
        if found:
            out.append((r.user_id, r.t, *found))
    return out


def check(df, rules):
    timed = df.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    got = sorted((r.user_id, r.t, r.kind, r.reason, r.since) for r in cycle_transitions(df, "base_w", rules).collect())
    assert got == sorted(model(timed, rules))
    return got


def test_one_cycle_with_inrush(spark):
    rules = CycleRules(slope=90, inrush=1.55)
    df = trace(spark, [45] * 5 + [250] + [165] * 20 + [45] * 20)
    got = check(df, rules)
    assert [g[2] for g in got] == ["started", "ended"]
    cycle = cycles_of(cycle_transitions(df, "base_w", rules)).collect()
    assert len(cycle) == 1 and cycle[0].end_s - cycle[0].start_s >= 12


def test_short_spike_and_noisy_plateau(spark):
    rnd = random.Random(1)
    check(trace(spark, [45] * 5 + [400] + [45] * 30), CycleRules(debounce=2))
    got = check(trace(spark, [45] * 5 + [160 + rnd.uniform(-15, 15) for _ in range(60)] + [46] * 30), CycleRules())
    assert sum(g[2] == "started" for g in got) == 1


def test_random_traces(spark):
    rnd = random.Random(7)
    df = None
    for user in range(12):
        watts = []
        while len(watts) < 200:
            watts += [max(0, rnd.choice([40, 50, 90, 200, 600]) + rnd.uniform(-20, 20))] * rnd.randint(1, 25)
        one = trace(spark, watts, user)
        df = one if df is None else df.unionByName(one)
    assert check(df, CycleRules())
    check(df, CycleRules(debounce=1, hold_s=3, grace_s=2))


def test_offline_events_against_a_model(spark):
    rnd = random.Random(3)
    watts = [max(0, rnd.choice([90, 95, 100, 300]) + rnd.uniform(-5, 5)) for _ in range(60) for _ in range(rnd.randint(1, 12))]
    df = trace(spark, watts)
    want, seen, start = [], watts[:40], None
    for k, p in enumerate(watts):
        base = statistics.median(seen[-120:])
        if start is None and p > base + 25:
            start = (k, base)
        if start is not None and p <= base + 25 * 0.55:
            if k - start[0] >= 8:
                want.append((start[0], k, start[1]))
            start = None
        if start is None:
            seen.append(p)
    if start is not None and len(watts) - 1 - start[0] >= 8:
        want.append((start[0], len(watts) - 1, start[1]))
    t0 = 1_775_476_800
    got = [(r.start_s - t0, r.end_s - t0, r.baseline) for r in offline_events(df).orderBy("start_s").collect()]
    assert got == want


def test_learned_baseline_model(spark):
    watts = [3, 4, 9, 50, 8, 7, 2, 60, 6]
    base, n, want = 0.0, 0, []
    for w in watts:
        if w <= base + 5 and n < 50:
            n += 1
            base += (w - base) / n
        want.append(max(w, base))
    assert [r.corrected for r in learned_baseline(trace(spark, watts)).orderBy("event_id").collect()] == want


def test_streams(spark, tmp_path):
    rules = CycleRules(slope=90, inrush=1.55)
    df = trace(spark, ([45] * 15 + [250] + [165] * 20 + [45] * 30) * 3).drop("base_w")
    df.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    append_batches(stream_cycles(stream, 45.0, rules), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted((r.t, r.kind) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.t, r.kind) for r in cycle_transitions(df.withColumn("base_w", F.lit(45.0)), "base_w", rules).collect())
    assert got == want and len(want) == 6
    q = stream_summary(stream, "1 minute").writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM sums").first().n == df.count()
