"""Streaming: cycles by a stateful operator, windowed sums with a watermark, gap sessions, and idempotent sinks.

Readings that arrive later than the watermark are dropped; the state of a series is a few numbers whatever its length, and
leaves when the series has been silent for `silent_s`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wattline.operators.cycles import ACTIVE, IDLE, MAYBE_OFF, MAYBE_ON, CycleRules

STATE = "state string, t double, p double, candidate double, reason string, count int, on double, ending double, powers array<double>"
OUT = "user_id long, t double, kind string, reason string, since double"
START = (IDLE, None, 0.0, None, "", 0, None, None, [])


def advance(state: tuple, t: float, p: float, base: float, rules: CycleRules) -> tuple[tuple, tuple | None]:
    """One sample: the next state and a transition (kind, reason, since) or None."""
    name, last_t, last_p, candidate, reason, count, on, ending, powers = state
    moved = 0.0 if last_t is None else p - last_p
    slope = moved / (t - last_t) if last_t is not None and t > last_t else 0.0
    delta = p - base
    spike, jump, over = slope >= rules.slope, moved >= rules.step, delta >= rules.delta_on
    inrush = slope >= 0 and p / max(base, 1.0) >= rules.inrush
    starts = spike or over or (jump and inrush)
    near, shut = delta <= rules.delta_off, slope <= -rules.shutdown
    found = None
    if starts and name in (IDLE, MAYBE_ON):
        if name == IDLE:
            candidate, reason, count = t, "derivative_spike" if spike else "step_jump" if jump else "inrush_ratio" if inrush else "delta_threshold", 0
        count += 1
        name = MAYBE_ON
        if count >= rules.debounce:
            name, on, found = ACTIVE, candidate, ("started", reason, candidate)
            count = 0
    elif name == MAYBE_ON and delta <= max(0.5 * rules.delta_off, 0.0):
        name, candidate, count = IDLE, None, 0
    elif name == ACTIVE and t - on >= rules.grace_s and (near or shut):
        name, ending, count, powers = MAYBE_OFF, t, 1, [p]
    elif name == MAYBE_OFF:
        middle = sum(powers) / len(powers) if powers else 0.0
        calm = bool(powers) and sum([abs(v - middle) for v in powers]) / len(powers) <= rules.spread
        powers = [*powers, p][-24:]
        if near or near + calm + shut >= 2:
            count += 1
            stable = t - ending
            if near and count >= rules.debounce and stable >= max(1.0, rules.hold_s) and len(powers) >= max(2, rules.least_points):
                found = ("ended", "stable_near_baseline", on)
                name, candidate, count, on, ending, powers = IDLE, None, 0, None, None, []
        elif starts:
            name, count, ending, powers = ACTIVE, 0, None, []
    return (name, t, p, candidate, reason, count, on, ending, powers), found


def stream_cycles(readings: DataFrame, base_w: float, rules: CycleRules = CycleRules(), delay: str = "10 minutes", silent_s: int = 86_400) -> DataFrame:
    """readings: a stream of (user_id, ts, event_id, value). Starts and ends of cycles of each series."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        now = state.get if state.exists else START
        out = []
        for t, p in zip(rows["t"], rows["value"], strict=True):
            if now[1] is not None and t < now[1]:
                continue  # within the watermark but behind what was already folded
            now, found = advance(now, float(t), float(p), base_w, rules)
            if found:
                out.append((key[0], float(t), *found))
        state.update(now)
        state.setTimeoutTimestamp(max(int(now[1] * 1000), state.getCurrentWatermarkMs()) + silent_s * 1000)
        yield pd.DataFrame(out, columns=["user_id", "t", "kind", "reason", "since"])

    rows = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = rows.select("user_id", "ts", "event_id", "value", (F.unix_micros("ts") / 1e6).alias("t"))
    return rows.groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_summary(readings: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Mean, maximum and number by window and series."""
    rows = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", window), "user_id").agg(F.avg("value").alias("avg_w"), F.max("value").alias("max_w"), F.count("*").alias("n"))


def stream_sessions(readings: DataFrame, gap: str = "2 hours", delay: str = "10 minutes") -> DataFrame:
    """Sessions of readings without a gap longer than `gap`."""
    rows = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("avg_w"))


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Each batch as its own folder, overwritten if the batch is replayed, so every row lands exactly once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
