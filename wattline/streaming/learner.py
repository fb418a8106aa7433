"""The live learner over a stream: arbitrary state by series, kept in the state store.

A series has one value (the machine, its baseline and what surrounds a cycle, all bounded) and one list (the samples of the
running cycle, which are appended and never rewritten). A timer in event time ends a series that stays silent, so its cycle in
the post-roll is emitted and its state leaves the store. Readings later than the watermark are dropped by it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wattline.operators.live import RAW, RAW_NAMES, Held, Live, LiveRules, as_frame, built_cycles
from wattline.operators.sequence import LearningRules, decisions, learn_in_order
from wattline.operators.series import EVENTS, Series

PAIRS = ("history", "ring", "candidates", "pre", "post")
NUMBERS = ("base", "start", "last_inside", "end", "ending")
FACTS = {"start_reason": "string", "end_reason": "string", "start_signals": "int", **dict.fromkeys(("start_delta_w", "start_slope", "baseline_start_w", "baseline_end_w", "end_stable_s"), "double")}
MACHINE = {"state": "string", "t": "double", "p": "double", "candidate": "double", "reason": "string", "count": "int", "on_s": "double", "ending_s": "double", "powers": "array<double>"}
VALUE = ", ".join(
    [*(f"m_{k} {v}" for k, v in MACHINE.items()), "window_p array<double>", *(f"{k} double" for k in NUMBERS), *(f"{k}_{x} array<double>" for k in PAIRS for x in "tp"), *(f"f_{k} {v}" for k, v in FACTS.items())]
)


class Stored(Held):
    """The samples of the running cycle: what came in this batch here, all before it in the store until it is asked for."""

    def __init__(self, state) -> None:
        super().__init__()
        self.state, self.kept = state, True

    def put(self, samples: list[tuple[float, float]]) -> None:
        self.samples, self.kept = list(samples), False

    def all(self) -> list[tuple[float, float]]:
        return ([tuple(x) for x in self.state.get()] if self.kept and self.state.exists() else []) + self.samples

    def save(self) -> None:
        if not self.kept:
            self.state.clear()
        if self.samples:
            self.state.appendList(self.samples)


class LearnCycles(StatefulProcessor):
    def __init__(self, rules: LiveRules, key: tuple[str, ...]):
        self.rules, self.key = rules, key
        # Types are parsed here, as workers have no session.
        self.types = T.StructType.fromDDL(VALUE), T.StructType.fromDDL("t double, p double")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("machine", self.types[0])
        self.samples = handle.getListState("inside", self.types[1])

    def load(self) -> Live:
        live = Live(self.rules, Stored(self.samples))
        if self.value.exists():
            v = list(self.value.get())
            take = lambda n: [v.pop(0) for _ in range(n)]
            plain = lambda x: [] if x is None else [float(y) for y in x]
            *scalars, powers = take(len(MACHINE))
            live.machine = (*scalars, plain(powers))
            live.window = plain(take(1)[0])
            for name, number in zip(NUMBERS, take(len(NUMBERS)), strict=True):
                setattr(live, name, number)
            for name in PAIRS:
                setattr(live, name, list(zip(*(plain(x) for x in take(2)), strict=True)))
            live.facts = {k: x for k, x in zip(FACTS, take(len(FACTS)), strict=True) if x is not None}
        return live

    def save(self, live: Live) -> None:
        live.inside.save()
        pairs = [[x[i] for x in getattr(live, name)] for name in PAIRS for i in (0, 1)]
        self.value.update((*live.machine[:-1], list(live.machine[-1]), live.window, *(getattr(live, k) for k in NUMBERS), *pairs, *(live.facts.get(k) for k in FACTS)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        live, found = self.load(), []
        batch = pd.concat(list(rows)).sort_values(["t", "tie"])
        for t, p in zip(batch["t"].tolist(), batch["p"].tolist(), strict=True):
            found += live.ingest(t, p)
        self.save(live)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(1000 * (live.machine[1] + self.rules.silent_s)), timerValues.getCurrentWatermarkInMs()) + 1)
        yield as_frame([(c, list(key)) for c in found], self.key, [*self.key, *RAW_NAMES])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.load().finish()
        self.value.clear()
        self.samples.clear()
        yield as_frame([(c, list(key)) for c in found], self.key, [*self.key, *RAW_NAMES])

    def close(self) -> None:
        pass


def stream_live_cycles(readings: DataFrame, rules: LiveRules = LiveRules(), s: Series = EVENTS, delay: str = "10 minutes") -> DataFrame:
    """The live learner's cycles of a stream of readings; equal to `live_cycles` over the same readings, once silent series have ended.

    The session's state store must be RocksDB, which timers and lists need."""
    rows = readings.withColumn(s.ts, F.col(s.ts).cast("timestamp")).withWatermark(s.ts, delay)
    rows = rows.select(*s.key, s.ts, s.seconds().alias("t"), F.col(s.tie).alias("tie"), F.col(s.value).cast("double").alias("p")).where("t IS NOT NULL AND p IS NOT NULL")
    out = T.StructType([*(rows.schema[k] for k in s.key), *T.StructType.fromDDL(RAW).fields])
    raw = rows.groupBy(*s.key).transformWithStateInPandas(LearnCycles(rules, s.key), out, "Append", "EventTime")
    return built_cycles(raw, rules)


def learn_batches(cycles: DataFrame, path: str, checkpoint: str, ident: tuple[str, ...] = ("event_id",), key: tuple[str, ...] = ("site", "phase"), rules: LearningRules = LearningRules()):
    """Sequential learning over a stream of prepared cycles. Every batch reads the newest state before it and writes one folder,
    version=N, with the state of every site and what the batch's cycles did; a replayed batch overwrites its own folder, so each
    cycle counts once. Batches must come in the order of time. `learned_state` reads the result."""

    def learn(batch: DataFrame, number: int) -> None:
        learn_in_order(batch, learned_state(batch.sparkSession, path, before=number), ident, key, rules).write.mode("overwrite").parquet(f"{path}/version={number}")

    return cycles.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(learn).start()


def learned_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest state that `learn_batches` has written, or the newest before a version; None where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    # A version without its success marker was not written to its end.
    names = [s.getPath().getName() for s in files.listStatus(folder) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    versions = [int(n.partition("=")[2]) for n in names if n.startswith("version=")]
    versions = [v for v in versions if before is None or v < before]
    return spark.read.parquet(f"{path}/version={max(versions)}") if versions else None


def learned_decisions(spark: SparkSession, path: str, key: tuple[str, ...] = ("site", "phase")) -> DataFrame:
    """What every cycle of every batch did."""
    return decisions(spark.read.option("basePath", path).parquet(path), ("version", *key))
