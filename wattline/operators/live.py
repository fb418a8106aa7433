"""The live learner: a state machine over a series that follows its own idle baseline and cuts out whole cycles.

`Live` is one series at one moment. A reading passes a median of the last three; while the machine is idle, readings near the baseline
move it (the mean of the last seconds); the machine decides when a cycle starts and ends; a ring of recent readings gives what
came before a start, and what follows an end is gathered until the post-roll is over. A cycle that outlasts the failsafe is
dropped and the machine starts anew. All that is kept between two readings is bounded, except for the readings of the cycle
that is running, which are only ever appended.

`segment` runs it over a table whose rows it sorts within partitions, so a series needs no more memory than its machine;
`wattline.streaming.learner` runs the same machine over a stream. Both give raw cycles with their samples; `built_cycles`, on
columns alone, decides which of them count and describes those.

A series that is silent for `silent_s` has ended: a cycle in its post-roll counts, a running one doesn't, and later readings
begin a new series. Readings without a time or a value, and those before the last one folded, are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions import curves as V
from wattline.operators.cycles import ACTIVE, IDLE, MAYBE_OFF, MAYBE_ON, CycleRules
from wattline.operators.phases import cut_off, span_seconds
from wattline.operators.series import EVENTS, Series
from wattline.streaming.cycles import START, advance


@dataclass(frozen=True)
class LiveRules:
    """Seconds, watts and counts of the live learner; the defaults are its own."""

    machine: CycleRules = CycleRules(delta_on=30.0, delta_off=10.0, slope=90.0, inrush=1.55)
    baseline_s: float = 5.0
    baseline_samples: int = 60
    pre_s: float = 20.0
    post_s: float = 30.0
    ring_s: float = 10.0
    least_samples: int = 4
    shortest_s: float = 5.0
    longest_s: float = 8 * 3600.0
    silent_s: float = 86_400.0
    median: int = 3


SAMPLES = "array<struct<t:double,p:double>>"
RAW = (
    "start_s double, end_s double, start_reason string, end_reason string, start_signals int, start_delta_w double, start_slope double, "
    f"baseline_start_w double, baseline_end_w double, end_stable_s double, pre {SAMPLES}, inside {SAMPLES}, post {SAMPLES}"
)
RAW_NAMES = [f.split()[0] for f in RAW.split(", ")]


class Held:
    """The samples of the running cycle, in memory."""

    def __init__(self) -> None:
        self.samples: list[tuple[float, float]] = []

    def put(self, samples: list[tuple[float, float]]) -> None:
        self.samples = list(samples)

    def append(self, sample: tuple[float, float]) -> None:
        self.samples.append(sample)

    def all(self) -> list[tuple[float, float]]:
        return self.samples


@dataclass
class Live:
    rules: LiveRules
    inside: Held = field(default_factory=Held)
    machine: tuple = START
    window: list = field(default_factory=list)
    base: float = 0.0
    history: list = field(default_factory=list)
    ring: list = field(default_factory=list)
    candidates: list = field(default_factory=list)
    start: float | None = None
    last_inside: float | None = None
    pre: list = field(default_factory=list)
    post: list = field(default_factory=list)
    end: float | None = None
    ending: float = 0.0
    facts: dict = field(default_factory=dict)

    def learn(self, t: float, v: float) -> None:
        rules, history = self.rules, self.history
        if self.base <= 0 or v <= self.base + max(0.5 * rules.machine.delta_on, 15.0):
            history = [*history, (t, v)][-rules.baseline_samples :]
        self.history = history = [x for x in history if t - x[0] <= rules.baseline_s]
        if history:
            self.base = sum([v for _, v in history]) / len(history)

    def cycle(self) -> list[dict]:
        row = {**self.facts, "start_s": self.start, "end_s": self.end, "pre": self.pre, "inside": list(self.inside.all()), "post": self.post}
        self.forget()
        return [row]

    def forget(self) -> None:
        self.inside.put([])
        self.candidates, self.pre, self.post, self.facts = [], [], [], {}
        self.start = self.end = self.last_inside = None

    def finish(self) -> list[dict]:
        """The series is over; the next reading begins a new one."""
        out = self.cycle() if self.end is not None else []
        self.forget()
        self.machine, self.window, self.base, self.history, self.ring = START, [], 0.0, [], []
        return out

    def ingest(self, t: float, p: float) -> list[dict]:
        rules, last, out = self.rules, self.machine[1], []
        if last is not None and t < last:
            return out
        if last is not None and t - last > rules.silent_s:
            out = self.finish()
        self.window = [*self.window, p][-rules.median :]
        self.ring.append((t, p))
        kept = max(rules.ring_s, rules.pre_s + rules.baseline_s)
        while len(self.ring) > 1 and t - self.ring[0][0] > kept:
            del self.ring[0]
        v = sorted(self.window)[len(self.window) // 2] if len(self.window) > 2 else sum(self.window) / len(self.window)
        before, (_, before_t, before_v, *_) = self.machine[0], self.machine
        if before == IDLE and self.end is None:
            self.learn(t, v)
        self.machine, found = advance(self.machine, t, v, self.base, rules.machine)
        after, kind = self.machine[0], found[0] if found else None
        started = kind == "started"
        if (MAYBE_ON in (before, after) or started) and (not self.candidates or self.candidates[-1][0] != t):
            self.candidates.append((t, p))
        if before == MAYBE_ON and after == IDLE:
            self.candidates = []
        if started:
            if self.end is not None:
                out += self.cycle()
            self.begin(t, p, v, before_t, before_v, found[1])
        elif kind == "ended":
            self.take(t, p)
            self.end, self.post = t, [(t, p)]
            self.facts |= {"end_reason": found[1], "baseline_end_w": self.base, "end_stable_s": t - self.ending}
            if rules.post_s <= 0:
                out += self.cycle()
        else:
            if self.start is not None and before in (ACTIVE, MAYBE_OFF):
                self.take(t, p)
            out += self.wait(t, p, v, after)
        if self.machine[7] is not None:
            self.ending = self.machine[7]
        return out

    def take(self, t: float, p: float) -> None:
        if self.last_inside != t:
            self.inside.append((t, p))
            self.last_inside = t

    def begin(self, t: float, p: float, v: float, before_t: float | None, before_v: float, reason: str) -> None:
        seed = self.candidates or [(t, p)]
        self.start, self.last_inside = seed[0][0], seed[-1][0]
        self.pre = [x for x in self.ring if 0 < self.start - x[0] <= self.rules.pre_s]
        self.inside.put(seed)
        slope = (v - before_v) / (t - before_t) if before_t is not None and t > before_t else 0.0
        step, machine = v - before_v if before_t is not None else 0.0, self.rules.machine
        signals = (v - self.base >= machine.delta_on) + (slope >= machine.slope) + (step >= machine.step) + (v / max(self.base, 1.0) >= machine.inrush and slope >= 0)
        self.candidates, self.post, self.end = [], [], None
        self.facts = {"start_reason": reason, "start_signals": int(signals), "start_delta_w": v - self.base, "start_slope": slope, "baseline_start_w": self.base}

    def wait(self, t: float, p: float, v: float, after: str) -> list[dict]:
        """What a reading does that neither starts nor ends a cycle."""
        rules = self.rules
        if after == IDLE:
            self.learn(t, v)
            if self.end is None:
                return []
            if self.post[-1][0] != t:
                self.post.append((t, p))
            n = len(self.post)
            span = (self.post[-1][0] - self.post[0][0]) * n / (n - 1) if n > 1 else self.usual_step()
            return self.cycle() if t >= self.end + rules.post_s or span >= rules.post_s else []
        if self.start is not None and t - self.start > rules.longest_s:
            self.machine = START
            self.forget()
        return []

    def usual_step(self) -> float:
        times = [t for t, _ in self.inside.all()]
        steps = sorted(b - a for a, b in zip(times, times[1:], strict=False) if b > a)
        return steps[len(steps) // 2] if steps else 0.0


def segment(df: DataFrame, rules: LiveRules = LiveRules(), s: Series = EVENTS, seconds: Column | None = None, primed: Column | None = None) -> DataFrame:
    """The raw cycles of every series: key and RAW. `seconds` stands for the time of a row in seconds, if that isn't `s.ts`;
    `primed`, equal in all rows of a series, is the baseline that it begins with."""
    base = F.lit(0.0) if primed is None else F.coalesce(primed.cast("double"), F.lit(0.0))
    time = s.seconds() if seconds is None else seconds
    rows = df.select(*s.key, time.alias("t"), F.col(s.tie).alias("tie"), F.col(s.value).cast("double").alias("p"), base.alias("base")).where("t IS NOT NULL AND p IS NOT NULL")
    names = [*s.key, *RAW_NAMES]
    out = T.StructType([*(rows.schema[k] for k in s.key), *T.StructType.fromDDL(RAW).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last, live = None, None, Live(rules)
        for batch in batches:
            found = []
            # A key may hold nulls, which differ from themselves in pandas; their text does not.
            for *own, t, _, p, base in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                if own != last and (mark := repr(own)) != key:
                    found += [({**c}, last) for c in live.finish()] if key is not None else []
                    key, last, live = mark, own, Live(rules, base=base)
                found += [(c, own) for c in live.ingest(t, p)]
            yield as_frame(found, s.key, names)
        yield as_frame([(c, last) for c in live.finish()] if key is not None else [], s.key, names)

    return rows.repartition(*s.key).sortWithinPartitions(*s.key, "t", "tie").mapInPandas(run, out)


def as_frame(found: list[tuple[dict, list]], key: tuple[str, ...], names: list[str]) -> pd.DataFrame:
    pairs = lambda x: [{"t": t, "p": p} for t, p in x]
    return pd.DataFrame([{**c, **{k: pairs(c[k]) for k in ("pre", "inside", "post")}, **dict(zip(key, own, strict=True))} for c, own in found], columns=names)


def built_cycles(raw: DataFrame, rules: LiveRules = LiveRules(), least_high: int = 2) -> DataFrame:
    """The raw cycles that count, with figures, flags, a waveform from pre-roll to post-roll and the profile of the cycle alone.

    A cycle needs `least_samples`, a duration from `shortest_s` to `longest_s`, and `least_high` samples well above its baseline."""
    at = lambda c: F.transform(c, lambda x: x["t"])
    power = F.transform("inside", lambda x: x["p"])
    steps = F.filter(F.transform("inside", lambda x, i: x["t"] - F.try_element_at("inside", F.greatest(i, F.lit(1)))["t"]), lambda d: d > 0)
    sustained = F.col("baseline_start_w") + max(rules.machine.delta_off, 0.35 * rules.machine.delta_on, 10.0)
    out = raw.withColumns({
        "duration_s": F.col("end_s") - F.col("start_s"), "n": F.size("inside"), "step_s": F.coalesce(V.once(steps, V.upper_median), F.lit(0.0)),
        "n_high": F.size(F.filter(power, lambda p: p > sustained)),
    })
    out = out.where((F.col("n") >= rules.least_samples) & F.col("duration_s").between(rules.shortest_s, rules.longest_s) & (F.col("n_high") >= least_high))
    area = F.aggregate(
        F.transform("inside", lambda x, i: (x["p"] + F.try_element_at("inside", F.greatest(i, F.lit(1)))["p"]) / 2 * (x["t"] - F.try_element_at("inside", F.greatest(i, F.lit(1)))["t"])),
        F.lit(0.0), lambda a, e: a + F.greatest(e, F.lit(0.0)),
    )
    base = F.when(F.col("baseline_end_w") != 0, F.col("baseline_end_w")).otherwise(F.col("baseline_start_w"))
    flags = lambda b: cut_off(F.col("pre"), F.col("inside"), F.col("post"), F.col("step_s"), b, rules.machine.delta_on, rules.machine.delta_off, rules.pre_s, rules.post_s)
    return out.withColumns({
        "avg_w": V.mean(power), "peak_w": F.array_max(power), "energy_wh": area / 3600,
        "pre_roll_s": span_seconds(at(F.col("pre")), F.col("step_s")), "post_roll_s": span_seconds(at(F.col("post")), F.col("step_s")),
        "cut_start": flags(F.col("baseline_start_w"))["cut_start"], "cut_end": flags(base)["cut_end"],
        "profile": F.col("inside"), "waveform": F.concat("pre", "inside", "post"),
    }).drop("n_high")


def live_cycles(df: DataFrame, rules: LiveRules = LiveRules(), s: Series = EVENTS, seconds: Column | None = None) -> DataFrame:
    """The cycles that the live learner finds in a table of readings."""
    return built_cycles(segment(df, rules, s, seconds), rules)
