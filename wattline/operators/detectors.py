"""Device detectors: three states and ordered rules over flags that windows compute first, folded in order of time.

A rule is (state, condition, next state, confidence); the first that fits decides, and a sample that no rule fits gives no
result. Conditions see the sample's flags and the seconds since the cycle began."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.operators.series import EVENTS, Series, steadiness, window_slope

OFF, STARTING, ON = "off", "starting", "on"
Rule = tuple[str, Callable[[Column, Column], Column], str, float]


def detect(df: DataFrame, flags: tuple[str, ...], rules: list[Rule], s: Series = EVENTS) -> DataFrame:
    """(key, t, tie, state, confidence) for every sample that a rule fits."""
    start = F.struct(F.lit(OFF).alias("state"), F.lit(0.0).alias("since"))

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        runtime = x["t"] - a["since"]
        state = confidence = None
        for name, condition, then, sure in rules:
            fits = (a["state"] == name) & F.coalesce(condition(x, runtime), F.lit(False))
            state = F.when(fits, then) if state is None else state.when(fits, then)
            confidence = F.when(fits, sure) if confidence is None else confidence.when(fits, sure)
        now = F.coalesce(state, a["state"])
        row = F.struct(x["t"].alias("t"), x["tie"].alias("tie"), now.alias("state"), confidence.alias("confidence"))
        since = F.when((a["state"] == OFF) & (now == STARTING), x["t"]).otherwise(a["since"])
        return F.struct(now.alias("state"), since.alias("since")), F.when(confidence.isNotNull(), row)

    return s.scan(df, start, step, "struct<t:double,tie:bigint,state:string,confidence:double>", flags)


def always(x: Column, runtime: Column) -> Column:
    return F.lit(True)


def fridge(df: DataFrame, power_min: float, startup_s: float, min_runtime_s: float, s: Series = EVENTS) -> DataFrame:
    rules: list[Rule] = [
        (OFF, lambda x, r: x["high"], STARTING, 0.65),
        (STARTING, lambda x, r: x["high"] & (r >= startup_s), ON, 0.82), (STARTING, lambda x, r: x["high"], STARTING, 0.55), (STARTING, always, OFF, 0.40),
        (ON, lambda x, r: x["high"], ON, 0.88), (ON, lambda x, r: r >= min_runtime_s, OFF, 0.75), (ON, always, ON, 0.66),
    ]
    return detect(df.withColumn("high", F.col(s.value) > power_min), ("high",), rules, s)


def adaptive_load(df: DataFrame, baseline: Column, spread: Column, startup_s: float, min_runtime_s: float, most_variance: float = 300.0, s: Series = EVENTS) -> DataFrame:
    """Baseline and spread are columns (mean and deviation of calm samples), so they can come from a window or a table."""
    flagged = steadiness(df, s, 5, 3, most_variance).withColumns({"above": F.col(s.value) >= baseline + 1.4 * spread, "below": F.col(s.value) < baseline + 0.5 * spread})
    rules: list[Rule] = [
        (OFF, lambda x, r: x["above"] & x["rising"], STARTING, 0.60),
        (STARTING, lambda x, r: (r >= startup_s) & x["stable"] & ~x["below"], ON, 0.75), (STARTING, lambda x, r: x["below"], OFF, 0.35), (STARTING, always, STARTING, 0.55),
        (ON, lambda x, r: (x["below"] | ~x["stable"]) & (r >= min_runtime_s), OFF, 0.70), (ON, lambda x, r: x["below"] | ~x["stable"], ON, 0.60),
    ]
    return detect(flagged, ("above", "below", "stable", "rising"), rules, s)


def inverter(df: DataFrame, baseline: Column, slope_s: float, ramp: float, min_runtime_s: float, most_variance: float = 1500.0, s: Series = EVENTS) -> DataFrame:
    flagged = window_slope(steadiness(df, s, 8, 3, most_variance), slope_s, s)
    flagged = flagged.withColumns({"ramps": (F.col("slope") > ramp) & (F.col(s.value) > baseline + 40), "gone": F.col(s.value) < baseline + 20, "ends": (F.col(s.value) < baseline + 30) | (F.col("slope") < -ramp)})
    rules: list[Rule] = [
        (OFF, lambda x, r: x["ramps"], STARTING, 0.60),
        (STARTING, lambda x, r: (r >= 1) & x["stable"], ON, 0.75), (STARTING, lambda x, r: x["gone"], OFF, 0.40), (STARTING, always, STARTING, 0.55),
        (ON, lambda x, r: x["ends"] & (r >= max(min_runtime_s, 10)), OFF, 0.70), (ON, lambda x, r: x["ends"], ON, 0.55), (ON, always, ON, 0.80),
    ]
    return detect(flagged, ("ramps", "stable", "gone", "ends"), rules, s)
