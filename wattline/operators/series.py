"""Operators over time-ordered readings, one series for each key.

Everything a frame can say is a window expression; state that feeds back (baselines that only learn while idle, hysteresis)
is a fold over the sorted array of a series and stays in the JVM. Series are split by key and, for the folds, may be cut
into spans (a day, say) by adding the span to the key, so no array need hold more than a span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    """Which columns are the series' key, its time, its tie-breaker and its power."""

    key: tuple[str, ...] = ("user_id",)
    ts: str = "ts"
    tie: str = "event_id"
    value: str = "value"

    def window(self):
        return Window.partitionBy(*self.key).orderBy(self.ts, self.tie)

    def rows(self, low: int, high: int = 0):
        return self.window().rowsBetween(low, high)

    def seconds(self) -> Column:
        return F.unix_micros(F.col(self.ts).cast("timestamp")) / 1e6

    def fold(self, df: DataFrame, start: Column, step, finish=None, keep: tuple[str, ...] = ()) -> DataFrame:
        """One row for each key with `out`: the fold of its samples (t, tie, value, ...) in order."""
        sample = F.struct(self.seconds().alias("t"), F.col(self.tie).alias("tie"), F.col(self.value).alias("p"), *keep)
        arrays = df.groupBy(*self.key).agg(F.array_sort(F.collect_list(sample)).alias("__samples"))
        return arrays.select(*self.key, F.aggregate("__samples", start, step, finish or (lambda a: a)).alias("out"))

    def scan(self, df: DataFrame, start: Column, step, row: str, keep: tuple[str, ...] = (), chunk: int = 256) -> DataFrame:
        """The rows that a fold gives on its way: step(state, sample) is (state, row or null), `row` the type of a row.

        Rows are gathered a chunk of samples at a time, so that no sample copies all rows before it: time is linear in the series."""
        sample = F.struct(self.seconds().alias("t"), F.col(self.tie).alias("tie"), F.col(self.value).alias("p"), *keep)
        arrays = df.groupBy(*self.key).agg(F.array_sort(F.collect_list(sample)).alias("__samples"))
        firsts = F.sequence(F.lit(1), F.size("__samples"), F.lit(chunk))
        none = F.array().cast(f"array<{row}>")

        def one(a: Column, x: Column) -> Column:
            state, out = step(a["state"], x)
            return F.struct(state.alias("state"), F.when(out.isNull(), a["rows"]).otherwise(F.concat(a["rows"], F.array(out.cast(row)))).alias("rows"))

        def many(a: Column, first: Column) -> Column:
            done = F.aggregate(F.slice("__samples", first, F.lit(chunk)), F.struct(a["state"].alias("state"), none.alias("rows")), one)
            gathered = lambda d: F.struct(d["state"].alias("state"), F.concat(a["rows"], F.array(d["rows"])).alias("rows"))
            return F.element_at(F.transform(F.array(done), gathered), 1)

        begin = F.struct(start.alias("state"), F.array().cast(f"array<array<{row}>>").alias("rows"))
        rows = F.flatten(F.aggregate(firsts, begin, many, lambda a: a["rows"]))
        return arrays.select(*self.key, F.inline(rows)).withColumnRenamed("tie", self.tie)


EVENTS = Series()


def moving_average(df: DataFrame, s: Series = EVENTS, size: int = 5, into: str = "smoothed") -> DataFrame:
    return df.withColumn(into, F.avg(s.value).over(s.rows(1 - max(3, size))))


def noise_gate(df: DataFrame, s: Series = EVENTS, size: int = 5, most: float = 2.0, into: str = "filtered") -> DataFrame:
    """The smoothed value where it is near the raw one, else the raw one."""
    smoothed = F.avg(s.value).over(s.rows(1 - max(3, size)))
    return df.withColumn(into, F.when(F.abs(smoothed - F.col(s.value)) <= most, smoothed).otherwise(F.col(s.value)))


def learned_baseline(df: DataFrame, s: Series = EVENTS, band: float = 5.0, most: int = 50) -> DataFrame:
    """A baseline that follows samples near or below it, the first `most` of them; a row for each sample."""
    start = F.struct(F.lit(0.0).alias("base"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        learns = (x["p"] <= a["base"] + band) & (a["n"] < most)
        base = F.when(learns, a["base"] + (x["p"] - a["base"]) / (a["n"] + 1)).otherwise(a["base"])
        row = F.struct(x["t"].alias("t"), x["tie"].alias("tie"), F.greatest(x["p"], base).alias("corrected"), base.alias("baseline"))
        return F.struct(base.alias("base"), (a["n"] + learns.cast("int")).alias("n")), row

    return s.scan(df, start, step, "struct<t:double,tie:bigint,corrected:double,baseline:double>")


def median_filter(df: DataFrame, s: Series = EVENTS, size: int = 3, into: str = "filtered") -> DataFrame:
    """The middle of the last `size` samples; their mean while there are fewer."""
    frame = s.rows(1 - size)
    values = F.sort_array(F.collect_list(s.value).over(frame))
    return df.withColumn(into, F.when(F.count(s.value).over(frame) < size, F.avg(s.value).over(frame)).otherwise(F.element_at(values, size // 2 + 1)))


def primed_baseline(df: DataFrame, s: Series = EVENTS, first: int = 60) -> DataFrame:
    """The upper median of the first samples of each series."""
    seed = df.withColumn("__n", F.row_number().over(s.window())).where(F.col("__n") <= first)
    values = seed.groupBy(*s.key).agg(F.sort_array(F.collect_list(s.value)).alias("v"))
    return values.select(*s.key, F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int")).alias("baseline"), F.size("v").cast("long").alias("n_seed"))


def differences(df: DataFrame, s: Series = EVENTS) -> DataFrame:
    """dt, dp and dp/dt against the sample before; 0 for the first and where no time passed."""
    w = s.window()
    out = df.withColumn("dt", F.coalesce(s.seconds() - F.lag(s.seconds()).over(w), F.lit(0.0))).withColumn("dp", F.coalesce(F.col(s.value) - F.lag(s.value).over(w), F.lit(0.0)))
    return out.withColumn("dpdt", F.when(F.col("dt") > 0, F.col("dp") / F.col("dt")).otherwise(0.0))


def start_signals(df: DataFrame, baseline: Column, s: Series = EVENTS, delta_on: float = 30, slope: float = 120, step: float = 18, inrush: float = 1.6) -> DataFrame:
    """The four signals that a cycle starts, and their verdict."""
    out = differences(df, s).withColumn("baseline", baseline)
    delta, ratio = F.col(s.value) - F.col("baseline"), F.col(s.value) / F.greatest(F.col("baseline"), F.lit(1.0))
    out = out.withColumns({"by_delta": delta >= delta_on, "by_slope": F.col("dpdt") >= slope, "by_step": F.col("dp") >= step, "by_inrush": (ratio >= inrush) & (F.col("dpdt") >= 0)})
    count = sum((F.col(c).cast("int") for c in ("by_slope", "by_step", "by_inrush")), F.col("by_delta").cast("int"))
    return out.withColumn("n_signals", count).withColumn("starts", F.col("by_delta") | F.col("by_slope") | (count >= 2))


def islands(df: DataFrame, active: Column, s: Series = EVENTS, into: str = "island") -> DataFrame:
    """Numbers the runs of rows with equal `active` in each series."""
    w = s.window()
    out = df.withColumn("__on", active)
    changed = F.coalesce((F.col("__on") != F.lag("__on").over(w)).cast("long"), F.lit(1))
    return out.withColumn("__c", changed).withColumn(into, F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c").withColumnRenamed("__on", "active")


def gap_sessions(df: DataFrame, gap_s: float, s: Series = EVENTS) -> DataFrame:
    """Runs of samples no more than gap_s apart: start, end, number and mean."""
    w = s.window()
    out = df.withColumn("__t", s.seconds()).withColumn("__new", F.coalesce(((F.col("__t") - F.lag("__t").over(w)) > gap_s).cast("long"), F.lit(1)))
    out = out.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*s.key, "session").agg(F.min("__t").alias("start_s"), F.max("__t").alias("end_s"), F.count("*").alias("n"), F.avg(s.value).alias("avg_w"))


def state_runs(df: DataFrame, state: Column, s: Series = EVENTS) -> DataFrame:
    """Run-length intervals of a state: peak, mean, number, duration."""
    runs = islands(df.withColumn("state", state), F.col("state"), s)
    return runs.groupBy(*s.key, "island", "state").agg(F.min(s.seconds()).alias("start_s"), F.max(s.seconds()).alias("end_s"), F.max(s.value).alias("peak_w"), F.avg(s.value).alias("avg_w"), F.count("*").alias("n")).withColumn("duration_s", F.col("end_s") - F.col("start_s"))


def state_summary(runs: DataFrame, s: Series = EVENTS) -> DataFrame:
    """Of each key: the states in order, time in each, and the unweighted mean of the runs' means."""
    ordered = F.array_sort(F.collect_list(F.struct("island", "state")))
    return runs.groupBy(*s.key).agg(
        F.array_join(F.transform(ordered, lambda x: x["state"]), ">").alias("sequence"), F.count("*").alias("n_runs"), F.avg("avg_w").alias("mean_of_means"), *(F.sum(F.when(F.col("state") == v, F.col("duration_s")).otherwise(0.0)).alias(f"{v}_s") for v in ("idle", "low", "medium", "high"))
    )


def device_power(df: DataFrame, s: Series = EVENTS, size: int = 60, most: float = 400.0, into: str = "device_w") -> DataFrame:
    """Power above the lowest of the last samples, capped."""
    low = F.min(s.value).over(s.rows(1 - size))
    return df.withColumn(into, F.least(F.greatest(F.col(s.value) - low, F.lit(0.0)), F.lit(most)))


def above_baseline(df: DataFrame, baseline: Column, s: Series = EVENTS, most: float = 400.0, into: str = "device_w") -> DataFrame:
    return df.withColumn(into, F.least(F.greatest(F.col(s.value) - baseline, F.lit(0.0)), F.lit(most)))


def recent_stats(df: DataFrame, seconds: float, s: Series = EVENTS) -> DataFrame:
    """Mean, maximum, minimum and number of the samples of the last `seconds` before each."""
    w = Window.partitionBy(*s.key).orderBy("__us").rangeBetween(-int(seconds * 1e6), 0)
    out = df.withColumn("__us", F.unix_micros(F.col(s.ts).cast("timestamp")))
    return out.withColumns({"avg_w": F.avg(s.value).over(w), "max_w": F.max(s.value).over(w), "min_w": F.min(s.value).over(w), "n_recent": F.count("*").over(w)}).drop("__us")


def steadiness(df: DataFrame, s: Series = EVENTS, k: int = 5, rising: int = 3, most: float = 300.0) -> DataFrame:
    """Population variance of the last k samples, whether they are steady, and whether the last `rising` rise."""
    full = F.count("*").over(s.rows(1 - k)) == k
    out = df.withColumn("variance", F.var_pop(s.value).over(s.rows(1 - k)))
    return out.withColumn("stable", full & (F.col("variance") < most)).withColumn("rising", F.coalesce(F.col(s.value) > F.lag(s.value, rising - 1).over(s.window()), F.lit(False)))


def window_slope(df: DataFrame, seconds: float, s: Series = EVENTS, into: str = "slope") -> DataFrame:
    """Watts a second from the first to the last sample of the last `seconds`; with fewer than two of them, of the last three."""
    us = F.unix_micros(F.col(s.ts).cast("timestamp"))
    near = Window.partitionBy(*s.key).orderBy("__us").rangeBetween(-int(seconds * 1e6), 0)
    out = df.withColumn("__us", us).withColumn("__x", F.struct("__us", s.tie, s.value))
    first = F.when(F.count("*").over(near) >= 2, F.min("__x").over(near)).otherwise(F.min("__x").over(s.rows(-2)))
    out = out.withColumn("__f", first)
    dt = (F.col("__us") - F.col("__f.__us")) / 1e6
    return out.withColumn(into, F.when(dt > 0, (F.col(s.value) - F.col(f"__f.{s.value}")) / dt).otherwise(0.0)).drop("__us", "__x", "__f")


def carried_forward(df: DataFrame, phase: str, phases: list, s: Series = EVENTS) -> DataFrame:
    """Sparse readings of several phases as totals: each phase keeps its last value; totals of 0 and below are dropped."""
    w = s.window().rowsBetween(Window.unboundedPreceding, 0)
    last = {f"phase_{p}": F.last(F.when(F.col(phase) == p, F.col(s.value)), ignorenulls=True).over(w) for p in phases}
    out = df.withColumns(last)
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in last), F.lit(0.0))
    return out.withColumn("total_w", total).where(F.col("total_w") > 0)


def hysteresis(df: DataFrame, on: float, off: float, s: Series = EVENTS, least_s: float = 0.0) -> DataFrame:
    """Transitions of a two-threshold switch, folded in order: rows (t, tie, state) where the state changes. A switch that is on
    stays so for least_s seconds."""
    start = F.struct(F.lit(False).alias("on"), F.lit(0.0).alias("since"))

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        now = F.when(a["on"], (x["p"] > off) | (x["t"] - a["since"] < least_s)).otherwise(x["p"] >= on)
        row = F.struct(x["t"].alias("t"), x["tie"].alias("tie"), F.when(now, "on").otherwise("off").alias("state"))
        since = F.when(now & ~a["on"], x["t"]).otherwise(a["since"])
        return F.struct(now.alias("on"), since.alias("since")), F.when(now != a["on"], row)

    return s.scan(df, start, step, "struct<t:double,tie:bigint,state:string>")


def daily_counters(transitions: DataFrame, s: Series = EVENTS) -> DataFrame:
    """Starts a day of each key, from transitions."""
    day = F.to_date(F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    return transitions.groupBy(*s.key, day.alias("day")).agg(F.count_if(F.col("state") == "on").alias("starts"), F.count("*").alias("changes"))
