"""Sources of readings: files with alternative field names, time ranges, warm starts, simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.functions import scalars as S

TIME_NAMES, POWER_NAMES = ("t", "ts", "timestamp"), ("power_w", "power", "value")
LIST_NAMES = ("readings", "power_series", "series", "samples")


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(readings, patterns) of a JSON object or list; either may be missing."""
    raw = spark.read.option("multiLine", True).json(path)
    lists = [n for n in LIST_NAMES if n in raw.columns]
    readings = raw.select(F.inline(lists[0])) if lists else raw if set(TIME_NAMES) & set(raw.columns) else None
    patterns = raw.select(F.inline("patterns")) if "patterns" in raw.columns else None
    return readings, patterns


def named_readings(df: DataFrame) -> DataFrame:
    """(t, power_w) from whichever of the known names a file has; decimal commas are read, negative powers become 0."""
    def pick(names: tuple[str, ...]) -> Column:
        return F.coalesce(*(S.safe_float(F.col(n), float("nan")) for n in names if n in df.columns))

    out = df.select(pick(TIME_NAMES).alias("t"), pick(POWER_NAMES).alias("power_w"))
    return out.where(~F.isnan("t") & ~F.isnan("power_w")).withColumn("power_w", F.greatest("power_w", F.lit(0.0)))


def normalize_readings(df: DataFrame, t: Column, power: Column, key: tuple[str, ...] = ("user_id",), tie: str = "event_id") -> DataFrame:
    """Powers of 0 at least and strictly rising times: a time that isn't later than the one before becomes that plus one.

    t'(i) = max(t(i), t'(i-1) + 1) is a running maximum of t(i) - i, so no fold is needed."""
    w = Window.partitionBy(*key).orderBy("__t", tie)
    out = df.withColumn("__t", t).withColumn("power_w", F.greatest(power, F.lit(0.0))).withColumn("__i", F.row_number().over(w))
    later = F.max(F.col("__t") - F.col("__i")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__i")
    repeats = F.col("__t") <= F.lag("__t").over(w)
    return out.withColumn("t", F.when(repeats | (later > F.col("__t")), later).otherwise(F.col("__t"))).drop("__t", "__i")


def since(df: DataFrame, seconds: float, ts: str = "ts") -> DataFrame:
    """Rows of the last `seconds` before the newest one; the bound is a single value that the scan filters by."""
    newest = df.agg(F.max(ts).alias("m")).first().m
    if newest is None:
        return df.limit(0)
    return df.where(F.col(ts) >= F.lit(newest).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(seconds)))


def recent_values(df: DataFrame, seconds: float, most: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    return since(df, seconds, ts).orderBy(F.desc(ts), F.desc(tie)).limit(most).orderBy(ts, tie)


def warm_start(df: DataFrame, seconds: float, most: int, fallback: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest rows of a window, or the newest of all where the window is empty."""
    recent = recent_values(df, seconds, most, ts, tie)
    if recent.limit(1).count():
        return recent
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(fallback).orderBy(ts, tie)


def range_scan(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def fallback_profile(avg: Column, peak: Column, seconds: Column) -> Column:
    """A curve of three parts for a pattern without one: a tenth rising to the peak, then the average, a tenth falling off."""
    n = F.least(F.greatest((seconds / 10).cast("int"), F.lit(12)), F.lit(80))
    edge = F.greatest(F.lit(1), (n / 10).cast("int"))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i <= edge, peak * i / edge).when(i > n - edge, avg * (n - i + 1) / (edge + 1)).otherwise(avg))


def simulate(patterns: DataFrame, base: float = 90.0, idle: int = 20, cooldown: int = 8, most: int = 10) -> DataFrame:
    """Readings of each pattern: idle, its profile above the base, a cooldown; again for each sighting, `most` times at most."""
    one = F.concat(F.array_repeat(F.lit(base), idle), F.transform("profile", lambda v: v + base), F.array_repeat(F.lit(base), cooldown))
    rounds = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.greatest("seen", F.lit(1)), F.lit(most)).cast("int")), lambda _: one))
    return patterns.select("pattern_id", F.posexplode(rounds).alias("t", "power_w"))


def discover_entity(entities: DataFrame, preferred: str = "") -> DataFrame:
    """The entity that looks most like a power meter: power class and unit, name, and a preferred name."""
    name = F.lower("entity_id")
    score = F.when((F.col("device_class") == "power") | F.lower("unit").isin("w", "kw"), 2).otherwise(0) + F.when(name.rlike("power|leistung|watt"), 1).otherwise(0)
    if preferred:
        score = score + F.when(name == preferred.lower(), 8).when(name.contains(preferred.lower()), 4).otherwise(0)
    return entities.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "entity_id").limit(1)
