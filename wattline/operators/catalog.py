"""Lists and counters over patterns, phase locks, and what detectors report of themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions import scalars as S
from wattline.operators.series import EVENTS, Series

PHASES = ("L1", "L2", "L3")


def status(seen: Column, least: int = 3) -> Column:
    """Patterns with few sightings are weak until they are promoted."""
    return F.when(seen < least, "weak_pattern").otherwise("active")


def provisional(patterns: DataFrame, newest: int, order: tuple[str, ...]) -> DataFrame:
    """The newest weak patterns: a list with its own limit."""
    return patterns.where(F.col("status") == "weak_pattern").orderBy(F.desc("last_s"), *order).limit(newest)


def phase_locks(locks: DataFrame, order: Column) -> DataFrame:
    """(label_key, phase): the last lock of each normalised label that names a phase; others are no locks."""
    valid = locks.where(F.upper("phase").isin(*PHASES) & (F.trim("label") != "")).withColumn("label_key", S.normalize_label(F.col("label")))
    return valid.groupBy("label_key").agg(F.max_by(F.upper("phase"), order).alias("phase"))


def aligned(patterns: DataFrame, locks: DataFrame, label: str = "label", phase: str = "phase") -> DataFrame:
    """Patterns moved to the phase that their label is locked to. A lock table has a row for each locked label."""
    named = patterns.withColumn("label_key", S.normalize_label(F.col(label)))
    chosen = locks.select("label_key", F.col("phase").alias("locked_phase"))
    out = named.join(chosen, "label_key", "left")
    return out.withColumn(phase, F.coalesce("locked_phase", phase)).withColumn("locked", F.col("locked_phase").isNotNull()).drop("label_key", "locked_phase")


def learning_counters(decisions: DataFrame, by: str = "action") -> DataFrame:
    return decisions.groupBy(by).agg(F.count("*").alias("n"))


def dataset_rows(features: DataFrame, patterns: DataFrame, key: tuple[str, ...], label: str, quality: str) -> DataFrame:
    """Features with the label and quality of their pattern; unknown and unsicher where they have none."""
    out = features.join(patterns.select(*key, F.col(label).alias("target_candidate"), F.col(quality).alias("target_quality")), list(key), "left")
    return out.fillna({"target_candidate": "unknown", "target_quality": "unsicher"})


def primed(df: DataFrame, most_w: float, last: int = 300, s: Series = EVENTS) -> DataFrame:
    """(key, base, spread) of the last samples of each series that are no higher than most_w; the spread is 2 at least."""
    from pyspark.sql import Window

    newest = Window.partitionBy(*s.key).orderBy(F.desc(s.ts), F.desc(s.tie))
    kept = df.withColumn("__back", F.row_number().over(newest)).where((F.col("__back") <= last) & (F.col(s.value) <= most_w))
    return kept.groupBy(*s.key).agg(F.avg(s.value).alias("base"), F.greatest(F.stddev_pop(s.value), F.lit(2.0)).alias("spread"))


def diagnostics(df: DataFrame, base: Column, spread: Column, startup: float = 1.4, learning: int = 30, s: Series = EVENTS) -> DataFrame:
    """What a detector knows at each sample: mean and variance of the last five, its threshold, and whether it still learns."""
    frame = s.rows(-4)
    return df.withColumns({
        "recent_avg_w": F.avg(s.value).over(frame), "recent_var": F.var_pop(s.value).over(frame), "startup_w": base + startup * spread,
        "learning": F.row_number().over(s.window()) < learning,
    })


def routed(devices: DataFrame) -> DataFrame:
    """(columns of devices, detector): the detectors that a device's type asks for."""
    kind = F.lower(F.col("detector_type"))
    both = lambda first: F.array(F.lit(first), F.lit("adaptive"))
    return devices.withColumn("detector", F.explode(F.when(kind == "inverter", both("inverter")).when(kind == "adaptive", F.array(F.lit("adaptive"))).otherwise(both("fridge"))))
