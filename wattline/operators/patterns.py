"""Patterns: what recurs among cycles. Running means of the live system don't depend on order, so they are plain averages;
only what needs order (last intervals, latest profile) looks at it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions import scalars as S


def patterns_of(cycles: DataFrame, key: tuple[str, ...] = ("phase", "label")) -> DataFrame:
    """One row for each (phase, label): sightings, means, bounds and the frequency a day."""
    out = cycles.groupBy(*key).agg(
        F.count("*").alias("seen"), F.avg("avg_w").alias("avg_w"), F.max("peak_w").alias("peak_w"), F.avg("duration_s").alias("duration_s"), F.avg("energy_wh").alias("energy_wh"), F.avg("variance").alias("variance"),
        F.avg("duty").alias("duty"), F.min("start_s").alias("first_s"), F.max("end_s").alias("last_s"),
    )
    return out.withColumn("per_day", F.col("seen") / F.greatest((F.col("last_s") - F.col("first_s")) / 86400.0, F.lit(1.0 / 24.0)))


def scored(patterns: DataFrame, quality: Column) -> DataFrame:
    """Stability and confidence of patterns, as lists show them."""
    return patterns.withColumn("stability", S.stability_score(F.col("variance"), F.col("avg_w"))).withColumn("confidence", S.confidence_score(quality, F.col("seen")))


def hour_profile(cycles: DataFrame, key: tuple[str, ...] = ("phase", "label")) -> DataFrame:
    """Sightings by hour of the day."""
    return cycles.groupBy(*key, F.pmod(F.floor(F.col("start_s") / 3600), F.lit(24)).cast("int").alias("hour")).agg(F.count("*").alias("n"))


def last_intervals(cycles: DataFrame, most: int = 24, key: tuple[str, ...] = ("phase", "label"), tie: tuple[str, ...] = ("user_id", "cycle")) -> DataFrame:
    """The mean of the last `most` positive gaps between starts, and their number."""
    w = Window.partitionBy(*key).orderBy("start_s", *tie)
    gaps = cycles.withColumn("gap", F.col("start_s") - F.lag("start_s").over(w)).where("gap > 0")
    newest = Window.partitionBy(*key).orderBy(F.desc("start_s"), *(F.desc(t) for t in tie))
    return gaps.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= most).groupBy(*key).agg(F.avg("gap").alias("typical_interval_s"), F.count("*").alias("n_intervals"))


def typical_frequency(cycles: DataFrame, key: tuple[str, ...] = ("phase", "label"), tie: tuple[str, ...] = ("user_id", "cycle")) -> DataFrame:
    """86400 over the median positive gap."""
    w = Window.partitionBy(*key).orderBy("start_s", *tie)
    gaps = cycles.withColumn("gap", F.col("start_s") - F.lag("start_s").over(w)).where("gap > 0")
    return gaps.groupBy(*key).agg((86400.0 / F.median("gap")).alias("per_day"))


def representatives(patterns: DataFrame, per: str = "label") -> DataFrame:
    """The best pattern of each label: confidence, then sightings, then power."""
    best = F.struct("confidence", "seen", "avg_w", "phase")
    return patterns.groupBy(per).agg(F.max(best).alias("b")).select(per, "b.*")


def vote(results: DataFrame, key: tuple[str, ...], state: str, confidence: str, least: float) -> DataFrame:
    """Detector results joined to one verdict: the most confident state, or off where their mean is below `least`."""
    out = results.groupBy(*key).agg(F.avg(confidence).alias("mean_confidence"), F.max(F.struct(F.col(confidence).alias("c"), F.col(state).alias("s"))).alias("best"))
    weak = F.col("mean_confidence") < least
    return out.select(*key, F.when(weak, "off").otherwise(F.col("best.s")).alias("state"), F.when(weak, F.greatest(F.lit(0.2), 0.7 * F.col("mean_confidence"))).otherwise(F.col("mean_confidence")).alias("confidence"))


def starved(training: DataFrame, key: tuple[str, ...], order: tuple, last: int = 8) -> DataFrame:
    """Whether the last `last` training rows of each key were all rejected for their segmentation."""
    newest = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    rows = training.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= last)
    return rows.groupBy(*key).agg(((F.count("*") == last) & F.bool_and(~F.col("accepted") & (F.col("reason") == "segmentation_quality_gate"))).alias("starved"))
