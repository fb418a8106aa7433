"""The offline pipeline: readings to events, features, clusters and quality, as one chain of DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wattline.functions import curves as V
from wattline.operators import classify, cycles
from wattline.operators.matching import interval_context
from wattline.operators.series import EVENTS, Series


def event_features(events: DataFrame, readings: DataFrame, s: Series = EVENTS, key: str = "user_id", bucket_s: float = 86400.0) -> DataFrame:
    """Features of merged events: power above the baseline, duration with a median step added, energy as rectangles, a curve of 32 points."""
    rows = interval_context(events, readings.select(key, s.ts, s.tie, s.value), key, 0.0, 0.0, s.seconds(), bucket_s)
    w = Window.partitionBy(key, "event_no").orderBy("t", s.tie)
    rows = rows.withColumn("p", F.greatest(F.col(s.value) - F.col("baseline"), F.lit(0.0))).withColumn("dt", F.col("t") - F.lag("t").over(w))
    x = F.array_sort(F.collect_list(F.struct("t", s.tie, "p")))
    out = rows.groupBy(key, "event_no").agg(
        F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.avg("p").alias("avg_w"), F.max("p").alias("peak_w"), F.sum("p").alias("sum_w"), F.var_pop("p").alias("variance"), F.stddev_pop("p").alias("std_w"),
        F.coalesce(F.greatest(F.lit(0.1), F.median(F.when(F.col("dt") > 0, F.col("dt")))), F.lit(1.0)).alias("dt"), F.transform(x, lambda v: v["p"]).alias("curve"), F.count("*").alias("n"),
    )
    out = out.withColumn("duration_s", F.greatest(F.col("dt"), F.col("end_s") - F.col("start_s") + F.col("dt"))).withColumn("energy_wh", F.col("sum_w") * F.col("dt") / 3600.0)
    out = out.withColumn("jumps", V.count_jumps(F.col("curve"), 40.0)).withColumn("plateaus", F.size(V.cluster_levels(F.col("curve"), 30.0)))
    return out.withColumn("profile", F.transform(V.resample(F.col("curve"), 32), lambda v: F.round(v, 2))).withColumn("peak_to_avg", F.when(F.col("avg_w") > 1e-9, F.col("peak_w") / F.col("avg_w")).otherwise(1.0)).drop("sum_w", "dt", "curve")


class Clusters:
    """Running means of the patterns of one series, as arrays over the patterns, so that an event meets all of them at once."""

    def __init__(self, most: float, alpha: float):
        self.most, self.alpha, self.n = most, alpha, 0
        self.seen, self.means, self.curves = np.zeros(8), np.zeros((8, 3)), np.zeros((8, 32))

    def add(self, watts: float, seconds: float, plateaus: float, curve: np.ndarray) -> int:
        """The pattern that the event joins: the nearest of the compatible ones, the first of equals, else a new one."""
        n = self.n
        means, curves = self.means[:n], self.curves[:n]
        far = np.abs(np.array([watts, seconds, plateaus]) - means) / np.maximum(means, (80.0, 30.0, 0.0), where=(True, True, False), out=np.ones((n, 3)))
        shape = np.abs(curves - curve).mean(1) / np.maximum(np.maximum(80.0, curve.mean()), curves.mean(1))
        distance = 0.4 * far[:, 0] + 0.25 * far[:, 1] + 0.25 * shape + 0.10 * np.minimum(1.0, far[:, 2] / 4)
        distance[(far[:, 0] > 0.15) | (far[:, 1] > 0.5) | (far[:, 2] > 2) | (distance > self.most)] = np.inf
        if n and distance.min() < np.inf:
            k = int(distance.argmin())
            self.means[k] = (self.means[k] * self.seen[k] + (watts, seconds, plateaus)) / (self.seen[k] + 1)
            self.means[k, 2] = np.round(self.means[k, 2])
            self.curves[k] = (1 - self.alpha) * self.curves[k] + self.alpha * curve
            self.seen[k] += 1
            return k
        if n == len(self.seen):
            self.seen, self.means, self.curves = (np.concatenate([x, np.zeros_like(x)]) for x in (self.seen, self.means, self.curves))
        self.seen[n], self.means[n], self.curves[n] = 1, (watts, seconds, plateaus), curve
        self.n += 1
        return n


def cluster(features: DataFrame, key: str = "user_id", most: float = 0.85, alpha: float = 0.22) -> DataFrame:
    """The features with pattern_no: events in order join the nearest compatible pattern of their series or begin one.

    Order matters, so the series of a partition come one after the other, their events in order; what is held is one series' patterns."""

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, known = None, Clusters(most, alpha)
        for events in batches:
            numbers = []
            for own, w, s, n, curve in zip(events[key], events.avg_w, events.duration_s, events.plateaus, events.profile, strict=True):
                if (mark := repr(own)) != series:
                    series, known = mark, Clusters(most, alpha)
                numbers.append(known.add(w, s, n, np.asarray(curve, dtype=float)))
            yield events.assign(pattern_no=np.array(numbers, dtype=np.int64))

    schema = StructType([*features.schema.fields, StructField("pattern_no", LongType())])
    return features.repartition(key).sortWithinPartitions(key, "start_s", "event_no").mapInPandas(joined, schema)


def run(readings: DataFrame, threshold: float = 25.0, least_s: float = 8.0, gap_s: float = 6.0, key: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """(features with their pattern, evaluated patterns)."""
    events = cycles.merge_gaps(cycles.offline_events(readings, threshold, least_s), gap_s)
    features = event_features(events, readings)
    named = cluster(features, key)
    w = Window.partitionBy(key, "pattern_no").orderBy("start_s", "event_no")
    gaps = named.withColumn("gap", F.col("start_s") - F.lag("start_s").over(w))
    patterns = gaps.groupBy(key, "pattern_no").agg(
        F.count("*").alias("seen"), F.avg("avg_w").alias("avg_w"), F.avg("peak_w").alias("peak_w"), F.avg("duration_s").alias("duration_s"), F.avg("energy_wh").alias("energy_wh"), F.sqrt(F.avg("variance")).alias("std_w"),
        F.round(F.avg("plateaus")).cast("long").alias("plateaus"), F.round(F.avg("jumps")).cast("long").alias("jumps"), F.avg("peak_to_avg").alias("peak_to_avg"), F.coalesce(86400.0 / F.median(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(0.0)).alias("per_day"), F.lit(0.42).alias("confidence"),
    )
    return named, classify.pattern_quality(patterns)
