"""Joins: best matches, context intervals, duplicates, overlays.

Matches share an equality key (phase, label, a time bucket), so no join is a nested loop; a hot key is left to adaptive
skew handling, and best matches are aggregated with max_by before anything is shuffled again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions import scalars as S


def cycle_distance(a: str, b: str) -> Column:
    """Distance of two cycles by power, peak, duration and energy, at most 1."""
    parts = ((0.40, "avg_w"), (0.25, "peak_w"), (0.25, "duration_s"), (0.10, "energy_wh"))
    return F.least(F.lit(1.0), sum((w * S.rel(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for w, c in parts), F.lit(0.0)))


def best_pattern(cycles: DataFrame, patterns: DataFrame, key: str = "phase", cycle_id: tuple[str, ...] = ("user_id", "cycle")) -> DataFrame:
    """The nearest pattern of each cycle's phase. Patterns are summed from cycles, so a phase has as many as it has labels."""
    joined = cycles.alias("c").join(patterns.alias("p"), F.col(f"c.{key}") == F.col(f"p.{key}"))
    scored = joined.select(*(F.col(f"c.{k}").alias(k) for k in cycle_id), F.col("p.label").alias("label"), (1 - cycle_distance("c", "p")).alias("similarity"))
    best = F.max(F.struct("similarity", "label")).alias("m")
    return scored.groupBy(*cycle_id).agg(best).select(*cycle_id, F.col("m.label").alias("matched_label"), F.col("m.similarity").alias("similarity"))


def dedup_action(similarity: Column, update: float = 0.94, merge: float = 0.88) -> Column:
    return F.when(similarity >= update, "update_existing").when(similarity >= merge, "merge_mode").otherwise("create_new")


def weighted_vote(cycles: DataFrame, patterns: DataFrame, cycle_id: tuple[str, ...] = ("user_id", "cycle"), least: float = 0.60) -> DataFrame:
    """Groups of patterns vote for a cycle's label: nearness, sightings, quality, duration and hour weigh in."""
    joined = cycles.alias("c").join(patterns.alias("p"), F.col("c.phase") == F.col("p.phase"))
    d = cycle_distance("c", "p")
    weight = (0.72 * F.exp(-4 * d) + 0.28 * (1 - d)) * (1 + F.log(1 + F.greatest(F.col("p.seen"), F.lit(1)))) * F.greatest(F.lit(0.75), 1 - 0.25 * F.least(S.rel(F.col("c.duration_s"), F.col("p.duration_s")), F.lit(1.0)))
    votes = joined.select(*(F.col(f"c.{k}").alias(k) for k in cycle_id), F.col("p.label").alias("label"), weight.alias("vote"), F.col("p.seen").alias("seen"))
    groups = votes.groupBy(*cycle_id, "label").agg(F.sum("vote").alias("vote"), F.max("seen").alias("seen"))
    out = groups.groupBy(*cycle_id).agg(F.max(F.struct("vote", "label", "seen")).alias("b"), F.sum("vote").alias("total"))
    proto = F.col("b.vote") / F.col("total")
    confidence = S.clamp(0.62 * proto + 0.15 * F.least(F.lit(1.0), F.log(1 + F.col("b.seen")) / 3) + 0.23 * proto)
    return out.select(*cycle_id, F.when(confidence < least, "unknown").otherwise(F.col("b.label")).alias("label"), confidence.alias("confidence"))


def interval_context(intervals: DataFrame, readings: DataFrame, key: str, before_s: float, after_s: float, ts_s: Column, bucket_s: float) -> DataFrame:
    """Readings within [start - before, end + after] of each interval, as an equality join on time buckets and a filter.

    An interval reaches only the buckets that it touches, so rows made follow its length and not the table's."""
    low, high = F.col("start_s") - before_s, F.col("end_s") + after_s
    left = intervals.withColumn("__b", F.explode(F.sequence(F.floor(low / bucket_s), F.floor(high / bucket_s)))).withColumns({"__low": low, "__high": high})
    right = readings.withColumn("__t", ts_s).withColumn("__b", F.floor(F.col("__t") / bucket_s))
    out = left.join(right, [key, "__b"]).where(F.col("__t").between(F.col("__low"), F.col("__high")))
    return out.drop("__b", "__low", "__high").withColumnRenamed("__t", "t")


def similar_pairs(patterns: DataFrame, key: str, ids: str, most: float) -> DataFrame:
    """Pairs of patterns of one key within a distance. Powers are bucketed so that only neighbours meet: two patterns within
    `most` differ by a bounded ratio of average power, so a pair lies in equal or adjacent buckets of its logarithm."""
    reach = F.log(F.lit(1.0 / max(1e-9, 1 - min(0.999, most / 0.40))))
    bucket = F.floor(F.log(F.greatest(F.col("avg_w"), F.lit(1.0))) / reach)
    a = patterns.withColumn("__b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    b = patterns.withColumn("__b", bucket)
    joined = a.alias("a").join(b.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.__b") == F.col("b.__b")) & (F.col(f"a.{ids}") < F.col(f"b.{ids}")))
    d = cycle_distance("a", "b")
    return joined.where(d <= most).select(F.col(f"a.{key}").alias(key), F.col(f"a.{ids}").alias("id_a"), F.col(f"b.{ids}").alias("id_b"), d.alias("distance"))


def latest_per_key(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    newest = F.max(F.struct(*order, *keep)).alias("m")
    return rows.groupBy(*key).agg(newest).select(*key, *(F.col(f"m.{k}").alias(k) for k in (*order, *keep)))


def session_duplicates(cycles: DataFrame, key: tuple[str, ...], tie: tuple[str, ...], gap_s: float = 120.0) -> DataFrame:
    """Cycles that overlap an earlier one of their key or begin within gap_s after its end."""
    w = Window.partitionBy(*key).orderBy("start_s", *tie).rowsBetween(Window.unboundedPreceding, -1)
    return cycles.withColumn("duplicate", F.coalesce(F.col("start_s") <= F.max("end_s").over(w) + gap_s, F.lit(False)))


def with_lock(rows: DataFrame, locks: DataFrame, label: str = "label", phase: str = "phase") -> DataFrame:
    """Rows without those whose label is locked to another phase."""
    locked = locks.select(S.normalize_label(F.col("label")).alias("__l"), F.col("phase").alias("__p"))
    out = rows.join(locked, S.normalize_label(F.col(label)) == F.col("__l"), "left")
    return out.where(F.col("__p").isNull() | (F.col("__p") == F.col(phase))).drop("__l", "__p")


def allocate(patterns: DataFrame, observed: DataFrame, bucket: str, least: float = 0.33) -> DataFrame:
    """Greedy split of each bucket's load among its patterns: in order of score the expected power is taken off what is left."""
    closeness = F.greatest(F.lit(0.0), 1 - F.abs(F.col("observed_w") - F.col("avg_w")) / F.greatest(F.col("avg_w"), F.lit(1.0)))
    upper = F.greatest(F.lit(80.0), 1.9 * F.col("avg_w"), 1.35 * F.col("peak_w"))
    near = F.when(F.col("observed_w") < F.greatest(F.lit(25.0), 0.45 * F.col("avg_w")), 0.0).otherwise(closeness * F.when(F.col("observed_w") > upper, 1 - F.least((F.col("observed_w") - upper) / upper, F.lit(1.0))).otherwise(1.0))
    scored = patterns.join(observed, bucket).withColumn("score", F.col("confidence") * near).where(F.col("score") >= least)
    item = F.struct((-F.col("score")).alias("s"), (-F.col("seen")).alias("n"), (-F.col("avg_w")).alias("w"), "label", "avg_w")
    rows = scored.groupBy(bucket).agg(F.array_sort(F.collect_list(item)).alias("x"), F.max("observed_w").alias("left"))
    none = "array<struct<label:string,taken_w:double>>"

    def step(a: Column, p: Column) -> Column:
        fits = a["left"] + F.greatest(F.lit(25.0), 0.35 * p["avg_w"]) >= p["avg_w"]
        taken = F.least(a["left"], p["avg_w"])
        return F.struct(F.when(fits, a["left"] - taken).otherwise(a["left"]).alias("left"), F.when(fits, F.concat(a["rows"], F.array(F.struct(p["label"].alias("label"), taken.alias("taken_w"))))).otherwise(a["rows"]).alias("rows"))

    folded = F.aggregate("x", F.struct(F.col("left").cast("double").alias("left"), F.array().cast(none).alias("rows")), step, lambda a: a["rows"])
    return rows.select(bucket, F.inline(folded))
