"""Learning from cycles in batches: matching, updating and creating patterns, promotion, nightly merges, operating modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions import scalars as S
from wattline.operators.matching import best_pattern, dedup_action, similar_pairs

MEANS = ("avg_w", "duration_s", "energy_wh", "variance", "duty")


def learn(patterns: DataFrame, cycles: DataFrame, cycle_id: tuple[str, ...] = ("user_id", "cycle"), update: float = 0.94, merge: float = 0.88) -> DataFrame:
    """Patterns after a batch of cycles. A cycle joins its nearest pattern of the phase from `merge` on, else the cycles of one
    phase and label begin a pattern; means are weighted by sightings, so the order within the batch doesn't matter."""
    best = best_pattern(cycles, patterns, cycle_id=cycle_id)
    named = cycles.join(best, list(cycle_id), "left").withColumn("action", F.coalesce(dedup_action(F.col("similarity"), update, merge), F.lit("create_new")))
    named = named.withColumn("label", F.when(F.col("action") == "create_new", F.col("label")).otherwise(F.col("matched_label")))
    new = named.groupBy("phase", "label").agg(F.count("*").alias("seen"), *(F.avg(c).alias(c) for c in MEANS), F.max("peak_w").alias("peak_w"), F.min("start_s").alias("first_s"), F.max("end_s").alias("last_s"))
    both = patterns.select("phase", "label", "seen", *MEANS, "peak_w", "first_s", "last_s").unionByName(new)
    weighted = [(F.sum(F.col(c) * F.col("seen")) / F.sum("seen")).alias(c) for c in MEANS]
    return both.groupBy("phase", "label").agg(F.sum("seen").alias("seen"), *weighted, F.max("peak_w").alias("peak_w"), F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"))


def promoted(provisional: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(patterns seen often enough, the others)."""
    return provisional.where(F.col("seen") >= least), provisional.where(F.col("seen") < least)


def merge_plan(patterns: DataFrame, key: str, ids: str, most: float = 0.20) -> DataFrame:
    """(id, into): pairs that are each other's nearest within the distance; no pattern is in two of them, so one pass of
    mutual choices replaces a greedy loop over all pairs and can be repeated until nothing is left to merge."""
    pairs = similar_pairs(patterns, key, ids, most)
    both = pairs.select(key, "id_a", "id_b", "distance").unionByName(pairs.select(key, F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "distance"))
    nearest = both.groupBy(key, "id_a").agg(F.min(F.struct("distance", "id_b")).alias("m")).select(key, "id_a", F.col("m.id_b").alias("id_b"))
    other = nearest.select(key, F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))
    return nearest.join(other, [key, "id_a", "id_b"]).where("id_a > id_b").select(F.col("id_a").alias(ids), F.col("id_b").alias("into"))


MODES = "array<struct<avg_w:double,duration_s:double,peak_w:double,seen:int>>"


def with_mode(modes: Column, m: Column, near: float = 0.30) -> Column:
    """Clusters of modes after mode m: it joins the nearest within `near` (.55 power, .35 duration, .10 peak) or begins one."""

    def distance(c: Column) -> Column:
        return 0.55 * S.rel(c["avg_w"], m["avg_w"]) + 0.35 * S.rel(c["duration_s"], m["duration_s"]) + 0.10 * S.rel(c["peak_w"], m["peak_w"])

    ranked = F.array_min(F.transform(modes, lambda c, k: F.struct(distance(c).alias("d"), k.alias("k"))))
    joined = F.transform(
        modes,
        lambda c, k: F.when(
            k == ranked["k"],
            F.struct(*((((c[n] * c["seen"] + m[n]) / (c["seen"] + 1)).alias(n)) for n in ("avg_w", "duration_s", "peak_w")), (c["seen"] + 1).alias("seen")),
        ).otherwise(c),
    )
    return F.when((F.size(modes) > 0) & (ranked["d"] <= near), joined).otherwise(F.concat(modes, F.array(F.struct(m["avg_w"], m["duration_s"], m["peak_w"], F.lit(1).alias("seen")))))


def joined_mode(modes: Column, m: Column, most: int = 6, near: float = 0.30) -> Column:
    """As with_mode, then the `most` most seen ones, most seen first; the order before settles ties."""
    by_seen = F.array_sort(F.transform(with_mode(modes, m, near), lambda c, k: F.struct((-c["seen"]).alias("order"), k.alias("k"), c.alias("mode"))))
    return F.slice(F.transform(by_seen, lambda x: x["mode"]), 1, most)


def operating_modes(modes: Column, most: int = 6, near: float = 0.30) -> Column:
    """Modes, array<struct<avg_w, duration_s, peak_w>> in order, clustered one after the other; the `most` most seen ones stay."""
    found = F.aggregate(modes, F.array().cast(MODES), lambda a, m: with_mode(a, m, near))
    by_seen = F.array_sort(F.transform(found, lambda c: F.struct((-c["seen"]).alias("order"), c.alias("mode"))))
    return F.slice(F.transform(by_seen, lambda x: x["mode"]), 1, most)


def edge_cycles(df: DataFrame, on: float, off: float, gap_s: float, series) -> DataFrame:
    """Replay fallback: (key, start_s, end_s) from edges over the value at index int(0.2 n) - 1 of the sorted powers. A cycle
    opens at base + on and closes near the base, at a drop of `off`, after a gap while low, or with the series."""
    none = "array<struct<start_s:double,end_s:double>>"
    sample = F.struct(series.seconds().alias("t"), F.col(series.tie).alias("tie"), F.col(series.value).cast("double").alias("p"))
    rows = df.groupBy(*series.key).agg(F.array_sort(F.collect_list(sample)).alias("x"))
    at = F.greatest((F.size("x") * 0.2).cast("int"), F.lit(1))
    rows = rows.withColumn("base", F.element_at(F.array_sort(F.transform("x", lambda v: v["p"])), at))
    start = F.struct(F.lit(False).alias("on"), F.lit(0.0).alias("since"), F.lit(None).cast("double").alias("t"), F.lit(0.0).alias("p"), F.array().cast(none).alias("rows"))

    def step(a: Column, x: Column) -> Column:
        base = F.col("base")
        gap = a["on"] & a["t"].isNotNull() & (x["t"] - a["t"] >= gap_s) & (x["p"] < base + on)
        ends = a["on"] & (gap | (x["p"] <= base + off) | (a["p"] - x["p"] >= off))
        opens = ~a["on"] & (x["p"] >= base + on)
        row = F.struct(a["since"].alias("start_s"), F.when(gap, a["t"]).otherwise(x["t"]).alias("end_s"))
        return F.struct((opens | (a["on"] & ~ends)).alias("on"), F.when(opens, x["t"]).otherwise(a["since"]).alias("since"), x["t"].alias("t"), x["p"].alias("p"), F.when(ends, F.concat(a["rows"], F.array(row))).otherwise(a["rows"]).alias("rows"))

    def finish(a: Column) -> Column:
        return F.when(a["on"], F.concat(a["rows"], F.array(F.struct(a["since"].alias("start_s"), a["t"].alias("end_s"))))).otherwise(a["rows"])

    return rows.select(*series.key, F.inline(F.aggregate("x", start, step, finish)))


def segment_modes(samples: DataFrame, key: tuple[str, ...], series, change: float = 0.15, least_s: float = 0.5) -> DataFrame:
    """Segments of a cycle where its power, over its own range, keeps its direction within `change` a step; each is standby
    (below 15 % of the peak), startup (the first, if it rises by half) or operating."""
    w, whole = Window.partitionBy(*key).orderBy(series.ts, series.tie), Window.partitionBy(*key)
    p = F.col(series.value)
    rows = samples.withColumn("__n", (p - F.min(p).over(whole)) / F.greatest(F.max(p).over(whole) - F.min(p).over(whole), F.lit(1e-9))).withColumn("__peak", F.max(p).over(whole))
    rows = rows.withColumn("__d", F.coalesce(F.col("__n") - F.lag("__n").over(w), F.lit(0.0)))
    rows = rows.withColumn("__new", F.coalesce((F.abs(F.col("__d") - F.lag("__d").over(w)) > change).cast("long"), F.lit(1)))
    rows = rows.withColumn("segment", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*key, "segment").agg(F.min(series.seconds()).alias("start_s"), F.max(series.seconds()).alias("end_s"), F.avg(p).alias("avg_w"), F.max("__n").alias("high"), F.min("__n").alias("low"), F.max("__peak").alias("peak_w"), F.count("*").alias("n"))
    kind = F.when(F.col("avg_w") < 0.15 * F.col("peak_w"), "standby").when((F.col("segment") == 1) & (F.col("high") - F.col("low") >= 0.5), "startup").otherwise("operating")
    return out.where((F.col("end_s") - F.col("start_s") > least_s) | (F.col("n") == 1)).withColumn("kind", kind).drop("high", "low")
