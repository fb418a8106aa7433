"""Changes to patterns and readings, as new tables: overlays, deletions, retention and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions import scalars as S
from wattline.operators.fusion import COMPARED
from wattline.operators.profiles import pattern_distance
from wattline.sources.steps import written


def with_user_labels(patterns: DataFrame, labels: DataFrame, key: tuple[str, ...], into: str = "user_label") -> DataFrame:
    """Patterns with the label that a user gave them, null for the others."""
    return patterns.join(labels.select(*key, into), list(key), "left")


def without_rows(rows: DataFrame, gone: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return rows.join(gone.select(*key), list(key), "left_anti")


def upserted(rows: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows with those of `new` in place of the ones of the same key."""
    return without_rows(rows, new, key).unionByName(new)


def retained(rows: DataFrame, days: float, ts: str = "ts") -> DataFrame:
    from wattline.sources.readings import since

    return since(rows, days * 86400.0, ts)


def repaired_bounds(rows: DataFrame, first: str, last: str) -> DataFrame:
    low, high = S.ordered_bounds(F.col(first), F.col(last))
    return rows.withColumns({first: low, last: high})


def merged_patterns(patterns: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Patterns joined by a table (key, into): sums of sightings and means weighted by them."""
    named = patterns.join(groups, key, "left").withColumn("into", F.coalesce("into", F.col(key)))
    weighted = lambda c: (F.sum(F.col(c) * F.col("seen")) / F.sum("seen")).alias(c)
    return named.groupBy("into").agg(F.sum("seen").alias("seen"), weighted("avg_w"), weighted("duration_s"), weighted("energy_wh"), F.max("peak_w").alias("peak_w"), F.max_by("label", "seen").alias("label"))


def close_pairs(patterns: DataFrame, key: str = "site", ids: str = "number", most: float = 0.20) -> DataFrame:
    """(key, a, b, distance): pairs a < b of one key's patterns within a distance (R18). A key has a bounded number of patterns."""
    fields = (*COMPARED, ids)
    one, other = (patterns.select(key, F.struct(*fields).alias(n)) for n in ("x", "y"))
    side = lambda n: {c: F.col(f"{n}.{c}") for c in COMPARED} | {"phases": F.lit(1.0), "peak_at": F.lit(None).cast("double")}
    both = one.join(other, key).where(F.col(f"x.{ids}") < F.col(f"y.{ids}"))
    return both.select(key, F.col(f"x.{ids}").alias("a"), F.col(f"y.{ids}").alias("b"), pattern_distance(side("x"), side("y")).alias("distance")).where(F.col("distance") <= most)


def matching(pairs: DataFrame, key: str = "site") -> DataFrame:
    """(key, a, b): the pairs that a greedy pass by distance, then a and b, would choose, none sharing an end with another.

    A pair that is the first of both its ends is chosen by the greedy pass whatever comes before it, so each round takes all of those
    at once and drops what touches them; rounds go on until no pair is left. Half of all pairs go in a round on average."""
    chosen, left = [], written(pairs, "pairs")
    while not left.isEmpty():
        order = F.struct("distance", "a", "b")
        ends = left.select(key, F.explode(F.array("a", "b")).alias("end"), order.alias("p")).groupBy(key, "end").agg(F.min("p").alias("p"))
        firsts = written(ends.groupBy(key, "p").agg(F.count("*").alias("n")).where("n = 2").select(key, "p.a", "p.b"), "firsts")
        chosen.append(firsts)
        gone = firsts.select(key, F.explode(F.array("a", "b")).alias("end"))
        for c in ("a", "b"):
            left = left.join(gone.withColumnRenamed("end", c), [key, c], "left_anti")
        left = written(left.select(key, "a", "b", "distance"), "pairs")
    out = pairs.select(key, "a", "b").where("false")
    for firsts in chosen:
        out = out.unionByName(firsts)
    return out


def nightly_merge(patterns: DataFrame, key: str = "site", ids: str = "number", most: float = 0.20) -> DataFrame:
    """Active patterns after one nightly pass: of each matched pair the first takes in the second, with summed sightings, means
    weighted by them, the first label that says something and the outer bounds. `merged` counts what a pattern took in.

    patterns: key, ids, status, name, seen, first_s, last_s, avg_w, peak_w, duration_s, energy_wh, quality and COMPARED."""
    active = patterns.where("status = 'active'")
    pairs = matching(close_pairs(active, key, ids, most), key)
    into = pairs.select(key, F.col("b").alias(ids), F.col("a").alias("__into"))
    named = active.join(into, [key, ids], "left").withColumn("__into", F.coalesce("__into", ids))
    weighted = lambda c: (F.sum(F.col(c) * F.col("seen")) / F.greatest(F.sum("seen"), F.lit(1))).alias(c)
    says = F.min_by("name", F.struct(F.coalesce(F.col("name").isin("", "unknown"), F.lit(True)), F.col(ids)))
    out = named.groupBy(key, F.col("__into").alias(ids)).agg(
        F.sum("seen").alias("seen"), *(weighted(c) for c in ("avg_w", "peak_w", "duration_s", "energy_wh", "quality")), F.coalesce(says, F.lit("unknown")).alias("name"),
        F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"), (F.count("*") - 1).alias("merged"),
    )
    return out
