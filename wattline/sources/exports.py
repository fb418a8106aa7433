"""Exports: pattern packs, JSON lines and CSV files, written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions import scalars as S


def pattern_pack(patterns: DataFrame) -> DataFrame:
    """Patterns without anything private: public labels, rounded numbers, a hashed name, no times."""
    out = patterns.select(S.public_label(F.col("label")).alias("label"), *(F.round(c).cast("long").alias(c) for c in ("avg_w", "peak_w", "duration_s")), "seen")
    return out.withColumn("shared_id", S.shared_id("label", *(F.col(c).cast("string") for c in ("avg_w", "peak_w", "duration_s"))))


def json_lines(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns)).alias("line"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Flat CSV; arrays become their values joined by bars."""
    flat = [F.array_join(F.col(f.name).cast("array<string>"), "|").alias(f.name) if f.dataType.typeName() == "array" else F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "map") else F.col(f.name) for f in rows.schema]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def append_readings(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to a table partitioned by day, which later scans and retention prune by."""
    rows.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def import_readings(rows: DataFrame, existing: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """What isn't there yet."""
    return rows.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")


def export_all(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as JSON lines in a folder of its name, written by the executors."""
    for name, rows in tables.items():
        write_json_lines(rows, f"{path}/{name}")


def import_all(spark: SparkSession, path: str, known: dict[str, DataFrame], keys: dict[str, tuple[str, ...]]) -> dict[str, DataFrame]:
    """The known tables with the exported rows in place of those of the same key; the known schemas are the ones read."""
    from wattline.operators.maintenance import upserted

    return {name: upserted(rows, spark.read.schema(rows.schema).json(f"{path}/{name}").dropDuplicates(list(keys[name])), keys[name]) for name, rows in known.items()}


def review_bundle(patterns: DataFrame, events: DataFrame, logs: DataFrame, limits: tuple[int, int], readings: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a reviewer is sent: the patterns seen most and the newest events and logs up to the given limits, readings on demand.

    Limits are the bundle's own. patterns: as for `pattern_pack`; events and logs have start_s."""
    most, newest = limits
    ordered = patterns.orderBy(F.desc("seen"), *(c for c in ("phase", "label") if c in patterns.columns)).limit(most)
    out = {"patterns": pattern_pack(ordered), "events": events.orderBy(F.desc("start_s"), *events.columns).limit(newest), "logs": logs.orderBy(F.desc("start_s"), *logs.columns).limit(newest)}
    return out if readings is None else out | {"readings": readings}
