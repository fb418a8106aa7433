"""A random forest over the 13 features of a cycle, trained on stored patterns or labelled cycles."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("avg_w", "peak_w", "duration_s", "energy_wh", "variance", "duty", "peak_to_avg", "rise_rate", "fall_rate", "active_phases", "heating", "motor", "n_substates")


def train(rows: DataFrame, label: str = "label", trees: int = 80, depth: int = 10, least: int = 8):
    """A fitted pipeline, or None where there are fewer than `least` rows or two labels."""
    told = rows.agg(F.count("*").alias("n"), F.approx_count_distinct(label).alias("k")).first()
    if told.n < least or told.k < 2:
        return None
    steps = [StringIndexer(inputCol=label, outputCol="__y", handleInvalid="skip"), VectorAssembler(inputCols=list(FEATURES), outputCol="__x", handleInvalid="skip"), RandomForestClassifier(labelCol="__y", featuresCol="__x", probabilityCol="__p", predictionCol="__c", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=42)]
    return Pipeline(stages=steps).fit(rows)


def predict(model, rows: DataFrame, top: int = 3, least: float = 0.0) -> DataFrame:
    """rows with `predicted` (null below `least`), `probability` and the `top` classes as array<struct<p, label>>."""
    names = F.array(*(F.lit(x) for x in model.stages[0].labels))
    ranked = F.slice(F.reverse(F.array_sort(F.zip_with(vector_to_array("__p"), names, lambda p, n: F.struct(p.alias("p"), n.alias("label"))))), 1, top)
    out = model.transform(rows.withColumn("label", F.coalesce("label", F.lit("")))).withColumn("top", ranked)
    best = F.element_at("top", 1)
    return out.withColumn("probability", best["p"]).withColumn("predicted", F.when(best["p"] >= least, best["label"])).drop("__x", "__y", "__p", "__c", "rawPrediction")
