"""The offline pipeline's clusters: series after series in a partition, each as if it were alone."""

import random

import numpy as np
from pyspark.sql import functions as F

from wattline.plans.offline import Clusters, cluster


def test_series_are_clustered_alone_and_in_order(spark):
    rnd = random.Random(3)
    rows = []
    for user in (*range(40), None):
        for k in rnd.sample(range(30), rnd.randrange(1, 30)):
            level = rnd.choice([60.0, 300.0, 2000.0])
            rows.append((user, k, float(k // 2), level * rnd.uniform(0.9, 1.1), rnd.choice([20.0, 600.0]), rnd.randrange(1, 4), [level * rnd.uniform(0.8, 1.2) for _ in range(32)]))
    df = spark.createDataFrame(rows, "user_id long, event_no long, start_s double, avg_w double, duration_s double, plateaus int, profile array<double>")
    named = cluster(df.repartition(5, F.rand(1)))
    assert "FlatMapGroupsInPandas" not in named._jdf.queryExecution().optimizedPlan().toString()  # a Python call a series costs more than its events
    want = {}
    for user in {r[0] for r in rows}:
        known = Clusters(0.85, 0.22)
        for r in sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1])):
            want[user, r[1]] = known.add(r[3], r[4], r[5], np.array(r[6]))
    assert {(r.user_id, r.event_no): r.pattern_no for r in named.collect()} == want
    assert len(set(want.values())) > 2 and len(want) == len(rows)
