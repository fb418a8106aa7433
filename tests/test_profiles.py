"""Profile operators against plain versions on random curves."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from wattline.operators import profiles as A

SCHEMA = "id long, points array<struct<t:double,tie:long,p:double>>"


def random_profiles(n=60):
    r = random.Random(5)
    out = []
    for k in range(n):
        level, t, points = 50.0, 0.0, []
        for i in range(r.choice((1, 3, 4, 5, 9, 20, 60))):
            if r.random() < 0.25:
                level = r.choice((50.0, 60.0, 400.0, 410.0, 900.0, 1500.0))
            t += r.choice((0.0, 1.0, 2.5, 10.0)) if i else 0.0
            points.append((t, i, level + r.uniform(-4, 4)))
        out.append((k, points))
    return [*out, (900, [(float(i), i, p) for i, p in enumerate([800.0] * 20 + [1200.0] * 20 + [800.0] * 20)]), (901, [(float(i), i, 70.0) for i in range(9)])]


def plain_substates(points):
    if len(points) < 5:
        return [], 0
    watts = [p for _, _, p in points]
    swing, span = max(watts) - min(watts), points[-1][0]
    if swing < 10:
        return [(statistics.fmean(watts), span)], 0
    runs = [[points[0]]]
    for before, now in zip(points, points[1:]):
        if abs(now[2] - before[2]) > max(25, 0.12 * swing):
            runs.append([])
        runs[-1].append(now)
    least = max(2, int(0.03 * len(points)))
    held = [(statistics.fmean(x[2] for x in r), r[-1][0] - r[0][0]) for r in runs if len(r) >= (2 if r is runs[-1] else least)]
    tolerance = max(15, 0.06 * swing)
    blend = lambda a, b: ((a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1])
    merged = []
    for x in (h for h in held if h[1] > 0):
        if merged and abs(x[0] - merged[-1][0]) <= tolerance:
            merged[-1] = blend(merged[-1], x)
        else:
            merged.append(x)
    levels = []
    for x in [m for m in merged if m[1] >= max(2, 0.03 * span)] or merged:
        at = next((i for i, y in enumerate(levels) if abs(x[0] - y[0]) <= tolerance), None)
        if at is None:
            levels.append(x)
        else:
            levels[at] = blend(levels[at], x)
    return levels, len(runs) - 1


def test_substates(spark):
    given = random_profiles()
    got = {r.id: r for r in A.with_substates(spark.createDataFrame(given, SCHEMA)).collect()}
    for k, points in given:
        levels, steps = plain_substates(points)
        assert got[k].steps == steps
        assert sorted((s.level, s.seconds) for s in got[k].substates) == [pytest.approx(x) for x in sorted(levels)]
    assert len(got[900].substates) == 2 and got[900].steps == 2
    assert len(got[901].substates) == 1


def test_delta_of_a_known_cycle(spark):
    watts = [50.0] * 10 + [250.0] + [150.0] * 29 + [50.0] * 10
    df = spark.createDataFrame([(1, [(float(i), i, p) for i, p in enumerate(watts)])], SCHEMA).withColumn("avg_w", F.lit(statistics.fmean(watts)))
    r = A.with_baseline_delta(df).first()
    assert (r.before_w, r.after_w, r.drift_w, r.baseline_quality) == (50, 50, 0, 1)
    assert (r.delta_peak_w, r.inrush_w, r.steady_w, r.settling_s, r.plateaus) == (200, 200, 100, 11, 1)
    assert r.inrush_ratio == 2
    area = sum((max(a - 50, 0) + max(b - 50, 0)) / 2 for a, b in zip(watts, watts[1:]))
    assert r.delta_wh == pytest.approx(area / 3600)


def plain_rel(a, b):
    return abs(a - b) / max(abs(a), abs(b), 1)


def plain_shape(a, b):
    if a is None or b is None:
        return None
    tops = [max(max(abs(x) for x in c), 1e-9) for c in (a, b)]
    return min(1, statistics.fmean(abs(x / tops[0] - y / tops[1]) for x, y in zip(a, b)))


FIELDS = "avg_w peak_w duration_s energy_wh rise_w rise_rate fall_rate duty variance peak_to_avg delta_avg_w settling_s plateaus n_substates phases".split()


@pytest.fixture(scope="module")
def pairs(spark):
    r = random.Random(11)

    def row(k):
        near = [100.0] * len(FIELDS) if k % 3 == 0 else [r.uniform(0, 900) for _ in FIELDS]
        d = dict(zip(FIELDS, (x * r.uniform(0.9, 1.1) for x in near)))
        d.update(duty=r.random(), peak_at=None if k % 7 == 0 else r.random(), heating=r.random() < 0.5, motor=r.random() < 0.5, curve_hash=r.choice(("", "a", "b")))
        d["curve"] = None if k % 5 == 0 else [100 + r.uniform(-3, 3) for _ in range(16)]
        return d

    rows = [(row(k), row(k + 1 if k % 2 else k)) for k in range(60)]
    fields = ", ".join(f"{c}:double" for c in (*FIELDS, "peak_at")) + ", heating:boolean, motor:boolean, curve_hash:string, curve:array<double>"
    df = spark.createDataFrame(rows, f"a struct<{fields}>, b struct<{fields}>")
    names = df.schema["a"].dataType.fieldNames()
    return rows, df, *({c: F.col(f"{x}.{c}") for c in names} for x in "ab")


def test_distance_and_similarity(pairs):
    rows, df, a, b = pairs
    got = df.select(A.pattern_distance(a, b).alias("d"), A.dedup_similarity(a, b).alias("s"), A.one_cluster(a, b).alias("c")).collect()
    for (x, y), g in zip(rows, got, strict=True):
        far = plain_shape(x["curve"], y["curve"])
        parts = dict(avg_w=0.20, peak_w=0.15, duration_s=0.14, rise_w=0.12, energy_wh=0.03, phases=0.02, rise_rate=0.08, fall_rate=0.07, variance=0.05, peak_to_avg=0.04)
        d = sum(w * plain_rel(x[c], y[c]) for c, w in parts.items()) + 0.06 * abs(x["duty"] - y["duty"]) + 0.01 * abs(x["n_substates"] - y["n_substates"])
        d += 0.03 * (x["heating"] != y["heating"]) + 0.02 * (x["motor"] != y["motor"]) + (0.05 if far is None else 0.12 * far)
        d += 0.02 if None in (x["peak_at"], y["peak_at"]) else 0.05 * abs(x["peak_at"] - y["peak_at"])
        assert g.d == pytest.approx(min(1, d))
        like = lambda c: 1 - plain_rel(x[c], y[c])  # noqa: B023, E731
        s = 0.5 * (0 if far is None else 1 - far) + 0.2 * like("duration_s") + 0.2 * like("delta_avg_w") + 0.07 * like("peak_w") + 0.03 * like("settling_s")
        s += 0.1 * (x["curve_hash"] == y["curve_hash"] != "")
        assert g.s == pytest.approx(min(1, s))
        assert g.c == (far is not None and 1 - far >= 0.92 and plain_rel(x["avg_w"], y["avg_w"]) <= 0.25 and plain_rel(x["duration_s"], y["duration_s"]) <= 0.4 and plain_rel(x["plateaus"], y["plateaus"]) <= 0.75)
    assert {g.c for g in got} == {True, False}


def test_public_labels(spark):
    from wattline.functions import scalars as S

    want = {"": "unknown", "Fan small": "fan_small", "Omas Kühlschrank": "fridge", "unknown_motor": "unknown_motor", "unknown_77": "unknown", "dishwasher": "dishwasher", "Washing 2": "washing_machine", "Pumpe links": "pump", "Zimmer 3": "custom_user_label"}
    got = spark.createDataFrame([(k,) for k in want], "label string").select("label", S.public_label(F.col("label")).alias("p")).collect()
    assert {r.label: r.p for r in got} == want
    assert len(set(S.PUBLIC_LABELS)) == 48
