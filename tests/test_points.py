from pyspark.sql import functions as F

from wattline.functions.points import overlap_signal, point_values, profile_points, timed_points


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("x")).first().x


def test_values_of_mixed_points(spark):
    text = '[1, 2.5, "3,5", "x", -4, null, [7], {"power": 6, "p": 9}, {"watts": "8.5 "}, {"other": 1}, {"power_w": null, "p": 2}, {"value": -3}]'
    assert one(spark, text, point_values) == [1.0, 2.5, 3.5, 0.0, 0.0, 6.0, 8.5, 0.0, 0.0]
    assert one(spark, '[1, {"power_w": 2}, {"p": 3}, {"power_w": -1}]', overlap_signal) == [1.0, 2.0, 0.0]
    for nothing in (None, "", "no json", "{}", "5", "[]"):
        assert one(spark, nothing, point_values) == [] == one(spark, nothing, profile_points)


def test_profile_points(spark):
    text = '[{"t_s": 1.23456, "power_w": -5.5555, "t_norm": 2}, 7, {"power_w": "x"}, {"t_s": -3}, {"power_w": "4.5", "t_norm": "0.25"}]'
    assert [tuple(p) for p in one(spark, text, profile_points)] == [(1.235, -5.556, 1.0), (0.0, 0.0, 0.0), (0.0, 4.5, 0.25)]
    assert len(one(spark, "[" + ",".join('{"power_w": 1}' for _ in range(200)) + "]", profile_points)) == 128


def test_times_of_points(spark):
    timed = lambda d: lambda text: timed_points(profile_points(text), F.lit(d))
    text = '[{"t_s": 0, "power_w": 1}, {"t_s": 5, "power_w": 2}, {"t_s": 20, "power_w": 3}]'
    assert [tuple(p) for p in one(spark, text, timed(10.0))] == [(0.0, 1.0, 0.0), (5.0, 2.0, 0.5), (20.0, 3.0, 1.0)]
    assert [tuple(p) for p in one(spark, '[{"power_w": 1}, {"power_w": 2}, {"power_w": 3}]', timed(8.0))] == [(0.0, 1.0, 0.0), (4.0, 2.0, 0.5), (8.0, 3.0, 1.0)]
    assert one(spark, "[]", timed(8.0)) == []
