"""Profile points of any form, read from JSON text as variants: numbers, texts and objects in one array, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattline.functions import scalars as S
from wattline.functions.curves import once

# Names under which a point may hold its power, the first present one counts.
POWER_NAMES = ("power_w", "power", "value", "w", "watts", "p")
#: Points of a profile that are kept.
MOST = 128
POINT = "struct<t_s:double,power_w:double,t_norm:double>"


def elements(text: Column) -> Column:
    """The elements of a JSON array as variants; an empty array for any other text."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), F.array().cast("array<variant>"))


def _scalar(x: Column) -> Column:
    return ~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY|VOID)")


def _fields(x: Column) -> Column:
    """The fields of an object; null for anything else."""
    return F.try_variant_get(x, "$", "map<string,variant>")


def _number(x: Column) -> Column:
    return S.safe_float(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))


def point_values(text: Column, names: tuple[str, ...] = POWER_NAMES) -> Column:
    """The powers of a list of numbers, texts and objects, none below 0. What isn't a number counts as 0; objects without any of the
    names, lists and nulls are left out."""

    def one(x: Column) -> Column:
        def of(m: Column) -> Column:
            key = F.try_element_at(F.filter(F.array(*map(F.lit, names)), lambda k: F.map_contains_key(m, k)), F.lit(1))
            return F.when(key.isNotNull(), F.greatest(_number(F.try_element_at(m, key)), F.lit(0.0)))

        return F.when(_scalar(x), F.greatest(_number(x), F.lit(0.0))).otherwise(once(_fields(x), of))

    return F.filter(F.transform(elements(text), one), lambda v: v.isNotNull())


def overlap_signal(text: Column) -> Column:
    """The powers of numbers and of objects with power_w, none below 0."""
    return point_values(text, ("power_w",))


def profile_points(text: Column, most: int = MOST) -> Column:
    """array<POINT> of the objects of a JSON array: time, power and place in [0, 1], 0 where one is missing. An object with a value that
    isn't a number is left out; the first `most` stay."""

    def one(x: Column) -> Column:
        def of(m: Column) -> Column:
            value = lambda k: F.when(F.map_contains_key(m, F.lit(k)), F.try_variant_get(F.try_element_at(m, F.lit(k)), "$", "double")).otherwise(0.0)
            t, p, place = value("t_s"), value("power_w"), value("t_norm")
            point = F.struct(F.round(F.greatest(t, F.lit(0.0)), 3).alias("t_s"), F.round(p, 3).alias("power_w"), F.round(S.clamp(place), 6).alias("t_norm"))
            return F.when(m.isNotNull() & t.isNotNull() & p.isNotNull() & place.isNotNull(), point)

        return once(_fields(x), of)

    return F.slice(F.filter(F.transform(elements(text), one), lambda p: p.isNotNull()), 1, most)


def timed_points(points: Column, duration: Column) -> Column:
    """Points with their place taken from their times and a duration; evenly spread where the times don't differ."""

    def spread(a: Column) -> Column:
        n = F.size(a)
        spans = (n >= 2) & (F.abs(F.try_element_at(a, F.lit(-1))["t_s"] - F.try_element_at(a, F.lit(1))["t_s"]) > 1e-6)
        whole = F.greatest(duration, F.lit(1.0))

        def one(p: Column, i: Column) -> Column:
            even = i / F.greatest(n - 1, F.lit(1))
            place, t = F.when(spans, S.clamp(p["t_s"] / whole)).otherwise(even), F.when(spans, p["t_s"]).otherwise(even * whole)
            return F.struct(F.round(t, 3).alias("t_s"), p["power_w"].alias("power_w"), F.round(place, 6).alias("t_norm"))

        return F.transform(a, one)

    return once(points, spread)
