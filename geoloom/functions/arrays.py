"""Geometry on arrays of points (struct x, y), as Columns that stay inside the JVM."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.schema import AREA_KEYS, AREA_VALUES, LINE_VALUES, PLACES


def point(x: Column, y: Column) -> Column:
    """A point at the precision of the model."""
    return F.struct(F.round(x, PLACES).alias("x"), F.round(y, PLACES).alias("y"))


def without_repeats(points: Column) -> Column:
    """Without points that equal the one before."""
    return F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))


def n_points(points: Column) -> Column:
    return F.size(points)


def first_point(points: Column) -> Column:
    return F.get(points, F.lit(0))


def last_point(points: Column) -> Column:
    return F.get(points, F.size(points) - 1)


def is_closed(points: Column) -> Column:
    return F.coalesce(first_point(points) == last_point(points), F.lit(False))


def is_ring(points: Column) -> Column:
    """Closed, with four points at least once repeats are gone."""
    return is_closed(points) & (F.size(without_repeats(points)) >= 4)


def signed_area(points: Column) -> Column:
    """Shoelace area of a ring: positive if it runs counter-clockwise."""
    terms = F.transform(F.sequence(F.lit(0), F.size(points) - 2), lambda i: F.get(points, i)["x"] * F.get(points, i + 1)["y"] - F.get(points, i + 1)["x"] * F.get(points, i)["y"])
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2)


def haversine_length(points: Column, radius: float = 6371008.8) -> Column:
    """Length in metres on a sphere."""

    def leg(i: Column) -> Column:
        a, b = F.get(points, i), F.get(points, i + 1)
        h = F.pow(F.sin(F.radians(b["y"] - a["y"]) / 2), 2) + F.cos(F.radians(a["y"])) * F.cos(F.radians(b["y"])) * F.pow(F.sin(F.radians(b["x"] - a["x"]) / 2), 2)
        return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))

    legs = F.transform(F.sequence(F.lit(0), F.size(points) - 2), leg)
    return F.when(F.size(points) < 2, F.lit(0.0)).otherwise(F.aggregate(legs, F.lit(0.0), lambda s, d: s + d))


def _number(value: Column) -> Column:
    """Shortest decimal text, without an exponent and without trailing zeros."""
    text = F.format_string(f"%.{PLACES}f", value)
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def _listed(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat(_number(p["x"]), F.lit(" "), _number(p["y"]))), ", ")


def line_wkt(points: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), _listed(points), F.lit(")"))


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside or on the border of (x_min, y_min, x_max, y_max)."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def in_rings(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Inside or on the border of a region given by all its rings, by the even-odd rule.

    One literal array of edges; meant for regions of up to some hundred edges.
    """
    edges = [(*a, *b) for ring in rings for a, b in zip(ring[:-1], ring[1:])]
    literal = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e)]) for e in edges])

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return F.when(spans & (x < at), 1).otherwise(0)

    def touches(e: Column) -> Column:
        level = (e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])
        return level & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    odd = F.aggregate(literal, F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1
    return F.coalesce(odd | F.exists(literal, touches), F.lit(False))


def area_tags(tags: Column, keys=AREA_KEYS, values=AREA_VALUES, lines=LINE_VALUES) -> Column:
    """Whether the raw tags of a closed way say that it is an area."""
    of = lambda k: F.try_element_at(tags, F.lit(k))
    tests = [of("area") == "yes"]
    tests += [F.arrays_overlap(F.map_keys(tags), F.array(*map(F.lit, keys)))] if keys else []
    tests += [of(k).isin(list(v)) for k, v in values.items()]
    tests += [of(k).isNotNull() & ~of(k).isin(list(v)) for k, v in lines.items()]
    any_ = functools.reduce(operator.or_, (F.coalesce(t, F.lit(False)) for t in tests))
    return tags.isNotNull() & ~F.coalesce(of("area") == "no", F.lit(False)) & any_
