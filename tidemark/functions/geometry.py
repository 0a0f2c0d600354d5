"""Bounding boxes and types of geometries in WKT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def wkt_type(wkt: Column) -> Column:
    """Lower-case type name with its dimensions, such as `point z`; null for what is no geometry."""
    name = F.lower(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))
    dims = F.lower(F.regexp_extract(wkt, r"^\s*[A-Za-z]+\s+(ZM|Z|M|zm|z|m)\b", 1))
    return F.when(name != "", F.trim(F.concat_ws(" ", name, dims)))


def wkt_points(wkt: Column) -> Column:
    """Array of points, each an array of its coordinates as doubles."""
    texts = F.split(F.regexp_replace(F.regexp_replace(wkt, r"^\s*[A-Za-z ]+", ""), r"[()]", " "), ",")
    points = F.transform(texts, lambda p: F.regexp_extract_all(p, F.lit(f"({NUMBER})"), F.lit(1)).cast("array<double>"))
    return F.filter(points, lambda p: F.size(p) >= 2)


def wkt_bounds(wkt: Column) -> dict[str, Column]:
    """xmin, xmax, ymin, ymax, zmin, zmax, mmin and mmax of one geometry; null for a dimension that it lacks."""
    points, kind = wkt_points(wkt), wkt_type(wkt)
    third = F.transform(points, lambda p: F.try_element_at(p, F.lit(3)))
    fourth = F.transform(points, lambda p: F.try_element_at(p, F.lit(4)))
    only_m = kind.rlike(r" m$")
    axes = {
        "x": F.transform(points, lambda p: F.element_at(p, 1)),
        "y": F.transform(points, lambda p: F.element_at(p, 2)),
        "z": F.when(only_m, F.lit(None)).otherwise(third),
        "m": F.when(only_m, third).otherwise(fourth),
    }
    return {f"{a}{end}": (F.array_min if end == "min" else F.array_max)(v) for a, v in axes.items() for end in ("min", "max")}


def geometry_stats(wkt: Column) -> list[Column]:
    """Aggregates over a group: its box (null where no geometry has the axis) and the sorted set of types."""
    bounds = wkt_bounds(wkt)
    boxes = [(F.min if name.endswith("min") else F.max)(c).alias(name) for name, c in bounds.items()]
    return [*boxes, F.array_sort(F.collect_set(wkt_type(wkt))).alias("types")]
