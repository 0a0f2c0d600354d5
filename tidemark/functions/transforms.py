"""Partition transforms. A value travels as text with a mark before it, so that null and empty differ in a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL, VALUE = "n", "v"
TRANSFORMS = ("identity", "year", "month", "day", "hour", "bucket")


def transform(column: Column, name: str, argument: int | None = None) -> Column:
    """The partition value of a column: itself, a calendar part, or its bucket of `argument`."""
    if name == "identity":
        return column
    if name == "bucket":
        return F.when(column.isNotNull(), F.pmod(F.xxhash64(column), F.lit(argument)))
    part = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}[name]
    return part(column)


def marked(value: Column) -> Column:
    return F.when(value.isNull(), F.lit(NULL)).otherwise(F.concat(F.lit(VALUE), value.cast("string")))


def unmarked(text: str) -> str | None:
    return None if text == NULL else text[1:]
