"""UUIDs, which Spark has as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_uuid(text: Column) -> Column:
    """Text of 32 hexadecimal digits, with hyphens and braces anywhere or none, as a UUID in its usual form; null for other
    text."""
    digits = F.lower(F.regexp_replace(text, "[-{}]", ""))
    parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(digits.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))
