"""Where queries keep lakes of their own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from .lake import Lake


def new_lake(spark: SparkSession) -> Lake:
    """An empty lake in the shared folder that the session names in spark.checkpoint.dir, or, where it names none, as in
    tests, in a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return Lake(spark, f"{shared or tempfile.mkdtemp(prefix='lakes-')}/lake-{uuid.uuid4().hex}")
