"""Versioned tables for PySpark: plain Parquet files under an atomic commit log.

`Lake` is the entry point. Metadata lives on the driver as one immutable state per version; every read is one native Spark
plan over Parquet files.
"""

from .lake import Lake
from .operators.dml import When
from .session import Session
from .state import ConflictError, LakeError

__all__ = ["ConflictError", "Lake", "LakeError", "Session", "When"]
