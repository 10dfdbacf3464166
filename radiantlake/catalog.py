"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import file_queries  # noqa: F401  registers its queries
from .plans.queries import ORACLE_SQL, QUERIES, rotation_codec_error

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rotation codec over all embeddings: mean reconstruction error by label."""
    return rotation_codec_error(spark, sf_dir)
