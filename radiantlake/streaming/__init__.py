"""Row-wise operators on streams.

There is no streaming operator of its own here: the reference workload is batch. What
works row by row (codecs, selections, geometry, colours) takes a streaming DataFrame
as it takes a batch one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rotation_codec


def encode_stream(rows: DataFrame, column: str, d: int, bits: int, seed: int = 0) -> DataFrame:
    """A streaming table with norm and codes beside it; no state, no watermark needed."""
    return rows.withColumn("_c", rotation_codec.encode(F.col(column), d, bits, seed)).select(*rows.columns, "_c.norm", "_c.codes")
