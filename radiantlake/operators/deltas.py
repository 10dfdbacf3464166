"""Delta codes along an order, and their inverses.

Every function takes the columns that groups are made by (a scene, or a block of
one): an order is kept within a group, and each group is decoded by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dot


def _wrap16(x: Column) -> Column:
    """x as a signed 16 bit integer."""
    return F.pmod(x + 32768, F.lit(65536)) - 32768


def delta_encode(df: DataFrame, column: str, by: list[str], within: list[str]) -> DataFrame:
    """Array column as differences from the row before, wrapped to 16 bits; the first row stays (wrapped)."""
    before = F.lag(column).over(Window.partitionBy(*within).orderBy(*by))
    rows = df.withColumn("_before", before)
    out = F.when(F.col("_before").isNull(), F.transform(column, _wrap16)).otherwise(F.zip_with(column, "_before", lambda x, y: _wrap16(x - y)))
    return rows.withColumn(column, out).drop("_before")


def delta_decode(df: DataFrame, column: str, width: int, by: list[str], within: list[str]) -> DataFrame:
    """The inverse: running sums modulo 2^16."""
    w = Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.pmod(F.sum(F.get(F.col(column), F.lit(i)).cast("bigint")).over(w), F.lit(65536)) for i in range(width)]
    return df.withColumn(column, F.array(*sums))


def blocks(df: DataFrame, by: list[str], size: int, within: list[str] | None = None) -> DataFrame:
    """df with ordinal and block (ordinal over size), so that an order may be cut into blocks that are coded apart."""
    from .ordering import numbered

    return numbered(df, by, within).withColumn("block", F.floor(F.col("ordinal") / size).cast("bigint"))


def hemisphere_signs(df: DataFrame, by: list[str], within: list[str], column: str = "rotations") -> DataFrame:
    """df with sign: whether a quaternion is negated to lie within a quarter turn of the
    one before it (as negated itself).

    The sign is the parity of negative raw dot products since the last that is
    exactly zero, where it starts again at plus."""
    w = Window.partitionBy(*within).orderBy(*by)
    rows = df.withColumn("_dot", dot(F.col(column), F.lag(column).over(w)))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_dot") == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*within, "_run").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    flips = F.sum(F.when(F.col("_dot") < 0, 1).otherwise(0)).over(run)
    return rows.withColumn("sign", F.when(flips % 2 == 1, -1.0).otherwise(1.0)).drop("_dot", "_run")


def rotation_deltas(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """Quaternions with signs aligned along the order, as differences; the first stays."""
    rows = hemisphere_signs(df, by, within).withColumn("rotations", F.transform("rotations", lambda x: x * F.col("sign")))
    rows = rows.withColumn("_before", F.lag("rotations").over(Window.partitionBy(*within).orderBy(*by)))
    return rows.withColumn("rotations", F.when(F.col("_before").isNull(), F.col("rotations")).otherwise(F.zip_with("rotations", "_before", lambda x, y: x - y))).drop("_before", "sign")


def rotation_sums(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """The inverse: running sums, not renormalised."""
    w = Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("rotations", F.array(*(F.sum(F.get("rotations", F.lit(i))).over(w) for i in range(4))))


def anchored(df: DataFrame, resolution: int, bits: int = 4) -> DataFrame:
    """offsets: a position's place in its voxel (columns gx, gy, gz, box_min, voxel_size) in 2^bits steps."""
    cells = F.array("gx", "gy", "gz")

    def offset(i: int) -> Column:
        low = F.col("box_min")[i] + cells[i] * F.col("voxel_size")
        share = F.least(F.greatest((F.get("xyz", F.lit(i)) - low) / F.col("voxel_size"), F.lit(0.0)), F.lit(1 - 1e-6))
        return F.floor(share * (1 << bits)).cast("int")

    return df.withColumn("offsets", F.array(*(offset(i) for i in range(3))))


def unanchored(df: DataFrame, bits: int = 4, name: str = "xyz") -> DataFrame:
    """The inverse: the middle of the step."""
    cells = F.array("gx", "gy", "gz")
    return df.withColumn(name, F.array(*(F.col("box_min")[i] + cells[i] * F.col("voxel_size") + (F.get("offsets", F.lit(i)) + 0.5) / (1 << bits) * F.col("voxel_size") for i in range(3))))
