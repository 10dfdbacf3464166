"""Spatial orders: Morton codes, voxel keys, and importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid

MORTON_BITS = 21
# Fixed value: an axis of a Morton box is at least so long.
LEAST_EXTENT = 1e-6
#: Rows that one window numbers, unless equal keys are more.
CELL_ROWS = 32_768


def bounding_box(df: DataFrame, column: str = "xyz", least: float = 0.0) -> DataFrame:
    """One row: box_min, box_max, box_size (at least `least` an axis)."""
    lows, highs = ([f(F.get(column, F.lit(i))) for i in range(3)] for f in (F.min, F.max))
    box = df.agg(F.array(*lows).alias("box_min"), F.array(*highs).alias("box_max"))
    return box.withColumn("box_size", F.zip_with("box_max", "box_min", lambda a, b: F.greatest(a - b, F.lit(least))))


def spread_bits(v: Column) -> Column:
    """The low 21 bits of v, two zero bits after each."""
    # each step halves the runs of bits and doubles what is between them
    x = v.bitwiseAND((1 << MORTON_BITS) - 1)
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(mask)
    return x


def morton(x: Column, y: Column, z: Column) -> Column:
    """Interleaved code of three cells, x in the lowest bit."""
    a, b, c = (spread_bits(v.cast("bigint")) for v in (x, y, z))
    return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(c, 2))


def with_morton(df: DataFrame, column: str = "xyz") -> DataFrame:
    """df with the column morton: positions scaled to 21 bits an axis over the bounding box."""
    box = bounding_box(df, column, LEAST_EXTENT)
    top = (1 << MORTON_BITS) - 1
    cell = [F.least(F.greatest(F.floor((F.get(column, F.lit(i)) - F.col("box_min")[i]) / F.col("box_size")[i] * top), F.lit(0)), F.lit(top)) for i in range(3)]
    return df.crossJoin(F.broadcast(box)).withColumn("morton", morton(*cell)).drop("box_min", "box_max", "box_size")


def morton_sorted(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df in Morton order over range partitions; ties by splat_id."""
    rows = with_morton(df)
    dealt = rows.repartitionByRange(partitions, "morton", "splat_id") if partitions else rows.repartitionByRange("morton", "splat_id")
    return dealt.sortWithinPartitions("morton", "splat_id")


def restored(df: DataFrame) -> DataFrame:
    """The inverse permutation: by the row id that rows carry."""
    return df.orderBy("splat_id")


def importance() -> Column:
    """Activated opacity times the geometric mean of the activated scales."""
    return sigmoid(F.col("opacity")) * F.exp((F.col("scales")[0] + F.col("scales")[1] + F.col("scales")[2]) / 3)


def prune(df: DataFrame, ratio: float, rounds: int = 64) -> DataFrame:
    """The max(int(n (1 - ratio)), 1) most important rows (ties: lower splat_id), all columns.

    No global sort: the threshold importance is found by counting over ever finer
    ranges (each count combined map-side, one row to the driver), then rows above it
    are filtered and only the ties at it are ranked. ratio <= 0 keeps all."""
    if ratio <= 0:
        return df
    rows = df.withColumn("_importance", importance())
    n, low, high = rows.agg(F.count("*"), F.min("_importance"), F.max("_importance")).first()
    if not n:
        return df
    keep = max(int(n * (1 - ratio)), 1)
    # largest t with at least `keep` rows at or above it, narrowed 64-fold a pass
    above = 0  # rows known to be above the range
    for _ in range(rounds):
        if not low < high:
            break
        width = (high - low) / 64
        bucket = F.least(F.floor((F.col("_importance") - low) / width), F.lit(63))
        inside = rows.where((F.col("_importance") >= low) & (F.col("_importance") <= high))
        found = {int(r[0]): r for r in inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("_importance").alias("lo"), F.max("_importance").alias("hi")).collect()}
        for b in sorted(found, reverse=True):
            if above + found[b]["n"] >= keep:
                low, high = found[b]["lo"], found[b]["hi"]
                break
            above += found[b]["n"]
        if found and low == high:
            break
    sure = rows.where(F.col("_importance") > high)
    edge = rows.where((F.col("_importance") >= low) & (F.col("_importance") <= high)).orderBy(F.desc("_importance"), "splat_id").limit(keep - above)
    return sure.unionByName(edge).drop("_importance")


def voxel_keys(df: DataFrame, resolution: int, size: float | None = None, column: str = "xyz", least: float = 0.0) -> DataFrame:
    """df with voxel_size, gx, gy, gz and voxel (gx R^2 + gy R + gz).

    Cells are truncated and kept in the grid; the size is the longest extent over the
    resolution unless given."""
    box = bounding_box(df, column, least)
    edge = F.lit(float(size)) if size else F.array_max("box_size") / resolution
    box = box.withColumn("voxel_size", edge)
    cells = {name: F.when(F.col("voxel_size") > 0, F.least(F.greatest(F.floor((F.get(column, F.lit(i)) - F.col("box_min")[i]) / F.col("voxel_size")), F.lit(0)), F.lit(resolution - 1))).otherwise(0).cast("bigint") for i, name in enumerate(("gx", "gy", "gz"))}
    out = df.crossJoin(F.broadcast(box)).withColumns(cells)
    return out.withColumn("voxel", F.col("gx") * resolution * resolution + F.col("gy") * resolution + F.col("gz")).drop("box_max", "box_size")


def voxel_count(df: DataFrame) -> DataFrame:
    """One row: occupied voxels of a table with the column voxel."""
    return df.agg(F.countDistinct("voxel").alias("n_voxels"))


def by_voxel(df: DataFrame) -> DataFrame:
    """df in voxel order (ties by splat_id) over range partitions."""
    return df.repartitionByRange("voxel", "splat_id").sortWithinPartitions("voxel", "splat_id")


def numbered(df: DataFrame, by: list[str], within: list[str] | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """df with ordinal, from 0, in the order of `by`, for each group of `within`.

    Without groups a row's cell is found by its values, and a window numbers each cell,
    so there is no single-partition window. That never asks where a row was dealt to:
    ranges are sampled anew whenever a plan is evaluated, so ranks that join the
    partitions of one evaluation with the counts of another would collide."""
    if within:
        return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*within).orderBy(*by)) - 1)
    found = df.crossJoin(F.broadcast(_cells(df, by, cell_rows)))
    # binary search for the last cell whose least key is not above the row's
    at = F.aggregate("_steps", F.lit(0), lambda i, s: F.when(F.get(F.col("_cells"), i + s)["_least"] <= F.struct(*by), i + s).otherwise(i))
    rows = found.withColumn("_before", F.get(F.col("_cells"), at)["_before"]).drop("_cells", "_steps")
    place = F.row_number().over(Window.partitionBy("_before").orderBy(*by)) - 1
    return rows.withColumn("ordinal", (F.col("_before") + place).cast("bigint")).drop("_before")


def _cells(df: DataFrame, by: list[str], cell_rows: int) -> DataFrame:
    """One row: _cells, each with its least key and the rows before it, in order; _steps,
    powers of two that search them. Equal keys share a cell, whatever their number."""
    local = F.col("_row").bitwiseAND((1 << 33) - 1)
    dealt = df.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    runs = dealt.groupBy("_part", F.floor(local / cell_rows).alias("_run")).agg(F.min(F.struct(*by)).alias("_least"), F.max(F.struct(*by)).alias("_most"), F.count("*").alias("_n"))
    # a row for each cell_rows rows; a run begins a cell if all keys before are below its own
    earlier = Window.orderBy("_least", "_most").rowsBetween(Window.unboundedPreceding, -1)
    cuts = runs.withColumns({"_top": F.max("_most").over(earlier), "_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0))}).where("_top IS NULL OR _top < _least")
    cells = cuts.agg(F.array_sort(F.collect_list(F.struct("_before", "_least"))).alias("_cells"))
    return cells.withColumn("_steps", F.expr("transform(sequence(cast(ceil(log2(greatest(size(_cells), 1))) AS int), 0), k -> shiftleft(1, k))"))
