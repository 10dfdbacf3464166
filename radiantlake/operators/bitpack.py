"""Packing small codes into bytes, over a stream of rows or within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes and bytes of a group, by bits; other widths are a byte a code.
GROUPS = {2: (4, 1), 3: (8, 3), 4: (2, 1)}


def pack_stream(df: DataFrame, column: str, width: int, bits: int, within: list[str]) -> DataFrame:
    """within..., at, byte: the bytes of the codes of rows (column ordinal from 0, arrays
    of width codes), the first code in the high bits, the last group filled with zeros.

    Codes are grouped by their place in the stream, summed map-side: no sort."""
    codes = df.select(*within, "ordinal", F.posexplode(column).alias("j", "code")).withColumn("_p", F.col("ordinal") * width + F.col("j"))
    if bits not in GROUPS:
        return codes.select(*within, F.col("_p").alias("at"), F.col("code").cast("int").alias("byte"))
    n, size = GROUPS[bits]
    shift = (n * bits - bits) - bits * (F.col("_p") % n)
    groups = codes.groupBy(*within, F.floor(F.col("_p") / n).alias("_g")).agg(F.sum(F.expr("cast(code as bigint)") * F.pow(F.lit(2), shift).cast("bigint")).alias("_v"))
    parts = F.array(*(F.pmod(F.floor(F.col("_v") / (1 << 8 * (size - 1 - k))), F.lit(256)).cast("int") for k in range(size)))
    return groups.select(*within, "_g", F.posexplode(parts).alias("_k", "byte")).select(*within, (F.col("_g") * size + F.col("_k")).cast("bigint").alias("at"), "byte")


def unpack_stream(df: DataFrame, width: int, bits: int, within: list[str], total: Column) -> DataFrame:
    """The inverse: within..., ordinal, j, code of rows (at, byte); codes from total on are padding."""
    if bits not in GROUPS:
        out = df.select(*within, F.col("at").alias("_p"), F.col("byte").alias("code"), total.alias("_total"))
    else:
        n, size = GROUPS[bits]
        groups = df.groupBy(*within, F.floor(F.col("at") / size).alias("_g")).agg(F.sum(F.col("byte").cast("bigint") * F.pow(F.lit(256), size - 1 - F.col("at") % size).cast("bigint")).alias("_v"), F.max(total).alias("_total"))
        codes = F.array(*(F.pmod(F.floor(F.col("_v") / (1 << bits * (n - 1 - k))), F.lit(1 << bits)).cast("int") for k in range(n)))
        out = groups.select(*within, "_g", "_total", F.posexplode(codes).alias("_k", "code")).withColumn("_p", F.col("_g") * n + F.col("_k"))
    return out.where(F.col("_p") < F.col("_total")).select(*within, F.floor(F.col("_p") / width).cast("bigint").alias("ordinal"), (F.col("_p") % width).cast("int").alias("j"), "code")


def packed(codes: Column, width: int, bits: int) -> Column:
    """A row's codes as its own bytes (padded with zeros): no shuffle, and a row can be read alone."""
    n, size = GROUPS.get(bits, (1, 1))
    if bits not in GROUPS:
        return codes
    filled = F.concat(codes, F.array_repeat(F.lit(0), -width % n))
    groups = F.sequence(F.lit(0), F.lit(-(-width // n) - 1))
    whole = F.transform(groups, lambda g: F.aggregate(F.slice(filled, g * n + 1, n), F.lit(0), lambda s, x: s * (1 << bits) + x))
    return F.flatten(F.transform(whole, lambda v: F.array(*(F.pmod(F.floor(v / (1 << 8 * (size - 1 - k))), F.lit(256)).cast("int") for k in range(size)))))


def unpacked(data: Column, width: int, bits: int) -> Column:
    if bits not in GROUPS:
        return data
    n, size = GROUPS[bits]
    groups = F.sequence(F.lit(0), F.lit(-(-width // n) - 1))
    whole = F.transform(groups, lambda g: F.aggregate(F.slice(data, g * size + 1, size), F.lit(0), lambda s, x: s * 256 + x))
    codes = F.flatten(F.transform(whole, lambda v: F.array(*(F.pmod(F.floor(v / (1 << bits * (n - 1 - k))), F.lit(1 << bits)).cast("int") for k in range(n)))))
    return F.slice(codes, 1, width)


def byte_shuffled(df: DataFrame, column: str, itemsize: int, within: list[str]) -> DataFrame:
    """within..., at, byte: little-endian bytes of integers (column ordinal), all first
    bytes, then all second bytes, and so on. One count for each group is joined."""
    total = df.groupBy(*within).agg(F.count("*").alias("_n"))
    planes = df.select(*within, "ordinal", F.posexplode(F.array(*(F.pmod(F.floor(F.col(column) / (1 << 8 * k)), F.lit(256)).cast("int") for k in range(itemsize)))).alias("_k", "byte"))
    return planes.join(total, within).select(*within, (F.col("_k") * F.col("_n") + F.col("ordinal")).cast("bigint").alias("at"), "byte")


def byte_unshuffled(df: DataFrame, itemsize: int, within: list[str], signed: bool = False) -> DataFrame:
    """The inverse: within..., ordinal, value."""
    total = df.groupBy(*within).agg((F.count("*") / itemsize).cast("bigint").alias("_n"))
    rows = df.join(total, within).withColumn("ordinal", F.col("at") % F.col("_n"))
    value = F.sum(F.col("byte").cast("bigint") * F.pow(F.lit(256), F.floor(F.col("at") / F.col("_n"))).cast("bigint"))
    if signed:
        half = 1 << (8 * itemsize - 1)
        value = F.pmod(value + half, F.lit(2 * half)) - half
    return rows.groupBy(*within, "ordinal").agg(value.cast("bigint").alias("value"))
