"""Data-oblivious vector quantization: rotate a unit vector, code its coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.scalars import dot, norm
from . import codebook

#: Up to this dimension the rotation is a literal of the plan; beyond, an Arrow UDF holds it.
LITERAL_DIMENSION = 64


def literal_rows(rows) -> Column:
    return F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in rows))


def encode(vector: Column, d: int, bits: int, seed: int = 0) -> Column:
    """Struct of norm and codes (one small int a coordinate) of a column of d doubles.

    A zero vector has norm 0 and the codes of a zero unit vector. Built-in
    expressions only, so the scan, this and what follows are one stage."""
    n = norm(vector)
    by = F.when(n > 0, 1 / n).otherwise(F.lit(1.0))
    cuts = codebook.boundaries(codebook.centroids(d, bits))

    def code(row) -> Column:
        y = dot(F.array(*(F.lit(float(x)) for x in row)), vector) * by
        total = F.lit(0)
        for c in cuts:
            total = total + (y > c).cast("int")
        return total

    return F.struct(n.alias("norm"), F.array(*(code(row) for row in codebook.rotation(d, seed))).alias("codes"))


def decode(codes: Column, length: Column, d: int, bits: int, seed: int = 0) -> Column:
    """The vector that codes and norm stand for."""
    levels = F.array(*(F.lit(x) for x in codebook.centroids(d, bits)))
    back = np.array(codebook.rotation(d, seed)).T
    turned = F.transform(codes, lambda c: F.get(levels, c))
    return F.transform(F.transform(literal_rows(back), lambda row: dot(row, turned)), lambda x: x * length)


def _batches(d: int, bits: int, seed: int):
    turn = np.array(codebook.rotation(d, seed))
    cuts = np.array(codebook.boundaries(codebook.centroids(d, bits)))
    return turn, cuts, np.array(codebook.centroids(d, bits))


def encode_bulk(df: DataFrame, column: str, d: int, bits: int, seed: int = 0) -> DataFrame:
    """df with norm and codes beside it, by one matrix product for each Arrow batch.

    The same codes as encode() but for coordinates at a boundary to the last bit;
    faster for wide vectors, where d^2 literals would bloat the plan."""
    turn, cuts, _ = _batches(d, bits, seed)

    @pandas_udf("struct<norm:double,codes:array<int>>")
    def coded(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            x = np.array(s.tolist(), dtype=float).reshape(len(s), d)
            n = np.sqrt((x * x).sum(axis=1))
            y = (x / np.where(n > 0, n, 1.0)[:, None]) @ turn.T
            yield pd.DataFrame({"norm": n, "codes": list(np.searchsorted(cuts, y).astype(np.int32))})

    return df.withColumn("_coded", coded(column)).select(*df.columns, "_coded.norm", "_coded.codes")


def decode_bulk(df: DataFrame, d: int, bits: int, seed: int = 0, name: str = "decoded") -> DataFrame:
    """df with the vector that its norm and codes stand for."""
    turn, _, levels = _batches(d, bits, seed)

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def vectors(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for codes, n in parts:
            y = levels[np.array(codes.tolist(), dtype=int).reshape(len(codes), d)]
            yield pd.Series(list((y @ turn) * n.to_numpy()[:, None]))

    return df.withColumn(name, vectors("codes", "norm"))


@pandas_udf(T.FloatType())
def half(x: pd.Series) -> pd.Series:
    """A number as half precision keeps it."""
    return x.astype("float16").astype("float32")


def with_noise(df: DataFrame, column: str, d: int, bits: int, skip: float = 0.5, seed: int = 0, training: bool = True) -> DataFrame:
    """df with column through a quantization round trip, as noise for training; a row is
    left alone with probability skip, and every row when not training."""
    if not training:
        return df
    coded = encode(F.col(column), d, bits, seed)
    noisy = decode(coded["codes"], coded["norm"], d, bits, seed)
    return df.withColumn(column, F.when(F.rand(seed) >= skip, noisy).otherwise(F.col(column)))


def squared_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
