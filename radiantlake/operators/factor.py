"""Principal components of an array attribute, and codebooks local to a voxel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dot

# Fixed value: a column that varies less counts as constant.
LEAST_STD = 1e-8


def moments(df: DataFrame, column: str, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and covariance (over n - 1) of an array column.

    Each partition sends one row of d + d^2 sums, so the driver gets partitions, not
    data; sums are taken about a common first guess of the mean, for precision."""
    guess = df.agg(F.array(*(F.avg(F.get(column, F.lit(i))) for i in range(d)))).first()[0]
    if guess is None or guess[0] is None:
        return 0, np.zeros(d), np.zeros((d, d))
    about = np.array(guess, dtype=float)

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, square = 0, np.zeros(d), np.zeros((d, d))
        for pdf in parts:
            x = np.array(pdf[column].tolist(), dtype=float).reshape(len(pdf), d) - about
            n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "total": [total.tolist()], "square": [square.ravel().tolist()]})

    n, total, square = 0, np.zeros(d), np.zeros((d, d))
    for r in df.select(column).mapInPandas(sums, "n long, total array<double>, square array<double>").toLocalIterator():
        n, total, square = n + r.n, total + np.array(r.total), square + np.array(r.square).reshape(d, d)
    shift = total / n
    return n, about + shift, (square - n * np.outer(shift, shift)) / max(n - 1, 1)


def components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvectors (rows) and all eigenvalues, descending."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    return vectors[:, order[:k]].T, values[order]


def explained(values: np.ndarray) -> np.ndarray:
    """Cumulated share of variance."""
    return np.cumsum(values) / max(float(values.sum()), 1e-12)


def explained_curve(df: DataFrame, column: str, d: int, at: tuple[int, ...] = (4, 8, 12, 16, 20, 24, 32, 45)) -> DataFrame:
    """n_components, share."""
    _, _, cov = moments(df, column, d)
    share = explained(components(cov, d)[1])
    return df.sparkSession.createDataFrame([(k, float(share[min(k, d) - 1])) for k in at if k <= d], "n_components int, share double")


def project(df: DataFrame, column: str, mean: np.ndarray, rows: np.ndarray, name: str = "projected") -> DataFrame:
    """df with the centred column's coordinates along rows."""
    m = F.array(*(F.lit(float(x)) for x in mean))
    return df.withColumn("_c", F.zip_with(column, m, lambda a, b: a - b)).withColumn(name, F.array(*(dot(F.array(*(F.lit(float(x)) for x in row)), F.col("_c")) for row in rows))).drop("_c")


def unproject(df: DataFrame, column: str, mean: np.ndarray, rows: np.ndarray, name: str) -> DataFrame:
    """The inverse, up to what the left-out components held."""
    back = [F.array(*(F.lit(float(x)) for x in row)) for row in np.asarray(rows).T]
    return df.withColumn(name, F.array(*(dot(r, F.col(column)) + float(m) for r, m in zip(back, mean, strict=True))))


def column_stds(df: DataFrame, column: str, d: int, by: list[str]) -> DataFrame:
    """stds by group: population deviation of each place, 1 where it is next to none."""
    std = lambda i: F.stddev_pop(F.get(column, F.lit(i)))
    return df.groupBy(*by).agg(F.array(*(F.when(std(i) > LEAST_STD, std(i)).otherwise(1.0) for i in range(d))).alias("stds"))


def _lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of at most k clusters of rows: farthest-first seeds, then Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    seeds = [int(rng.integers(len(x)))]
    near = ((x - x[seeds[0]]) ** 2).sum(axis=1)
    while len(seeds) < k and near.max() > 0:
        seeds.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[seeds[-1]]) ** 2).sum(axis=1))
    centers = x[seeds].copy()
    for _ in range(rounds):
        own = _nearest(x, centers)
        counts = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest centre, in blocks of rows."""
    out = [((x[i : i + 4096, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, len(x), 4096)]
    return np.concatenate(out)


def voxel_codebooks(df: DataFrame, column: str, clusters: int = 256, rounds: int = 10, seed: int = 42, sample: int = 50_000) -> DataFrame:
    """voxel, codebook (array of vectors): k-means within each voxel over columns scaled
    to unit deviation; a voxel of no more rows than clusters keeps each row.

    A crowded voxel is fitted on `sample` of its rows (the lowest hashes of splat_id);
    all rows are coded later, by code_rows, without meeting in one task."""
    salted = df.select("voxel", "splat_id", column)
    rank = F.row_number().over(Window.partitionBy("voxel", "_salt").orderBy("_h"))
    # two steps: each of 64 salts of a voxel ranks its own, so no task sorts a hot voxel whole
    hashed = salted.withColumn("_h", F.xxhash64("splat_id")).withColumn("_salt", F.pmod(F.xxhash64("splat_id", F.lit(1)), F.lit(64)))
    chosen = hashed.withColumn("_r", rank).where(F.col("_r") <= -(-sample // 64)).drop("_r", "_h", "_salt")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("splat_id")
        x = np.array(pdf[column].tolist(), dtype=float)
        if len(x) <= clusters:
            centers = x
        else:
            std = x.std(axis=0)
            std = np.where(std > LEAST_STD, std, 1.0)
            centers = _lloyd(x / std, clusters, rounds, seed) * std
        return pd.DataFrame({"voxel": [int(pdf["voxel"].iloc[0])], "codebook": [[c.tolist() for c in centers]]})

    return chosen.groupBy("voxel").applyInPandas(fit, "voxel long, codebook array<array<double>>")


def code_rows(df: DataFrame, column: str, books: DataFrame) -> DataFrame:
    """df with code: the nearest vector of its voxel's codebook."""
    d2 = lambda c: F.aggregate(F.zip_with(c, column, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return df.join(books, "voxel").withColumn("_d", F.transform("codebook", d2)).withColumn("code", (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d", "codebook")


def decode_rows(df: DataFrame, books: DataFrame, name: str, width: int) -> DataFrame:
    """df with the vector of its voxel and code: codes are kept in the codebook's range; a voxel without a codebook gives zeros."""
    at = F.least(F.greatest(F.col("code"), F.lit(0)), F.size("codebook") - 1)
    zeros = F.array_repeat(F.lit(0.0), width)
    return df.join(books, "voxel", "left").withColumn(name, F.coalesce(F.when(F.col("codebook").isNotNull(), F.get("codebook", at)), zeros)).drop("codebook")


def codebook_offsets(books: DataFrame) -> DataFrame:
    """voxel, n, first: where a voxel's vectors begin when codebooks are laid end to end."""
    from .ordering import numbered

    sizes = numbered(books.select("voxel", F.size("codebook").alias("n")), ["voxel"])
    # running sums over blocks of 4096 voxels, then over the blocks: neither window holds all rows
    block = F.floor(F.col("ordinal") / 4096)
    rows = sizes.withColumn("_b", block).withColumn("_in", F.coalesce(F.sum("n").over(Window.partitionBy("_b").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = rows.groupBy("_b").agg(F.sum("n").alias("_t")).withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(totals.select("_b", "_before"), "_b").select("voxel", "n", (F.col("_before") + F.col("_in")).cast("bigint").alias("first"))
