"""Reports on metrics by scene, view and configuration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def finite(x: Column) -> Column:
    """x, or null where it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)


def ratio(train_drop: Column, test_drop: Column, rule: str = "exact") -> Column:
    """How much more a change costs on training views than on test views.

    exact: infinite where the test drop is zero. small: where it is at most 1e-6 in
    size. signed: below 1e-4 in size, infinite if the train drop is positive, else
    not a number; where it is negative, infinite if the train drop is positive, else
    the quotient."""
    if rule == "signed":
        lost = F.when(train_drop > 0, F.lit(INF))
        return F.when(F.abs(test_drop) < 1e-4, F.coalesce(lost, F.lit(NAN))).when((test_drop < 0) & (train_drop > 0), F.lit(INF)).otherwise(train_drop / test_drop)
    usable = test_drop != 0 if rule == "exact" else F.abs(test_drop) > 1e-6
    return F.when(usable, train_drop / test_drop).otherwise(F.lit(INF))


def noise_fraction(r: Column) -> Column:
    return F.when(r != 0, (r - 1) / r)


def means(df: DataFrame, by: list[str], metrics: list[str], only_finite: bool = False) -> DataFrame:
    """Mean of each metric by group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(finite(F.col(m)) if only_finite else F.col(m)).alias(m) for m in metrics))


def rolled_means(df: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Means by group and, with a null group, over all rows, without rows that have an error or no number."""
    rows = df.where(F.col("error").isNull()) if "error" in df.columns else df
    return rows.rollup(by).agg(F.count("*").alias("n"), *(F.avg(finite(F.col(m))).alias(m) for m in metrics))


def train_test_gap(df: DataFrame, by: list[str], metric: str, split: str = "split") -> DataFrame:
    """train, test and gap (not a number where a split is empty) by group."""
    side = lambda name: F.coalesce(F.avg(F.when(F.col(split) == name, F.col(metric))), F.lit(NAN))
    return df.groupBy(*by).agg(side("train").alias("train"), side("test").alias("test")).withColumn("gap", F.col("train") - F.col("test"))


def band_drops(df: DataFrame, by: list[str], metric: str, band: str = "band", split: str = "split", rule: str = "exact") -> DataFrame:
    """By group and band over 0: mean baseline (band 0) less mean metric, on each split, and their ratio."""
    m = df.groupBy(*by, band).agg(*(F.avg(F.when(F.col(split) == s, F.col(metric))).alias(s) for s in ("train", "test")))
    base = m.where(F.col(band) == 0).select(*by, F.col("train").alias("base_train"), F.col("test").alias("base_test"))
    out = m.where(F.col(band) > 0).join(base, by).select(*by, band, (F.col("base_train") - F.col("train")).alias("train_drop"), (F.col("base_test") - F.col("test")).alias("test_drop"))
    return out.withColumn("ratio", ratio(F.col("train_drop"), F.col("test_drop"), rule))


def paired(base: DataFrame, other: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Difference of a metric between two runs on equal keys."""
    return base.select(*keys, F.col(metric).alias("before")).join(other.select(*keys, F.col(metric).alias("after")), keys).withColumn("change", F.col("after") - F.col("before"))


def compression(df: DataFrame, raw: Column, stored: Column, by: list[str]) -> DataFrame:
    """raw_bytes, stored_bytes and their ratio by group; null where nothing is stored."""
    out = df.groupBy(*by).agg(F.sum(raw).alias("raw_bytes"), F.sum(stored).alias("stored_bytes"))
    return out.withColumn("ratio", F.when(F.col("stored_bytes") > 0, F.col("raw_bytes") / F.col("stored_bytes")))


def view_table(df: DataFrame, by: list[str], name: str, metric: str) -> DataFrame:
    """Map from view to metric by group."""
    return df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, metric)))).alias("views"))


def smoothed(df: DataFrame, value: str, by: list[str], order: str, share: float = 0.4) -> DataFrame:
    """Exponential moving average from zero along an order, at the last row of each group.

    A row's weight falls by 1 - share with each row after it, so rows beyond those whose
    weight is over 2^-70 change no digit of a double; only these leave a task."""
    last = max(1, math.ceil(-70 / math.log2(1 - share))) if share < 1 else 1
    rows = df.withColumn("_back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_back") <= last)
    return rows.groupBy(*by).agg(F.sum(F.col(value) * share * F.pow(F.lit(1.0 - share), F.col("_back") - 1)).alias("smoothed"))


def held_out(df: DataFrame, by: list[str], every: int = 8, within: list[str] | None = None) -> DataFrame:
    """df with is_test: every so many rows in the order of `by`, from the first."""
    from .ordering import numbered

    return numbered(df, by, within).withColumn("is_test", F.col("ordinal") % every == 0).drop("ordinal")


def evenly_spaced(df: DataFrame, by: list[str], n: int, within: list[str]) -> DataFrame:
    """At most n rows of each group, evenly spaced in its order (all if it has no more); halves to even. n = 1 takes the first."""
    w = Window.partitionBy(*within)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*by)) - 1).withColumn("_n", F.count("*").over(w))
    if n == 1:
        return rows.where("_i = 0").drop("_i", "_n")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (F.col("_n") - 1) / (n - 1)).cast("int"))
    return rows.where((F.col("_n") <= n) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")


def first_views(df: DataFrame, by: list[str], n: int, within: list[str]) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where(F.col("_i") <= n).drop("_i")


def probe_views(df: DataFrame, by: list[str], within: list[str], places: tuple[int, ...] = (5, 10, 15, 20, 25)) -> DataFrame:
    """probe, and the row at that place in the group's order, counted round; a group's row may come up again."""
    w = Window.partitionBy(*within)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*by)) - 1).withColumn("_n", F.count("*").over(w))
    return rows.withColumn("probe", F.explode(F.array(*(F.lit(p) for p in places)))).where(F.col("probe") % F.col("_n") == F.col("_i")).drop("_i", "_n")


def summary(df: DataFrame, rows: str, columns: str, values: list, metric: str, places: int = 3) -> DataFrame:
    """Mean metric, rounded, with a column for each of the stated values."""
    return df.groupBy(rows).pivot(columns, values).agg(F.round(F.avg(metric), places))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """df in an order that key and seed decide, whatever the partitions."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have equal rows, equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
