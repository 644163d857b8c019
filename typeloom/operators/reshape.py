"""Long and wide tables, question-level tables, combination of families, quality and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _or_error(problem: Column, message: str, keys: list[str], value: Column) -> Column:
    """``value``, or an error that names the keys of the row with a problem."""
    named = F.concat(F.lit(f"{message}: "), F.to_json(F.struct(*keys)))
    return F.when(problem, F.raise_error(named)).otherwise(value)


def wide(long: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Lossless: groups with NULLs only stay; a repeated (group, feature) is an error when the table is computed.

    The check rides on the aggregation by group and feature that the pivot needs anyway.
    """
    at = [*by, "feature"]
    counted = long.groupBy(*at).agg(F.count("*").alias("n"), F.first("value").alias("value"))
    value = _or_error(F.col("n") > 1, "more than one value", at, F.col("value"))
    return counted.select(*at, value.alias("value")).groupBy(*by).pivot("feature", names).agg(F.first("value"))


def wide_lossy(long: DataFrame, by: list[str], dropped: tuple[str, ...] = ()) -> DataFrame:
    """Groups and features without any value go; the first value counts."""
    known = long.where(F.col("value").isNotNull())
    if dropped:
        known = known.where(~F.col("feature").isin(*dropped))
    names = [r[0] for r in known.select("feature").distinct().orderBy("feature").collect()]  # names of features, not of groups
    return known.groupBy(*by).pivot("feature", names).agg(F.first("value"))


def combine(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """1:1 join of two families; keys must be unique and the same on both sides, or computing it is an error.

    Rows are counted by key on the partitioning that the join needs, so nothing runs beforehand.
    """
    each = Window.partitionBy(*keys)
    a, b = (df.withColumn(mark, F.count("*").over(each)) for df, mark in ((left, "n_left"), (right, "n_right")))
    both = a.join(b, keys, "full_outer")
    unmatched = F.col("n_left").isNull() | F.col("n_right").isNull()
    repeated = (F.col("n_left") > 1) | (F.col("n_right") > 1)
    fine = _or_error(unmatched, "a key is in one table only", keys, _or_error(repeated, "a key is repeated", keys, F.lit(True)))
    return both.where(fine).drop("n_left", "n_right")


def quality(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(F.count("*").alias("n"), F.count("value").alias("n_known"), (F.count("*") - F.count("value")).alias("n_missing"))


def coverage(df: DataFrame, dim: DataFrame, key: str, counted: str) -> DataFrame:
    """Distinct ``counted`` for each row of ``dim``, 0 where there is none."""
    n = df.groupBy(key).agg(F.countDistinct(counted).alias("n_users"))
    return dim.join(n, key, "left").select(key, F.coalesce("n_users", F.lit(0)).alias("n_users"))


def latest_version(df: DataFrame, group: list[str]) -> DataFrame:
    """Of groups with several versions, the rows of version 1 go."""
    seen = df.groupBy(*group).agg(F.countDistinct("version").alias("n_versions"))
    return df.join(seen, group).where("n_versions = 1 OR version <> 1").drop("n_versions")


def label(df: DataFrame, task: str) -> DataFrame:
    """Adds label: 0 or 1 for ``binary``, the session less one for ``multiclass``."""
    labels = {"binary": (F.col("session") != 1).cast("int"), "multiclass": F.col("session") - 1}
    if task not in labels:
        raise ValueError(f"unknown task {task!r}")
    return df.withColumn("label", labels[task])
