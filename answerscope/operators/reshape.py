"""Small relational shapes: unpivot, overrides by key, marks, set sizes, newest good row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_engines(sheet: DataFrame, ids: list[str], engines: list[str], value: str = "answer_raw") -> DataFrame:
    """A row for each engine column of a wide sheet."""
    return sheet.unpivot(ids, engines, "engine", value)


def override(df: DataFrame, changes: DataFrame, on: list[str], column: str) -> DataFrame:
    """column's value from changes where the key has one."""
    new = changes.select(*on, F.col(column).alias("__new"))
    return df.join(new, on, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def mark(df: DataFrame, keys: DataFrame, on: list[str], out: str) -> DataFrame:
    """df with a boolean: whether keys has the row's key."""
    return df.join(keys.select(*on).distinct().withColumn("__in", F.lit(True)), on, "left").withColumn(out, F.coalesce("__in", F.lit(False))).drop("__in")


def newest_good(attempts: DataFrame, key: str, good: Column, at: str) -> DataFrame:
    """For each key the newest good row, or the newest row if none is good."""
    return attempts.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(F.coalesce(good, F.lit(False)), F.col(at))).alias("r")).select("r.*")


def unfetched(wanted: DataFrame, cache: DataFrame, key: str, good: Column) -> DataFrame:
    """Rows whose key the cache has no good row for."""
    return wanted.join(cache.where(good).select(key), key, "left_anti")


def in_order(df: DataFrame, key: str, values: list[str], fill: dict[str, object]) -> DataFrame:
    """A row for each value, in a column place's order, with fills where df has none."""
    order = df.sparkSession.createDataFrame(list(enumerate(values)), f"place int, {key} string")
    return order.join(df, key, "left").na.fill(fill)
