"""Set operations and assertions on tables of days and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(wanted: DataFrame, done: DataFrame, key: str = "day") -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def assert_disjoint(a: DataFrame, b: DataFrame) -> None:
    if not a.intersect(b).isEmpty():
        raise ValueError("the two samples share days")


def repeated_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(table: DataFrame, keys: list[str]) -> DataFrame:
    if not repeated_keys(table, keys).isEmpty():
        raise ValueError(f"keys repeat: {keys}")
    return table


def join_keeping_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails if it would change the number of rows."""
    return left.join(assert_unique(right, keys), keys, "left")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def union_tagged(**tables: DataFrame) -> DataFrame:
    """Union of tables by name, with the keyword as `kind`."""
    out = None
    for kind, t in tables.items():
        t = t.withColumn("kind", F.lit(kind))
        out = t if out is None else out.unionByName(t)
    return out


def priority_order(days: DataFrame, first: DataFrame) -> DataFrame:
    """Missing days, those of `first` before the others, then by day."""
    return days.join(first.select("day", F.lit(0).alias("p")), "day", "left").select("day", F.coalesce("p", F.lit(1)).alias("priority")).orderBy("priority", "day")
