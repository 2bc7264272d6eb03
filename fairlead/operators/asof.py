"""As-of joins without a nested loop: both sides in one sorted stream per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _sides(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, tie: str) -> DataFrame:
    a = left.select(F.struct(*left.columns).alias("row"), F.col(key), F.col(ts), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("tie"))
    b = right.select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.col(key), F.col(ts), F.col(value).alias("v"), F.lit(0).alias("side"), F.col(tie).cast("long").alias("tie"))
    return a.unionByName(b)


def _held(key: str, ts: str, backward: bool):
    """The nearest right value seen so far: forward in time, or backward from the end."""
    order = [F.col(ts).asc(), F.col("side").asc(), F.col("tie").asc()] if backward else [F.col(ts).desc(), F.col("side").asc(), F.col("tie").desc()]
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return F.last(F.when(F.col("side") == 0, F.struct("v", F.col(ts).alias("t"))), ignorenulls=True).over(w)


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, direction: str = "backward", tie: str = "tie") -> DataFrame:
    """left rows with the last (backward) or first (forward) right value at or before (after) them: adds `value` and `value`_ts.

    One union, one shuffle by key, one window: value and time travel in one struct, so both come from the same row. Equal
    times match. Of right rows at the same time the one with the greatest (backward) or least (forward) `tie` counts.
    """
    found = _sides(left, right, key, ts, value, tie).withColumn("m", _held(key, ts, direction == "backward")).filter("side = 1")
    return found.select("row.*", F.col("m.v").alias(value), F.col("m.t").alias(f"{value}_ts"))


def as_of_both(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, tie: str = "tie") -> DataFrame:
    """Both directions: `value`, `value`_ts from before and `value`_next, `value`_next_ts from after.

    Both windows have the same key, so one union and one shuffle serve them; the rows are only sorted twice.
    """
    both = _sides(left, right, key, ts, value, tie).withColumn("m", _held(key, ts, True)).withColumn("n", _held(key, ts, False)).filter("side = 1")
    return both.select("row.*", F.col("m.v").alias(value), F.col("m.t").alias(f"{value}_ts"), F.col("n.v").alias(f"{value}_next"), F.col("n.t").alias(f"{value}_next_ts"))
