"""Whole-day plans: from a stored day to crossings, daily tables and signals; scheduling of missing days."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead import config as C
from fairlead.functions.cells import CellIndex
from fairlead.functions.numbers import in_box
from fairlead.operators import gates, laden, signals, traffic


def day_crossings(p: DataFrame, pool: list[gates.Gate], index: CellIndex | None = None, max_gap_s: float = C.CROSSING_GAP_S, weight: str | None = "dup_db", order: str = "ord") -> DataFrame:
    """Crossings of a pool of gates with ship group and gate draught.

    Gates of one pool share the votes: group and draught come from all their corridors together, so monitored gates go in
    one pool and each experimental gate in its own.
    """
    inside = gates.in_pool(p, pool, index)
    events = gates.pool_crossings(inside, pool, max_gap_s, order)
    out = gates.with_groups(events, traffic.ship_types(inside, weight))
    draughts = gates.gate_draught(inside if weight else inside.withColumn("one", F.lit(1)), weight or "one")
    return out.join(draughts, "mmsi", "left")


def laden_tables(events: DataFrame, history: DataFrame, train_end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(relative draughts, daily table); thresholds may be learned up to a day only, ship maxima always from all history."""
    rel = laden.relative(events, laden.ship_max(history))
    train = rel if train_end is None else rel.filter(F.col("day") <= train_end)
    limits = laden.otsu(train.filter("evaluable"), "ship_group", "rel")
    return rel, laden.laden_daily(rel, limits)


def gate_series(cube: DataFrame, groups: tuple[str, ...] = ("Teherhajó", "Tanker"), by_direction: bool = False) -> DataFrame:
    """Commercial crossings per gate (or gate and direction) and day, zero where a day has none, with the gates' total."""
    name = F.concat_ws(" | ", "gate", "direction") if by_direction else F.col("gate")
    s = cube.filter(F.col("ship_group").isin(*groups)).groupBy(name.alias("series"), F.to_date("day").alias("day")).agg(F.sum("crossings").cast("double").alias("value"))
    filled = signals.zero_filled(s)
    return filled if by_direction else signals.with_total(filled)


def wanted_days(today: date, done: set[date], lag: int = 3, back: int = 7) -> list[date]:
    """Days to fetch: up to `lag` days ago, at most `back` days back, that are not done."""
    last = today - timedelta(days=lag)
    return [d for d in (last - timedelta(days=i) for i in range(back - 1, -1, -1)) if d not in done]


def four_queries(spark: SparkSession, paths: list[str], box: C.Box = C.STUDY_BOX) -> dict[str, DataFrame]:
    """The benchmark set on stored days: raw rows, distinct ships, box rows, hourly box; all weighted by dup_db."""
    p = spark.read.parquet(*paths)
    inside = p.filter(in_box(F.col("lat"), F.col("lon"), box))
    return {
        "rows": p.agg(F.sum("dup_db").alias("rows")),
        "ships": p.agg(F.countDistinct("mmsi").alias("ships")),
        "box": inside.agg(F.sum("dup_db").alias("rows")),
        "hourly": traffic.hourly(inside, "dup_db").orderBy("hour"),
    }
