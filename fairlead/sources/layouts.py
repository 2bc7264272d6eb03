"""Storage orders compared: the same positions sorted four ways, what each query finds, and the row groups it may skip."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead import config as C
from fairlead.functions.cells import CellIndex, GridIndex
from fairlead.functions.numbers import in_box
from fairlead.sources.footers import footers, groups_to_read

#: Name: whether the cell is stored, and the order of the rows.
LAYOUTS = {"ship": (False, ("mmsi", "ts")), "ship_cell": (True, ("mmsi", "ts")), "cell": (True, ("cell", "ts")), "time": (False, ("ts", "mmsi"))}
COLUMNS = ("mmsi", "ts", "lat", "lon", "sog", "cog")


def write_layouts(p: DataFrame, root: str, index: CellIndex | None = None, group_rows: int = C.GROUP_ROWS, partitions: int | None = None) -> dict[str, str]:
    """Paths of the written layouts: range partitions of the order, so files and groups both follow it."""
    index, n = index or GridIndex(), partitions or int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = {}
    for name, (with_cell, order) in LAYOUTS.items():
        rows = p.select(*COLUMNS, *([index.cell(F.col("lat"), F.col("lon")).alias("cell")] if with_cell else []))
        out[name] = f"{root}/{name}"
        w = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite")
        w.option("compression", "zstd").option("parquet.block.row.count.limit", group_rows).parquet(out[name])
    return out


def cells_of(box: C.Box, index: GridIndex) -> list[int]:
    """Cells that a box touches: as many as its area holds."""
    lows, highs = index.of(box.lat_min, box.lon_min), index.of(box.lat_max, box.lon_max)
    rows = range(lows // index.columns, highs // index.columns + 1)
    return [r * index.columns + c for r in rows for c in range(lows % index.columns, highs % index.columns + 1)]


def _micros(t: str) -> float:
    return datetime.fromisoformat(t).replace(tzinfo=UTC).timestamp() * 1e6


def trial(spark: SparkSession, paths: dict[str, str], start: str, end: str, box: C.Box = C.TRIAL_BOX, index: GridIndex | None = None) -> DataFrame:
    """layout, groups, to_read_box, to_read_time, box_ships, box_rows, time_rows, hours, hour_ships; `cells` reads by cell first.

    `start` is in and `end` is out. Raises if two layouts answer differently.
    """
    index = index or GridIndex()
    rows = []
    for name, path in paths.items():
        t, f = spark.read.parquet(path), footers(spark, path)
        here, there = in_box(F.col("lat"), F.col("lon"), box), F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))
        groups = f.select("file", "row_group").distinct().count()
        by_box = groups_to_read(f, {"lat": (box.lat_min, box.lat_max), "lon": (box.lon_min, box.lon_max)}).count()
        by_time = groups_to_read(f, {"ts": (_micros(start), _micros(end) - 1)}).count()
        ways = {name: here}
        if LAYOUTS[name][0]:
            ways[f"{name} by cell"] = F.col("cell").isin(*cells_of(box, index)) & here
        hours = t.groupBy(F.hour("ts").alias("hour")).agg(F.countDistinct("mmsi").alias("ships")).agg(F.count("*").alias("hours"), F.sum("ships").alias("ships")).first()
        time_rows = t.filter(there).count()
        for way, wanted in ways.items():
            found = t.filter(wanted).agg(F.countDistinct("mmsi").alias("ships"), F.count("*").alias("rows")).first()
            rows.append((way, groups, by_box, by_time, found.ships, found.rows, time_rows, hours.hours, hours.ships))
    if len({r[4:] for r in rows}) > 1:
        raise ValueError(f"layouts give different answers: {rows}")
    return spark.createDataFrame(rows, "layout string, groups long, to_read_box long, to_read_time long, box_ships long, box_rows long, time_rows long, hours long, hour_ships long")


def sweep_groups(spark: SparkSession, paths: dict[str, str], boxes: list[tuple[float, C.Box, float]]) -> DataFrame:
    """layout, half_height, groups, to_read: how many row groups each box needs under each order, from footers alone."""
    rows = []
    for name, path in paths.items():
        f = footers(spark, path)
        groups = f.select("file", "row_group").distinct().count()
        rows += [(name, h, groups, groups_to_read(f, {"lat": (b.lat_min, b.lat_max), "lon": (b.lon_min, b.lon_max)}).count()) for h, b, _ in boxes]
    return spark.createDataFrame(rows, "layout string, half_height double, groups long, to_read long")
