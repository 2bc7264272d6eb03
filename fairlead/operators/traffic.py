"""Traffic queries: counts, distinct ships, hourly profiles, votes, cross-tables, dedup with multiplicity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead import config as C
from fairlead.functions.numbers import in_box, plausible_draught, valid_position
from fairlead.functions.text import NOT_SHIPS, clean_text, not_empty, ship_group


def dedup_with_multiplicity(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row per distinct content: dup_db counts its copies, first is the least source position. Combined map-side."""
    return rows.groupBy(*columns).agg(F.count("*").cast("int").alias("dup_db"), F.min(order).alias("first"))


def replicate(rows: DataFrame, times: str = "dup_db") -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by `order`: a struct minimum, so no sort of whole groups."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min(F.struct(F.col(order).alias("__o"), *[F.col(c).alias(c) for c in rest]))
    return rows.groupBy(*keys).agg(best.alias("__b")).select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(F.col(order).alias("__o"), *[F.col(c).alias(c) for c in rest]))
    return rows.groupBy(*keys).agg(best.alias("__b")).select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def source_order(rows: DataFrame, order: str) -> DataFrame:
    """ord: rank of a row among those of its ship and second, by source position."""
    return rows.withColumn("ord", F.row_number().over(W.partitionBy("mmsi", "ts").orderBy(order)).cast("short"))


def row_counts(p: DataFrame) -> DataFrame:
    """Conservation figures of a position table in one scan."""
    ok = F.coalesce(in_box(F.col("lat"), F.col("lon")), F.lit(False))
    ships = p.agg(
        F.count("*").alias("rows"),
        F.sum("dup_db").cast("long").alias("raw_rows"),
        F.count_if(F.col("ts").isNull()).alias("no_ts"),
        F.count_if(~valid_position(F.col("lat"), F.col("lon"))).alias("no_cell"),
        F.count_if(ok).alias("box_rows"),
        F.sum(F.when(ok, F.col("dup_db")).otherwise(0)).cast("long").alias("box_raw_rows"),
        F.countDistinct("mmsi").alias("ships"),
    )
    return ships


def hourly(p: DataFrame, weight: str | None = None) -> DataFrame:
    """hour, messages, ships. Ships are made distinct per (hour, ship) first, so one shuffle carries counts, not sets."""
    n = F.sum(weight) if weight else F.count("*")
    per_ship = p.groupBy(F.hour("ts").cast("long").alias("hour"), "mmsi").agg(n.cast("long").alias("n"))
    return per_ship.groupBy("hour").agg(F.sum("n").alias("messages"), F.count("*").alias("ships"))


def hourly_in_box(p: DataFrame, box: C.Box = C.STUDY_BOX, weight: str | None = None) -> DataFrame:
    return hourly(p.filter(in_box(F.col("lat"), F.col("lon"), box)), weight)


def hourly_by_day(p: DataFrame) -> DataFrame:
    """date, hour, messages, ships for all 24 hours of every day; hours without messages are zero."""
    days = p.select(F.to_date("ts").alias("date")).distinct()
    grid = days.select("date", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    per_ship = p.groupBy(F.to_date("ts").alias("date"), F.hour("ts").cast("long").alias("hour"), "mmsi").agg(F.count("*").alias("n"))
    found = per_ship.groupBy("date", "hour").agg(F.sum("n").alias("messages"), F.count("*").alias("ships"))
    zero = F.lit(0).cast("long")
    return grid.join(found, ["date", "hour"], "left").select("date", "hour", F.coalesce("messages", zero).alias("messages"), F.coalesce("ships", zero).alias("ships"))


def day_summary(hours: DataFrame) -> DataFrame:
    """Per day: messages, peak hour by ships (the first of equals), its ships, mean hourly ships."""
    best = F.max_by("hour", F.struct("ships", -F.col("hour")))
    return hours.groupBy("date").agg(F.sum("messages").alias("messages"), best.alias("peak_hour"), F.max("ships").alias("peak_ships"), F.avg("ships").alias("mean_ships"))


def ever_in_box(p: DataFrame, box: C.Box = C.STUDY_BOX) -> DataFrame:
    """All positions of the ships that were in the box at least once."""
    ships = p.filter(in_box(F.col("lat"), F.col("lon"), box)).select("mmsi").distinct()
    return p.join(ships, "mmsi", "left_semi")


def fill_rates(p: DataFrame, fields: list[str]) -> DataFrame:
    """field, messages, filled, ships, ships_filled: how many messages and ships say something in a field, in one pass a ship."""
    says = [F.max(not_empty(F.col(f)).cast("int")).alias(f"{f}_any") for f in fields]
    per = p.groupBy("mmsi").agg(F.count("*").alias("n"), *[F.count_if(not_empty(F.col(f))).alias(f) for f in fields], *says)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled"), F.col(f"{f}_any").alias("any")) for f in fields])).alias("r")
    return per.select("n", rows).groupBy("r.field").agg(F.sum("n").alias("messages"), F.sum("r.filled").alias("filled"), F.count("*").alias("ships"), F.count_if(F.col("r.any") == 1).alias("ships_filled"))


def hash_sample(p: DataFrame, share: float, *keys: str, seed: int = 0) -> DataFrame:
    """A share of the rows that depends only on their keys, so reruns and other partitionings give the same rows."""
    return p.filter(F.pmod(F.crc32(F.concat_ws("|", F.lit(str(seed)), *keys).cast("binary")), F.lit(1_000_000)) < int(share * 1_000_000))


def vote(p: DataFrame, value: Column, key: str = "mmsi", weight: str | None = None) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the least."""
    n = F.sum(weight) if weight else F.count("*")
    counts = p.groupBy(key, value.alias("value")).agg(n.cast("long").alias("n"))
    top = counts.groupBy(key).agg(F.max("n").alias("most"), F.collect_list(F.struct("n", "value")).alias("all"))
    won = F.array_min(F.transform(F.filter("all", lambda s: s["n"] == F.col("most")), lambda s: s["value"]))
    return top.select(key, won.alias("value"), F.col("most").alias("votes"))


def ship_types(p: DataFrame, weight: str | None = None) -> DataFrame:
    """mmsi, ship_type (vote over types that say something), ship_group."""
    v = vote(p.filter(not_empty(F.col("ship_type"))), F.col("ship_type"), weight=weight)
    ships = p.select("mmsi").distinct().join(v, "mmsi", "left")
    return ships.select("mmsi", F.col("value").alias("ship_type"), ship_group(F.col("value")).alias("ship_group"))


def group_counts(p: DataFrame) -> DataFrame:
    """Ships, messages and their shares by group."""
    per_ship = p.groupBy("mmsi").agg(F.count("*").alias("n"))
    g = per_ship.join(ship_types(p), "mmsi").groupBy("ship_group").agg(F.count("*").alias("ships"), F.sum("n").alias("messages"))
    whole = W.partitionBy()
    return g.withColumn("ship_share", 100.0 * F.col("ships") / F.sum("ships").over(whole)).withColumn("message_share", 100.0 * F.col("messages") / F.sum("messages").over(whole))


def class_counts(p: DataFrame) -> DataFrame:
    """By transmitter class: rows, ships, and ships that report a navigational status."""
    per = p.groupBy("type_of_mobile", "mmsi").agg(F.count("*").alias("n"), F.max(clean_text(F.col("nav_status")) != "").alias("has"))
    return per.groupBy("type_of_mobile").agg(F.sum("n").alias("rows"), F.count("*").alias("ships"), F.count_if("has").alias("with_status"))


def group_by_status(p: DataFrame) -> DataFrame:
    """Cross table of ship group and voted status, in ships."""
    status = vote(p, F.col("nav_status")).select("mmsi", F.col("value").alias("status"))
    return ship_types(p).join(status, "mmsi").groupBy("ship_group", "status").agg(F.count("*").alias("ships"))


def hourly_groups(p: DataFrame) -> DataFrame:
    hours = p.select(F.hour("ts").cast("long").alias("hour"), "mmsi").distinct()
    return hours.join(ship_types(p), "mmsi").groupBy("hour", "ship_group").agg(F.count("*").alias("ships"))


def conflicts(p: DataFrame, fields: list[str], key: str = "mmsi") -> DataFrame:
    """How many keys report more than one value, by field. One scan: fields are unpivoted before the distinct."""
    pairs = ", ".join(f"'{f}', cast({f} AS string)" for f in fields)
    long = p.select(key, F.expr(f"stack({len(fields)}, {pairs}) AS (field, value)")).filter("value is not null").distinct()
    return long.groupBy(key, "field").agg(F.count("*").alias("n")).groupBy("field").agg(F.count("*").alias("keys"), F.count_if(F.expr("n > 1")).alias("conflicting"))


def longest_value(p: DataFrame, key: str, value: str) -> DataFrame:
    """The longest value of each key; of equally long ones the greatest."""
    return p.groupBy(key).agg(F.max(F.struct(F.length(value).alias("n"), F.col(value).alias("v"))).alias("b")).select(key, F.col("b.v").alias(value))


def first_per_ship(p: DataFrame, start: str, end: str) -> DataFrame:
    """The first message of each ship in [start, end]."""
    inside = p.filter(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return keep_first(inside.withColumn("__k", F.struct("ts", "event_id")), ["mmsi"], "__k").drop("__k")


def thin(p: DataFrame, seconds: int = 120) -> DataFrame:
    """The first message of each ship and time bucket."""
    from fairlead.functions.numbers import micros

    bucket = F.floor(micros("ts") / (seconds * 1_000_000)).cast("long")
    return keep_first(p.withColumn("bucket", bucket).withColumn("__k", F.struct("ts", "event_id")), ["mmsi", "bucket"], "__k").drop("__k")


def ship_day(p: DataFrame) -> DataFrame:
    """Day and ship: voted type by dup_db, medians of plausible draught and of positive length and width (unweighted)."""
    v = vote(p.withColumn("__k", F.concat_ws("|", F.date_format(F.to_date("ts"), "yyyy-MM-dd"), F.col("mmsi"))), F.col("ship_type"), "__k", "dup_db")
    v = v.select(F.substring_index("__k", "|", 1).alias("day"), F.substring_index("__k", "|", -1).cast("long").alias("mmsi"), F.col("value").alias("ship_type"))
    m = p.groupBy(F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day"), "mmsi").agg(
        F.median(F.when(plausible_draught(F.col("draught")), F.col("draught"))).alias("draught"),
        F.median(F.when(F.col("length") > 0, F.col("length"))).alias("length"),
        F.median(F.when(F.col("width") > 0, F.col("width"))).alias("width"),
    )
    return m.join(v, ["day", "mmsi"])


def cell_heat(p: DataFrame, cell: Column) -> DataFrame:
    """Distinct ships and raw messages by cell."""
    per = p.groupBy(cell.alias("cell"), "mmsi").agg(F.sum("dup_db").alias("n"))
    return per.groupBy("cell").agg(F.count("*").alias("ships"), F.sum("n").cast("long").alias("messages"))


def presence(p: DataFrame, cell: Column) -> DataFrame:
    """Ship-hours by day and cell."""
    seen = p.select(F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day"), cell.alias("cell"), "mmsi", F.hour("ts").alias("hour")).distinct()
    return seen.groupBy("day", "cell").agg(F.count("*").alias("ship_hours"))


def roll_up(cells: DataFrame, parent: Column, days: Column | float) -> DataFrame:
    return cells.groupBy(parent.alias("cell")).agg((F.sum("ship_hours") / days).alias("per_day"))


def sweep_boxes(heights: tuple[float, ...] = C.SWEEP_HEIGHTS, centre: tuple[float, float] = C.SWEEP_CENTRE, bounds: C.Box = C.STUDY_BOX) -> list[tuple[float, C.Box, float]]:
    """(half height, box, square kilometres) of boxes around one point, as wide as high on the ground, cut to the bounds."""
    out, shrink, km = [], math.cos(math.radians(centre[0])), C.METRES_PER_DEGREE / 1000
    for h in heights:
        b = C.Box(max(centre[0] - h, bounds.lat_min), min(centre[0] + h, bounds.lat_max), max(centre[1] - h / shrink, bounds.lon_min), min(centre[1] + h / shrink, bounds.lon_max))
        out.append((h, b, (b.lat_max - b.lat_min) * km * (b.lon_max - b.lon_min) * km * shrink))
    return out


def area_sweep(p: DataFrame, boxes: list[tuple[float, C.Box, float]] | None = None) -> DataFrame:
    """half_height, km2, rows, ships, row_share for each box: one scan and one shuffle (on the ship) for all of them."""
    boxes = sweep_boxes() if boxes is None else boxes
    per = p.groupBy("mmsi").agg(F.count("*").alias("n"), *[F.count_if(in_box(F.col("lat"), F.col("lon"), b)).alias(f"n{i}") for i, (_, b, _) in enumerate(boxes)])
    sums = [F.struct(F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias("rows"), F.count_if((F.col(f"n{i}") > 0) & F.col("mmsi").isNotNull()).alias("ships")).alias(f"s{i}") for i in range(len(boxes))]
    one = per.agg(F.sum("n").alias("n"), *sums)
    rows = [F.struct(F.lit(h).alias("half_height"), F.lit(km2).alias("km2"), F.col(f"s{i}.rows").alias("rows"), F.col(f"s{i}.ships").alias("ships"), (F.col(f"s{i}.rows") / F.col("n")).alias("row_share")) for i, (h, _, km2) in enumerate(boxes)]
    return one.select(F.inline(F.array(*rows)))


def ships_only(p: DataFrame) -> DataFrame:
    """Without stations, aids to navigation and search transponders; a missing kind counts as a ship."""
    return p.filter(~F.coalesce(F.col("type_of_mobile").isin(*NOT_SHIPS), F.lit(False)))


def histogram(rows: DataFrame, group: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """group, bin, n: counts in equal bins over [low, high], its upper end in the last bin; values outside are left out."""
    v = rows.filter(F.col(value).between(low, high))
    b = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return v.groupBy(group, b.alias("bin")).agg(F.count("*").alias("n"))
