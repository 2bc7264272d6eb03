"""Laden state: ship draught history, relative draught, Otsu threshold, daily and rolling tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead import config as C
from fairlead.functions.numbers import half_even, plausible_draught, sorted_percentile


def ship_max(history: DataFrame) -> DataFrame:
    """mmsi, max_draught (95th percentile, linear), distinct values, days.

    A ship's draughts, one a day, are one array. `percentile` rounds its sum otherwise than SQL does, and a ratio on the
    edge of a bin then falls on its other side.
    """
    own = history.filter("draught is not null").groupBy("mmsi").agg(F.sort_array(F.collect_list("draught")).alias("own"))
    return own.select("mmsi", sorted_percentile(F.col("own"), 0.95).alias("max_draught"), F.size(F.array_distinct("own")).cast("long").alias("values"), F.size("own").cast("long").alias("days"))


def draught_at_crossing(events: DataFrame, at_gate: DataFrame, ship_day: DataFrame) -> DataFrame:
    """Draught seen at the gate if plausible, else the ship's daily median; one decimal."""
    e = events.withColumn("day", F.date_format(F.to_date("ts"), "yyyy-MM-dd"))
    e = e.join(at_gate.select("mmsi", F.col("median").alias("gate_draught")), "mmsi", "left").join(ship_day.select("day", "mmsi", F.col("draught").alias("day_draught"), "length", "width"), ["day", "mmsi"], "left")
    return e.withColumn("draught", half_even(F.when(plausible_draught(F.col("gate_draught")), F.col("gate_draught")).otherwise(F.col("day_draught")), 1))


def relative(events: DataFrame, most: DataFrame, least_values: int = 2) -> DataFrame:
    """Adds plausible, evaluable (plausible, and the ship reports different draughts) and rel (draught over the ship's own maximum)."""
    r = events.join(most, "mmsi", "left").withColumn("plausible", plausible_draught(F.col("draught")))
    r = r.withColumn("evaluable", F.col("plausible") & (F.coalesce("values", F.lit(0)) >= least_values))
    return r.withColumn("rel", F.when(F.col("evaluable"), F.col("draught") / F.col("max_draught")))


def otsu(values: DataFrame, group: str, value: str, bins: int = 100, clip: float = 1.2) -> DataFrame:
    """group, threshold: the right edge of the histogram bin that parts the values with most variance between the classes.

    A group becomes a histogram of `bins` rows before any window, so a hot group costs one map-side sum.
    """
    v = values.filter(F.col(value).isNotNull()).select(group, F.least(F.col(value), F.lit(clip)).alias("x"))
    ends = v.groupBy(group).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = v.join(F.broadcast(ends), group).withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    b = b.filter("hi > lo").groupBy(group, "lo", "hi", "bin").agg(F.count("*").cast("double").alias("n"))
    b = b.withColumn("m", F.col("n") * (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins))
    up, whole = W.partitionBy(group).orderBy("bin").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(group)
    b = b.withColumns({"w0": F.sum("n").over(up), "s0": F.sum("m").over(up), "w": F.sum("n").over(whole), "s": F.sum("m").over(whole)})
    between = F.col("w0") * (F.col("w") - F.col("w0")) * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0")), 2)
    b = b.filter("w0 < w").withColumn("between", between)
    best = b.groupBy(group).agg(F.max_by(F.struct("lo", "hi", "bin"), F.struct(F.round("between", 6), -F.col("bin"))).alias("k"))
    return best.select(group, (F.col("k.lo") + (F.col("k.bin") + 1) * (F.col("k.hi") - F.col("k.lo")) / bins).alias("threshold"))


def laden_daily(rel: DataFrame, thresholds: DataFrame) -> DataFrame:
    """day, gate, direction, ship_group: crossings, evaluable, laden, volume index, laden share."""
    r = rel.join(F.broadcast(thresholds), "ship_group", "left")
    laden = F.coalesce(F.col("evaluable") & (F.col("rel") >= F.col("threshold")), F.lit(False))
    g = r.withColumn("laden_", laden).groupBy("day", "gate", "direction", "ship_group").agg(
        F.count("*").alias("crossings"),
        F.count_if("evaluable").alias("evaluable"),
        F.count_if("laden_").alias("laden"),
        half_even(F.sum(F.when(F.col("plausible"), F.col("length") * F.col("width") * F.col("draught")))).alias("volume"),
    )
    return g.withColumn("laden_share", half_even(F.col("laden") / F.nullif(F.col("evaluable"), F.lit(0)), 4))


def rolling(series: DataFrame, days: int = C.ROLLING_DAYS, mean: bool = False) -> DataFrame:
    """Sum (or mean) over `days` calendar days; NULL unless each of them is there. Missing days are no zeros.

    By day number and not by rows, so gaps need no calendar: a frame that holds fewer rows than days is not whole.
    """
    w = W.partitionBy("series").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(-(days - 1), 0)
    out = F.avg("value").over(w) if mean else F.sum("value").over(w)
    return series.withColumn("rolled", F.when(F.count("value").over(w) == days, out))


def coverage(rel: DataFrame) -> DataFrame:
    """Share of crossings with a draught, a plausible one and an evaluable one: by gate and group, and by group alone."""
    pct = lambda c: F.round(100 * F.avg(c.cast("double")), 1)
    return rel.groupingSets([[F.col("gate"), F.col("ship_group")], [F.col("ship_group")]], "gate", "ship_group").agg(
        F.count("*").alias("crossings"), pct(F.col("draught").isNotNull()).alias("with_draught"), pct(F.col("plausible")).alias("plausible_share"), pct(F.col("evaluable")).alias("evaluable_share")
    ).withColumn("gate", F.coalesce("gate", F.lit(C.BOTH_GATES)))


def synthetic_decrease(rel: DataFrame, thresholds: DataFrame, first_day: str, share: float, group: str = "Tanker") -> DataFrame:
    """`rel` with a share of one week's laden crossings of a group made empty (0.8 of the threshold), chosen by a hash."""
    r = rel.join(F.broadcast(thresholds), "ship_group", "left")
    chosen = (F.col("ship_group") == group) & F.col("evaluable") & (F.col("rel") >= F.col("threshold")) & (F.datediff("day", F.lit(first_day)).between(0, 6))
    hit = chosen & (F.pmod(F.xxhash64("mmsi", "ts"), F.lit(10_000)) < int(share * 10_000))
    return r.withColumn("rel", F.when(hit, 0.8 * F.col("threshold")).otherwise(F.col("rel"))).drop("threshold")
