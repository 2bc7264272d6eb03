"""Trajectories: dead-reckoning compression, resampling, compression effect."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead import config as C
from fairlead.functions.numbers import micros, resultant_length
from fairlead.operators.traffic import hourly


def _scan(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, sog: np.ndarray, cog: np.ndarray, threshold: float, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """(kept, error): the first point is kept; later ones are if the anchor is too old or cannot predict, or predicts badly.

    From each anchor the predictions for all later points are made at once and the first that fails becomes the next
    anchor, in stretches that double, so the work follows the points and not the anchors times points.
    """
    n = len(t)
    kept, error = np.zeros(n, bool), np.full(n, np.nan)
    a, step = 0, 64
    while a < n:
        kept[a] = True
        at, able = a + 1, sog[a] == sog[a] and cog[a] == cog[a] and sog[a] < C.SOG_INVALID and cog[a] < C.COG_INVALID
        angle, shrink = math.radians(cog[a]) if able else 0.0, math.cos(math.radians(lat[a]))
        while at < n:
            to = min(n, at + step)
            dt = t[at:to] - t[a]
            if not able:
                a = at
                break
            way = sog[a] * C.KNOT * dt
            dy = (lat[at:to] - (lat[a] + way * math.cos(angle) / C.METRES_PER_DEGREE)) * C.METRES_PER_DEGREE
            dx = (lon[at:to] - (lon[a] + way * math.sin(angle) / (C.METRES_PER_DEGREE * shrink))) * C.METRES_PER_DEGREE * shrink
            off = np.hypot(dx, dy)
            bad = (dt > gap) | ~(off <= threshold)
            if bad.any():
                k = int(np.argmax(bad))
                error[at : at + k] = off[:k]
                a, step = at + k, 64
                break
            error[at:to] = off
            at, step = to, min(2 * step, 65536)
        else:
            break
    return kept, error


def dead_reckoning(p: DataFrame, thresholds: tuple[float, ...] = (C.DR_THRESHOLD_M,), gap_s: float = C.DR_GAP_S, order: str = "event_id") -> DataFrame:
    """mmsi, event order, ts, lat, lon, sog, cog, threshold, kept, error (of dropped points). Ships are independent.

    Sequential by nature. Ships are dealt to partitions and stand there in order, so a task scans one ship after another
    without a call per ship; it holds the rows of a batch and of the ship that the batch cuts.
    """

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        ship = rows["mmsi"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], ship[1:] != ship[:-1], [True]]))
        t = rows["us"].to_numpy() / 1e6
        values = [rows[c].to_numpy(float) for c in ("lat", "lon", "sog", "cog")]
        out = []
        for limit in thresholds:
            parts = [_scan(t[lo:hi], *(v[lo:hi] for v in values), limit, gap_s) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            kept, error = (np.concatenate(x) for x in zip(*parts, strict=True))
            out.append(pd.DataFrame({"mmsi": ship, order: rows[order].to_numpy(), "threshold": limit, "kept": kept, "error": pd.array(error, "Float64").copy()}))
            out[-1]["error"] = out[-1]["error"].mask(np.isnan(error))
        return pd.concat(out)

    def run(batches):
        held: list[pd.DataFrame] = []
        for b in batches:
            if b.empty:
                continue
            last = b["mmsi"].to_numpy() == b["mmsi"].iloc[-1]
            if held and held[-1]["mmsi"].iloc[-1] == b["mmsi"].iloc[-1] and last.all():
                held.append(b)
                continue
            whole = [*held, b[~last]]
            if sum(map(len, whole)):
                yield scan(pd.concat(whole))
            held = [b[last]]
        if held:
            yield scan(pd.concat(held))

    q = p.select("mmsi", order, micros("ts").alias("us"), "lat", "lon", "sog", "cog")
    return q.filter("mmsi is not null").repartition("mmsi").sortWithinPartitions("mmsi", "us", order).mapInPandas(run, f"mmsi long, {order} long, threshold double, kept boolean, error double")


def dr_summary(dr: DataFrame) -> DataFrame:
    """Per threshold: points, kept points and share, mean and largest error of the dropped ones."""
    return dr.groupBy("threshold").agg(
        F.count("*").alias("points"), F.count_if("kept").alias("kept"), (F.count_if("kept") / F.count("*")).alias("share"), F.avg("error").alias("mean_error"), F.max("error").alias("max_error")
    )


def compression_effect(p: DataFrame, dr: DataFrame, order: str = "event_id") -> DataFrame:
    """Hourly distinct ships from all points and from the kept ones, with differences."""
    kept = p.join(dr.filter("kept").select("mmsi", order), ["mmsi", order], "left_semi")
    full, less = hourly(p).select("hour", F.col("ships").alias("full")), hourly(kept).select("hour", F.col("ships").alias("compressed"))
    t = full.join(less, "hour", "left").withColumn("compressed", F.coalesce("compressed", F.lit(0).cast("long")))
    return t.withColumn("difference", F.abs(F.col("full") - F.col("compressed"))).withColumn("relative", F.col("difference") / F.col("full"))


def resample(p: DataFrame, step_s: int = C.GRID_STEP_S, gap_s: int = C.GRID_GAP_S, order: str = "event_id") -> DataFrame:
    """Linear interpolation of lat, lon and sog to a grid of step_s between a ship's first and last message.

    A grid point stands if the messages around it are at most gap_s apart or the nearer is at most gap_s / 2 away. Each
    pair of consecutive messages makes its own grid points, so nothing is joined: one window per ship.
    """
    step, gap = step_s * 1_000_000, gap_s * 1_000_000
    w = W.partitionBy("mmsi").orderBy("us", order)
    q = p.select("mmsi", order, micros("ts").alias("us"), "lat", "lon", "sog")
    q = q.withColumns({"us0": F.lag("us").over(w), "lat0": F.lag("lat").over(w), "lon0": F.lag("lon").over(w), "sog0": F.lag("sog").over(w)}).filter("us0 is not null and us > us0")
    lo, hi = F.floor(F.col("us0") / step) + 1, F.floor(F.col("us") / step)
    q = q.withColumns({"lo": lo.cast("long"), "hi": hi.cast("long")}).filter("lo <= hi").withColumn("g", F.explode(F.sequence("lo", "hi"))).withColumn("grid", F.col("g") * step)
    near = F.least(F.col("grid") - F.col("us0"), F.col("us") - F.col("grid"))
    part = (F.col("grid") - F.col("us0")) / (F.col("us") - F.col("us0"))
    mid = lambda c: F.col(f"{c}0") + (F.col(c) - F.col(f"{c}0")) * part
    return q.filter((F.col("us") - F.col("us0") <= gap) | (near <= gap / 2)).select("mmsi", "grid", mid("lat").alias("lat"), mid("lon").alias("lon"), mid("sog").alias("sog"))


def quantise(x, low: float, high: float):
    """0..65534 over [low, high], 65535 outside."""
    q = F.bround((x - low) / (high - low) * 65534)
    return F.when((q >= 0) & (q <= 65534), q).otherwise(65535).cast("int")


def explained(p: DataFrame, dr: DataFrame, gap_s: float = C.DR_GAP_S, order: str = "event_id") -> DataFrame:
    """Point by point why it was kept or dropped: seconds since the anchor, predicted position, error in metres, decision.

    Decisions: first, blind (the anchor is too old or has no speed or course), off (predicted badly, the next anchor) and
    dropped. The anchor is the last kept point before, so one window a threshold and ship finds it.
    """
    q = p.select("mmsi", order, micros("ts").alias("us"), "lat", "lon", "sog", "cog").join(dr.select("mmsi", order, "threshold", "kept"), ["mmsi", order])
    before = W.partitionBy("threshold", "mmsi").orderBy("us", order).rowsBetween(W.unboundedPreceding, -1)
    q = q.withColumn("a", F.last(F.when(F.col("kept"), F.struct("us", "lat", "lon", "sog", "cog")), ignorenulls=True).over(before))
    able = F.coalesce((F.col("a.sog") < C.SOG_INVALID) & (F.col("a.cog") < C.COG_INVALID), F.lit(False))
    q = q.withColumn("seconds", F.col("us") / 1e6 - F.col("a.us") / 1e6)
    seen = able & (F.col("seconds") <= gap_s)
    way, shrink = F.col("a.sog") * C.KNOT * F.col("seconds"), F.cos(F.radians("a.lat"))
    q = q.withColumns(
        {
            "lat_predicted": F.when(seen, F.col("a.lat") + way * F.cos(F.radians("a.cog")) / C.METRES_PER_DEGREE),
            "lon_predicted": F.when(seen, F.col("a.lon") + way * F.sin(F.radians("a.cog")) / (C.METRES_PER_DEGREE * shrink)),
        }
    )
    dy, dx = (F.col("lat") - F.col("lat_predicted")) * C.METRES_PER_DEGREE, (F.col("lon") - F.col("lon_predicted")) * C.METRES_PER_DEGREE * shrink
    decision = F.when(F.col("a").isNull(), "first").when(~seen, "blind").when(F.col("kept"), "off").otherwise("dropped")
    return q.select("threshold", "mmsi", order, "us", "seconds", "lat_predicted", "lon_predicted", F.sqrt(dy * dy + dx * dx).alias("miss"), decision.alias("decision"))


def steadiest(p: DataFrame, turning: bool = False, least_points: int = 200, least_valid: int = 50, least_sog: float = 5.0) -> DataFrame:
    """mmsi, points, steadiness of the one ship that best shows dead reckoning: the straightest (or most turning) of those under way.

    Steadiness is the circular resultant length of valid courses. Ties go to more points, then to the least ship.
    """
    sog, cog = F.when(F.col("sog") < C.SOG_INVALID, F.col("sog")), F.when(F.col("cog") < C.COG_INVALID, F.col("cog"))
    q = p.filter("mmsi is not null").groupBy("mmsi").agg(F.count("*").alias("points"), F.count(sog).alias("n_sog"), F.median(sog).alias("mid"), F.count(cog).alias("n_cog"), resultant_length(cog).alias("steadiness"))
    q = q.filter((F.col("points") >= least_points) & (F.col("n_sog") >= least_valid) & (F.col("mid") >= least_sog) & (F.col("n_cog") >= least_valid))
    best = F.round("steadiness", 9)
    return q.orderBy(best.asc() if turning else best.desc(), F.col("points").desc(), "mmsi").limit(1).select("mmsi", "points", "steadiness")
