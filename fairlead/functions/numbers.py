"""Numbers and time: guards, rounding, deviations, calendar keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairlead import config as C


def plausible_draught(d: Column) -> Column:
    """1.0 <= d < 25.5; NULL and NaN are not plausible (NaN compares greater)."""
    return F.coalesce((d >= C.DRAUGHT_MIN) & (d < C.DRAUGHT_MAX), F.lit(False))


def valid_position(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0), F.lit(False))


def in_box(lat: Column, lon: Column, box: C.Box = C.STUDY_BOX) -> Column:
    return lat.between(box.lat_min, box.lat_max) & lon.between(box.lon_min, box.lon_max)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def fma(a: Column, b: Column, c: Column) -> Column:
    """a * b + c of doubles, rounded once; no argument may be NULL."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("fma"), a, b, c).cast("double")


def sorted_percentile(values: Column, share: float) -> Column:
    """Linear percentile of an ascending array without NULL, not empty; the same bits as DuckDB's quantile_cont, which adds its terms by fma."""
    place = (F.size(values) - 1) * F.lit(float(share))
    part = place - F.floor(place)
    at = lambda i: F.get(values, i.cast("int")).cast("double")
    return fma(at(F.floor(place)), 1 - part, at(F.ceil(place)) * part)


def deviation(x: Column, base: Column) -> Column:
    return x / base - 1


def log_ratio(x: Column, base: Column) -> Column:
    """Log ratio with 0.5 in place of zero counts."""
    return F.ln(F.when(x > 0, x.cast("double")).otherwise(0.5) / base)


def micros(ts: Column | str = "ts") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts if isinstance(ts, str) else 'ts'})")


def day_text(ts: str = "ts") -> Column:
    return F.date_format(F.to_date(F.col(ts)), "yyyy-MM-dd")


def monday(d: Column) -> Column:
    return F.to_date(F.date_trunc("WEEK", d))


def parse_timestamp(raw: Column) -> Column:
    """Day-first timestamp; NULL where it cannot be read."""
    return F.try_to_timestamp(raw, F.lit("dd/MM/yyyy HH:mm:ss")).cast("timestamp_ntz")


def box_km2(box: C.Box) -> float:
    import math

    mid = math.radians((box.lat_min + box.lat_max) / 2)
    return (box.lat_max - box.lat_min) * (box.lon_max - box.lon_min) * math.cos(mid) * (C.METRES_PER_DEGREE / 1000) ** 2


def resultant_length(cog: Column) -> Column:
    """Circular resultant length of courses in degrees (an aggregate)."""
    r = F.radians(cog)
    return F.sqrt(F.pow(F.avg(F.cos(r)), 2) + F.pow(F.avg(F.sin(r)), 2))
