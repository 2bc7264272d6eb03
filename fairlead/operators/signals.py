"""Monitoring: series from cubes, same-weekday baseline, robust threshold, signals and comparisons of signal tables.

A series table is long: series, day (DATE), value (DOUBLE); one row a series and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead import config as C
from fairlead.functions.numbers import deviation, log_ratio


def calendar(first: Column | str, last: Column | str, of: DataFrame) -> DataFrame:
    return of.select(F.explode(F.sequence(first, last)).alias("day"))


def zero_filled(series: DataFrame) -> DataFrame:
    """All series on all days that any series has; absent pairs are zero. The calendar, some thousand days, is broadcast."""
    days, names = series.select("day").distinct(), series.select("series").distinct()
    grid = names.withColumn("__all", F.lit(1)).join(F.broadcast(days.withColumn("__all", F.lit(1))), "__all").drop("__all")
    return grid.join(series, ["series", "day"], "left").select("series", "day", F.coalesce("value", F.lit(0.0)).alias("value"))


def with_total(series: DataFrame, name: str = C.BOTH_GATES) -> DataFrame:
    return series.unionByName(series.groupBy("day").agg(F.sum("value").alias("value")).withColumn("series", F.lit(name)))


def wide(series: DataFrame, names: list[str]) -> DataFrame:
    """A day a row, a column a series, zero where absent. Names are given, so the pivot needs no extra scan."""
    return series.groupBy("day").pivot("series", names).agg(F.sum("value")).fillna(0.0)


def baseline(series: DataFrame, weeks: int = C.WEEKS, least: int = C.MIN_BASE_DAYS) -> DataFrame:
    """Adds base_days, base (median of the values 7, 14, ... days before that exist) and e (relative deviation).

    Each value is sent to the days that it is a base of, with the value itself as week 0, so one grouping by (series,
    day) makes it: no self-join.
    """
    sent = series.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(weeks)))).select("series", F.expr("date_add(day, 7 * w)").alias("day"), "value", "w")
    g = sent.groupBy("series", "day").agg(F.max(F.when(F.col("w") == 0, F.col("value"))).alias("value"), F.max(F.col("w") == 0).alias("own"), F.count_if(F.expr("w > 0 and value is not null")).alias("base_days"), F.median(F.when(F.col("w") > 0, F.col("value"))).alias("m"))
    g = g.filter("own").withColumn("base", F.when((F.col("base_days") >= least) & (F.col("m") > 0), F.col("m")))
    return g.select("series", "day", "value", "base_days", "base", deviation(F.col("value"), F.col("base")).alias("e"))


def lag_segments(daily: DataFrame, first: str, last: str, lags: tuple[int, ...], sums: list[str]) -> DataFrame:
    """lag, segment (before, during or after the closed range first..last moved by `lag` days), from, to, days and the daily mean of each column."""
    a, b = (F.date_add(F.lit(x).cast("date"), F.col("lag")) for x in (first, last))
    moved = daily.withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags])))
    segment = F.when(F.col("day") < a, "before").when(F.col("day") <= b, "during").otherwise("after")
    return moved.groupBy("lag", segment.alias("segment")).agg(F.min("day").alias("from"), F.max("day").alias("to"), F.count("*").alias("days"), *[F.avg(c).alias(c) for c in sums])


def iso_week(day: Column) -> Column:
    """The ISO year and week of a day, as 2024-W09."""
    monday = F.date_trunc("WEEK", day)
    return F.concat(F.year(F.date_add(monday.cast("date"), 3)).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def mad(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, mad: median absolute deviation from the median, in two passes."""
    mid = rows.groupBy(key).agg(F.median(value).alias("__m"))
    return rows.join(mid, key).groupBy(key).agg(F.median(F.abs(F.col(value) - F.col("__m"))).alias("mad"))


def classify(e: Column, limit: Column) -> Column:
    return F.when(e.isNull() | limit.isNull(), C.NO_BASE).when(e > limit, C.HIGH).when(e < -limit, C.LOW).otherwise(C.NORMAL)


def code(e: Column, limit: Column) -> Column:
    """1 high, -1 low, 0 normal, -9 none."""
    return F.when(e.isNull() | limit.isNull(), -9).when(e > limit, 1).when(e < -limit, -1).otherwise(0)


def signals(series: DataFrame, k: float = C.K) -> DataFrame:
    """The signal rule: series, day, value, base_days, base, e, threshold, signal. Compared before any rounding."""
    b = baseline(series)
    limits = mad(b.filter("e is not null"), "series", "e").select("series", (k * C.MAD_SCALE * F.col("mad")).alias("threshold"))
    t = b.join(limits, "series", "left")
    return t.withColumn("signal", classify(F.col("e"), F.col("threshold"))).withColumn("threshold", F.when(F.col("e").isNotNull(), F.col("threshold")))


def noise(b: DataFrame) -> DataFrame:
    """Per series: valid days, median and 90th percentile of absolute deviations, robust sigma."""
    v = b.filter("e is not null")
    return v.groupBy("series").agg(F.count("*").alias("n"), F.median(F.abs("e")).alias("median_abs"), F.percentile(F.abs(F.col("e")), 0.9).alias("p90_abs")).join(mad(v, "series", "e"), "series").select("series", "n", "median_abs", "p90_abs", (C.MAD_SCALE * F.col("mad")).alias("sigma"))


def naive(series: DataFrame, k: float = C.K) -> DataFrame:
    """Deviation from the median of the whole series, under the same threshold rule."""
    m = series.groupBy("series").agg(F.median("value").alias("m"))
    e = series.join(m, "series").select("series", "day", "value", (F.col("value") / F.col("m") - 1).alias("e"))
    limits = mad(e, "series", "e").select("series", (k * C.MAD_SCALE * F.col("mad")).alias("threshold"))
    return e.join(limits, "series").withColumn("signal", classify(F.col("e"), F.col("threshold")))


def compare(a: DataFrame, b: DataFrame, fields: list[str], keys: tuple[str, ...] = ("series", "day")) -> DataFrame:
    """Rows in one table only, and differences of each field (NULL equals NULL), in one full join."""
    x = a.select(*keys, F.lit(True).alias("in_a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    y = b.select(*keys, F.lit(True).alias("in_b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    j = x.join(y, list(keys), "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    out = [F.count_if(both).alias("both"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b")]
    return j.agg(*out, *[F.count_if(both & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).alias(f"{f}_differs") for f in fields])


def latest(table: DataFrame) -> DataFrame:
    """The last row of each series."""
    rest = [c for c in table.columns if c not in ("series", "day")]
    return table.groupBy("series").agg(F.max_by(F.struct("day", *rest), "day").alias("s")).select("series", "s.*")


def ranked(b: DataFrame) -> DataFrame:
    """Rank of each day by absolute deviation in its series (the greatest first, equals share the best rank) and their number."""
    v = b.filter("e is not null")
    return v.withColumn("rank", F.rank().over(W.partitionBy("series").orderBy(F.round(F.abs("e"), 9).desc())).cast("long")).withColumn("n", F.count("*").over(W.partitionBy("series")))


def series_stats(series: DataFrame) -> DataFrame:
    """Mean, median, spread, robust spread, extremes, weekday and weekend means and their ratio."""
    end = F.weekday("day") >= 5
    g = series.groupBy("series").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg(F.when(~end, F.col("value"))).alias("weekdays"), F.avg(F.when(end, F.col("value"))).alias("weekend"),
    )
    g = g.join(mad(series, "series", "value"), "series")
    return g.select("series", "n", "mean", "median", "sd", (F.col("sd") / F.col("mean")).alias("rel_sd"), (C.MAD_SCALE * F.col("mad")).alias("robust_sd"), "min", "max", "weekdays", "weekend", (F.col("weekend") / F.col("weekdays")).alias("ratio"))


def yearly(series: DataFrame) -> DataFrame:
    """Monthly means and their change over twelve months, in percent. By month number, so missing months stay NULL."""
    m = series.groupBy("series", F.date_format("day", "yyyy-MM").alias("month")).agg(F.avg("value").alias("mean"), F.count("*").alias("days"))
    nth = (F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")).alias("nth")
    w = W.partitionBy("series").orderBy("nth").rangeBetween(-12, -12)
    return m.select("*", nth).withColumn("before", F.max("mean").over(w)).select("series", "month", "days", "mean", (100 * (F.col("mean") / F.col("before") - 1)).alias("change"))


def weekly(series: DataFrame, full_weeks_only: bool = False) -> DataFrame:
    """Sums over weeks from Monday; the first and last may be partial."""
    g = series.groupBy("series", F.to_date(F.date_trunc("WEEK", "day")).alias("week")).agg(F.sum("value").alias("value"), F.count("*").alias("days"))
    return g.filter("days = 7") if full_weeks_only else g


def average_rank(value: str, key: str | None = None) -> Column:
    """Rank with equals sharing their mean rank. Without a key for tables that a calendar bounds, one row a day."""
    part = W.partitionBy(key) if key else W.partitionBy()
    same = W.partitionBy(*([key] if key else []), value)
    return F.rank().over(part.orderBy(value)) + (F.count("*").over(same) - 1) / 2


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson and Spearman correlation and ratios of two daily series (day, value) on the days both have."""
    j = a.select("day", F.col("value").alias("x")).join(b.select("day", F.col("value").alias("y")), "day")
    r = j.withColumn("rx", average_rank("x")).withColumn("ry", average_rank("y"))
    return r.agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.avg(F.col("x") / F.col("y")).alias("mean_ratio"), F.min(F.col("x") / F.col("y")).alias("min_ratio"), F.max(F.col("x") / F.col("y")).alias("max_ratio"))


def false_alarms(table: DataFrame) -> DataFrame:
    """Signalled days by series and month, of days with a baseline."""
    v = table.filter(F.col("signal") != C.NO_BASE)
    return v.groupBy("series", F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("days"), F.count_if(F.col("signal").startswith("szokatlanul")).alias("signalled"))


def dictionary_codes(table: DataFrame, column: str) -> DataFrame:
    """Codes from 0 in order of the values. The dictionary is ranked, not the table."""
    codes = table.select(column).distinct().withColumn("code", (F.dense_rank().over(W.orderBy(column)) - 1).cast("long"))
    return table.join(codes, column)


def last_days(table: DataFrame, n: int) -> DataFrame:
    days = table.select("day").distinct().orderBy(F.col("day").desc()).limit(n)
    return table.join(F.broadcast(days), "day", "left_semi")


def open_alerts(table: DataFrame, opened: DataFrame) -> DataFrame:
    """What to do with alerts of the last day: open (new), keep (goes on), close (gone); at most one a series and direction."""
    last = table.agg(F.max("day").alias("day"))
    now = table.join(F.broadcast(last), "day", "left_semi").filter(F.col("signal").startswith("szokatlanul")).select("series", "signal", F.lit(True).alias("now"))
    j = now.join(opened.select("series", "signal", F.lit(True).alias("was")), ["series", "signal"], "full")
    return j.select("series", "signal", F.when(F.col("was").isNull(), "open").when(F.col("now").isNull(), "close").otherwise("keep").alias("action"))


def log_deviation(b: DataFrame) -> DataFrame:
    return b.withColumn("lr", log_ratio(F.col("value"), F.col("base")))
