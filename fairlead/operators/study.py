"""The window study: daily metrics, result tables, sensitivity, breakdowns, and series stitched over a calendar.

Metrics are ratios of sums, so a table by window and week holds all that estimates need. That table is a few dozen rows a
variant and metric whatever the days hold, and only it goes to the driver, for the resampling.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead import config as C
from fairlead.functions import text as T
from fairlead.operators import evaluate
from fairlead.operators.laden import rolling
from fairlead.operators.sets import assert_unique, union_tagged

#: A variant's limit of laden ships, and whether ships without orders leave the second metric.
Variants = dict[str, tuple[float, bool]]
MAIN: Variants = {"main": (C.TANKER_LIMIT, False)}


def daily_metrics(events: DataFrame, days: DataFrame, variants: Variants = MAIN, outward: str = "észak") -> DataFrame:
    """variant, day, window, block, h1, h2_top, h2_bottom, h3, outward, outward_evaluable, one; zeros where a day has none.

    `events` are tanker crossings with day, direction, evaluable, rel, plausible, length, width, draught and category; `days`
    are the days of the study with window and block. All variants come from one pass over the events.
    """
    table = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(k).alias("limit"), F.lit(skip).alias("skip")) for n, (k, skip) in variants.items()])
    e = events.filter(F.col("direction") == outward).withColumn("v", F.explode(table))
    laden = F.coalesce(F.col("evaluable") & (F.col("rel") >= F.col("v.limit")), F.lit(False))
    counted = laden & ~(F.col("v.skip") & F.coalesce(F.col("category") == T.CAT_ORDER, F.lit(False)))
    sums = e.groupBy(F.col("v.variant").alias("variant"), F.to_date("day").alias("day")).agg(
        F.count_if(laden).alias("h1"),
        F.count_if(counted & (F.col("category") == T.CAT_EAST)).alias("h2_top"),
        F.count_if(counted).alias("h2_bottom"),
        F.sum(F.when(F.col("plausible"), F.col("length") * F.col("width") * F.col("draught"))).alias("h3"),
        F.count("*").alias("outward"),
        F.count_if("evaluable").alias("outward_evaluable"),
    )
    whole = days.select("day", "window", "block").withColumn("variant", F.explode(F.array(*map(F.lit, variants)))).join(sums, ["variant", "day"], "left")
    found = [F.coalesce(c, F.lit(0)).alias(c) for c in ("h1", "h2_top", "h2_bottom", "h3", "outward", "outward_evaluable")]
    return whole.select("variant", "day", "window", "block", *found, F.lit(1).alias("one"))


def by_metric(daily: DataFrame) -> DataFrame:
    """One row a metric: metric, top and bottom beside the other columns."""
    parts = [F.struct(F.lit(m).alias("metric"), F.col(a).cast("double").alias("top"), F.col(b).cast("double").alias("bottom")) for m, (a, b) in C.METRICS.items()]
    return daily.withColumn("m", F.explode(F.array(*parts))).select("*", "m.*").drop("m")


def window_means(rows: DataFrame, by: list[str]) -> DataFrame:
    """Ratio of sums in each window and the difference of their differences, by the given columns and metric."""

    def mean(w: str) -> Column:
        here = F.col("window") == w
        return F.sum(F.when(here, F.col("top"))) / F.nullif(F.sum(F.when(here, F.col("bottom"))), F.lit(0.0))

    t = rows.groupBy(*by, "metric").agg(F.countDistinct("day").alias("days"), *[mean(w).alias(w) for w in C.WINDOWS])
    return t.withColumn("did", (F.col("B26") - F.col("A26")) - (F.col("B25") - F.col("A25")))


def weekday_breakdown(daily: DataFrame, weekdays: tuple[int, ...] = C.SAMPLE_WEEKDAYS) -> DataFrame:
    """Window means on the sampled weekdays, on the other days and on all."""
    part = F.when(F.weekday("day").isin(*weekdays), "sampled").otherwise("other")
    return window_means(by_metric(daily).withColumn("subset", F.explode(F.array(part, F.lit("all")))), ["variant", "subset"])


def _blocks(daily: DataFrame) -> dict[tuple[str, str], list]:
    """Block sums of each variant and metric on the driver, in the order of windows and weeks."""
    sums = by_metric(daily).groupBy("variant", "metric", "window", "block").agg(F.sum("top").alias("top"), F.sum("bottom").alias("bottom"))
    out: dict[tuple[str, str], list] = {}
    for r in sorted(sums.collect(), key=lambda r: (r.variant, r.metric, r.window, r.block)):
        out.setdefault((r.variant, r.metric), []).append(r)
    return out


def result_table(daily: DataFrame, n: int = C.BOOTSTRAP_N, alpha: float = C.ALPHA) -> DataFrame:
    """variant, metric, window means, did, 95 % and Holm-level intervals, p, Holm's columns, standard error and smallest effects.

    Holm's rule runs over the metrics of one variant. `effect_holm` is the smallest effect at the first of Holm's levels.
    """
    spark, schema = daily.sparkSession, "variant string, metric string, " + ", ".join(f"{w} double" for w in C.WINDOWS) + ", did double, low double, high double, p double, se double, effect double, effect_holm double, at array<double>"
    rows, found = [], _blocks(daily)
    for (variant, metric), blocks in found.items():
        weeks = evaluate.week_tables(blocks)
        point, draws = evaluate.draw_did([weeks], n)
        means = [evaluate.ratio(weeks[w]) for w in C.WINDOWS]
        m = sum(v == variant for v, _ in found)
        se, effect = evaluate.mde(draws, alpha=alpha)
        at = [x for i in range(1, m + 1) for x in evaluate.interval(draws, alpha / i)]
        rows.append((variant, metric, *map(float, means), point, *evaluate.interval(draws, alpha), evaluate.bootstrap_p(draws), se, effect, evaluate.mde(draws, alpha=alpha / m)[1], at))
    t = spark.createDataFrame(rows, schema)
    h = evaluate.holm(t.select("variant", F.col("metric").alias("name"), "p"), alpha, ("variant",)).withColumnRenamed("name", "metric").drop("p")
    place = 2 * (F.count("*").over(W.partitionBy("variant")) - F.col("rank")) + 1
    t = t.join(h, ["variant", "metric"]).withColumns({"holm_low": F.element_at("at", place.cast("int")), "holm_high": F.element_at("at", (place + 1).cast("int"))})
    return t.withColumn("effect_share", F.col("effect") / F.nullif(F.abs("A26"), F.lit(0.0))).drop("at")


def sensitivity(results: DataFrame, main: str = "main", claims: tuple[str, ...] = ("H1", "H2")) -> DataFrame:
    """variant, metric, did, low, high, found (zero outside the interval), found_holm, claim (any of the claimed metrics), changes."""
    per = results.groupBy("variant").agg(F.bool_or(F.col("rejected") & F.col("metric").isin(*claims)).alias("claim"))
    per = per.withColumn("main_claim", F.max(F.when(F.col("variant") == main, F.col("claim"))).over(W.partitionBy()))
    t = results.filter(F.col("metric").isin(*claims)).join(per, "variant")
    return t.select("variant", "metric", "did", "low", "high", (~F.lit(0.0).between(F.col("low"), F.col("high"))).alias("found"), F.col("rejected").alias("found_holm"), "claim", (F.col("claim") != F.col("main_claim")).alias("changes"))


def compare_samples(claims: tuple[str, ...] = ("H1", "H2"), **results: DataFrame) -> DataFrame:
    """Result tables of several samples below one another, each with its sample's claim."""
    t = union_tagged(**results)
    return t.withColumn("claim", F.bool_or(F.col("rejected") & F.col("metric").isin(*claims)).over(W.partitionBy("kind", "variant")))


def window_intervals(daily: DataFrame, n: int = C.BOOTSTRAP_N, seed: int = C.DID_SEED) -> DataFrame:
    """variant, metric, window, mean, low, high: weeks of one window drawn with replacement, each window from the same seed."""
    rows = []
    for (variant, metric), blocks in _blocks(daily).items():
        for w, weeks in evaluate.week_tables(blocks).items():
            if len(weeks) == 0:
                continue
            r = np.random.default_rng(seed)
            draws = np.array([evaluate.ratio(weeks[r.integers(0, len(weeks), len(weeks))]) for _ in range(n)])
            low, high = evaluate.interval(draws) if not np.isnan(draws).all() else (None, None)
            rows.append((variant, metric, w, float(evaluate.ratio(weeks)), low, high))
    return daily.sparkSession.createDataFrame(rows, "variant string, metric string, window string, mean double, low double, high double")


def stitched(parts: list[DataFrame], first: str, last: str, mean_days: int = C.ROLLING_DAYS) -> DataFrame:
    """series, day, value, rolled: files of (series, day, value) as one calendar, NULL on days that none holds.

    Raises if two files hold the same series and day. The calendar is made a series at a time, so nothing is crossed.
    """
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = assert_unique(rows.withColumn("day", F.to_date("day")), ["series", "day"]).filter(F.col("day").between(first, last))
    every = rows.select("series").distinct().withColumn("day", F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))))
    return rolling(every.join(rows, ["series", "day"], "left"), mean_days, mean=True)


def completion(days: DataFrame, log: DataFrame) -> DataFrame:
    """window, days, done, left: sampled days of each window and how many the log calls done."""
    done = log.filter("status = 'kesz'").select("day").distinct().withColumn("done", F.lit(1))
    t = days.join(done, "day", "left").groupBy("window").agg(F.count("*").alias("days"), F.coalesce(F.sum("done"), F.lit(0)).alias("done"))
    return t.withColumn("left", F.col("days") - F.col("done"))
