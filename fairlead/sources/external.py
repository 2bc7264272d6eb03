"""Small external tables: gazetteer, strait series, CI logs, size estimates. Downloads are left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.operators.destinations import gazetteer

#: Fixed value: fields of the strait series.
STRAIT_FIELDS = "date date, portid string, portname string, n_container int, n_dry_bulk int, n_general_cargo int, n_roro int, n_tanker int, n_cargo int, n_total int, capacity_container double, capacity_dry_bulk double, capacity_general_cargo double, capacity_roro double, capacity_tanker double, capacity_cargo double, capacity double"


def read_gazetteer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return gazetteer(spark.read.option("header", True).option("quote", '"').csv(path))


def read_strait(spark: SparkSession, path: str, name: str, field: str = "n_total") -> DataFrame:
    """series, day, value of one strait; days that are missing stay missing."""
    t = spark.read.option("header", True).schema(STRAIT_FIELDS).csv(path).filter(F.col("portname") == name)
    return t.select(F.lit(name).alias("series"), F.col("date").alias("day"), F.col(field).cast("double").alias("value"))


def validated_days(log: DataFrame, day: str = r"nap:\s*(\d{4}-\d{2}-\d{2})", rows: str = r"sorok:\s*(\d+)") -> DataFrame:
    """One row per validated day of a CI log (file, line, value): a day holds until the next is named."""
    w = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    named = F.nullif(F.regexp_extract("value", day, 1), F.lit(""))
    t = log.withColumn("day", F.last(named, ignorenulls=True).over(w)).withColumn("rows", F.regexp_extract("value", rows, 1).try_cast("long"))
    return t.filter("rows is not null and day is not null").groupBy("file", "day").agg(F.max_by("rows", "line").alias("rows"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files with their file and place."""
    t = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return t.select("file", "line", "value")


def reconcile(log: DataFrame, store: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Days whose log and store figures (day, mib) differ by more than the tolerance, or that one side lacks."""
    j = log.select("day", F.col("mib").alias("log_mib")).join(store.select("day", F.col("mib").alias("store_mib")), "day", "full")
    return j.filter(F.col("log_mib").isNull() | F.col("store_mib").isNull() | (F.abs(F.col("log_mib") - F.col("store_mib")) > tolerance))


def monthly_size(sizes: DataFrame, ratio_low: float, ratio_high: float) -> DataFrame:
    """month, bytes, low, high: raw sizes (day, bytes) times the measured band of store to raw."""
    m = sizes.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("bytes").alias("bytes"))
    return m.withColumn("low", F.col("bytes") * ratio_low).withColumn("high", F.col("bytes") * ratio_high)
