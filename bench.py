"""Run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Besides, a generated day of positions of the size that the published times are of (16.64 million stored rows for 36.65
million raw ones) is written once to a temporary folder; the four benchmark queries, dead reckoning and the day's
crossings run on it (`day`). $BENCH_DAY_ROWS changes its rows; 0 leaves it out.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.cells import GridIndex
from fairlead.functions.numbers import in_box
from fairlead.operators import gates, trajectory
from fairlead.plans import daily
from fairlead.plans.queries import QUERIES
from fairlead.session import session
from fairlead.sources.ingest import write_store

HEADLINE = ["count_rows", "distinct_ships", "bbox_count", "hourly_bbox", "hourly_bbox_weighted", "dedup_multiplicity", "vote_ship_type", "gate_crossings", "crossing_daily", "through_traffic", "asof_backward", "resample_grid", "dr_compress", "relative_draught", "signal_rule", "walk_forward", "did_point"]
DAY_ROWS, SHIPS = 16_640_000, 4_000


def made_day(spark: SparkSession, rows: int) -> DataFrame:
    """A day of ships that sail on straight lines over a sea larger than the study box and turn every hour."""
    p = spark.range(rows).select((F.col("id") % SHIPS).alias("mmsi"), F.floor(F.col("id") / SHIPS).alias("k"))
    p = p.withColumn("s", F.col("k") * F.lit(86_400.0 * SHIPS / rows))
    h = lambda salt, n: F.pmod(F.xxhash64("mmsi", F.lit(salt)), F.lit(n))
    sog, cog = 4.0 + h(1, 160) / 10.0, F.pmod(h(2, 360) + F.floor(F.col("s") / 3600) * 180, F.lit(360)).cast("double")
    inside = F.pmod(F.col("s"), F.lit(7200.0))
    way = F.when(inside < 3600, inside).otherwise(7200 - inside) * sog * 0.514444 / 111_320
    lat, lon = 53.0 + h(3, 6000) / 1000.0 + way * F.cos(F.radians(h(2, 360))), 7.0 + h(4, 9000) / 1000.0 + way * F.sin(F.radians(h(2, 360))) * 1.75
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Cargo", "Tanker", "Passenger", "Undefined")]), (h(5, 4) + 1).cast("int"))
    day = p.select("mmsi", F.timestamp_seconds(F.lit(1_784_073_600) + F.col("s")).cast("timestamp_ntz").alias("ts"), lat.alias("lat"), lon.alias("lon"), sog.alias("sog"), cog.alias("cog"), kind.alias("ship_type"), (h(6, 150) / 10.0).alias("draught"), (1 + F.pmod(F.col("k"), F.lit(4))).cast("int").alias("dup_db"), F.lit(1).cast("short").alias("ord"))
    return day.withColumn("cell", GridIndex().cell(F.col("lat"), F.col("lon")))


def timed(run, times: int = 3) -> float:
    found = []
    for _ in range(times):
        start = time.perf_counter()
        run()
        found.append(time.perf_counter() - start)
    return round(statistics.median(found), 4)


def noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def day_times(spark: SparkSession, rows: int) -> dict[str, float]:
    folder = tempfile.mkdtemp(prefix="fairlead-bench-")
    try:
        path = f"{folder}/day"
        out = {"write_store": timed(lambda: write_store(made_day(spark, rows), path, 16), 1)}
        for name in ("rows", "ships", "box", "hourly"):
            out[name] = timed(lambda name=name: noop(daily.four_queries(spark, [path])[name]))
        out["four"] = round(sum(out[n] for n in ("rows", "ships", "box", "hourly")), 4)
        box = spark.read.parquet(path).filter(in_box(F.col("lat"), F.col("lon")))
        out["dead_reckoning"] = timed(lambda: noop(trajectory.dr_summary(trajectory.dead_reckoning(box, order="ord"))), 1)
        out["day_crossings"] = timed(lambda: noop(daily.day_crossings(spark.read.parquet(path), [gates.GREAT_BELT, gates.SOUND])))
        return {**out, "stored_rows": rows}
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: timed(lambda name=name: noop(QUERIES[name](spark, sf_dir))) for name in HEADLINE}
    rows = int(os.environ.get("BENCH_DAY_ROWS", DAY_ROWS))
    day = day_times(spark, rows) if rows else None
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "day": day}))
    spark.stop()


if __name__ == "__main__":
    main()
