"""Layouts, GeoParquet, ZIP scans and the cache of a backfill."""

import io
import json
import struct
import zipfile
from dataclasses import replace
from datetime import date

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fairlead import config as C
from fairlead.functions.cells import GridIndex
from fairlead.operators import traffic
from fairlead.plans import adapter, backfill, daily
from fairlead.sources import geo, ingest, layouts, zipped


@pytest.fixture(scope="module")
def positions(spark, sf_dir):
    return adapter.positions(spark, sf_dir).cache()


def test_layouts_answer_alike_and_each_skips_along_its_order(spark, positions, tmp_path):
    paths = layouts.write_layouts(positions, str(tmp_path), group_rows=50, partitions=4)
    box, start, end = C.Box(55.28, 55.40, 10.85, 11.15), "2024-01-10 09:00:00", "2024-01-12 10:00:00"
    got = {r.layout: r for r in layouts.trial(spark, paths, start, end, box).collect()}
    assert set(got) == {"ship", "ship_cell", "ship_cell by cell", "cell", "cell by cell", "time"}
    rows = [(r.mmsi, r.lat, r.lon, str(r.ts)) for r in positions.select("mmsi", "lat", "lon", "ts").collect()]
    here = [m for m, la, lo, _ in rows if 55.28 <= la <= 55.40 and 10.85 <= lo <= 11.15]
    assert {(r.box_ships, r.box_rows, r.time_rows) for r in got.values()} == {(len(set(here)), len(here), sum(start <= t < end for *_, t in rows))}
    assert got["time"].groups >= 15 and got["time"].to_read_time < got["ship"].to_read_time
    assert got["cell"].to_read_box < got["time"].to_read_box
    sweep = layouts.sweep_groups(spark, paths, traffic.sweep_boxes()).collect()
    assert all(r.to_read <= r.groups for r in sweep) and len(sweep) == 4 * len(C.SWEEP_HEIGHTS)
    assert sum(r.to_read for r in sweep if r.layout == "cell") < sum(r.to_read for r in sweep if r.layout == "time")


def test_cells_of_a_box_hold_all_its_points():
    index, box = GridIndex(), C.Box(55.28, 55.40, 10.85, 11.15)
    cells = set(layouts.cells_of(box, index))
    assert all(index.of(55.28 + 0.12 * i / 40, 10.85 + 0.30 * j / 40) in cells for i in range(41) for j in range(41))


def test_geoparquet_keeps_points_and_filters_on_the_covering_box(spark, tmp_path):
    rows = [(1, 55.3, 11.0), (2, 55.39, 10.9), (3, 60.0, 11.0), (4, None, 11.0), (5, -90.0, -180.0)]
    p = spark.createDataFrame(rows, "mmsi long, lat double, lon double").repartition(2)
    path = str(tmp_path / "points")
    geo.write_geoparquet(p, path, group_rows=2)
    back = geo.read_geoparquet(spark, path)
    points = {r.mmsi: r.geometry for r in back.collect()}
    assert {m: None if g is None else struct.unpack("<BIdd", bytes(g)) for m, g in points.items()} == {m: None if la is None else (1, 1, lo, la) for m, la, lo in rows}
    inside = geo.in_bbox(back, C.TRIAL_BOX)
    assert {r.mmsi for r in inside.collect()} == {1, 2}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    scan = spark._jvm.PythonSQLUtils.explainString(inside._jdf.queryExecution(), "formatted")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = next(line for line in scan.splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(bbox.ymin" in pushed and "(bbox.xmin" in pushed
    files = list((tmp_path / "points").iterdir())
    about = json.loads(pq.read_metadata(files[0]).metadata[b"geo"])
    assert about["primary_column"] == "geometry" and all(f.name.startswith("part-") for f in files)


def test_geoparquet_of_an_empty_table_writes_nothing_and_of_a_failure_leaves_nothing(spark, tmp_path):
    p = spark.createDataFrame([(1, 55.0, 11.0)], "mmsi long, lat double, lon double")
    geo.write_geoparquet(p.filter("false"), str(tmp_path / "empty"))
    with pytest.raises(Exception, match="stop"):
        geo.write_geoparquet(p.withColumn("lat", F.when(F.col("mmsi") == 1, F.raise_error(F.lit("stop"))).cast("double")), str(tmp_path / "failed"))
    assert not list(tmp_path.glob("failed/*"))


HEAD = "﻿# Timestamp,MMSI,Latitude,Name"


def _archive(path, lines, name="day.csv", end=""):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, "\n".join(lines) + end)


def test_zip_is_read_in_place_as_spark_reads_the_extracted_file(spark, tmp_path):
    lines = [HEAD, *(f'15/07/2026 12:00:{i % 60:02d},{i},55.{i % 10},"A, {i}"' for i in range(5000)), "x,,,"]
    _archive(tmp_path / "a.zip", lines, end="\n")
    _archive(tmp_path / "b.zip", [HEAD, "y,7,1.5,last"])
    csv, count = ingest.unzip_day(str(tmp_path / "a.zip"), str(tmp_path))
    assert zipped.count_lines(str(tmp_path / "a.zip")) == count == 5001 and zipped.count_lines(str(tmp_path / "b.zip")) == 1
    one = zipped.read_zip(spark, str(tmp_path / "a.zip"))
    want = ingest.read_raw(spark, csv)
    assert one.columns == want.columns
    assert [tuple(r) for r in one.drop("rn").collect()] == [tuple(r) for r in want.orderBy("rn").drop("rn").collect()]
    both = zipped.read_zip(spark, str(tmp_path), ["MMSI", "Name"])
    assert both.columns == ["MMSI", "Name", "rn"] and both.rdd.getNumPartitions() == 2
    got = [r.MMSI for r in both.orderBy("rn").collect()]
    assert got == [*map(str, range(5000)), None, "7"]
    assert ingest.to_store(zipped.read_zip(spark, str(tmp_path / "b.zip")).select("*", *[F.lit(None).cast("string").alias(c) for c, *_ in ingest.COLUMNS if c not in ("MMSI", "Latitude", "Name")])).first().mmsi == 7


def test_zip_with_short_lines_or_two_tables_is_an_error_and_a_bare_header_no_rows(spark, tmp_path):
    _archive(tmp_path / "short.zip", [HEAD, "a,1"])
    with pytest.raises(Exception, match="columns"):
        zipped.read_zip(spark, str(tmp_path / "short.zip")).collect()
    _archive(tmp_path / "bare.zip", [HEAD], end="\n")
    assert zipped.read_zip(spark, str(tmp_path / "bare.zip")).count() == 0 and zipped.count_lines(str(tmp_path / "bare.zip")) == 0
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.csv", io.StringIO(HEAD).getvalue())
        z.writestr("b.csv", HEAD)
    with pytest.raises(Exception, match="2 tables"):
        zipped.read_zip(spark, str(tmp_path / "two.zip"))


def test_backfill_makes_only_what_is_new_or_changed(spark, positions, tmp_path):
    days = {}
    for d, part in ((date(2024, 1, 10), F.col("mmsi") % 2 == 0), (date(2024, 1, 11), F.col("mmsi") % 2 == 1)):
        days[d] = str(tmp_path / f"{d}")
        positions.filter(part).write.parquet(days[d])
    belt, alone = adapter.BELT, replace(adapter.NORTH, monitor=False)
    how, out = {"max_gap_s": adapter.GAP_S, "order": "event_id"}, str(tmp_path / "out")
    assert len(backfill.backfill(spark, days, [belt, alone], out, **how)) == 4
    assert backfill.backfill(spark, days, [alone, belt], out, **how) == []
    got = backfill.filled(spark, [belt, alone], out)
    columns = ["mmsi", "ts", "direction", "gate", "ship_group", "draught"]
    want = [daily.day_crossings(spark.read.parquet(p), pool, **how).select(*columns) for p in days.values() for pool in ([belt], [alone])]
    rows = sorted(tuple(map(str, r)) for w in want for r in w.collect())
    assert rows and sorted(tuple(map(str, r)) for r in got.select(*columns).collect()) == rows
    moved = replace(alone, b=(55.61, 11.35))
    assert backfill.backfill(spark, days, [belt, moved], out, **how) == [(backfill.fingerprint([moved]), d) for d in days]
    assert {r.gate for r in backfill.filled(spark, [belt], out).select("gate").collect()} <= {belt.name}
    assert backfill.pools([alone, belt, adapter.NORTH]) != backfill.pools([belt])
