import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from fairlead.plans import adapter, daily
from fairlead.sources import external, footers, ingest, sinks
from fairlead.streaming.hourly import crossing_stream, hourly_stream, read_positions

HEAD = "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,Navigational status,ROT,SOG,COG,IMO,Callsign,Name,Ship type,Width,Length,Draught,Destination"
ROW = "15/07/2026 12:00:0{s},Class A,{m},55.39,11.0,Moored,,10.5,90.0,1,X,\"A, B\",Cargo,20,100,7.5,NLRTM"


@pytest.fixture(scope="module")
def day(tmp_path_factory):
    d = tmp_path_factory.mktemp("day")
    lines = [HEAD, *(ROW.format(s=1, m=1) for _ in range(3)), ROW.format(s=1, m=2), ROW.format(s=2, m="x"), ROW.format(s=1, m=1).replace("55.39", "91")]
    with zipfile.ZipFile(d / "day.zip", "w") as z:
        z.writestr("day.csv", "\n".join(lines))
    return d


def test_ingest_conserves_rows(spark, day):
    assert ingest.zip_is_whole(str(day / "day.zip")) and not ingest.zip_is_whole(str(day / "none.zip"))
    csv, lines = ingest.unzip_day(str(day / "day.zip"), str(day))
    assert lines == 6
    path = ingest.store_path(str(day), date(2026, 7, 15))
    found = ingest.ingest_day(spark, csv, path, lines)
    assert (found["rows"], found["raw_rows"], found["no_cell"]) == (4, 6, 1)
    s = spark.read.parquet(path)
    assert {(r.mmsi, r.lat, r.dup_db) for r in s.collect()} == {(1, 55.39, 3), (2, 55.39, 1), (None, 55.39, 1), (1, 91.0, 1)}
    assert sorted(r.ord for r in s.filter("mmsi = 1").collect()) == [1, 2]
    with pytest.raises(ValueError):
        ingest.check_store(spark, path, 7)
    ingest.subset_store(spark, path, str(day / "sub"))
    f = footers.footers(spark, path)
    assert footers.skippable(f, "lat", 60.0, 70.0).first().groups > 0
    assert footers.groups_to_read(f, {"lat": (0.0, 1.0)}).count() == 0
    q = daily.four_queries(spark, [path])
    assert q["rows"].first().rows == 6 and q["ships"].first().ships == 2


def test_line_numbers_rise_through_files_and_blocks(spark, tmp_path):
    """Files of unlike sizes, small blocks: Spark packs them out of order, `rn` does not."""
    want = []
    for name, lines in (("a b.csv", 30_000), ("b.csv", 10), ("c.csv", 90_000)):
        rows = [f"{name},{i},{'x' * 30}" for i in range(lines)]
        (tmp_path / name).write_text("\n".join(["file,line,fill", *rows]) + "\n")
        want += [(name, str(i)) for i in range(lines)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        got = ingest.read_raw(spark, str(tmp_path)).select("file", "line", "rn").toArrow().to_pylist()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r["rn"] for r in got}) == len(want)
    assert [(r["file"], r["line"]) for r in sorted(got, key=lambda r: r["rn"])] == want


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "day int, v string")
    path = str(tmp_path / "t")
    sinks.upsert(t, path, ["day"])
    sinks.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "day int, v string"), path, ["day"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    sinks.upsert_days(t, str(tmp_path / "p"))
    sinks.upsert_days(t.filter("day = 2").withColumn("v", F.lit("z")), str(tmp_path / "p"))
    assert {(r.day, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, "a"), (2, "z")}
    sinks.atomic_csv(t, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    c = sinks.feed(spark, str(tmp_path / "feed"), {"x": spark.createDataFrame([(1, float("nan")), (2, 0.1234567)], "k int, v double")})
    assert c["x"]["rows"] == 2
    assert json.loads((tmp_path / "feed" / "x.json").read_text()) == [{"k": 1, "v": None}, {"k": 2, "v": 0.123457}]
    import base64
    import struct

    p = sinks.packed_track(spark.createDataFrame([(1, 0, 258), (1, 1, 65535)], "m int, o int, x int"), "m", "o", ["x"]).first()
    assert struct.unpack("<2H", base64.b64decode(p.x)) == (258, 65535)


def test_log_and_sizes(spark, tmp_path):
    (tmp_path / "a.log").write_text("nap: 2026-07-15\nx\nsorok: 12\nnap: 2026-07-16\nsorok: 7\nsorok: 8\n")
    got = {(r.day, r.rows) for r in external.validated_days(external.read_log(spark, str(tmp_path))).collect()}
    assert got == {("2026-07-15", 12), ("2026-07-16", 8)}
    m = external.monthly_size(spark.createDataFrame([(date(2026, 7, 1), 100), (date(2026, 7, 2), 50)], "day date, bytes long"), 0.2, 0.3).first()
    assert (m.bytes, m.low, m.high) == (150, 30.0, 45.0)
    assert daily.wanted_days(date(2026, 7, 10), {date(2026, 7, 5)}, 3, 3) == [date(2026, 7, 6), date(2026, 7, 7)]


def test_day_plan(spark, sf_dir):
    p = adapter.positions(spark, sf_dir).withColumn("ord", F.lit(1).cast("short"))
    e = daily.day_crossings(p, [adapter.BELT], max_gap_s=adapter.GAP_S)
    assert {"gate", "ship_group", "draught"} <= set(e.columns)
    s = daily.gate_series(spark.createDataFrame([("2026-01-01", "g", "észak", "Tanker", 2), ("2026-01-02", "h", "dél", "Tanker", 1)], "day string, gate string, direction string, ship_group string, crossings long"))
    assert s.count() == 6 and s.filter("series = 'Mindkét kapu'").count() == 2


def test_streams(spark, sf_dir, tmp_path):
    p = adapter.positions(spark, sf_dir)
    p.write.parquet(str(tmp_path / "in"))
    stream = read_positions(spark, str(tmp_path / "in"), p.schema)
    q = hourly_stream(stream).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    from fairlead import config as C
    from fairlead.functions.numbers import in_box

    assert spark.table("hours").agg(F.sum("messages")).first()[0] == p.filter(in_box(F.col("lat"), F.col("lon"), C.STUDY_BOX)).count()
    q = crossing_stream(stream, adapter.BELT, adapter.GAP_S, None).writeStream.outputMode("append").format("memory").queryName("cross").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    from fairlead.operators.gates import crossings

    assert spark.table("cross").count() == crossings(p, adapter.BELT, adapter.GAP_S).count()
