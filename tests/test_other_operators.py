import math
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

from fairlead import config as C
from fairlead.functions import text as T
from fairlead.operators import asof, destinations, evaluate, gates, laden, sets, traffic, trajectory
from pyspark.sql import functions as F

T0 = datetime(2026, 7, 15, 12)


def plain_scan(t, lat, lon, sog, cog, limit, gap):
    kept = [True]
    a = 0
    for i in range(1, len(t)):
        ok = sog[a] < C.SOG_INVALID and cog[a] < C.COG_INVALID
        if t[i] - t[a] > gap or not ok:
            kept.append(True)
            a = i
            continue
        way, ang, sh = sog[a] * C.KNOT * (t[i] - t[a]), math.radians(cog[a]), math.cos(math.radians(lat[a]))
        dy = (lat[i] - (lat[a] + way * math.cos(ang) / C.METRES_PER_DEGREE)) * C.METRES_PER_DEGREE
        dx = (lon[i] - (lon[a] + way * math.sin(ang) / (C.METRES_PER_DEGREE * sh))) * C.METRES_PER_DEGREE * sh
        kept.append(math.hypot(dx, dy) > limit)
        if kept[-1]:
            a = i
    return kept


@pytest.mark.parametrize("limit", [10.0, 50.0, 500.0])
def test_dead_reckoning_is_the_plain_scan(spark, limit):
    r = np.random.default_rng(2)
    rows = []
    for ship in range(3):
        t = np.cumsum(r.integers(1, 40, 400)) + (np.arange(400) > 200) * 700
        sog = np.where(r.random(400) < 0.02, 102.3, 10 + r.normal(size=400))
        cog = np.where(r.random(400) < 0.02, 360.0, 90 + 5 * r.normal(size=400))
        lat, lon = 55 + np.cumsum(r.normal(size=400)) * 1e-4, 11 + t * 8e-5
        rows += [(ship, i, T0 + timedelta(seconds=int(t[i])), float(lat[i]), float(lon[i]), float(sog[i]), float(cog[i])) for i in range(400)]
    p = spark.createDataFrame(rows, "mmsi long, event_id long, ts timestamp_ntz, lat double, lon double, sog double, cog double")
    got = {(x.mmsi, x.event_id): (x.kept, x.error) for x in trajectory.dead_reckoning(p, (limit,)).collect()}
    for ship in range(3):
        own = [x for x in rows if x[0] == ship]
        want = plain_scan([(x[2] - T0).total_seconds() for x in own], *([x[i] for x in own] for i in (3, 4, 5, 6)), limit, 600)
        assert [got[ship, i][0] for i in range(400)] == want
    assert all(e is None or e <= limit for _, e in got.values())


FIXTURE = [
    ("NLRTM", "EU/EGT/UK", "EU/EGT/UK"), ("NL RTM", "EU/EGT/UK", "EU/EGT/UK"), ("BEANR VIA DENOK", T.CAT_NONE, "EU/EGT/UK"), ("EGPSD VIA SKAW", T.CAT_NONE, T.CAT_EAST),
    ("RU ULU>NL RTM", T.CAT_NONE, "RU"), ("CNSHA/SGSIN", T.CAT_NONE, T.CAT_EAST), ("TO NLRTM", T.CAT_NONE, "EU/EGT/UK"), ("NLRTM FOR ORDERS", T.CAT_ORDER, "EU/EGT/UK"),
    ("FOR ORDERS", T.CAT_ORDER, T.CAT_ORDER), ("PORT SAID", T.CAT_EAST, T.CAT_EAST), ("SKAGEN", T.CAT_NONE, T.CAT_NONE), ("AT SEA", T.CAT_NONE, T.CAT_NONE), (None, T.CAT_NONE, T.CAT_NONE),
]


def test_categories_by_hand(spark):
    codes = spark.createDataFrame([(c,) for c in ("NLRTM", "BEANR", "EGPSD", "RUULU", "CNSHA", "SGSIN", "DENOK")], "code string")
    rows = spark.createDataFrame([(i, f[0]) for i, f in enumerate(FIXTURE)], "id int, raw string")
    for lenient, at in ((False, 1), (True, 2)):
        got = {r.id: r.category for r in destinations.categorise(rows, "raw", codes, lenient).collect()}
        assert [got[i] for i in range(len(FIXTURE))] == [f[at] for f in FIXTURE]


def test_gazetteer_and_prefix_trap(spark):
    raw = spark.createDataFrame([("BA", "LTI", "Laktasi", "Laktasi", "--3-----", "4454N 01718E"), ("DE", "BRV", "Bremerhaven", "Bremerhaven", "12345---", "5332N 00835E"), ("FR", "BES", "Brest", "Brest", "1-------", "4823N 00429W")], "Country string, Location string, Name string, NameWoDiacritics string, Function string, Coordinates string")
    codes, names = destinations.gazetteer(raw)
    c = {r.code: r for r in codes.collect()}
    assert c["FRBES"].lon == pytest.approx(-4.4833, abs=1e-3) and c["DEBRV"].lat == pytest.approx(53.5333, abs=1e-3)
    rows = spark.createDataFrame([(0, "BALTIJSK"), (1, "Bremerhaven"), (2, "brest"), (3, "debrv 2"), (4, "")], "id int, raw string")
    got = {r.id: (r.code, r.level) for r in destinations.resolve(rows, "raw", codes, names).collect()}
    assert got == {0: (None, "nincs"), 1: ("DEBRV", "nev"), 2: ("FRBES", "nev"), 3: ("DEBRV", "prefix"), 4: (None, "ures")}


def test_as_of_is_inclusive_and_keeps_all_rows(spark):
    s = "id long, mmsi long, ts timestamp_ntz"
    left = spark.createDataFrame([(1, 1, T0), (2, 1, T0 + timedelta(seconds=5)), (3, 2, T0)], s)
    right = spark.createDataFrame([(1, T0, "a", 1), (1, T0 + timedelta(seconds=6), "b", 2)], "mmsi long, ts timestamp_ntz, v string, tie long")
    got = {r.id: (r.v, r.v_next) for r in asof.as_of_both(left, right, "mmsi", "ts", "v").collect()}
    assert got == {1: ("a", "a"), 2: ("a", "b"), 3: (None, None)}


def test_vote_ties_go_to_the_least_value(spark):
    p = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "c"), (2, "a")], "mmsi long, v string")
    assert {r.mmsi: r.value for r in traffic.vote(p, F.col("v")).collect()} == {1: "a", 2: "c"}


def test_ship_groups_by_order(spark):
    raw = ["Cargo", "Tanker", "SAR", "HSC", "Sailing", "Law enforcement", None]
    got = [r.g for r in spark.createDataFrame([(x,) for x in raw], "x string").select(T.ship_group(F.col("x")).alias("g")).collect()]
    assert got == ["Teherhajó", "Tanker", T.OTHER, T.OTHER, "Kedvtelési", "Szolgálati", T.OTHER]


def test_small_operators_that_no_query_calls(spark):
    """Keep last, priority order, decision, box area, half-open windows, samples that depend on keys alone."""
    t = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c")], "k int, o int, v string")
    assert sorted((r.k, r.v) for r in traffic.keep_last(t, ["k"], "o").collect()) == [(1, "b"), (2, "c")]
    tests = spark.createDataFrame([("H1", False), ("H2", True), ("H3", True)], "name string, rejected boolean")
    assert evaluate.decision(tests).first().effect and not evaluate.decision(tests, ("H1",)).first().effect
    p = spark.range(20_000).select("id")
    half = {r.id for r in traffic.hash_sample(p, 0.5, "id").collect()}
    assert abs(len(half) - 10_000) < 400 and half == {r.id for r in traffic.hash_sample(p.repartition(7), 0.5, "id").collect()}
    assert half != {r.id for r in traffic.hash_sample(p, 0.5, "id", seed=1).collect()}


def test_draught_at_a_crossing_and_a_synthetic_decrease(spark):
    day = datetime(2024, 1, 3, 5)
    events = spark.createDataFrame([(1, day), (2, day), (3, day)], "mmsi long, ts timestamp_ntz")
    seen = spark.createDataFrame([(1, 8.25), (2, 0.4)], "mmsi long, median double")
    own = spark.createDataFrame([("2024-01-03", m, 6.0 + m, 100.0, 20.0) for m in (1, 2)], "day string, mmsi long, draught double, length double, width double")
    got = {r.mmsi: r.draught for r in laden.draught_at_crossing(events, seen, own).collect()}
    assert got == {1: 8.2, 2: 8.0, 3: None}
    rel = spark.createDataFrame([(m, day, "2024-01-03", "Tanker", True, 0.9) for m in range(2000)], "mmsi long, ts timestamp_ntz, day string, ship_group string, evaluable boolean, rel double")
    limits = spark.createDataFrame([("Tanker", 0.8)], "ship_group string, threshold double")
    low = laden.synthetic_decrease(rel, limits, "2024-01-01", 0.3).filter("rel < 0.8")
    assert 500 < low.count() < 700 and low.select("rel").distinct().count() == 1
    assert laden.synthetic_decrease(rel, limits, "2024-01-08", 0.3).filter("rel < 0.8").count() == 0


#: Days of a ship of a large table: its day at 3.216 over its 95th percentile lies on the edge between bins 8 and 9.
EDGE_SHIP = [1.2555, 1.5725, 1.716, 1.9537499999999999, 2.2545, 2.3835, 2.886, 2.9305, 3.146, 3.2159999999999997, 3.5164999999999997, 3.5744999999999996, 3.636, 3.8175, 3.8907499999999997, 4.1785, 4.192, 4.227, 4.386, 4.4052500000000006, 4.67725, 6.7700000000000005, 6.806, 6.8745, 7.14175]


def test_a_ships_maximum_has_the_bits_of_sql_and_an_edge_falls_in_its_bin(spark, tmp_path):
    r = np.random.default_rng(9)
    ships = [EDGE_SHIP, [7.3], [4.1, 4.1]] + [list(r.integers(2000, 50000, n) / 2000) for n in r.integers(2, 80, 150)] + [list(np.repeat(r.integers(2000, 50000, 4) / 2000, r.integers(2, 9, 4))) for _ in range(50)]
    spark.createDataFrame([(i, float(d)) for i, ship in enumerate(ships) for d in ship], "mmsi long, draught double").write.parquet(f"{tmp_path}/history")
    history = spark.read.parquet(f"{tmp_path}/history")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW D AS SELECT * FROM '{tmp_path}/history/*.parquet'")
    con.execute("CREATE VIEW HM AS SELECT mmsi, quantile_cont(draught, 0.95) AS max_draught, count(DISTINCT draught) AS values, count(*) AS days FROM D GROUP BY 1")
    most = laden.ship_max(history)
    assert sorted(map(tuple, most.collect())) == con.execute("SELECT * FROM HM ORDER BY mmsi").fetchall()
    bins = traffic.histogram(laden.relative(history, most), "mmsi", "rel", 0.3, 1.2, 48)
    assert sorted(map(tuple, bins.collect())) == con.execute("SELECT mmsi, CAST(least(floor((rel - 0.3::DOUBLE) / (1.2::DOUBLE - 0.3::DOUBLE) * 48), 47) AS INT) AS bin, count(*) AS n FROM (SELECT mmsi, draught / max_draught AS rel FROM D JOIN HM USING (mmsi) WHERE values >= 2) WHERE rel BETWEEN 0.3::DOUBLE AND 1.2::DOUBLE GROUP BY 1, 2 ORDER BY 1, 2").fetchall()


def test_concentration_ranks_in_parts_as_it_would_whole(spark):
    r = np.random.default_rng(0)
    rows = [(int(m), datetime(2024, 1, 1 + int(d)), "u", "g", "Tanker") for m, d in zip(r.integers(0, 60, 900), r.integers(0, 9, 900), strict=True)]
    got = gates.concentration(spark.createDataFrame(rows, "mmsi long, ts timestamp_ntz, direction string, gate string, ship_group string")).first()
    counts = sorted((sum(x[0] == m for x in rows) for m in range(60)), reverse=True)
    assert got.top5_share == pytest.approx(sum(counts[:5]) / 900) and got.ships == 60 and got.top1_per_day == pytest.approx(counts[0] / 9)


def test_week_bootstrap_and_log_difference(spark):
    days = [(datetime(2024, 1, 1).date() + timedelta(days=i), float(i % 5), 2.0) for i in range(70)]
    low, high, weeks = evaluate.week_bootstrap(spark.createDataFrame(days, "day date, top double, bottom double"), "top", "bottom", n=200)
    assert weeks == 10 and low < sum(d[1] for d in days) / 140 < high
    rows = [(w, days[7 * i][0], float(10 + i + 5 * j), 2.0) for j, w in enumerate(C.WINDOWS) for i in range(6)]
    b = spark.createDataFrame(rows, "window string, block date, top double, bottom double")
    mean = {w: sum(r[2] for r in rows if r[0] == w) / 12 for w in C.WINDOWS}
    assert evaluate.bootstrap_did(b, n=3, log=True)[0] == pytest.approx(math.log(mean["B26"] / mean["A26"]) - math.log(mean["B25"] / mean["A25"]))
