"""Queries over the benchmark tables, each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead import config as C
from fairlead.functions import text as T
from fairlead.functions.cells import GridIndex
from fairlead.functions.numbers import day_text, in_box, micros, resultant_length
from fairlead.operators import asof, destinations, evaluate, gates, laden, sets, signals, study, traffic, trajectory
from fairlead.plans import adapter as A
from fairlead.plans import daily
from fairlead.sources import geo

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BOX = "lat BETWEEN 54.5 AND 55.4 AND lon BETWEEN 10.7 AND 11.2"
BOX_C = C.Box(54.5, 55.4, 10.7, 11.2)
DAY = "CAST(CAST(ts AS DATE) AS VARCHAR)"


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c: str):
    return F.round(c, 6).alias(c)


def text_day(df: DataFrame, c: str = "day") -> DataFrame:
    return df.withColumn(c, F.date_format(c, "yyyy-MM-dd"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- traffic -------------------------------------------------------------------------------------------------
@query("SELECT count(*) AS rows FROM lineitem")
def count_rows(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("rows"))


@query("SELECT count(DISTINCT user_id) AS ships FROM events")
def distinct_ships(spark, sf):
    return table(spark, sf, "events").agg(F.countDistinct("user_id").alias("ships"))


@query(f"WITH {A.P_SQL} SELECT count(*) AS rows FROM P WHERE {BOX}")
def bbox_count(spark, sf):
    return A.positions(spark, sf).filter(in_box(F.col("lat"), F.col("lon"), BOX_C)).agg(F.count("*").alias("rows"))


@query(f"WITH {A.P_SQL} SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS messages, count(DISTINCT mmsi) AS ships FROM P WHERE {BOX} GROUP BY 1 ORDER BY 1")
def hourly_bbox(spark, sf):
    return traffic.hourly_in_box(A.positions(spark, sf), BOX_C).orderBy("hour")


@query(f"WITH {A.P_SQL} SELECT CAST(hour(ts) AS BIGINT) AS hour, CAST(sum(dup_db) AS BIGINT) AS messages, count(DISTINCT mmsi) AS ships FROM P WHERE {BOX} GROUP BY 1 ORDER BY 1")
def hourly_bbox_weighted(spark, sf):
    return traffic.hourly_in_box(A.positions(spark, sf), BOX_C, "dup_db").orderBy("hour")


@query(f"WITH {A.P_SQL}, R AS (SELECT P.*, generate_series AS copy FROM P, generate_series(1, 3) WHERE generate_series <= dup_db) SELECT mmsi, epoch_us(ts) AS us, CAST(count(*) AS INT) AS dup_db, min(event_id * 10 + copy) AS first FROM R GROUP BY 1, 2, lat, lon, sog, cog, ship_type, destination")
def dedup_multiplicity(spark, sf):
    raw = traffic.replicate(A.positions(spark, sf)).withColumn("rn", F.col("event_id") * 10 + F.col("copy"))
    out = traffic.dedup_with_multiplicity(raw, ["mmsi", "ts", "lat", "lon", "sog", "cog", "ship_type", "destination"], "rn")
    return out.select("mmsi", micros("ts").alias("us"), "dup_db", "first")


@query(f"WITH {A.P_SQL} SELECT mmsi, epoch_us(ts) AS us, event_id FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, ts ORDER BY event_id) AS r FROM P) WHERE r = 1")
def dedup_keep_first(spark, sf):
    p = traffic.replicate(A.positions(spark, sf)).select("mmsi", "ts", "event_id")
    return traffic.keep_first(p, ["mmsi", "ts"], "event_id").select("mmsi", micros("ts").alias("us"), "event_id")


@query(f"WITH {A.P_SQL} SELECT event_id, CAST(row_number() OVER (PARTITION BY mmsi, ts ORDER BY event_id) AS SMALLINT) AS ord FROM P")
def source_order(spark, sf):
    return traffic.source_order(A.positions(spark, sf), "event_id").select("event_id", "ord")


@query(f"WITH {A.P_SQL} SELECT count(*) AS rows, CAST(sum(dup_db) AS BIGINT) AS raw_rows, count(*) FILTER (ts IS NULL) AS no_ts, count(*) FILTER (NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)) AS no_cell, count(*) FILTER (lat BETWEEN 54.5 AND 56.5 AND lon BETWEEN 10 AND 13) AS box_rows, CAST(sum(dup_db) FILTER (lat BETWEEN 54.5 AND 56.5 AND lon BETWEEN 10 AND 13) AS BIGINT) AS box_raw_rows, count(DISTINCT mmsi) AS ships FROM P")
def validate_invariants(spark, sf):
    return traffic.row_counts(A.positions(spark, sf))


_HOURS = f"H AS (SELECT CAST(d.day AS VARCHAR) AS date, CAST(h.hour AS BIGINT) AS hour, count(P.mmsi) AS messages, count(DISTINCT P.mmsi) AS ships FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM P) d CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN P ON CAST(P.ts AS DATE) = d.day AND hour(P.ts) = h.hour GROUP BY 1, 2)"


@query(f"WITH {A.P_SQL}, {_HOURS} SELECT * FROM H")
def hourly_profile_filled(spark, sf):
    return text_day(traffic.hourly_by_day(A.positions(spark, sf)), "date")


@query(f"WITH {A.P_SQL}, {_HOURS} SELECT date, CAST(sum(messages) AS BIGINT) AS messages, arg_max(hour, ships * 100 - hour) AS peak_hour, max(ships) AS peak_ships, round(avg(ships), 6) AS mean_ships FROM H GROUP BY 1")
def day_summary_peak(spark, sf):
    return text_day(traffic.day_summary(traffic.hourly_by_day(A.positions(spark, sf))), "date").withColumn("mean_ships", F.round("mean_ships", 6))


@query(f"WITH {A.P_SQL}, {A.VOTE_SQL} SELECT mmsi, ship_type, ship_group FROM G")
def vote_ship_type(spark, sf):
    return traffic.ship_types(A.positions(spark, sf))


@query(f"WITH {A.P_SQL}, {A.VOTE_SQL}, C AS (SELECT ship_group, count(DISTINCT mmsi) AS ships, count(*) AS messages FROM P JOIN G USING (mmsi) GROUP BY 1) SELECT ship_group, ships, messages, round(100.0::DOUBLE * ships / sum(ships) OVER (), 6) AS ship_share, round(100.0::DOUBLE * messages / sum(messages) OVER (), 6) AS message_share FROM C")
def ship_groups(spark, sf):
    return traffic.group_counts(A.positions(spark, sf)).select("ship_group", "ships", "messages", r6("ship_share"), r6("message_share"))


@query(f"WITH {A.P_SQL} SELECT type_of_mobile, count(*) AS rows, count(DISTINCT mmsi) AS ships, count(DISTINCT mmsi) FILTER (nav_status <> 'Unknown value') AS with_status FROM P GROUP BY 1")
def class_status(spark, sf):
    return traffic.class_counts(A.positions(spark, sf))


@query(f"WITH {A.P_SQL}, {A.VOTE_SQL}, N AS (SELECT mmsi, nav_status AS status FROM (SELECT mmsi, nav_status, row_number() OVER (PARTITION BY mmsi ORDER BY count(*) DESC, nav_status) AS r FROM P GROUP BY 1, 2) WHERE r = 1) SELECT ship_group, status, count(*) AS ships FROM G JOIN N USING (mmsi) GROUP BY 1, 2")
def crosstab_group_status(spark, sf):
    return traffic.group_by_status(A.positions(spark, sf))


@query(f"WITH {A.P_SQL}, {A.VOTE_SQL} SELECT CAST(hour(ts) AS BIGINT) AS hour, ship_group, count(DISTINCT mmsi) AS ships FROM P JOIN G USING (mmsi) GROUP BY 1, 2")
def hour_group_ships(spark, sf):
    return traffic.hourly_groups(A.positions(spark, sf))


@query(f"WITH {A.P_SQL}, U AS (SELECT mmsi, unnest(['ship_type', 'nav_status', 'destination']) AS field, unnest([ship_type, nav_status, destination]) AS value FROM P), N AS (SELECT mmsi, field, count(DISTINCT value) AS n FROM U WHERE value IS NOT NULL GROUP BY 1, 2) SELECT field, count(*) AS keys, count(*) FILTER (n > 1) AS conflicting FROM N GROUP BY 1")
def static_conflicts(spark, sf):
    return traffic.conflicts(A.positions(spark, sf), ["ship_type", "nav_status", "destination"])


@query("SELECT p_brand, arg_max(p_name, (length(p_name), p_name)) AS p_name FROM part GROUP BY 1")
def static_longest(spark, sf):
    return traffic.longest_value(table(spark, sf, "part"), "p_brand", "p_name")


@query(f"WITH {A.P_SQL} SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, epoch_us(ts) // 120000000 ORDER BY ts, event_id) AS r FROM P) WHERE r = 1")
def thin_2min(spark, sf):
    return traffic.thin(A.positions(spark, sf)).select("event_id")


@query(f"WITH {A.P_SQL} SELECT mmsi, event_id, round(lat, 6) AS lat FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts, event_id) AS r FROM P WHERE ts BETWEEN TIMESTAMP '2024-01-01 12:00:00' AND TIMESTAMP '2024-01-03 12:10:00') WHERE r = 1")
def first_snapshot(spark, sf):
    return traffic.first_per_ship(A.positions(spark, sf), "2024-01-01 12:00:00", "2024-01-03 12:10:00").select("mmsi", "event_id", r6("lat"))


@query(f"WITH {A.P_SQL} SELECT CASE WHEN lower(ship_type) LIKE '%cargo%' OR lower(ship_type) LIKE '%tanker%' THEN 'k' WHEN lower(ship_type) LIKE '%passenger%' THEN 's' ELSE 'e' END AS kind, count(*) AS rows FROM P GROUP BY 1")
def coarse_groups(spark, sf):
    return A.positions(spark, sf).groupBy(T.coarse_group(F.col("ship_type")).alias("kind")).agg(F.count("*").alias("rows"))


_CELL = "CAST(floor((lat + 90.0) * 120) * 43200 + floor((lon + 180.0) * 120) AS BIGINT)"
_PARENT = "CAST(floor(floor(cell / 43200) / 3) * 43200 + floor((cell % 43200) / 3) AS BIGINT)"


@query(f"WITH {A.P_SQL} SELECT {_CELL} AS cell, count(DISTINCT mmsi) AS ships, CAST(sum(dup_db) AS BIGINT) AS messages FROM P GROUP BY 1")
def cell_heat(spark, sf):
    return traffic.cell_heat(A.positions(spark, sf), GridIndex().cell(F.col("lat"), F.col("lon")))


@query(f"WITH {A.P_SQL}, S1 AS (SELECT {DAY} AS day, {_CELL} AS cell, count(DISTINCT mmsi * 100 + hour(ts)) AS ship_hours FROM P WHERE ship_type = 'Tanker' GROUP BY 1, 2) SELECT {_PARENT} AS cell, round(sum(ship_hours) / 30.0, 6) AS per_day FROM S1 GROUP BY 1")
def presence_rollup(spark, sf):
    g = GridIndex()
    tankers = A.positions(spark, sf).filter("ship_type = 'Tanker'")
    return traffic.roll_up(traffic.presence(tankers, g.cell(F.col("lat"), F.col("lon"))), g.parent(F.col("cell")), F.lit(30.0)).select("cell", r6("per_day"))


@query(f"WITH {A.P_SQL} SELECT mmsi, round(sqrt(pow(avg(cos(radians(cog))), 2) + pow(avg(sin(radians(cog))), 2)), 6) AS r FROM P GROUP BY 1")
def circular_r(spark, sf):
    return A.positions(spark, sf).groupBy("mmsi").agg(F.round(resultant_length(F.col("cog")), 6).alias("r"))


# -- gates ---------------------------------------------------------------------------------------------------
_BAND = A.BELT.band()


@query(f"WITH {A.P_SQL} SELECT event_id FROM P WHERE lat BETWEEN {_BAND.lat_min!r}::DOUBLE AND {_BAND.lat_max!r}::DOUBLE AND lon BETWEEN {_BAND.lon_min!r}::DOUBLE AND {_BAND.lon_max!r}::DOUBLE")
def gate_band_filter(spark, sf):
    return A.positions(spark, sf).filter(in_box(F.col("lat"), F.col("lon"), _BAND)).select("event_id")


_CORRIDOR = sorted({c for lat, lon in GridIndex().path(A.BELT.a, A.BELT.b) for c in GridIndex().disk(lat, lon, C.CORRIDOR_RINGS)})


@query(f"WITH {A.P_SQL} SELECT event_id FROM P WHERE {_CELL} IN ({', '.join(map(str, _CORRIDOR))})")
def corridor_semi(spark, sf):
    return gates.in_corridor(A.positions(spark, sf), gates.corridor(spark, A.BELT)).select("event_id")


def _events(spark, sf, gate=A.BELT) -> DataFrame:
    return gates.crossings(A.positions(spark, sf), gate, A.GAP_S)


def _grouped(spark, sf) -> DataFrame:
    return gates.with_groups(_events(spark, sf), traffic.ship_types(A.positions(spark, sf)))


_X = A.crossings_sql(A.BELT, "X")
_XG = f"{A.P_SQL}, {A.VOTE_SQL}, {_X}, XG AS (SELECT X.*, ship_group, {DAY} AS day FROM X LEFT JOIN G USING (mmsi))"


@query(f"WITH {A.P_SQL}, {_X} SELECT mmsi, epoch_us(ts) AS us, direction, gate FROM X")
def gate_crossings(spark, sf):
    return _events(spark, sf).select("mmsi", micros("ts").alias("us"), "direction", "gate")


@query(f"WITH {A.P_SQL}, R AS (SELECT P.*, event_id * 10 + generate_series AS rn FROM P, generate_series(1, 3) WHERE generate_series <= dup_db), {A.crossings_sql(A.BELT, 'X', 'R', order='rn')} SELECT direction, count(*) AS crossings, count(DISTINCT mmsi) AS ships FROM X GROUP BY 1")
def gate_crossings_weighted(spark, sf):
    raw = traffic.replicate(A.positions(spark, sf)).withColumn("rn", F.col("event_id") * 10 + F.col("copy"))
    return gates.crossings(raw, A.BELT, A.GAP_S, "rn").groupBy("direction").agg(F.count("*").alias("crossings"), F.countDistinct("mmsi").alias("ships"))


@query(f"WITH {_XG} SELECT day, gate, direction, ship_group, count(*) AS crossings FROM XG GROUP BY 1, 2, 3, 4")
def crossing_cube(spark, sf):
    return gates.cube(_grouped(spark, sf))


@query(f"WITH {_XG} SELECT day, gate, ship_group, count(*) AS crossings, count(*) FILTER (direction = 'észak') AS north, count(*) FILTER (direction <> 'észak') AS south, count(DISTINCT mmsi) AS ships, count(*) FILTER (hour(ts) <> 11) AS without_hour FROM XG GROUP BY 1, 2, 3")
def crossing_daily(spark, sf):
    return gates.daily(_grouped(spark, sf))


@query(f"""WITH {_XG}, SH AS (SELECT gate, mmsi, count(*) AS n FROM XG GROUP BY 1, 2), TT AS (SELECT gate, sum(n) FILTER (r <= 5) AS top, max(n) AS top1, count(*) AS ships FROM (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY n DESC, mmsi) AS r FROM SH) GROUP BY 1),
DD AS (SELECT gate, day, mmsi, count(*) AS n, count(DISTINCT direction) AS d, count(*) FILTER (ship_group IN ('Teherhajó', 'Tanker')) AS cn FROM XG GROUP BY 1, 2, 3),
DA AS (SELECT gate, count(*) FILTER (d > 1) AS ship_days_both, coalesce(sum(n) FILTER (d > 1), 0) AS both_n, count(*) FILTER (n >= 4) AS ship_days_busy, count(*) FILTER (cn >= 4) AS commercial_ship_days_busy FROM DD GROUP BY 1),
WH AS (SELECT gate, count(*) AS crossings, count(DISTINCT day) AS days, avg(CASE WHEN ship_group = 'Személyszállító' THEN 1.0 ELSE 0.0 END) AS passenger_share, count(*) FILTER (ship_group IN ('Teherhajó', 'Tanker')) AS commercial FROM XG GROUP BY 1)
SELECT gate, crossings, ships, round(top / crossings, 6) AS top5_share, round(top1 / days, 6) AS top1_per_day, round(passenger_share, 6) AS passenger_share, ship_days_both, round(both_n / crossings, 6) AS both_share, ship_days_busy, commercial, commercial_ship_days_busy FROM WH JOIN TT USING (gate) JOIN DA USING (gate)""")
def crossing_concentration(spark, sf):
    c = gates.concentration(_grouped(spark, sf))
    return c.select(*[r6(n) if t == "double" else n for n, t in c.dtypes])


@query(f"WITH {A.P_SQL}, {_X}, {A.crossings_sql(A.NORTH, 'Y')} SELECT mmsi, epoch_us(ts) AS us, direction, gate FROM X WHERE EXISTS (SELECT 1 FROM Y WHERE Y.mmsi = X.mmsi AND Y.direction = X.direction AND abs(epoch_us(Y.ts) - epoch_us(X.ts)) <= 43200000000)")
def through_traffic(spark, sf):
    return gates.through_traffic(_events(spark, sf), _events(spark, sf, A.NORTH)).select("mmsi", micros("ts").alias("us"), "direction", "gate")


@query(f"WITH {A.P_SQL}, R AS (SELECT mmsi, draught FROM P, generate_series(1, 3) WHERE generate_series <= dup_db) SELECT mmsi, round(median(draught), 6) AS median FROM R GROUP BY 1")
def weighted_median_draught(spark, sf):
    return gates.weighted_median(A.positions(spark, sf), "mmsi", "draught", "dup_db").select("mmsi", r6("median"))


# -- trajectories --------------------------------------------------------------------------------------------
@query(f"""WITH {A.P_SQL}, Q AS (SELECT *, lag(us) OVER w AS us0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(sog) OVER w AS sog0 FROM (SELECT mmsi, event_id, epoch_us(ts) AS us, lat, lon, sog FROM P) WINDOW w AS (PARTITION BY mmsi ORDER BY us, event_id)),
G2 AS (SELECT *, unnest(range(us0 // 600000000 + 1, us // 600000000 + 1)) * 600000000 AS grid FROM Q WHERE us > us0)
SELECT mmsi, grid, round(lat0 + (lat - lat0) * ((grid - us0) / (us - us0)), 6) AS lat, round(lon0 + (lon - lon0) * ((grid - us0) / (us - us0)), 6) AS lon, round(sog0 + (sog - sog0) * ((grid - us0) / (us - us0)), 6) AS sog FROM G2 WHERE us - us0 <= 1200000000 OR least(grid - us0, us - grid) <= 600000000""")
def resample_grid(spark, sf):
    return trajectory.resample(A.positions(spark, sf)).select("mmsi", F.col("grid").cast("long").alias("grid"), r6("lat"), r6("lon"), r6("sog"))


#: Points here are hours apart, so thresholds are wide.
_DR = {"thresholds": (20_000.0, 50_000.0, 100_000.0), "gap_s": A.GAP_S}


def _dr_sql(thresholds: tuple[float, ...]) -> str:
    """The scan from anchor to anchor as a recursion over each ship's points."""
    m, k = f"{C.METRES_PER_DEGREE!r}::DOUBLE", f"{C.KNOT!r}::DOUBLE"
    way = f"(asog * {k} * (T.us / 1e6 - aus / 1e6))"
    dy = f"((T.lat - (alat + {way} * cos(radians(acog)) / {m})) * {m})"
    dx = f"((T.lon - (alon + {way} * sin(radians(acog)) / ({m} * cos(radians(alat))))) * {m} * cos(radians(alat)))"
    own = "T.us, T.lat, T.lon, T.sog, T.cog"
    anchor = ", ".join(f"CASE WHEN bad THEN {c} ELSE a{c} END" for c in ("us", "lat", "lon", "sog", "cog"))
    return f"""TH AS (SELECT unnest([{', '.join(f'{t!r}::DOUBLE' for t in thresholds)}]) AS threshold),
T AS (SELECT mmsi, event_id, epoch_us(ts) AS us, lat, lon, sog, cog, row_number() OVER (PARTITION BY mmsi ORDER BY epoch_us(ts), event_id) AS i FROM P WHERE mmsi IS NOT NULL),
DR(threshold, mmsi, event_id, i, kept, error, aus, alat, alon, asog, acog) AS (SELECT threshold, mmsi, event_id, i, TRUE, CAST(NULL AS DOUBLE), {own} FROM T, TH WHERE i = 1
UNION ALL SELECT threshold, mmsi, event_id, i, bad, CASE WHEN NOT bad THEN miss END, {anchor} FROM (SELECT *, us / 1e6 - aus / 1e6 > {A.GAP_S} OR NOT able OR NOT (miss <= threshold) AS bad FROM
(SELECT DR.threshold, T.mmsi, T.event_id, T.i, {own}, aus, alat, alon, asog, acog, asog < {C.SOG_INVALID} AND acog < {C.COG_INVALID} AS able, sqrt(pow({dy}, 2) + pow({dx}, 2)) AS miss FROM DR JOIN T ON T.mmsi = DR.mmsi AND T.i = DR.i + 1)))"""


@query(f"WITH RECURSIVE {A.P_SQL}, {_dr_sql((50_000.0,))} SELECT mmsi, event_id, kept, round(error, 2) AS error FROM DR")
def dr_compress(spark, sf):
    return trajectory.dead_reckoning(A.positions(spark, sf), (50_000.0,), A.GAP_S).select("mmsi", "event_id", "kept", F.round("error", 2).alias("error"))


@query(f"WITH RECURSIVE {A.P_SQL}, {_dr_sql(_DR['thresholds'])} SELECT threshold, count(*) AS points, count(*) FILTER (kept) AS kept, round(count(*) FILTER (kept) / count(*), 6) AS share, round(avg(error), 2) AS mean_error, round(max(error), 2) AS max_error FROM DR GROUP BY 1")
def dr_sweep(spark, sf):
    t = trajectory.dr_summary(trajectory.dead_reckoning(A.positions(spark, sf), **_DR))
    return t.select("threshold", "points", "kept", r6("share"), F.round("mean_error", 2).alias("mean_error"), F.round("max_error", 2).alias("max_error"))


@query(f"""WITH RECURSIVE {A.P_SQL}, {_dr_sql((50_000.0,))}, KP AS (SELECT P.* FROM P JOIN DR USING (mmsi, event_id) WHERE kept), HF AS (SELECT CAST(hour(ts) AS BIGINT) AS hour, count(DISTINCT mmsi) AS n FROM P GROUP BY 1), HK AS (SELECT CAST(hour(ts) AS BIGINT) AS hour, count(DISTINCT mmsi) AS n FROM KP GROUP BY 1)
SELECT hour, HF.n AS "full", coalesce(HK.n, 0) AS compressed, abs(HF.n - coalesce(HK.n, 0)) AS difference, round(abs(HF.n - coalesce(HK.n, 0)) / HF.n, 6) AS relative FROM HF LEFT JOIN HK USING (hour)""")
def dr_effect(spark, sf):
    p = A.positions(spark, sf)
    return trajectory.compression_effect(p, trajectory.dead_reckoning(p, (50_000.0,), A.GAP_S)).withColumn("relative", F.round("relative", 6))


_WAY = f"(N.sog * {C.KNOT!r}::DOUBLE * (T.us / 1e6 - N.us / 1e6))"
_SEEN = f"N.sog < {C.SOG_INVALID} AND N.cog < {C.COG_INVALID} AND T.us / 1e6 - N.us / 1e6 <= {A.GAP_S}"


@query(f"""WITH RECURSIVE {A.P_SQL}, {_dr_sql((50_000.0,))}, AI AS (SELECT mmsi, i, kept, max(CASE WHEN kept THEN i END) OVER (PARTITION BY mmsi ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ai FROM DR),
XP AS (SELECT T.*, kept, ai, T.us / 1e6 - N.us / 1e6 AS seconds, coalesce({_SEEN}, FALSE) AS seen, N.lat + {_WAY} * cos(radians(N.cog)) / {C.METRES_PER_DEGREE!r}::DOUBLE AS y, N.lon + {_WAY} * sin(radians(N.cog)) / ({C.METRES_PER_DEGREE!r}::DOUBLE * cos(radians(N.lat))) AS x, cos(radians(N.lat)) AS c FROM T JOIN AI USING (mmsi, i) LEFT JOIN T N ON N.mmsi = T.mmsi AND N.i = ai)
SELECT mmsi, event_id, round(seconds, 3) AS seconds, CASE WHEN seen THEN round(y, 6) END AS lat_predicted, CASE WHEN seen THEN round(x, 6) END AS lon_predicted, CASE WHEN seen THEN round(sqrt(pow((lat - y) * {C.METRES_PER_DEGREE!r}::DOUBLE, 2) + pow((lon - x) * {C.METRES_PER_DEGREE!r}::DOUBLE * c, 2)), 2) END AS miss,
CASE WHEN ai IS NULL THEN 'first' WHEN NOT seen THEN 'blind' WHEN kept THEN 'off' ELSE 'dropped' END AS decision FROM XP""")
def dr_explained(spark, sf):
    p = A.positions(spark, sf)
    t = trajectory.explained(p, trajectory.dead_reckoning(p, (50_000.0,), A.GAP_S), A.GAP_S)
    return t.select("mmsi", "event_id", F.round("seconds", 3).alias("seconds"), r6("lat_predicted"), r6("lon_predicted"), F.round("miss", 2).alias("miss"), "decision")


@query(f"""WITH {A.P_SQL}, SH AS (SELECT mmsi, count(*) AS points, median(sog) FILTER (sog < {C.SOG_INVALID}) AS mid, count(*) FILTER (sog < {C.SOG_INVALID}) AS ns, count(*) FILTER (cog < {C.COG_INVALID}) AS nc, sqrt(pow(avg(cos(radians(cog))) FILTER (cog < {C.COG_INVALID}), 2) + pow(avg(sin(radians(cog))) FILTER (cog < {C.COG_INVALID}), 2)) AS steadiness FROM P WHERE mmsi IS NOT NULL GROUP BY 1)
SELECT mmsi, points, round(steadiness, 6) AS steadiness FROM SH WHERE points >= 20 AND ns >= 10 AND nc >= 10 AND mid >= 0.5 ORDER BY round(steadiness, 9) DESC, points DESC, mmsi LIMIT 1""")
def dr_candidate(spark, sf):
    return trajectory.steadiest(A.positions(spark, sf), least_points=20, least_valid=10, least_sog=0.5).withColumn("steadiness", F.round("steadiness", 6))


@query(f"WITH {A.P_SQL} SELECT event_id, CAST(coalesce(CASE WHEN round_even((lat - 54.5) / (56.5 - 54.5) * 65534, 0) BETWEEN 0 AND 65534 THEN round_even((lat - 54.5) / (56.5 - 54.5) * 65534, 0) END, 65535) AS INT) AS y, CAST(least(greatest(floor(sog), 0), 63) AS INT) AS s FROM P")
def quantised_track(spark, sf):
    return A.positions(spark, sf).select("event_id", trajectory.quantise(F.col("lat"), 54.5, 56.5).alias("y"), F.least(F.greatest(F.floor("sog"), F.lit(0)), F.lit(63)).cast("int").alias("s"))


# -- texts ---------------------------------------------------------------------------------------------------
@query("SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS name FROM customer")
def norm_text(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.normal_form(F.col("c_name")).alias("name"))


_RAW = ("NLRTM", "NL RTM", "BEANR VIA DENOK", "EGPSD VIA SKAW", "RU ULU>NL RTM", "CNSHA/SGSIN", "TO NLRTM", "NLRTM FOR ORDERS", "FOR ORDERS", "PORT SAID", "SKAGEN", "AT SEA", "", "unknown", "nation 3", "Nation_7", "NA3XX 1", "NATION", " de  ham ")
_CODES = (("NLRTM", True), ("BEANR", True), ("EGPSD", True), ("RUULU", True), ("CNSHA", True), ("SGSIN", True), ("DEHAM", True), ("NATIO", False), ("NA3XX", True))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(("TRUE" if x else "FALSE") if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


_LIT = f"R AS (SELECT * FROM (VALUES {_values(enumerate(_RAW))}) AS t(id, raw)), K AS (SELECT * FROM (VALUES {_values(_CODES)}) AS t(code, seaport))"
_NAMES = "NM AS (SELECT name, min(code) AS code FROM (SELECT regexp_replace(upper(n_name), '[^A-Z0-9]', '', 'g') AS name, 'N' || n_nationkey AS code FROM nation) GROUP BY 1 HAVING count(*) = 1)"
_COLL = "regexp_replace(upper(trim(raw)), '\\s+', ' ', 'g')"
_COUNTRY = f"CASE WHEN c = 'RU' THEN 'RU' WHEN c IN ({', '.join(repr(x) for x in T.EUROPE)}) THEN '{T.CAT_EUROPE}' WHEN c IN ({', '.join(repr(x) for x in T.EAST)}) THEN '{T.CAT_EAST}' ELSE '{T.CAT_OTHER}' END"
_TEXTCAT = "CASE WHEN " + " OR ".join(f"contains(s, '{t}')" for t in T.EAST_TEXTS) + f" THEN '{T.CAT_EAST}' WHEN contains(s, 'ORDER') THEN '{T.CAT_ORDER}' ELSE '{T.CAT_NONE}' END"


def _literals(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(list(enumerate(_RAW)), "id int, raw string"), spark.createDataFrame(list(_CODES), "code string, seaport boolean")


@query(f"""WITH {_LIT}, {_NAMES}, N AS (SELECT id, regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g') AS t FROM R)
SELECT id, CASE WHEN t IN ({', '.join(repr(x) for x in T.EMPTY_DESTINATION)}) THEN NULL ELSE coalesce(CASE WHEN length(t) = 5 THEN k.code END, NM.code, p.code) END AS code,
CASE WHEN t IN ({', '.join(repr(x) for x in T.EMPTY_DESTINATION)}) THEN 'ures' WHEN length(t) = 5 AND k.code IS NOT NULL THEN 'pontos' WHEN NM.code IS NOT NULL THEN 'nev' WHEN p.code IS NOT NULL THEN 'prefix' ELSE 'nincs' END AS level
FROM N LEFT JOIN K k ON k.code = t AND k.seaport LEFT JOIN NM ON NM.name = t LEFT JOIN K p ON length(t) > 5 AND p.code = substr(t, 1, 5) AND p.seaport""")
def locode_exact_name_prefix(spark, sf):
    rows, codes = _literals(spark)
    names = table(spark, sf, "nation").groupBy(T.normal_form(F.col("n_name")).alias("name")).agg(F.count("*").alias("n"), F.min(F.concat(F.lit("N"), "n_nationkey")).alias("code")).filter("n = 1").select("name", "code")
    return destinations.resolve(rows, "raw", codes, names).select("id", "code", "level")


_STRICT = f"""T1 AS (SELECT id, {_COLL} AS s FROM R), T2 AS (SELECT id, s, regexp_extract(s, '^([A-Z]{{2}}) ?([A-Z2-9]{{3}})$', 1) || regexp_extract(s, '^([A-Z]{{2}}) ?([A-Z2-9]{{3}})$', 2) AS code FROM T1),
T3 AS (SELECT id, s, substr(code, 1, 2) AS c, K.code IS NOT NULL AS known FROM T2 LEFT JOIN K USING (code)), ST AS (SELECT id, s, CASE WHEN known THEN {_COUNTRY} ELSE {_TEXTCAT} END AS category FROM T3)"""


@query(f"WITH {_LIT}, {_STRICT} SELECT id, category FROM ST")
def dest_category_strict(spark, sf):
    rows, codes = _literals(spark)
    return destinations.categorise(rows, "raw", codes).select("id", "category")


_LENIENT = f"""{_STRICT}, L0 AS (SELECT id, s, category, regexp_extract(' ' || regexp_replace(s, '[^A-Z0-9]', '  ', 'g') || ' ', '(?:^| )([A-Z]{{2}} {{0,2}}[A-Z2-9]{{3}}) ', 1) AS tok FROM ST), L1 AS (SELECT id, category, replace(tok, ' ', '') AS code FROM L0), L2 AS (SELECT id, category, substr(code, 1, 2) AS c, K.code IS NOT NULL AS known FROM L1 LEFT JOIN K USING (code))"""


@query(f"WITH {_LIT}, {_LENIENT} SELECT id, CASE WHEN known THEN {_COUNTRY} ELSE category END AS category FROM L2")
def dest_category_lenient(spark, sf):
    rows, codes = _literals(spark)
    return destinations.categorise(rows, "raw", codes, lenient=True).select("id", "category")


_DCAT = f"{A.P_SQL}, {_LIT.split(', K AS')[0].replace('R AS', 'R0 AS')}, K AS (SELECT * FROM (VALUES {_values(_CODES)}) AS t(code, seaport)), R AS (SELECT event_id AS id, destination AS raw FROM P), {_STRICT}, DC AS (SELECT P.*, category, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS part FROM P JOIN ST ON ST.id = event_id)"


def _categorised(spark, sf) -> DataFrame:
    return destinations.categorise(A.positions(spark, sf), "destination", _literals(spark)[1]).withColumn("part", F.when(F.col("event_id") % 2 == 0, "A").otherwise("B"))


@query(f"WITH {_DCAT} SELECT part, category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY part), 6) AS share FROM DC GROUP BY 1, 2")
def dest_composition(spark, sf):
    return destinations.composition(_categorised(spark, sf), "part", "category").withColumn("share", F.round("share", 6))


@query(f"WITH {_DCAT} SELECT part, ship_type, count(*) AS n, round(avg(CASE WHEN category <> '{T.CAT_NONE}' THEN 1.0 ELSE 0.0 END), 6) AS share FROM DC GROUP BY GROUPING SETS ((part, ship_type), (part))")
def dest_interpretable(spark, sf):
    return destinations.interpretable(_categorised(spark, sf), "part", "ship_type").withColumn("share", F.round("share", 6))


@query(f"WITH {A.P_SQL} SELECT destination, count(*) AS n FROM P GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def topk_destinations(spark, sf):
    return destinations.top(A.positions(spark, sf), "destination", 5)


def _asof_sides(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("mmsi"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", F.round("value", 6).alias("value"))
    return e.filter("event_type = 'purchase'").select("event_id", "mmsi", "ts"), e.filter("event_type = 'view'").select("mmsi", "ts", "value", F.col("event_id").alias("tie"))


_AS = "A1 AS (SELECT event_id, user_id AS mmsi, ts FROM events WHERE event_type = 'purchase'), A2 AS (SELECT user_id AS mmsi, ts, round(value, 6) AS value FROM events WHERE event_type = 'view')"


@query(f"WITH {_AS} SELECT event_id, A2.value, epoch_us(A2.ts) AS value_us FROM A1 ASOF LEFT JOIN A2 ON A1.mmsi = A2.mmsi AND A1.ts >= A2.ts")
def asof_backward(spark, sf):
    a, b = _asof_sides(spark, sf)
    return asof.as_of(a, b, "mmsi", "ts", "value").select("event_id", "value", micros("value_ts").alias("value_us"))


@query(f"WITH {_AS} SELECT event_id, A2.value, epoch_us(A2.ts) AS value_us FROM A1 ASOF LEFT JOIN A2 ON A1.mmsi = A2.mmsi AND A1.ts <= A2.ts")
def asof_forward(spark, sf):
    a, b = _asof_sides(spark, sf)
    return asof.as_of(a, b, "mmsi", "ts", "value", "forward").select("event_id", "value", micros("value_ts").alias("value_us"))


@query(f"WITH {_AS}, B1 AS (SELECT event_id, A2.value, epoch_us(A2.ts) AS value_us FROM A1 ASOF LEFT JOIN A2 ON A1.mmsi = A2.mmsi AND A1.ts >= A2.ts), B2 AS (SELECT event_id, A2.value AS value_next, epoch_us(A2.ts) AS value_next_us FROM A1 ASOF LEFT JOIN A2 ON A1.mmsi = A2.mmsi AND A1.ts <= A2.ts) SELECT * FROM B1 FULL JOIN B2 USING (event_id)")
def asof_both(spark, sf):
    a, b = _asof_sides(spark, sf)
    return asof.as_of_both(a, b, "mmsi", "ts", "value").select("event_id", "value", micros("value_ts").alias("value_us"), "value_next", micros("value_next_ts").alias("value_next_us"))


# -- laden state ---------------------------------------------------------------------------------------------
@query(f"WITH {A.P_SQL}, {A.DAY_SQL}, VD AS (SELECT day, mmsi, ship_type FROM (SELECT {DAY} AS day, mmsi, ship_type, row_number() OVER (PARTITION BY {DAY}, mmsi ORDER BY sum(dup_db) DESC, ship_type) AS r FROM P GROUP BY 1, 2, 3) WHERE r = 1) SELECT day, mmsi, round(draught, 6) AS draught, length, width, ship_type FROM D JOIN VD USING (day, mmsi)")
def ship_daily_attrs(spark, sf):
    return traffic.ship_day(A.positions(spark, sf)).select("day", "mmsi", r6("draught"), "length", "width", "ship_type")


_HM = "HM AS (SELECT mmsi, quantile_cont(draught, 0.95) AS max_draught, count(DISTINCT draught) AS values, count(*) AS days FROM D WHERE draught IS NOT NULL GROUP BY 1)"


@query(f"WITH {A.P_SQL}, {A.DAY_SQL}, {_HM} SELECT mmsi, round(max_draught, 8) AS max_draught, values, days FROM HM")
def ship_p95(spark, sf):
    return laden.ship_max(traffic.ship_day(A.positions(spark, sf))).select("mmsi", F.round("max_draught", 8).alias("max_draught"), "values", "days")


def _relative(spark, sf) -> DataFrame:
    """Crossings with the ship's daily draught over its own maximum."""
    day = traffic.ship_day(A.positions(spark, sf)).drop("ship_type")
    events = _grouped(spark, sf).withColumn("day", day_text("ts")).join(day, ["day", "mmsi"], "left")
    return laden.relative(events, laden.ship_max(day))


PL = "(D.draught >= 1.0 AND D.draught < 25.5)"
_REL = f"""{_XG}, {A.DAY_SQL}, {_HM}, RL AS (SELECT XG.*, D.draught, D.length, D.width, max_draught, coalesce({PL}, FALSE) AS plausible, coalesce({PL}, FALSE) AND coalesce(values, 0) >= 2 AS evaluable,
CASE WHEN coalesce({PL}, FALSE) AND coalesce(values, 0) >= 2 THEN D.draught / max_draught END AS rel FROM XG LEFT JOIN D USING (day, mmsi) LEFT JOIN HM USING (mmsi))"""


@query(f"WITH {_REL} SELECT mmsi, epoch_us(ts) AS us, evaluable, round(rel, 6) AS rel FROM RL")
def relative_draught(spark, sf):
    return _relative(spark, sf).select("mmsi", micros("ts").alias("us"), "evaluable", r6("rel"))


_OTSU = """OV AS (SELECT ship_group, least(rel, 1.2::DOUBLE) AS x FROM RL WHERE rel IS NOT NULL), OE AS (SELECT ship_group, min(x) AS lo, max(x) AS hi FROM OV GROUP BY 1),
OB AS (SELECT ship_group, lo, hi, CAST(least(floor((x - lo) / (hi - lo) * 100), 99) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS n FROM OV JOIN OE USING (ship_group) WHERE hi > lo GROUP BY 1, 2, 3, 4),
OM AS (SELECT *, n * (lo + (bin + 0.5::DOUBLE) * (hi - lo) / 100) AS m FROM OB),
OC AS (SELECT *, sum(n) OVER u AS w0, sum(m) OVER u AS s0, sum(n) OVER g AS w, sum(m) OVER g AS s FROM OM WINDOW u AS (PARTITION BY ship_group ORDER BY bin), g AS (PARTITION BY ship_group)),
OX AS (SELECT *, round(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 6) AS between_ FROM OC WHERE w0 < w),
OT AS (SELECT ship_group, lo + (bin + 1) * (hi - lo) / 100 AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY ship_group ORDER BY between_ DESC, bin) AS r FROM OX) WHERE r = 1)"""


@query(f"WITH {_REL}, {_OTSU} SELECT ship_group, round(threshold, 6) AS threshold FROM OT")
def otsu_threshold(spark, sf):
    return laden.otsu(_relative(spark, sf), "ship_group", "rel").select("ship_group", r6("threshold"))


_T0 = "T0 AS (SELECT * FROM (VALUES ('Tanker', 0.8148::DOUBLE), ('Teherhajó', 0.75::DOUBLE)) AS t(ship_group, threshold))"
_LD = f"""{_REL}, {_T0}, LD AS (SELECT day, gate, direction, ship_group, count(*) AS crossings, count(*) FILTER (evaluable) AS evaluable, count(*) FILTER (evaluable AND rel >= threshold) AS laden,
round_even(sum(length * width * draught) FILTER (plausible), 0) AS volume FROM RL LEFT JOIN T0 USING (ship_group) GROUP BY 1, 2, 3, 4)"""


def _laden_daily(spark, sf) -> DataFrame:
    limits = spark.createDataFrame([("Tanker", 0.8148), ("Teherhajó", 0.75)], "ship_group string, threshold double")
    return laden.laden_daily(_relative(spark, sf), limits)


@query(f"WITH {_LD} SELECT day, gate, direction, ship_group, crossings, evaluable, laden, volume, round_even(laden / nullif(evaluable, 0), 4) AS laden_share FROM LD")
def laden_daily(spark, sf):
    return _laden_daily(spark, sf)


@query(f"""WITH {_LD}, DY AS (SELECT CAST(day AS DATE) AS day, CAST(sum(crossings) AS DOUBLE) AS crossings, CAST(sum(laden) AS DOUBLE) AS laden, sum(volume) AS volume FROM LD GROUP BY 1),
LG AS (SELECT unnest([0, 2, 5]) AS lag), SG AS (SELECT DY.*, lag, CASE WHEN day < DATE '2024-01-10' + lag THEN 'before' WHEN day <= DATE '2024-01-15' + lag THEN 'during' ELSE 'after' END AS segment FROM DY, LG)
SELECT CAST(lag AS INT) AS lag, segment, CAST(min(day) AS VARCHAR) AS "from", CAST(max(day) AS VARCHAR) AS "to", count(*) AS days, round(avg(crossings), 6) AS crossings, round(avg(laden), 6) AS laden, round(avg(volume), 4) AS volume FROM SG GROUP BY 1, 2""")
def laden_segments(spark, sf):
    d = _laden_daily(spark, sf).groupBy(F.to_date("day").alias("day")).agg(*[F.sum(c).cast("double").alias(c) for c in ("crossings", "laden", "volume")])
    t = signals.lag_segments(d, "2024-01-10", "2024-01-15", (0, 2, 5), ["crossings", "laden", "volume"])
    return text_day(text_day(t, "from"), "to").withColumns({"crossings": F.round("crossings", 6), "laden": F.round("laden", 6), "volume": F.round("volume", 4)})


_BELT_CELLS, _NORTH_CELLS = (sorted({c for lat, lon in GridIndex().path(g.a, g.b) for c in GridIndex().disk(lat, lon, C.CORRIDOR_RINGS)}) for g in (A.BELT, A.NORTH))


def _near(name: str, gate, cells) -> str:
    b = gate.band()
    return f"{name} AS (SELECT * FROM P WHERE {_CELL} IN ({', '.join(map(str, cells))}) AND lat BETWEEN {b.lat_min!r}::DOUBLE AND {b.lat_max!r}::DOUBLE AND lon BETWEEN {b.lon_min!r}::DOUBLE AND {b.lon_max!r}::DOUBLE)"


_WVOTE = A.VOTE_SQL.replace("count(*) DESC", "sum(dup_db) DESC").replace("FROM P\n", "FROM PI\n").replace("DISTINCT mmsi FROM P)", "DISTINCT mmsi FROM PI)")


@query(f"""WITH {A.P_SQL}, {_near('PB', A.BELT, _BELT_CELLS)}, {_near('PO', A.NORTH, _NORTH_CELLS)}, PI AS (SELECT * FROM PB UNION ALL SELECT * FROM PO), {_WVOTE},
{A.crossings_sql(A.BELT, 'XB', 'PB')}, {A.crossings_sql(A.NORTH, 'XO', 'PO')},
WM AS (SELECT mmsi, round_even(median(draught), 1) AS draught FROM PI, generate_series(1, 3) AS c(copy) WHERE copy <= dup_db AND draught > 0 GROUP BY 1)
SELECT X.mmsi, epoch_us(X.ts) AS us, direction, gate, ship_group, WM.draught FROM (SELECT * FROM XB UNION ALL SELECT * FROM XO) X LEFT JOIN G USING (mmsi) LEFT JOIN WM USING (mmsi)""")
def day_crossings(spark, sf):
    x = daily.day_crossings(A.positions(spark, sf), [A.BELT, A.NORTH], max_gap_s=A.GAP_S, order="event_id")
    return x.select("mmsi", micros("ts").alias("us"), "direction", "gate", "ship_group", "draught")


@query(f"WITH {A.P_SQL} SELECT event_id FROM P WHERE mmsi IN (SELECT mmsi FROM P WHERE {BOX})")
def ever_in_box(spark, sf):
    return traffic.ever_in_box(A.positions(spark, sf), BOX_C).select("event_id")


_SAYS = "upper(trim(coalesce(value, ''))) NOT IN ('', 'UNKNOWN', 'UNDEFINED', 'NAN', 'NONE', 'N/A', 'UNKNOWN VALUE', 'NOT AVAILABLE', 'RESERVED FOR FUTURE USE')"


@query(f"WITH {A.P_SQL}, U AS (SELECT mmsi, unnest(['ship_type', 'nav_status', 'destination']) AS field, unnest([ship_type, nav_status, destination]) AS value FROM P) SELECT field, count(*) AS messages, count(*) FILTER ({_SAYS}) AS filled, count(DISTINCT mmsi) AS ships, count(DISTINCT mmsi) FILTER ({_SAYS}) AS ships_filled FROM U GROUP BY 1")
def fill_rates(spark, sf):
    t = traffic.fill_rates(A.positions(spark, sf), ["ship_type", "nav_status", "destination"])
    return t.select("field", "messages", F.col("filled").cast("long").alias("filled"), "ships", "ships_filled")


_SWEEP = traffic.sweep_boxes()
_SWEEP_SQL = " UNION ALL ".join(f"SELECT {h!r}::DOUBLE AS half_height, round({km2!r}::DOUBLE, 4) AS km2, count(*) AS rows, count(DISTINCT mmsi) AS ships, round(count(*) / (SELECT count(*) FROM P), 6) AS row_share FROM P WHERE lat BETWEEN {b.lat_min!r}::DOUBLE AND {b.lat_max!r}::DOUBLE AND lon BETWEEN {b.lon_min!r}::DOUBLE AND {b.lon_max!r}::DOUBLE" for h, b, km2 in _SWEEP)


@query(f"WITH {A.P_SQL} {_SWEEP_SQL}")
def area_sweep(spark, sf):
    return traffic.area_sweep(A.positions(spark, sf), _SWEEP).withColumns({"km2": F.round("km2", 4), "row_share": F.round("row_share", 6)})


@query(f"WITH {A.P_SQL}, GB AS (SELECT mmsi, {{'xmin': lon, 'ymin': lat, 'xmax': lon, 'ymax': lat}} AS bbox FROM P) SELECT count(DISTINCT mmsi) AS ships, count(*) AS rows FROM GB WHERE bbox.ymin BETWEEN 55.28::DOUBLE AND 55.40::DOUBLE AND bbox.xmin BETWEEN 10.85::DOUBLE AND 11.15::DOUBLE")
def geo_box(spark, sf):
    return geo.in_bbox(geo.with_bbox(A.positions(spark, sf)), C.TRIAL_BOX).agg(F.countDistinct("mmsi").alias("ships"), F.count("*").alias("rows"))


@query(f"WITH {A.P_SQL} SELECT ship_type, count(*) AS messages, count(DISTINCT mmsi) AS ships FROM P WHERE type_of_mobile NOT IN ('AtoN', 'Base Station', 'Search and Rescue Transponder') GROUP BY 1")
def ships_only(spark, sf):
    return traffic.ships_only(A.positions(spark, sf)).groupBy("ship_type").agg(F.count("*").alias("messages"), F.countDistinct("mmsi").alias("ships"))


@query(f"WITH {_REL} SELECT ship_group, CAST(least(floor((rel - 0.3::DOUBLE) / (1.2::DOUBLE - 0.3::DOUBLE) * 48), 47) AS INT) AS bin, count(*) AS n FROM RL WHERE rel BETWEEN 0.3::DOUBLE AND 1.2::DOUBLE GROUP BY 1, 2")
def draught_histogram(spark, sf):
    return traffic.histogram(_relative(spark, sf), "ship_group", "rel", 0.3, 1.2, 48)


@query("SELECT o_orderdate_week AS week, count(*) AS orders FROM (SELECT strftime(CAST(o_orderdate AS DATE), '%G-W%V') AS o_orderdate_week FROM orders) GROUP BY 1")
def iso_weeks(spark, sf):
    return table(spark, sf, "orders").groupBy(signals.iso_week(F.to_date("o_orderdate")).alias("week")).agg(F.count("*").alias("orders"))


@query(f"WITH {_REL} SELECT coalesce(gate, 'Mindkét kapu') AS gate, ship_group, count(*) AS crossings, round(100 * avg(CASE WHEN draught IS NOT NULL THEN 1.0 ELSE 0.0 END), 1) AS with_draught, round(100 * avg(CASE WHEN plausible THEN 1.0 ELSE 0.0 END), 1) AS plausible_share, round(100 * avg(CASE WHEN evaluable THEN 1.0 ELSE 0.0 END), 1) AS evaluable_share FROM RL GROUP BY GROUPING SETS ((gate, ship_group), (ship_group))")
def coverage_grouping_sets(spark, sf):
    return laden.coverage(_relative(spark, sf))


# -- series and signals --------------------------------------------------------------------------------------
_ROLL = "(SELECT series, day, value, CASE WHEN count(*) OVER w = 7 THEN sum(value) OVER w END AS rolled FROM S WINDOW w AS (PARTITION BY series ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))"


@query(f"WITH {A.S_SQL} SELECT series, CAST(day AS VARCHAR) AS day, value, rolled FROM {_ROLL}")
def rolling7(spark, sf):
    return text_day(laden.rolling(A.order_series(spark, sf))).select("series", "day", "value", "rolled")


_NAMES5 = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"WITH {A.S_SQL} SELECT CAST(day AS VARCHAR) AS day, " + ", ".join(f"coalesce(sum(value) FILTER (series = '{n}'), 0) AS \"p{n[0]}\"" for n in _NAMES5) + " FROM S GROUP BY 1")
def series_pivot(spark, sf):
    w = signals.wide(A.order_series(spark, sf), _NAMES5)
    return text_day(w.select("day", *[F.col(f"`{n}`").alias(f"p{n[0]}") for n in _NAMES5]))


@query(f"WITH {A.S_SQL}, DY AS (SELECT DISTINCT day FROM S), SR AS (SELECT DISTINCT series FROM S), Z AS (SELECT SR.series, DY.day, coalesce(S.value, 0) AS value FROM SR CROSS JOIN DY LEFT JOIN S ON S.series = SR.series AND S.day = DY.day) SELECT series, CAST(day AS VARCHAR) AS day, value FROM Z UNION ALL SELECT 'Mindkét kapu', CAST(day AS VARCHAR), sum(value) FROM Z GROUP BY day")
def series_filled_total(spark, sf):
    return text_day(signals.with_total(signals.zero_filled(A.order_series(spark, sf)))).select("series", "day", "value")


def _signals(spark, sf) -> DataFrame:
    return signals.signals(A.order_series(spark, sf))


_SIG = f"{A.S_SQL}, {A.BASE_SQL}"


@query(f"WITH {_SIG} SELECT series, CAST(day AS VARCHAR) AS day, value, base_days, base, round(e, 6) AS e, round(threshold, 6) AS threshold, signal FROM SIG")
def signal_rule(spark, sf):
    return text_day(_signals(spark, sf)).select("series", "day", "value", "base_days", "base", r6("e"), r6("threshold"), "signal")


@query(f"WITH {_SIG} SELECT series, count(e) AS n, round(median(abs(e)), 6) AS median_abs, round(quantile_cont(abs(e), 0.9), 6) AS p90_abs, round(1.4826 * max(mad), 6) AS sigma FROM EE JOIN M USING (series) WHERE e IS NOT NULL GROUP BY 1")
def noise_stats(spark, sf):
    n = signals.noise(signals.baseline(A.order_series(spark, sf)))
    return n.select("series", "n", r6("median_abs"), r6("p90_abs"), r6("sigma"))


_NAIVE = "NV AS (SELECT series, day, value / m - 1 AS e FROM S JOIN (SELECT series, median(value) AS m FROM S GROUP BY 1) USING (series)), NM2 AS (SELECT series, median(abs(e - m)) AS mad FROM NV JOIN (SELECT series, median(e) AS m FROM NV GROUP BY 1) USING (series) GROUP BY 1), NS AS (SELECT series, day, CASE WHEN e > 2.0::DOUBLE * 1.4826::DOUBLE * mad THEN 'szokatlanul magas' WHEN e < -(2.0::DOUBLE * 1.4826::DOUBLE * mad) THEN 'szokatlanul alacsony' ELSE 'normál' END AS naive FROM NV JOIN NM2 USING (series))"


@query(f"WITH {_SIG}, {_NAIVE} SELECT series, signal, naive, count(*) AS days FROM SIG JOIN NS USING (series, day) GROUP BY 1, 2, 3")
def metric_variants(spark, sf):
    s = A.order_series(spark, sf)
    n = signals.naive(s).select("series", "day", F.col("signal").alias("naive"))
    return signals.signals(s).join(n, ["series", "day"]).groupBy("series", "signal", "naive").agg(F.count("*").alias("days"))


_CUT = "1999-12-31"
_SIG2 = _SIG.replace("FROM orders GROUP BY", f"FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '{_CUT}' GROUP BY")


@query(f"WITH F1 AS (WITH {_SIG} SELECT series, day, signal, round(e, 9) AS e, value FROM SIG), F2 AS (WITH {_SIG2} SELECT series, day, signal, round(e, 9) AS e, value FROM SIG) SELECT count(*) FILTER (F1.series IS NOT NULL AND F2.series IS NOT NULL) AS both, count(*) FILTER (F2.series IS NULL) AS only_a, count(*) FILTER (F1.series IS NULL) AS only_b, count(*) FILTER (F1.series IS NOT NULL AND F2.series IS NOT NULL AND F1.signal IS DISTINCT FROM F2.signal) AS signal_differs, count(*) FILTER (F1.series IS NOT NULL AND F2.series IS NOT NULL AND F1.e IS DISTINCT FROM F2.e) AS e_differs FROM F1 FULL JOIN F2 ON F1.series = F2.series AND F1.day = F2.day")
def signal_diff(spark, sf):
    s = A.order_series(spark, sf)
    cut = s.filter(F.col("day") <= F.lit(_CUT).cast("date"))
    rounded = lambda t: signals.signals(t).withColumn("e", F.round("e", 9))
    return signals.compare(rounded(s), rounded(cut), ["signal", "e"])


@query(f"WITH {_SIG} SELECT series, CAST(max(day) AS VARCHAR) AS day, arg_max(value, day) AS value, round(arg_max_null(e, day), 6) AS e, arg_max(signal, day) AS signal FROM SIG GROUP BY 1")
def latest_state(spark, sf):
    return text_day(signals.latest(_signals(spark, sf))).select("series", "day", "value", r6("e"), "signal")


@query(f"WITH {_SIG} SELECT series, CAST(day AS VARCHAR) AS day, rank() OVER (PARTITION BY series ORDER BY round(abs(e), 9) DESC) AS rank, count(*) OVER (PARTITION BY series) AS n FROM EE WHERE e IS NOT NULL")
def deviation_rank(spark, sf):
    return text_day(signals.ranked(signals.baseline(A.order_series(spark, sf)))).select("series", "day", "rank", "n")


@query(f"WITH {A.S_SQL}, MD AS (SELECT series, median(abs(value - m)) AS mad FROM S JOIN (SELECT series, median(value) AS m FROM S GROUP BY 1) USING (series) GROUP BY 1) SELECT series, count(value) AS n, round(avg(value), 6) AS mean, median(value) AS median, round(stddev_samp(value), 6) AS sd, round(stddev_samp(value) / avg(value), 6) AS rel_sd, round(1.4826 * max(mad), 6) AS robust_sd, min(value) AS min, max(value) AS max, round(avg(value) FILTER (isodow(day) < 6), 6) AS weekdays, round(avg(value) FILTER (isodow(day) >= 6), 6) AS weekend, round(avg(value) FILTER (isodow(day) >= 6) / avg(value) FILTER (isodow(day) < 6), 6) AS ratio FROM S JOIN MD USING (series) GROUP BY 1")
def series_stats(spark, sf):
    s = signals.series_stats(A.order_series(spark, sf))
    return s.select(*[r6(n) if t == "double" else n for n, t in s.dtypes])


@query(f"WITH {A.S_SQL}, MO AS (SELECT series, strftime(day, '%Y-%m') AS month, count(*) AS days, avg(value) AS mean FROM S GROUP BY 1, 2) SELECT a.series, a.month, a.days, round(a.mean, 6) AS mean, round(100 * (a.mean / b.mean - 1), 6) AS change FROM MO a LEFT JOIN MO b ON a.series = b.series AND CAST(substr(a.month, 1, 4) AS INT) = CAST(substr(b.month, 1, 4) AS INT) + 1 AND substr(a.month, 6) = substr(b.month, 6)")
def yoy_month(spark, sf):
    return signals.yearly(A.order_series(spark, sf)).select("series", "month", "days", r6("mean"), r6("change"))


@query(f"WITH {A.AB_SQL}, WK AS (SELECT date_trunc('week', day) AS w, sum(x) AS x FROM A GROUP BY 1), WL AS (SELECT date_trunc('week', day) AS w, sum(y) AS y FROM B GROUP BY 1) SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM WK JOIN WL USING (w)")
def week_resample_corr(spark, sf):
    a = signals.weekly(A.daily_orders(spark, sf).withColumn("series", F.lit("a"))).select("week", F.col("value").alias("x"))
    b = signals.weekly(A.daily_lines(spark, sf).withColumn("series", F.lit("b"))).select("week", F.col("value").alias("y"))
    return a.join(b, "week").agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("r"))


@query(f"WITH {A.AB_SQL}, J AS (SELECT day, x, y FROM A JOIN B USING (day)), R AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM J) SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(avg(x / y), 6) AS mean_ratio, round(min(x / y), 6) AS min_ratio, round(max(x / y), 6) AS max_ratio FROM R")
def spearman(spark, sf):
    a = signals.agreement(A.daily_orders(spark, sf), A.daily_lines(spark, sf))
    return a.select("n", *[r6(c) for c in a.columns[1:]])


@query(f"WITH {_SIG}, {_NAIVE}, J AS (SELECT signal AS a, naive AS b FROM SIG JOIN NS USING (series, day) WHERE e IS NOT NULL), C AS (SELECT a, b, count(*) AS n FROM J GROUP BY 1, 2), T AS (SELECT sum(n) AS n, sum(n) FILTER (a = b) AS same FROM C), PE AS (SELECT sum(x * y) AS xy FROM (SELECT a AS l, sum(n) AS x FROM C GROUP BY 1) JOIN (SELECT b AS l, sum(n) AS y FROM C GROUP BY 1) USING (l)) SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS observed, CASE WHEN xy / (n * n) < 1 THEN round((same / n - xy / (n * n)) / (1 - xy / (n * n)), 6) END AS kappa FROM T, PE")
def kappa(spark, sf):
    s = A.order_series(spark, sf)
    n = signals.naive(s).select("series", "day", F.col("signal").alias("b"))
    pairs = signals.signals(s).filter("e is not null").join(n, ["series", "day"]).select(F.col("signal").alias("a"), "b")
    k = evaluate.kappa(pairs)
    return k.select("n", r6("observed"), r6("kappa"))


# -- evaluation ----------------------------------------------------------------------------------------------
_CLASS = lambda e, t: f"CASE WHEN {e} IS NULL OR {t} IS NULL THEN -9 WHEN {e} > {t} THEN 1 WHEN {e} < -({t}) THEN -1 ELSE 0 END"


@query(f"WITH {_SIG}, {A.LEARN_SQL} SELECT series, CAST(day AS VARCHAR) AS day, round(learned, 6) AS learned, {_CLASS('e', '2.0::DOUBLE * 1.4826::DOUBLE * learned')} AS class FROM L")
def walk_forward(spark, sf):
    return text_day(evaluate.walk_forward(signals.baseline(A.order_series(spark, sf)))).select("series", "day", r6("learned"), "class")


_END = "1997-12-31"


@query(f"WITH {_SIG}, TR AS (SELECT series, e FROM EE WHERE day <= DATE '{_END}' AND e IS NOT NULL), TM AS (SELECT series, 2.0::DOUBLE * 1.4826::DOUBLE * median(abs(e - m)) AS lim FROM TR JOIN (SELECT series, median(e) AS m FROM TR GROUP BY 1 HAVING count(*) >= 21) USING (series) GROUP BY 1) SELECT series, CAST(day AS VARCHAR) AS day, round(lim, 6) AS lim, {_CLASS('e', 'lim')} AS class FROM EE LEFT JOIN TM USING (series) WHERE day > DATE '{_END}'")
def frozen_threshold(spark, sf):
    t = text_day(evaluate.frozen(signals.baseline(A.order_series(spark, sf)), _END))
    return t.select("series", "day", F.round("limit", 6).alias("lim"), "class")


_Z = "Z AS (SELECT series, day, (value - 5) / 2 AS z, row_number() OVER (PARTITION BY series ORDER BY day) AS i FROM S)"


@query(f"""WITH RECURSIVE {A.S_SQL}, {_Z}, HH AS (SELECT unnest([1.0::DOUBLE, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0]) AS h),
ST0 AS (SELECT series, h, i, greatest(0.0::DOUBLE, z - 0.5::DOUBLE) AS up, greatest(0.0::DOUBLE, -z - 0.5::DOUBLE) AS dn FROM Z, HH WHERE i = 1),
RC AS (SELECT series, h, i, up > h AS hi, dn > h AS lo, CASE WHEN up > h THEN 0.0::DOUBLE ELSE up END AS up, CASE WHEN dn > h THEN 0.0::DOUBLE ELSE dn END AS dn FROM ST0
UNION ALL SELECT series, h, i, u > h, d > h, CASE WHEN u > h THEN 0.0::DOUBLE ELSE u END, CASE WHEN d > h THEN 0.0::DOUBLE ELSE d END FROM (SELECT RC.series, RC.h, Z.i, greatest(0.0::DOUBLE, RC.up + Z.z - 0.5::DOUBLE) AS u, greatest(0.0::DOUBLE, RC.dn - Z.z - 0.5::DOUBLE) AS d FROM RC JOIN Z ON Z.series = RC.series AND Z.i = RC.i + 1))
SELECT RC.series, CAST(Z.day AS VARCHAR) AS day, h, CASE WHEN hi THEN 1 WHEN lo THEN -1 ELSE 0 END AS class FROM RC JOIN Z USING (series, i)""")
def cusum(spark, sf):
    z = A.order_series(spark, sf).select("series", "day", ((F.col("value") - 5) / 2).alias("z"))
    return text_day(evaluate.cusum(z)).select("series", "day", "h", "class")


_LOGS = "LR AS (SELECT series, day, ln(CASE WHEN value > 0 THEN value ELSE 0.5 END / base) AS e FROM EE)"
_LOG_LEARN = A.LEARN_SQL.replace("FROM EE t LEFT JOIN EE p", "FROM LR t LEFT JOIN LR p")
_STD = f"{_SIG}, {_LOGS}, {_LOG_LEARN}, ZZ AS (SELECT series, day, CASE WHEN learned > 0 THEN e / (1.4826::DOUBLE * learned) END AS z FROM L), Z AS (SELECT series, day, z, row_number() OVER (PARTITION BY series ORDER BY day) AS i FROM ZZ WHERE z IS NOT NULL)"
_STEP = """HH AS (SELECT unnest([1.0::DOUBLE, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0]) AS h),
ST0 AS (SELECT series, h, i, greatest(0.0::DOUBLE, z - 0.5::DOUBLE) AS up, greatest(0.0::DOUBLE, -z - 0.5::DOUBLE) AS dn FROM Z, HH WHERE i = 1),
RC AS (SELECT series, h, i, up > h AS hi, dn > h AS lo, CASE WHEN up > h THEN 0.0::DOUBLE ELSE up END AS up, CASE WHEN dn > h THEN 0.0::DOUBLE ELSE dn END AS dn FROM ST0
UNION ALL SELECT series, h, i, u > h, d > h, CASE WHEN u > h THEN 0.0::DOUBLE ELSE u END, CASE WHEN d > h THEN 0.0::DOUBLE ELSE d END FROM (SELECT RC.series, RC.h, Z.i, greatest(0.0::DOUBLE, RC.up + Z.z - 0.5::DOUBLE) AS u, greatest(0.0::DOUBLE, RC.dn - Z.z - 0.5::DOUBLE) AS d FROM RC JOIN Z ON Z.series = RC.series AND Z.i = RC.i + 1))"""
_CUS = f"{_STEP}, CU AS (SELECT ZZ.series, ZZ.day, HH.h, CASE WHEN RC.i IS NULL THEN -9 WHEN hi THEN 1 WHEN lo THEN -1 ELSE 0 END AS class FROM ZZ CROSS JOIN HH LEFT JOIN Z ON Z.series = ZZ.series AND Z.day = ZZ.day LEFT JOIN RC ON RC.series = Z.series AND RC.i = Z.i AND RC.h = HH.h)"


@query(f"WITH RECURSIVE {_STD}, {_CUS} SELECT series, CAST(day AS VARCHAR) AS day, h, class FROM CU")
def cusum_standardised(spark, sf):
    return text_day(evaluate.cusum(evaluate.standardised(signals.baseline(A.order_series(spark, sf))))).select("series", "day", "h", "class")


def _family_sql(tag: str, source: str, back: tuple[int, ...], least: int) -> str:
    """CTEs E<tag> (series, day, e) and L<tag> (with the learned MAD) over `source`, with these base weeks."""
    days = ", ".join(f"s.day - {7 * w}" for w in back)
    return f"""E{tag} AS (SELECT s.series, s.day, any_value(s.value) / CASE WHEN count(p.value) >= {least} AND median(p.value) > 0 THEN median(p.value) END - 1 AS e FROM {source} s LEFT JOIN {source} p ON p.series = s.series AND p.day IN ({days}) GROUP BY 1, 2),
N{tag} AS (SELECT t.series, t.day, t.e, count(p.e) AS n, median(p.e) AS m, list(p.e) FILTER (p.e IS NOT NULL) AS past FROM E{tag} t LEFT JOIN E{tag} p ON p.series = t.series AND p.day < t.day GROUP BY 1, 2, 3),
L{tag} AS (SELECT series, day, e, CASE WHEN n >= 21 THEN list_median(list_transform(past, lambda v: abs(v - m))) END AS learned FROM N{tag})"""


_KS = ", ".join(f"{k!r}::DOUBLE" for k in C.K_GRID)
_R2 = [w for w in C.WEEK_CHOICES if w != C.WEEKS]
_RULES = f"""{_STD}, {_CUS}, W7 AS (SELECT series, day, round_even(rolled, 0) AS value FROM {_ROLL}), {_family_sql('R1', 'S', (1, 2, 3, 4), 3)}, {', '.join(_family_sql(f'R2{w}', 'S', tuple(range(1, w + 1)), max(2, w - 1)) for w in _R2)}, {_family_sql('R3', 'W7', (1, 2, 3, 4), 3)}, KG AS (SELECT unnest([{_KS}]) AS k),
FM AS (SELECT series, day, 'R1' AS family, k AS param, {_CLASS('e', 'k * 1.4826::DOUBLE * learned')} AS class FROM LR1, KG UNION ALL SELECT series, day, 'R3', k, {_CLASS('e', 'k * 1.4826::DOUBLE * learned')} FROM LR3, KG
{' '.join(f"UNION ALL SELECT series, day, 'R2', {w}::DOUBLE, {_CLASS('e', '2.0::DOUBLE * 1.4826::DOUBLE * learned')} FROM LR2{w}" for w in _R2)} UNION ALL SELECT series, day, 'R4', h, class FROM CU)"""


def _rules(spark, sf) -> DataFrame:
    return evaluate.rule_families(A.order_series(spark, sf))


@query(f"WITH RECURSIVE {_RULES} SELECT family, param, class, count(*) AS days FROM FM GROUP BY 1, 2, 3")
def rule_families(spark, sf):
    return _rules(spark, sf).groupBy("family", "param", "class").agg(F.count("*").alias("days"))


@query(f"""WITH RECURSIVE {_RULES}, JD AS (SELECT *, count(*) OVER (PARTITION BY series, day) = {2 * len(C.K_GRID) + len(_R2) + len(C.CUSUM_GRID)} AS every FROM FM WHERE class <> -9)
SELECT series, family, param, count(*) AS days, count(*) FILTER (class <> 0) AS signalled, count(*) FILTER (every) AS common_days, count(*) FILTER (every AND class <> 0) AS common_signalled, round(30 * count(*) FILTER (class <> 0) / count(*), 6) AS per_30, round(30 * count(*) FILTER (every AND class <> 0) / nullif(count(*) FILTER (every), 0), 6) AS common_per_30 FROM JD GROUP BY 1, 2, 3""")
def rule_table(spark, sf):
    t = evaluate.rule_table(_rules(spark, sf))
    return t.withColumns({"per_30": F.round("per_30", 6), "common_per_30": F.round("common_per_30", 6)})


@query(f"WITH RECURSIVE {_RULES}, R0 AS (SELECT series, day, class AS own FROM FM WHERE family = 'R1' AND param = 2.0 AND class <> -9) SELECT series, family, param, count(*) AS days, count(*) FILTER (class = own) AS alike FROM FM JOIN R0 USING (series, day) WHERE class <> -9 GROUP BY 1, 2, 3")
def rule_agreement(spark, sf):
    return evaluate.rule_agreement(_rules(spark, sf))


@query(f"WITH {_SIG}, {A.LEARN_SQL}, KK AS (SELECT unnest([{', '.join(map(str, C.K_GRID))}])::DOUBLE AS k), CL AS (SELECT series, k, {_CLASS('e', 'k * 1.4826::DOUBLE * learned')} AS class FROM L, KK) SELECT series, k, count(*) AS days, round(30 * avg(CASE WHEN class <> 0 THEN 1.0 ELSE 0.0 END), 6) AS per_30 FROM CL WHERE class <> -9 GROUP BY 1, 2")
def false_alarm_30(spark, sf):
    w = evaluate.walk_forward(signals.baseline(A.order_series(spark, sf)), C.K_GRID)
    return evaluate.alarm_rate(w, ("series", "k")).withColumn("per_30", F.round("per_30", 6))


@query(f"WITH {_SIG} SELECT series, strftime(day, '%Y-%m') AS month, count(*) AS days, count(*) FILTER (signal LIKE 'szokatlanul%') AS signalled FROM SIG WHERE signal <> 'nincs alapszint' GROUP BY 1, 2")
def false_alarms_monthly(spark, sf):
    return signals.false_alarms(_signals(spark, sf))


@query()
def injection_detect(spark, sf):
    return evaluate.detection(evaluate.injected(A.order_series(spark, sf)))


def _roc(spark, sf) -> DataFrame:
    s = A.order_series(spark, sf)
    rates = evaluate.detection(evaluate.injected(s, C.K_GRID))
    return evaluate.roc(rates, evaluate.alarm_rate(evaluate.walk_forward(signals.baseline(s), C.K_GRID), ("series", "k")))


@query()
def roc_points(spark, sf):
    return _roc(spark, sf)


@query()
def operating_point(spark, sf):
    return evaluate.operating_point(_roc(spark, sf))


_DAYP = "1997-07-15"


@query(f"""WITH {_SIG}, V AS (SELECT series, day, value, base FROM EE WHERE base IS NOT NULL), PP AS (SELECT a.series, a.day, round((a.value + b.value) / (a.base + b.base) - 1, 9) AS d FROM V a JOIN V b ON a.series = b.series AND b.day = a.day + 1), OW AS (SELECT series, d AS own FROM PP WHERE day = DATE '{_DAYP}')
SELECT series, round(own, 6) AS own, count(*) AS n, 1 + count(*) FILTER (d > own) AS rank, round((1 + count(*) FILTER (d >= own)) / (count(*) + 1), 6) AS p_upper, round((1 + count(*) FILTER (abs(d) >= abs(own))) / (count(*) + 1), 6) AS p_two_sided FROM PP JOIN OW USING (series) WHERE abs(day - DATE '{_DAYP}') > 1 GROUP BY 1, 2""")
def placebo(spark, sf):
    p = evaluate.placebo(A.order_series(spark, sf), _DAYP)
    return p.select("series", r6("own"), "n", "rank", r6("p_upper"), r6("p_two_sided"))


#: The study windows' calendar, moved to years that the orders cover.
_WINDOWS = {"A26": ("1998-01-12", "1998-02-27"), "B26": ("1998-03-09", "1998-05-29"), "A25": ("1997-01-13", "1997-02-28"), "B25": ("1997-03-10", "1997-05-30")}
_WCASE = "CASE " + " ".join(f"WHEN day BETWEEN DATE '{a}' AND DATE '{b}' THEN '{w}'" for w, (a, b) in _WINDOWS.items()) + " END"
_BLK = f"{A.AB_SQL}, WD AS (SELECT *, {_WCASE} AS \"window\", CAST(date_trunc('week', day) AS DATE) AS block FROM A), BS AS (SELECT \"window\", block, sum(x) AS top, CAST(count(*) AS DOUBLE) AS bottom FROM WD WHERE \"window\" IS NOT NULL GROUP BY 1, 2)"


def _blocks(spark, sf) -> DataFrame:
    d = evaluate.in_windows(A.daily_orders(spark, sf).withColumn("one", F.lit(1.0)), _WINDOWS)
    return evaluate.block_sums(d, "value", "one")


@query(f'WITH {_BLK} SELECT "window", CAST(block AS VARCHAR) AS block, top, bottom FROM BS')
def block_sums(spark, sf):
    return text_day(_blocks(spark, sf), "block")


_DIDM = ", ".join(f"sum(top) FILTER (\"window\" = '{w}') / sum(bottom) FILTER (\"window\" = '{w}') AS {w}" for w in _WINDOWS)


@query(f"WITH {_BLK}, DM AS (SELECT {_DIDM} FROM BS) SELECT " + ", ".join(f"round({w}, 6) AS {w}" for w in _WINDOWS) + ", round((B26 - A26) - (B25 - A25), 6) AS did FROM DM")
def did_point(spark, sf):
    return evaluate.did(_blocks(spark, sf)).select(*[r6(c) for c in (*_WINDOWS, "did")])


@query()
def bootstrap_did(spark, sf):
    point, draws = evaluate.bootstrap_did(_blocks(spark, sf))
    lo, hi = evaluate.interval(draws)
    return spark.createDataFrame([("value", point, lo, hi, evaluate.bootstrap_p(draws))], "name string, point double, low double, high double, p double")


@query()
def mde(spark, sf):
    se, least = evaluate.mde(evaluate.bootstrap_did(_blocks(spark, sf))[1])
    return spark.createDataFrame([("value", se, least)], "name string, se double, mde double")


_P = (("H1", 0.012), ("H2", 0.03), ("H3", 0.2))


@query(f"WITH T AS (SELECT * FROM (VALUES {', '.join(f'({n!r}, {p}::DOUBLE)' for n, p in _P)}) AS t(name, p)), R AS (SELECT *, row_number() OVER (ORDER BY p, name) AS rank, count(*) OVER () AS m FROM T), Q AS (SELECT *, 0.05::DOUBLE / (m - rank + 1) AS level, least(1.0::DOUBLE, (m - rank + 1) * p) AS raw FROM R) SELECT name, p, rank, round(level, 9) AS level, round(max(raw) OVER (ORDER BY rank), 9) AS p_holm, bool_and(p < level) OVER (ORDER BY rank) AS rejected FROM Q")
def holm(spark, sf):
    h = evaluate.holm(spark.createDataFrame(list(_P), "name string, p double"))
    return h.select("name", "p", "rank", F.round("level", 9).alias("level"), F.round("p_holm", 9).alias("p_holm"), "rejected")


@query("WITH W AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', DATE '{a}', DATE '{b}')" for w, (a, b) in C.WINDOWS.items()) + ") AS t(\"window\", a, b)), D AS (SELECT \"window\", CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM W) SELECT CAST(day AS VARCHAR) AS day, \"window\", isodow(day) - 1 AS weekday, CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS block FROM D WHERE isodow(day) IN (2, 4)")
def sample_calendar(spark, sf):
    return text_day(text_day(evaluate.sample_days(spark)), "block")


#: The study's windows in the days that positions cover.
_EV = {"A25": ("2024-01-02", "2024-01-08"), "B25": ("2024-01-09", "2024-01-16"), "A26": ("2024-01-17", "2024-01-23"), "B26": ("2024-01-24", "2024-01-30")}
_VARIANTS = {"main": (C.TANKER_LIMIT, False), **{f"limit {k}": (k, False) for k in C.LIMIT_VARIANTS}, "no orders": (C.TANKER_LIMIT, True)}
_VROWS = ", ".join(f"('{n}', {k!r}::DOUBLE, {'TRUE' if s else 'FALSE'})" for n, (k, s) in _VARIANTS.items())
_LADEN = "coalesce(evaluable AND rel >= lim, FALSE)"
_STUDY = f"""{_REL}, {_DCAT.removeprefix(A.P_SQL + ', ')}, SE AS (SELECT RL.*, category FROM RL JOIN DC USING (mmsi, ts) WHERE ship_group = 'Tanker' AND direction = 'észak'), VR AS (SELECT * FROM (VALUES {_VROWS}) AS t(variant, lim, skip)),
SD AS (SELECT "window", CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM (VALUES {', '.join(f"('{w}', DATE '{a}', DATE '{b}')" for w, (a, b) in _EV.items())}) AS t("window", a, b)),
SM AS (SELECT variant, CAST(day AS DATE) AS day, count(*) FILTER ({_LADEN}) AS h1, count(*) FILTER ({_LADEN} AND category = '{T.CAT_EAST}') AS h2_top, count(*) FILTER ({_LADEN} AND NOT (skip AND category = '{T.CAT_ORDER}')) AS h2_bottom, sum(length * width * draught) FILTER (plausible) AS h3, count(*) AS outward, count(*) FILTER (evaluable) AS outward_evaluable FROM SE, VR GROUP BY 1, 2),
DM AS (SELECT v.variant, SD.day, "window", CAST(date_trunc('week', SD.day) AS DATE) AS block, coalesce(h1, 0) AS h1, coalesce(h2_top, 0) AS h2_top, coalesce(h2_bottom, 0) AS h2_bottom, coalesce(h3, 0) AS h3, coalesce(outward, 0) AS outward, coalesce(outward_evaluable, 0) AS outward_evaluable FROM SD CROSS JOIN (SELECT variant FROM VR) v LEFT JOIN SM ON SM.variant = v.variant AND SM.day = SD.day),
MM AS (SELECT variant, day, "window", block, 'H1' AS metric, h1::DOUBLE AS top, 1::DOUBLE AS bottom FROM DM UNION ALL SELECT variant, day, "window", block, 'H2', h2_top::DOUBLE, h2_bottom::DOUBLE FROM DM UNION ALL SELECT variant, day, "window", block, 'H3', h3::DOUBLE, 1::DOUBLE FROM DM)"""
_WMEANS = ", ".join(f"sum(top) FILTER (\"window\" = '{w}') / nullif(sum(bottom) FILTER (\"window\" = '{w}'), 0) AS {w}" for w in C.WINDOWS)
_WROUND = ", ".join(f"round({w}, 6) AS {w}" for w in C.WINDOWS) + ", round((B26 - A26) - (B25 - A25), 6) AS did"


def _study_daily(spark, sf, variants=None) -> DataFrame:
    seen = _categorised(spark, sf).select("mmsi", "ts", "category")
    events = _relative(spark, sf).filter("ship_group = 'Tanker'").join(seen, ["mmsi", "ts"])
    return study.daily_metrics(events, evaluate.sample_days(spark, _EV, tuple(range(7))), variants or _VARIANTS)


@query(f'WITH {_STUDY} SELECT variant, CAST(day AS VARCHAR) AS day, "window", CAST(block AS VARCHAR) AS block, h1, h2_top, h2_bottom, round(h3, 6) AS h3, outward, outward_evaluable FROM DM')
def study_metrics(spark, sf):
    return text_day(text_day(_study_daily(spark, sf), "block")).withColumn("h3", F.round("h3", 6)).drop("one")


@query(f"WITH {_STUDY}, WM AS (SELECT variant, metric, count(DISTINCT day) AS days, {_WMEANS} FROM MM GROUP BY 1, 2) SELECT variant, metric, days, {_WROUND} FROM WM")
def study_means(spark, sf):
    t = study.window_means(study.by_metric(_study_daily(spark, sf)), ["variant"])
    return t.select("variant", "metric", "days", *[r6(c) for c in (*C.WINDOWS, "did")])


@query(f"WITH {_STUDY}, MS AS (SELECT *, CASE WHEN isodow(day) IN (2, 4) THEN 'sampled' ELSE 'other' END AS subset FROM MM UNION ALL SELECT *, 'all' FROM MM), WM AS (SELECT variant, subset, metric, count(DISTINCT day) AS days, {_WMEANS} FROM MS WHERE variant = 'main' GROUP BY 1, 2, 3) SELECT variant, subset, metric, days, {_WROUND} FROM WM")
def study_weekdays(spark, sf):
    t = study.weekday_breakdown(_study_daily(spark, sf, study.MAIN))
    return t.select("variant", "subset", "metric", "days", *[r6(c) for c in (*C.WINDOWS, "did")])


@query()
def study_results(spark, sf):
    return study.result_table(_study_daily(spark, sf))


@query()
def study_sensitivity(spark, sf):
    return study.sensitivity(study.result_table(_study_daily(spark, sf)))


@query()
def study_intervals(spark, sf):
    return study.window_intervals(_study_daily(spark, sf, study.MAIN))


@query(f"""WITH {A.S_SQL}, CA AS (SELECT series, CAST(unnest(generate_series(DATE '1995-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT series FROM S WHERE day BETWEEN DATE '1995-01-01' AND DATE '1998-12-31')),
SC AS (SELECT CA.series, CA.day, value FROM CA LEFT JOIN S USING (series, day)), SR AS (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m FROM SC WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT series, CAST(day AS VARCHAR) AS day, value, CASE WHEN n = 7 THEN round(m, 6) END AS rolled FROM SR""")
def stitched_series(spark, sf):
    s = A.order_series(spark, sf)
    parts = [s.filter("day < date'1996-07-01'"), s.filter("day >= date'1996-07-01' and day < date'1997-03-01'"), s.filter("day >= date'1997-03-01'")]
    return text_day(study.stitched(parts, "1995-01-01", "1998-12-31")).withColumn("rolled", F.round("rolled", 6))


# -- sets and publishing -------------------------------------------------------------------------------------
@query("SELECT CAST(d AS VARCHAR) AS day FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d) WHERE d NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)")
def days_except(spark, sf):
    want = spark.range(1).select(F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date"))).alias("day"))
    return text_day(sets.missing(want, A.daily_orders(spark, sf)))


@query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders INTERSECT SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) FROM lineitem")
def days_intersect(spark, sf):
    return text_day(sets.common(A.daily_orders(spark, sf).select("day"), A.daily_lines(spark, sf).select("day")))


@query(f"WITH {_SIG}, {_NAIVE} SELECT kind, signal, count(*) AS days FROM (SELECT 'rule' AS kind, signal FROM SIG UNION ALL SELECT 'naive', naive FROM NS) GROUP BY 1, 2")
def union_signals(spark, sf):
    s = A.order_series(spark, sf)
    u = sets.union_tagged(rule=signals.signals(s).select("series", "day", "signal"), naive=signals.naive(s).select("series", "day", "signal"))
    return u.groupBy("kind", "signal").agg(F.count("*").alias("days"))


@query("SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code, count(*) AS orders FROM orders GROUP BY 1")
def dict_encode(spark, sf):
    t = signals.dictionary_codes(table(spark, sf, "orders").select("o_orderpriority"), "o_orderpriority")
    return t.groupBy("o_orderpriority", "code").agg(F.count("*").alias("orders"))


@query("SELECT r_regionkey, sha256(r_regionkey || '|' || r_name) AS sha256, substr(sha1(r_name), 1, 12) AS short FROM region")
def feed_hash(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", F.sha2(F.concat_ws("|", "r_regionkey", "r_name"), 256).alias("sha256"), F.substring(F.sha1("r_name"), 1, 12).alias("short"))


@query(f"WITH {_SIG}, LD AS (SELECT DISTINCT day FROM SIG ORDER BY 1 DESC LIMIT 30) SELECT series, CAST(day AS VARCHAR) AS day, signal FROM SIG WHERE day IN (SELECT day FROM LD)")
def last_30_days(spark, sf):
    return text_day(signals.last_days(_signals(spark, sf), 30)).select("series", "day", "signal")


@query(f"WITH {_SIG}, NW AS (SELECT series, signal FROM SIG WHERE day = (SELECT max(day) FROM SIG WHERE day <= DATE '1998-06-10') AND signal LIKE 'szokatlanul%'), WS AS (SELECT series, signal FROM SIG WHERE day = DATE '1998-06-09' AND signal LIKE 'szokatlanul%') SELECT series, signal, CASE WHEN WS.series IS NULL THEN 'open' WHEN NW.series IS NULL THEN 'close' ELSE 'keep' END AS action FROM NW FULL JOIN WS USING (series, signal)")
def alert_actions(spark, sf):
    t = _signals(spark, sf)
    was = t.filter("day = date'1998-06-09' and signal like 'szokatlanul%'")
    return signals.open_alerts(t.filter("day <= date'1998-06-10'"), was)

