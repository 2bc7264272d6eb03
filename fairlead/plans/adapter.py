"""Positions and series made from the benchmark tables, for queries on data that has neither.

Only + - * / % and CASE, so another engine gets the same bits. Each builder has its SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.operators.gates import Gate

BELT = Gate("Nagy-Balti-öv", (55.40, 10.60), (55.40, 11.35), outbound="észak", monitor=True)
NORTH = Gate("Második", (55.60, 10.60), (55.60, 11.35), outbound="észak")
#: Events of one ship are hours apart here, so the gap limit is a day.
GAP_S = 86_400

_TYPES = "CASE event_type WHEN 'click' THEN 'Cargo' WHEN 'view' THEN 'Tanker' WHEN 'purchase' THEN 'Passenger' WHEN 'signup' THEN 'Sailing' ELSE 'Undefined' END"
_CLASS = "CASE WHEN event_id % 11 = 0 THEN 'Base Station' WHEN event_id % 4 = 0 THEN 'Class B' ELSE 'Class A' END"
_STATUS = "CASE event_id % 5 WHEN 0 THEN 'Under way using engine' WHEN 1 THEN 'Moored' WHEN 2 THEN 'At anchor' WHEN 3 THEN 'Unknown value' ELSE 'Engaged in fishing' END"
_DEST = "CASE event_id % 9 WHEN 0 THEN 'NLRTM' WHEN 1 THEN 'EGPSD VIA SKAW' WHEN 2 THEN 'FOR ORDERS' WHEN 3 THEN 'SKAGEN' WHEN 4 THEN '' WHEN 5 THEN 'DE HAM' WHEN 6 THEN 'CNSHA' WHEN 7 THEN 'RUULU' ELSE 'unknown' END"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "event_id",
        F.col("user_id").alias("mmsi"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.expr("54.9D + (value % 100) / 100").alias("lat"),
        F.expr("10.60D + 0.75D * ((event_id * 37) % 1000) / 999").alias("lon"),
        F.expr("value / 25").alias("sog"),
        F.expr("CAST((event_id * 53) % 360 AS DOUBLE)").alias("cog"),
        F.expr("value / 20").alias("draught"),
        F.expr("CAST(60 + user_id % 90 AS DOUBLE)").alias("length"),
        F.expr("CAST(10 + user_id % 17 AS DOUBLE)").alias("width"),
        F.expr(_TYPES).alias("ship_type"),
        F.expr(_CLASS).alias("type_of_mobile"),
        F.expr(_STATUS).alias("nav_status"),
        F.expr(_DEST).alias("destination"),
        F.expr("CAST(1 + event_id % 3 AS INT)").alias("dup_db"),
    )


P_SQL = f"""P AS (SELECT event_id, user_id AS mmsi, ts, 54.9::DOUBLE + (value % 100) / 100 AS lat,
  10.60::DOUBLE + 0.75::DOUBLE * ((event_id * 37) % 1000) / 999 AS lon, value / 25 AS sog, CAST((event_id * 53) % 360 AS DOUBLE) AS cog, value / 20 AS draught,
  CAST(60 + user_id % 90 AS DOUBLE) AS length, CAST(10 + user_id % 17 AS DOUBLE) AS width, {_TYPES} AS ship_type, {_CLASS} AS type_of_mobile, {_STATUS} AS nav_status, {_DEST} AS destination,
  CAST(1 + event_id % 3 AS INT) AS dup_db FROM events)"""


def crossings_sql(gate: Gate, name: str, source: str = "P", gap_s: int = GAP_S, order: str = "event_id") -> str:
    """The crossings of a gate as a CTE, from the same literals that the operator uses."""
    c, dx, dy = gate.plane()
    a = gate.canonical()[0]
    left, right = gate.canonical()[2]
    d = lambda x: f"{x!r}::DOUBLE"
    side = f"(((lat - {d(a[0])}) * {d(dx)} - (lon - {d(a[1])}) * {d(c)} * {d(dy)}) >= 0)"
    t = f"(((lon - {d(a[1])}) * {d(c)} * {d(dx)} + (lat - {d(a[0])}) * {d(dy)}) / {d(dx * dx + dy * dy)})"
    return f"""{name} AS (SELECT mmsi, ts, CASE WHEN s THEN '{left}' ELSE '{right}' END AS direction, '{gate.name}' AS gate FROM (
  SELECT *, lag(s) OVER w AS ps, lag(o) OVER w AS po, lag(us) OVER w AS pus FROM (SELECT mmsi, ts, {order}, epoch_us(ts) AS us, {side} AS s, {t} BETWEEN 0 AND 1 AS o FROM {source})
  WINDOW w AS (PARTITION BY mmsi ORDER BY ts, {order})) WHERE s <> ps AND o AND po AND us - pus <= {gap_s * 1_000_000})"""


VOTE_SQL = """V AS (SELECT mmsi, ship_type FROM (SELECT mmsi, ship_type, row_number() OVER (PARTITION BY mmsi ORDER BY count(*) DESC, ship_type) AS r FROM P
  WHERE upper(trim(ship_type)) NOT IN ('', 'UNKNOWN', 'UNDEFINED', 'NAN', 'NONE', 'N/A', 'UNKNOWN VALUE', 'NOT AVAILABLE', 'RESERVED FOR FUTURE USE') GROUP BY 1, 2) WHERE r = 1),
G AS (SELECT m.mmsi, ship_type, CASE ship_type WHEN 'Cargo' THEN 'Teherhajó' WHEN 'Tanker' THEN 'Tanker' WHEN 'Passenger' THEN 'Személyszállító' WHEN 'Sailing' THEN 'Kedvtelési' ELSE 'Egyéb / ismeretlen' END AS ship_group
  FROM (SELECT DISTINCT mmsi FROM P) m LEFT JOIN V USING (mmsi))"""
PLAUSIBLE = "(draught >= 1.0 AND draught < 25.5)"
DAY_SQL = f"""D AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, mmsi, median(draught) FILTER ({PLAUSIBLE}) AS draught, median(length) FILTER (length > 0) AS length, median(width) FILTER (width > 0) AS width FROM P GROUP BY 1, 2)"""


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per day and priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("value"))


S_SQL = "S AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)"


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("value"))


def daily_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").cast("double").alias("value"))


AB_SQL = "A AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS x FROM orders GROUP BY 1), B AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS y FROM lineitem GROUP BY 1)"
BASE_SQL = """E AS (SELECT s.series, s.day, s.value, CAST(count(p.value) AS BIGINT) AS base_days, CASE WHEN count(p.value) >= 3 AND median(p.value) > 0 THEN median(p.value) END AS base
  FROM S s LEFT JOIN S p ON p.series = s.series AND p.day IN (s.day - 7, s.day - 14, s.day - 21, s.day - 28) GROUP BY 1, 2, 3),
EE AS (SELECT *, value / base - 1 AS e FROM E),
M AS (SELECT series, median(abs(e - m)) AS mad FROM EE JOIN (SELECT series, median(e) AS m FROM EE GROUP BY 1) USING (series) GROUP BY 1),
SIG AS (SELECT series, day, value, base_days, base, e, CASE WHEN e IS NOT NULL THEN 2.0::DOUBLE * 1.4826::DOUBLE * mad END AS threshold,
  CASE WHEN e IS NULL THEN 'nincs alapszint' WHEN e > 2.0::DOUBLE * 1.4826::DOUBLE * mad THEN 'szokatlanul magas' WHEN e < -(2.0::DOUBLE * 1.4826::DOUBLE * mad) THEN 'szokatlanul alacsony' ELSE 'normál' END AS signal FROM EE LEFT JOIN M USING (series))"""
LEARN_SQL = """N AS (SELECT t.series, t.day, t.e, count(p.e) AS n, median(p.e) AS m, list(p.e) FILTER (p.e IS NOT NULL) AS past FROM EE t LEFT JOIN EE p ON p.series = t.series AND p.day < t.day GROUP BY 1, 2, 3),
L AS (SELECT series, day, e, CASE WHEN n >= 21 THEN list_median(list_transform(past, lambda v: abs(v - m))) END AS learned FROM N)"""
