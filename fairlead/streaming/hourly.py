"""Extensions for streams: hourly traffic with a watermark, and gate crossings with state per ship."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fairlead import config as C
from fairlead.functions.numbers import in_box
from fairlead.operators.gates import Gate


def read_positions(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly_stream(p: DataFrame, late: str = "1 hour", box: C.Box = C.STUDY_BOX) -> DataFrame:
    """hour, messages and approximate distinct ships per hour of event time; state is one sketch an open hour."""
    t = p.withColumn("ts", F.col("ts").cast("timestamp")).filter(in_box(F.col("lat"), F.col("lon"), box)).withWatermark("ts", late)
    return t.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("messages"), F.approx_count_distinct("mmsi").alias("ships")).select(F.col("window.start").alias("hour"), "messages", "ships")


def crossing_stream(p: DataFrame, gate: Gate, max_gap_s: float = C.CROSSING_GAP_S, idle_ms: int | None = 3_600_000) -> DataFrame:
    """mmsi, ts, direction as ships cross; the state is each ship's last point and goes after an idle hour (None: never)."""
    left, right = gate.canonical()[2]

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        g = pd.concat(list(frames)).sort_values(["us", "event_id"])
        last = state.get if state.exists else None
        out = []
        for us, s, on in zip(g["us"], g["s"], g["inside"], strict=True):
            if last and last[1] != s and last[2] and on and us - last[0] <= max_gap_s * 1e6:
                out.append((key[0], us, left if s == 1 else right))
            last = (int(us), int(s), bool(on))
        state.update(last)
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["mmsi", "us", "direction"])

    q = p.select("mmsi", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), gate.side(F.col("lat"), F.col("lon")).alias("s"), gate.inside(F.col("lat"), F.col("lon")).alias("inside"))
    return q.groupBy("mmsi").applyInPandasWithState(step, "mmsi long, us long, direction string", "us long, s int, inside boolean", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
