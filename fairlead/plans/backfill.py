"""Crossings of many days and gates, kept by day and by the gates' fingerprint, so only what is new or changed is made."""

from __future__ import annotations

import hashlib
import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from fairlead.operators.gates import Gate
from fairlead.plans.daily import day_crossings
from fairlead.sources.sinks import exists


def fingerprint(pool: list[Gate]) -> str:
    """Changes when a gate's name, line, directions or monitoring does, and not with the order of the gates."""
    about = sorted([g.name, *g.a, *g.b, *g.directions, g.monitor] for g in pool)
    return "g" + hashlib.sha256(json.dumps(about, ensure_ascii=False).encode()).hexdigest()[:12]


def pools(gates: list[Gate]) -> list[list[Gate]]:
    """Monitored gates together, since they share the votes; every other gate alone."""
    together = [g for g in gates if g.monitor]
    return ([together] if together else []) + [[g] for g in gates if not g.monitor]


def backfill(spark: SparkSession, days: dict[date, str], gates: list[Gate], out: str, **how) -> list[tuple[str, date]]:
    """Makes the crossings of stored days that `out` lacks; returns the (fingerprint, day) pairs it made.

    A day is there once its folder has Spark's mark of success, so a broken run is made again. `how` goes to day_crossings.
    """
    made = []
    for pool in pools(gates):
        key = fingerprint(pool)
        for day, path in sorted(days.items()):
            where = f"{out}/pool={key}/day={day}"
            if exists(spark, f"{where}/_SUCCESS"):
                continue
            day_crossings(spark.read.parquet(path), pool, **how).write.mode("overwrite").parquet(where)
            made.append((key, day))
    return made


def filled(spark: SparkSession, gates: list[Gate], out: str) -> DataFrame:
    """All kept days of these gates as they are defined now; what other definitions left is not read."""
    keys = [k for k in map(fingerprint, pools(gates)) if exists(spark, f"{out}/pool={k}")]
    return spark.read.option("basePath", out).parquet(*[f"{out}/pool={k}" for k in keys])
