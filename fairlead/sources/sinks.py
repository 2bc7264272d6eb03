"""Sinks: replaced whole, upserted by day, and the published feed with its catalogue."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def replace_table(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Write beside the target and rename, so readers see the old table or the new one. If the rename fails the old one comes back."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    df.write.format(fmt).options(**options).save(beside)
    fs, p = _fs(df.sparkSession, path)
    old = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.old")
    new = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(beside)
    had = fs.exists(p)
    if had and not fs.rename(p, old):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(new, p):
        if had:
            fs.rename(old, p)
        raise OSError(f"{beside} could not be renamed to {path}")
    fs.delete(old, True)


def atomic_csv(df: DataFrame, path: str) -> None:
    """A small table as one CSV part in a replaced folder."""
    replace_table(df.coalesce(1), path, "csv", header=True)


def upsert(df: DataFrame, path: str, keys: list[str], order: list[str] | None = None) -> None:
    """Rows of `df` take the place of stored rows with the same keys. For small keyed tables such as the run ledger."""
    spark = df.sparkSession
    if exists(spark, path):
        old = spark.read.parquet(path)
        df = old.join(df.select(*keys).distinct(), keys, "left_anti").unionByName(df, allowMissingColumns=True)
    replace_table(df.sort(*(order or keys)), path)


def upsert_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Replace whole days of a table partitioned by day; other days are not touched."""
    df.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def feed(spark: SparkSession, path: str, tables: dict[str, DataFrame], about: dict[str, dict[str, str]] | None = None) -> dict:
    """JSON documents of small result tables and a catalogue: bytes, SHA-256, rows and what the columns are.

    Tables of a feed are published results of some thousands of rows; NaN becomes null and floats are rounded to six.
    """
    catalogue: dict[str, dict] = {}
    fs, _ = _fs(spark, path)
    for name, df in tables.items():
        clean = df.select(*[F.round(F.nanvl(c, F.lit(None).cast(t)), 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
        rows = [json.loads(r.j) for r in clean.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]
        body = json.dumps(rows, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()
        _put(spark, f"{path}/{name}.json", body)
        catalogue[name] = {"bytes": len(body), "sha256": hashlib.sha256(body).hexdigest(), "rows": len(rows), "columns": (about or {}).get(name, dict(df.dtypes))}
    _put(spark, f"{path}/catalogue.json", json.dumps(catalogue, ensure_ascii=False, indent=1, sort_keys=True).encode())
    return catalogue


def _put(spark: SparkSession, path: str, body: bytes) -> None:
    fs, _ = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    part, target = jvm.org.apache.hadoop.fs.Path(path + ".part"), jvm.org.apache.hadoop.fs.Path(path)
    out = fs.create(part, True)
    try:
        out.write(body)
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def packed_track(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row a key with each column of small integers as base64 of little-endian 16-bit values, in order."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("r"))
    two = lambda c: F.base64(F.unhex(F.array_join(F.transform(F.col("r"), lambda s: F.concat(F.lpad(F.hex(s[c].bitwiseAND(255).cast("long")), 2, "0"), F.lpad(F.hex(F.shiftright(s[c], 8).cast("long")), 2, "0"))), "")))
    return rows.select(key, F.size("r").alias("points"), *[two(c).alias(c) for c in columns])
