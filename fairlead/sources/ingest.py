"""Raw day files: reading, typing, dedup with multiplicity, validation, sorted store."""

from __future__ import annotations

import os
import zipfile
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead import config as C
from fairlead.functions.cells import CellIndex, GridIndex
from fairlead.functions.numbers import parse_timestamp
from fairlead.operators.traffic import dedup_with_multiplicity, row_counts, source_order

#: The kept columns of a raw file, their names in the store and their types.
TIMESTAMP = "# Timestamp"
COLUMNS = [
    ("Type of mobile", "type_of_mobile", "string"),
    ("MMSI", "mmsi", "bigint"),
    ("Latitude", "lat", "double"),
    ("Longitude", "lon", "double"),
    ("Navigational status", "nav_status", "string"),
    ("SOG", "sog", "double"),
    ("COG", "cog", "double"),
    ("IMO", "imo", "string"),
    ("Callsign", "callsign", "string"),
    ("Name", "name", "string"),
    ("Ship type", "ship_type", "string"),
    ("Width", "width", "double"),
    ("Length", "length", "double"),
    ("Draught", "draught", "double"),
    ("Destination", "destination", "string"),
]
SCHEMA_VERSION = 2


def days(first: date, last: date) -> list[date]:
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


def store_path(root: str, day: date) -> str:
    return f"{root}/ev={day:%Y}/ho={day:%m}/nap={day:%Y-%m-%d}"


def zip_is_whole(path: str) -> bool:
    """CRC check of every member."""
    try:
        with zipfile.ZipFile(path) as z:
            return z.testzip() is None and len(z.namelist()) == 1
    except (OSError, zipfile.BadZipFile):
        return False


def unzip_day(path: str, folder: str) -> tuple[str, int]:
    """Extract the one member (a ZIP cannot be split) and count its data lines on the way, apart from any CSV reader."""
    with zipfile.ZipFile(path) as z:
        (name,) = z.namelist()
        out, lines, last = os.path.join(folder, os.path.basename(name)), 0, b"\n"
        with z.open(name) as src, open(out, "wb") as dst:
            while block := src.read(1 << 22):
                lines += block.count(b"\n")
                last = block
                dst.write(block)
    return out, lines + (not last.endswith(b"\n")) - 1


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with `rn`, a number that rises in the order of files and of lines within them.

    Spark deals blocks of files to partitions by size, so `rn` is made of the file's place among the names (10 bits), the
    megabyte at which the line's block starts (20 bits; blocks are larger) and the line's place in its partition (33 bits).
    """
    source = spark.read.option("header", True).option("quote", '"')
    header, files = source.csv(path).columns, sorted(source.csv(path).inputFiles())
    if len(files) >= 1 << 10:
        raise ValueError(f"{path} holds {len(files)} files; read at most 1023 at once")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = source.schema(schema).option("encoding", "UTF-8").csv(path)
    file = F.array_position(F.lit(files), F.input_file_name())
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rn = F.shiftleft(file, 53) + F.shiftleft(F.floor(F.col("_metadata.file_block_start") / (1 << 20)), 33) + line
    return rows.select("*", rn.alias("rn")).toDF(*[c.lstrip("\ufeff") for c in header], "rn")


def typed(raw: DataFrame) -> DataFrame:
    """Store columns by try_cast: what cannot be read is NULL, never an error."""
    kept = [F.col(f"`{src}`").try_cast(kind).alias(name) for src, name, kind in COLUMNS]
    return raw.select(parse_timestamp(F.col(f"`{TIMESTAMP}`")).alias("ts"), *kept, "dup_db", "first")


def to_store(raw: DataFrame, index: CellIndex | None = None) -> DataFrame:
    """Exact rows once with their number, typed, with cell (NULL for positions that are none) and source order."""
    columns = [f"`{c}`" for c in raw.columns if c != "rn"]
    one = dedup_with_multiplicity(raw, columns, "rn")
    rows = source_order(typed(one), "first")
    return rows.withColumn("cell", (index or GridIndex()).cell(F.col("lat"), F.col("lon"))).drop("first")


def write_store(store: DataFrame, path: str, partitions: int | None = None, group_rows: int = C.GROUP_ROWS) -> None:
    """Sorted by cell, time, ship, order: range partitions, so files and row groups (of `group_rows`) skip by cell."""
    n = partitions or int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    store.repartitionByRange(n, "cell").sortWithinPartitions("cell", "ts", "mmsi", "ord").write.mode("overwrite").option("compression", "zstd").option("parquet.block.row.count.limit", group_rows).parquet(path)


def check_store(spark: SparkSession, path: str, raw_lines: int) -> dict[str, int]:
    """Figures of the written store; raises if the copies do not add up to the raw lines."""
    found = row_counts(spark.read.parquet(path)).first().asDict()
    if found["raw_rows"] != raw_lines:
        raise ValueError(f"{found['raw_rows']} rows stored, {raw_lines} lines read")
    return found


def ingest_day(spark: SparkSession, csv: str, path: str, raw_lines: int | None = None) -> dict[str, int]:
    raw = read_raw(spark, csv)
    write_store(to_store(raw), path)
    return check_store(spark, path, raw_lines if raw_lines is not None else raw.count())


def subset_store(spark: SparkSession, path: str, out: str, types: tuple[str, ...] = ("Tanker", "Cargo")) -> None:
    """Rows of some ship types; counts and copies of source and target must agree."""
    rows = spark.read.parquet(path).filter(F.col("ship_type").isin(*types))
    rows.write.mode("overwrite").option("compression", "zstd").parquet(out)
    sums = lambda d: d.agg(F.count("*"), F.sum("dup_db")).first()
    if sums(rows) != sums(spark.read.parquet(out)):
        raise ValueError(f"{out} does not hold the rows it should")


def store_days(spark: SparkSession, root: str) -> DataFrame:
    """Stored days by partition discovery."""
    return spark.read.parquet(root).select("nap").distinct()
