"""Parquet footers as a relation: row-group statistics, and how many groups a range or a box must read."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, row_group int, rows long, column string, min_value double, max_value double, bytes long"


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FooterReader(DataSourceReader):
    """One task a batch of files; only footers are read."""

    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = where.get_file_info(path)
        if info.type == fs.FileType.Directory:
            files = sorted(f.path for f in where.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.endswith(".parquet"))
        else:
            files = [path]
        return [_Files(files[i : i + 64]) for i in range(0, len(files), 64)]

    def read(self, partition):
        import pyarrow.parquet as pq

        for path in partition.paths:
            meta = pq.ParquetFile(path).metadata
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                for c in range(group.num_columns):
                    col = group.column(c)
                    s = col.statistics
                    lo, hi = (s.min, s.max) if s is not None and s.has_min_max else (None, None)
                    if isinstance(lo, datetime):  # times as microseconds
                        lo, hi = ((x if x.tzinfo else x.replace(tzinfo=UTC)).timestamp() * 1e6 for x in (lo, hi))
                    number = isinstance(lo, int | float) and not isinstance(lo, bool)
                    yield path, g, group.num_rows, col.path_in_schema, float(lo) if number else None, float(hi) if number else None, col.total_compressed_size


class FooterSource(DataSource):
    @classmethod
    def name(cls):
        return "parquet_footers"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FooterReader(self.options)


def footers(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FooterSource)
    return spark.read.format("parquet_footers").load(path)


def skippable(f: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """groups, skippable: row groups whose range of one column lies outside [low, high]."""
    c = f.filter(F.col("column") == column)
    return c.agg(F.count("*").alias("groups"), F.count_if((F.col("max_value") < low) | (F.col("min_value") > high)).alias("skippable"))


def groups_to_read(f: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Row groups that no range rules out: an anti-join with those that one does."""
    out = None
    for column, (low, high) in ranges.items():
        hit = f.filter((F.col("column") == column) & ((F.col("max_value") < low) | (F.col("min_value") > high))).select("file", "row_group")
        out = hit if out is None else out.union(hit)
    return f.select("file", "row_group", "rows").distinct().join(out.distinct(), ["file", "row_group"], "left_anti")
