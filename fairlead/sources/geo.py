"""GeoParquet points: WKB geometry, a covering box that filters like any struct, and the file's own description."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from fairlead import config as C

#: The description that the format asks for, of points with a covering box.
GEO = {
    "version": "1.1.0",
    "primary_column": "geometry",
    "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Point"], "covering": {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}}},
}


def with_bbox(p: DataFrame) -> DataFrame:
    """Adds bbox; of a point, both corners are the point."""
    return p.withColumn("bbox", F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax")))


def in_bbox(p: DataFrame, box: C.Box) -> DataFrame:
    """Rows whose bbox lies in the box; the ranges go down to the struct's leaves in the scan."""
    return p.filter(F.col("bbox.ymin").between(box.lat_min, box.lat_max) & F.col("bbox.xmin").between(box.lon_min, box.lon_max))


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Written(WriterCommitMessage):
    def __init__(self, file: str | None):
        self.file = file


class GeoWriter(DataSourceArrowWriter):
    """A file a task under `_temporary`, moved to its place when all tasks are done, so a lost executor leaves nothing."""

    def __init__(self, path: str, group_rows: int):
        self.path, self.group_rows, self.run = path, group_rows, uuid.uuid4().hex

    def write(self, iterator):
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        where, root = _place(self.path)
        where.create_dir(f"{root}/_temporary/{self.run}", recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            lat, lon = (batch.column(batch.schema.get_field_index(c)).cast(pa.float64()) for c in ("lat", "lon"))
            points = np.zeros(len(batch), dtype=[("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")])
            points["order"], points["kind"] = 1, 1
            points["x"], points["y"] = lon.fill_null(0).to_numpy(), lat.fill_null(0).to_numpy()
            missing = ~(lat.is_valid().to_numpy(zero_copy_only=False) & lon.is_valid().to_numpy(zero_copy_only=False))
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(points.itemsize), len(batch), [None, pa.py_buffer(points.tobytes())]).cast(pa.binary())
            geometry = pa.compute.if_else(pa.array(missing), pa.scalar(None, pa.binary()), raw)
            table = pa.Table.from_batches([batch]).append_column("geometry", geometry)
            if out is None:
                schema = table.schema.with_metadata({"geo": json.dumps(GEO)})
                out = pq.ParquetWriter(f"{root}/_temporary/{self.run}/{name}", schema, filesystem=where, compression="zstd")
            out.write_table(table.replace_schema_metadata(schema.metadata), row_group_size=self.group_rows)
        if out is not None:
            out.close()
        return _Written(name if out is not None else None)

    def commit(self, messages):
        where, root = _place(self.path)
        for m in messages:
            if m is not None and m.file:
                where.move(f"{root}/_temporary/{self.run}/{m.file}", f"{root}/{m.file}")
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        from pyarrow import fs

        where, root = _place(self.path)
        if where.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/_temporary")


class GeoSource(DataSource):
    @classmethod
    def name(cls):
        return "geoparquet_points"

    def schema(self):
        return T.StructType()

    def writer(self, schema, overwrite):
        return GeoWriter(self.options["path"], int(self.options.get("group_rows", C.GROUP_ROWS)))


def write_geoparquet(p: DataFrame, path: str, group_rows: int = C.GROUP_ROWS) -> None:
    """Positions with lat and lon as GeoParquet; rows without a position keep a NULL geometry. `path` must be new."""
    p.sparkSession.dataSource.register(GeoSource)
    with_bbox(p).write.format("geoparquet_points").option("path", path).option("group_rows", group_rows).mode("append").save()


def read_geoparquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
