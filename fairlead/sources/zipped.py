"""CSV inside ZIP read in place: nothing is extracted, a day's archive is one task, since a ZIP cannot be split."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _archives(path: str) -> list[str]:
    from pyarrow import fs

    where, root = _place(path)
    if where.get_file_info(root).type != fs.FileType.Directory:
        return [root]
    return sorted(f.path for f in where.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.lower().endswith(".zip"))


def _member(z: zipfile.ZipFile) -> str:
    names = [n for n in z.namelist() if n.lower().endswith((".csv", ".txt"))]
    if len(names) != 1:
        raise ValueError(f"{z.filename}: {len(names)} tables in the archive, not 1")
    return names[0]


class _Archive(InputPartition):
    def __init__(self, place: int, path: str):
        self.place, self.path = place, path


class ZipReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self):
        return [_Archive(i, p) for i, p in enumerate(_archives(self.path))]

    def read(self, partition):
        """Batches of the wanted columns as text, streamed; a line with another number of fields is an error, not a loss."""
        import pyarrow as pa
        from pyarrow import csv

        names, line = [c for c in self.columns if c != "rn"], 0
        with _place(self.path)[0].open_input_file(partition.path) as f, zipfile.ZipFile(f) as z, z.open(_member(z)) as src:
            own = [c.lstrip("\ufeff") for c in _header(src)]
            options = csv.ConvertOptions(column_types={c: pa.string() for c in own}, include_columns=names, strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""])
            try:
                batches = csv.open_csv(src, csv.ReadOptions(column_names=own, block_size=1 << 23), convert_options=options)
            except pa.ArrowInvalid as e:
                if "Empty CSV" in str(e):
                    return
                raise
            for b in batches:
                rn = pa.array(range((partition.place << 40) + line, (partition.place << 40) + line + len(b)), pa.int64())
                line += len(b)
                columns = [b.column(names.index(c)) if c != "rn" else rn for c in self.columns]
                yield pa.RecordBatch.from_arrays(columns, names=self.columns)


def _header(src) -> list[str]:
    import csv

    return next(csv.reader(io.StringIO(src.readline().decode("utf-8"))))


class ZipSource(DataSource):
    @classmethod
    def name(cls):
        return "zipped_csv"

    def schema(self):
        first = _archives(self.options["path"])[0]
        with _place(self.options["path"])[0].open_input_file(first) as f, zipfile.ZipFile(f) as z, z.open(_member(z)) as src:
            own = [c.lstrip("\ufeff") for c in _header(src)]
        wanted = self.options.get("columns")
        keep = own if wanted is None else [c for c in own if c in wanted.split("\t")]
        return ", ".join(f"`{c}` string" for c in keep) + ", rn long"

    def reader(self, schema):
        return ZipReader(self.options["path"], schema.names)


def read_zip(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Columns of the CSV in one archive, or in all archives of a folder, as text, with `rn` rising through files and lines."""
    spark.dataSource.register(ZipSource)
    r = spark.read.format("zipped_csv")
    return (r if columns is None else r.option("columns", "\t".join(columns))).load(path)


def count_lines(path: str) -> int:
    """Data lines of the archive's table, by its bytes and apart from any CSV reader; nothing is written."""
    lines, last = 0, b"\n"
    where, root = _place(path)
    with where.open_input_file(root) as f, zipfile.ZipFile(f) as z, z.open(_member(z)) as src:
        while block := src.read(1 << 24):
            lines, last = lines + block.count(b"\n"), block
    return lines + (not last.endswith(b"\n")) - 1
