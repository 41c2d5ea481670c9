"""Where a dictionary's data is: folders of Parquet tables, catalog databases, and single Parquet files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.types import METADATA_KEY, field_type
from ..operators.data_checks import quoted
from ..plans.joins import fold


class Source(Protocol):
    """What checks ask of data: its relations' names and the relations, always as they are spelled there."""

    def names(self) -> list[str]: ...

    def table(self, name: str) -> DataFrame: ...


class Frames:
    """DataFrames by name."""

    def __init__(self, frames: dict[str, DataFrame]):
        self.frames = frames

    def names(self) -> list[str]:
        return sorted(self.frames)

    def table(self, name: str) -> DataFrame:
        return self.frames[name]


class ParquetFolder:
    """A folder with a Parquet file or folder `<table>.parquet`, or a folder `<table>`, for each table; any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._places = spark, path, {}
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):  # never created by reading it
            raise FileNotFoundError(f"{path} doesn't exist")
        for s in fs.listStatus(hadoop):
            name = s.getPath().getName()
            if name.endswith(".parquet") or s.isDirectory() and not name.startswith((".", "_")):
                self._places[name.removesuffix(".parquet")] = s.getPath().toString()

    def names(self) -> list[str]:
        return sorted(self._places)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._places[name])

    def columns(self, name: str) -> list[FileColumn]:
        """A table's columns and nulls as footers tell them."""
        return parquet_columns(self._places[name], self.spark)


class CatalogDatabase:
    """Tables and views of a catalog's database."""

    def __init__(self, spark: SparkSession, database: str):
        if not spark.catalog.databaseExists(database):
            raise FileNotFoundError(f"there is no database {database}")
        self.spark, self.database = spark, database

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{quoted(self.database)}.{quoted(name)}")


def open_source(spark: SparkSession, kind: str, value: str, base: Path) -> Source:
    """The source that a dictionary in the folder base names. Relative folders are the dictionary's; others, and URIs, stand as they are."""
    if kind == "parquet":
        return ParquetFolder(spark, resolve(value, base))
    if kind == "catalog":
        return CatalogDatabase(spark, value)
    raise OSError(f"Spark alone can't read a `{kind}` source; name a `parquet` folder or a `catalog` database")


def resolve(value: str, base: Path) -> str:
    return value if "://" in value or value.startswith("file:") else str(base / value)


def spelled(name: str, names: Sequence[str]) -> str | None:
    """The data's own spelling of a name, whatever its case."""
    return next((n for n in names if fold(n) == fold(name)), None)


@dataclass(frozen=True)
class Described:
    """A column as its data describes it."""

    table: str
    column: str
    type: str


def describe(source: Source, names: Sequence[str] | None = None) -> list[Described]:
    """Each relation's columns in their order, with canonical types; no data is read."""
    return [Described(n, f.name, str(field_type(f))) for n in (source.names() if names is None else names) for f in source.table(n).schema.fields]


def with_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with canonical types as metadata of its columns, which schema checks then compare exactly."""
    return df.select(*(df[quoted(f.name)].alias(f.name, metadata=(f.metadata or {}) | ({METADATA_KEY: types[f.name]} if f.name in types else {})) for f in df.schema.fields))


def legacy_type(d: T.DataType) -> str:
    """The older format's type of a column: boolean, number, string, date, datetime, or what Spark calls a nested one."""
    if isinstance(d, T.NumericType):
        return "number"
    for kinds, name in (((T.TimestampType, T.TimestampNTZType), "datetime"), (T.DateType, "date"), (T.BooleanType, "boolean"), ((T.StringType, T.BinaryType), "string")):
        if isinstance(d, kinds):
            return name
    return {T.ArrayType: "list", T.MapType: "map", T.StructType: "struct"}.get(type(d), "string")


@dataclass(frozen=True)
class FileColumn:
    """A column of a Parquet file: the older format's type, the logical annotation, the physical type, and its nulls where the footer knows them."""

    name: str
    type: str
    logical: str | None
    physical: str
    nulls: int | None


#: Footers that the driver reads of one table; of a table of more files only a scan can tell the nulls.
MOST_FOOTERS = 1000


def parquet_columns(path: str, spark: SparkSession | None = None) -> list[FileColumn]:
    """From footers alone: those of a file or a folder of files, here or, with a session, on any file system that Spark reads.

    The first file tells names and types. A column that must have values has no nulls; a row group without statistics makes the number unknown, and so does a file without the column.
    """
    footers = _hadoop_footers(spark, path) if spark is not None else [path]
    found = [_file_columns(f) for f in footers[:MOST_FOOTERS]]
    if not found:
        raise FileNotFoundError(f"{path} has no Parquet file")
    by_name = [{c.name: c.nulls for c in columns} for columns in found]
    known = lambda name: [x.get(name) for x in by_name] if len(footers) <= MOST_FOOTERS else [None]
    return [FileColumn(c.name, c.type, c.logical, c.physical, None if None in known(c.name) else sum(known(c.name))) for c in found[0]]


def _hadoop_footers(spark: SparkSession, path: str) -> list:
    """Each Parquet file's footer as a file of its own, read from the file's end."""
    import io

    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(place)
    files = sorted((s for s in fs.listStatus(place) if s.isFile() and not s.getPath().getName().startswith(("_", "."))), key=lambda s: s.getPath().getName()) if status.isDirectory() else [status]
    out = []
    for s in files:
        stream = fs.open(s.getPath())
        try:
            size = s.getLen()
            stream.seek(size - 8)
            end = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, 8))
            length = int.from_bytes(end[:4], "little")
            stream.seek(size - 8 - length)
            out.append(io.BytesIO(b"PAR1" + bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length)) + end))
        finally:
            stream.close()
    return out


def _file_columns(path) -> list[FileColumn]:
    import pyarrow.parquet as pq

    f = pq.ParquetFile(path)
    out = []
    for i, field in enumerate(f.schema_arrow):
        leaves = [j for j in range(len(f.schema)) if f.schema.column(j).path.split(".")[0] == field.name]
        leaf = f.schema.column(leaves[0])
        nested = len(leaves) > 1 or leaf.max_repetition_level > 0 or leaf.path != field.name
        known: int | None = 0 if not field.nullable else None
        if known is None and not nested:
            groups = [f.metadata.row_group(g).column(leaves[0]) for g in range(f.metadata.num_row_groups)]
            if all(g.is_stats_set and g.statistics.has_null_count for g in groups):
                known = sum(g.statistics.null_count for g in groups)
        logical = None if leaf.logical_type.type == "NONE" else annotation(leaf)
        out.append(FileColumn(field.name, _nested_name(field.type) if nested else _footer_type(leaf), None if nested else logical, "group" if nested else leaf.physical_type, known))
    return out


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, which spark.checkpoint.dir names; in local sessions that name none, one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexispark-")
    return f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"


def _nested_name(t) -> str:
    import pyarrow as pa

    return "map" if pa.types.is_map(t) else "struct" if pa.types.is_struct(t) else "list"


def annotation(leaf) -> str:
    """A logical type as text: Decimal(p,s), Timestamp(unit,UTC), Integer(i64), Time(unit) or its name."""
    import json

    said = json.loads(leaf.logical_type.to_json())
    units = {"milliseconds": "ms", "microseconds": "us", "nanoseconds": "ns"}
    kind = said["Type"]
    if kind == "Decimal":
        return f"Decimal({said['precision']},{said['scale']})"
    if kind in ("Timestamp", "Time"):
        return f"{kind}({units[said['timeUnit']]}{',UTC' if said.get('isAdjustedToUTC') else ''})"
    if kind == "Int":
        return f"Integer({'i' if said['isSigned'] else 'u'}{said['bitWidth']})"
    return kind


def _footer_type(leaf) -> str:
    kind = leaf.logical_type.type
    by_logical = {"STRING": "string", "ENUM": "enum", "DATE": "date", "TIMESTAMP": "datetime", "INT": "number", "FLOAT16": "number", "DECIMAL": "number"}
    by_physical = {"BOOLEAN": "boolean", "INT32": "number", "INT64": "number", "FLOAT": "number", "DOUBLE": "number", "INT96": "datetime"}
    return by_logical.get(kind) or by_physical.get(leaf.physical_type, "string")


def parquet_null_counts(df: DataFrame) -> DataFrame:
    """Nulls of each column of Parquet data in one pass: rows of (column, nulls). With Spark's aggregate push-down (spark.sql.parquet.aggregatePushdown and the newer reader) footers answer."""
    from pyspark.sql import functions as F

    counts = df.agg(F.count("*").alias("all"), *(F.count(F.col(quoted(c))).alias(f"c{i}") for i, c in enumerate(df.columns)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (F.col("all") - F.col(f"c{i}")).alias("nulls")) for i, c in enumerate(df.columns)))).alias("x")).select("x.*")
