"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir. Only where that is unset, as in
    local tests, a temporary folder of this machine is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexispark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Tables that returned plans still read, in the order they were written.
_kept: list[str] = []


def kept_tables() -> list[str]:
    """The tables that operators keep for the plans they returned."""
    return list(_kept)


def release(spark: SparkSession, tables: Iterable[str] | None = None) -> None:
    """Deletes kept tables, all of this process or those named; plans that read them can't run any more."""
    gone = kept_tables() if tables is None else list(tables)
    for path in gone:
        _delete(spark, path)
        if path in _kept:
            _kept.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder, which cut the lineage and outlive lost executors.

    keep=True marks tables that the returned plan still reads, until release(); drop() deletes the others.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.temporary: list[str] = []

    def table(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        (_kept if keep else self.temporary).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, upto: int | None = None) -> None:
        """Deletes the temporary tables, or the first `upto` of them."""
        gone, self.temporary = self.temporary[:upto], self.temporary[len(self.temporary[:upto]) :]
        for path in gone:
            _delete(self.spark, path)


#: Arrow batches between Spark and Python hold about so many bytes, however long the texts.
BATCH_BYTES = 2 << 20


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(f, schema) with batches of BATCH_BYTES, unless the session sets a size of its own."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def octets(text: Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def match_rows(docs: DataFrame, rows: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs joined (left_semi or left_anti) to rows (doc_id, h) by id and text's xxhash64. Null ids are equal to each other, null text to empty.

    There is no hint: Spark tells rows to all tasks if they are within its own threshold, and shuffles otherwise.
    """
    own = uuid.uuid4().hex  # no name of docs
    right = rows.select(F.col("doc_id").alias(f"d{own}"), F.col("h").alias(f"h{own}"))
    same_id = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(f"d{own}"))
    return docs.join(right, same_id & (text_hash(text_col) == F.col(f"h{own}")), how)


def text_hash(text_col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return match_rows(docs, gone, "left_anti", id_col, text_col)


def fresh(columns: Iterable[str], name: str) -> str:
    """name, with as many underscores behind it as make it none of columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Elements of a block in running().
_BLOCK = 256


def running(values: Column, largest: bool = False) -> Column:
    """For each number of an array (none below 0), the sum, or with largest the maximum, of those before it; 0 for the first.

    Blocks first, then the blocks' results: an array that grows element by element would be copied once for each.
    """
    join = F.greatest if largest else lambda a, b: a + b
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    numbers = lambda whole: F.sequence(F.lit(0), F.greatest(F.floor((F.size(whole) - 1) / _BLOCK), F.lit(0)).cast("int"))
    # The array is bound as a lambda's argument, so it is computed once and not for each block.
    cut = F.transform(F.array(values), lambda whole: F.transform(numbers(whole), lambda b: F.slice(whole, b * _BLOCK + 1, F.lit(_BLOCK))))[0]
    inside = lambda block: F.aggregate(block, F.struct(zero.alias("at"), none.alias("out")), lambda acc, x: F.struct(join(acc["at"], x.cast("long")).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
    start = F.struct(zero.alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    step = lambda acc, b: F.struct(join(acc["at"], b["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(b["out"], lambda o: join(o, acc["at"])))).alias("out"))
    return F.aggregate(F.transform(cut, inside), start, step, lambda acc: F.flatten(acc["out"]))


def partitions_for(rows: int, each: int) -> int:
    return max(1, -(-rows // each))
