"""Sharding: a Feistel permutation of global row numbers, by cycle walking.

Row numbers are dense from 0 in the order of the given keys. The permutation
sends row number r to p(r) among the n rows; shard = p mod shards and
slot = p div shards, so shard sizes differ by one at most, slots have no gaps,
and anyone who knows n and the seed computes a row's place, or the row at a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, map_batches

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift steps) of x and the round's key."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return x


class Feistel:
    """A permutation of range(n). The network works on 2 * half bits; values that land at n or above are sent through again until they don't."""

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [(seed * 0x632BE59BD9B4E019 + (i + 1) * 0x85157AF5C2B2AE35) % (1 << 64) for i in range(rounds)]

    def _once(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        h = np.uint64(self.half)
        left, right = x >> h, x & self.mask
        for k in keys:
            if back:
                left, right = right ^ (_mix(left, k) & self.mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & self.mask)
        return (left << h) | right

    def _walk(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        x = np.asarray(x, dtype=np.uint64)
        out = self._once(x, keys, back)
        while (far := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[far] = self._once(out[far], keys, back)
        return out

    def forward(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, self.keys, False)

    def backward(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, self.keys[::-1], True)


def assign_shards(df: DataFrame, keys: list[str], shards: int, seed: int = 0) -> DataFrame:
    """df with global_row, shard and slot; law `rows`: shard sizes differ by one at most.

    Rows are numbered by a range exchange on `keys`, which should hold a row's identity
    (rows equal in all keys are numbered in an arbitrary order, nulls come first). The exchange is written to
    the shared folder, as its partitions' sizes are needed before the numbers are: the
    driver sees one count per partition, never rows. An empty table stays empty. Rows may repeat, keys may be null, texts may be of any
    length. A new column whose name df has already gets underscores until it is new.
    """
    spark = df.sparkSession
    id_name, part_name, at_name, *new_names = (fresh(df.columns, c) for c in ("__id", "__part", "__at", "global_row", "shard", "slot"))
    quoted = [F.col(f"`{k}`") for k in keys]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, *quoted).sortWithinPartitions(*quoted)
    laid = laid.withColumn(id_name, F.monotonically_increasing_id()).select("*", F.shiftright(id_name, 33).cast("int").alias(part_name), F.col(id_name).bitwiseAND(F.lit((1 << 33) - 1)).alias(at_name)).drop(id_name)
    scratch = Scratch(spark, "sharding")
    laid = scratch.table(laid, "rows", keep=True)
    counts = {r["part"]: r["rows"] for r in laid.groupBy(F.col(part_name).alias("part")).agg(F.count("*").alias("rows")).collect()}
    first, total = {}, 0
    for part in sorted(counts):
        first[part] = total
        total += counts[part]
    net = Feistel(total, seed)

    fields = [f for f in laid.schema.fields if f.name not in (part_name, at_name)]
    schema = T.StructType([*fields, *(T.StructField(c, t) for c, t in zip(new_names, (T.LongType(), T.IntegerType(), T.LongType()), strict=True))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(part_name).to_numpy(zero_copy_only=False)
            known, back = np.unique(part, return_inverse=True)
            row = b.column(at_name).to_numpy() + np.array([first[int(p)] for p in known], dtype=np.int64)[back]
            place = net.forward(row)
            new = [pa.array(row), pa.array((place % np.uint64(shards)).astype(np.int32)), pa.array((place // np.uint64(shards)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in fields] + new, names=schema.names)

    return map_batches(laid, number, schema)


def row_at(shard: int, slot: int, rows: int, shards: int, seed: int = 0) -> int:
    """The global row number at a place."""
    return int(Feistel(rows, seed).backward(np.array([slot * shards + shard], dtype=np.uint64))[0])
