import collections
import zlib

import numpy as np
import pytest
from lexispark.llm import queries as Q
from lexispark.llm import sharding as S
from pyspark.sql import functions as F

from .common_data import frame, odd_rows


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(n):
    f = S.Feistel(n, seed=n)
    p = f.forward(np.arange(n))
    assert sorted(p.tolist()) == list(range(n))
    assert f.backward(p).tolist() == list(range(n))


@pytest.mark.parametrize("clash", [False, True])
def test_rows_law(spark, clash):
    rows = odd_rows()
    row, shard, slot = ("global_row_", "shard_", "slot_") if clash else ("global_row", "shard", "slot")
    got = S.assign_shards(frame(spark, rows, clash), ["doc_id", "text"], shards=5, seed=2)
    got = got.select("doc_id", "text", F.col(row).alias("global_row"), F.col(shard).alias("shard"), F.col(slot).alias("slot")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    assert sorted(r.global_row for r in got) == list(range(len(rows)))
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(by) == 5 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(S.row_at(r.shard, r.slot, len(rows), 5, 2) == r.global_row for r in got)


def test_layout_does_not_matter(spark):
    df = frame(spark, [(i, str(i)) for i in range(200)])
    places = lambda d: {r.doc_id: (r.shard, r.slot) for r in S.assign_shards(d, ["doc_id"], 7).collect()}
    assert places(df) == places(df.repartition(9).orderBy("text"))


def test_empty(spark):
    assert S.assign_shards(frame(spark, []), ["doc_id"], 3).count() == 0


def place(x, n, seed, rounds=6):
    """Where a permutation of range(n) sends x: a Feistel network on the fewest even bits that hold n, walked until it lands below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    word, mask = (1 << 64) - 1, (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for i in range(rounds):
            y = (right + (seed * 0x632BE59BD9B4E019 + (i + 1) * 0x85157AF5C2B2AE35)) * 0x9E3779B97F4A7C15 & word
            y = ((y ^ y >> 32) * 0xD6E8FEB86659FD93) & word
            left, right = right, left ^ ((y ^ y >> 29) & mask)
        x = left << half | right
        if x < n:
            return x


def test_query_op3(spark):
    docs = Q.read_table(spark, "/root/testdata/sf0.001", "documents").collect()
    data = {r.doc_id: (r.text or "").encode() for r in docs}
    row = {d: i for i, d in enumerate(sorted(data))}
    want = {(d, len(t) + 1, zlib.crc32(t), "rows", (p := place(row[d], len(data), 17)) % 8, p // 8, None) for d, t in data.items()}
    got = Q.op3_sharding(spark, "/root/testdata/sf0.001").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert len(got) == len(docs) and set(map(tuple, got)) == want
