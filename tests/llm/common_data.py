"""Odd rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""

import random

from pyspark.sql import functions as F

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "sta", "vor", "zel") for b in ("ben", "dur", "fi", "gast", "holm", "jo", "ker", "lund", "mor", "naf")]
#: Names that operators use inside, or give to their results.
CLASHES = ("h", "n", "v", "c", "k", "token", "place", "label", "block", "blocks", "head", "salt", "bucket", "shard", "slot", "global_row", "__part", "__at", "__id", "__d", "__h", "__lines", "lang_pred", "score", "base_spans", "spans", "found", "digest", "first", "n_lines", "n_dropped", "component", "start", "length", "u", "key", "row", "id")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows(seed=0):
    rng = random.Random(seed)
    long_text = prose(rng, 40_000)
    line = prose(rng, 12)
    rows = [(None, None), (None, None), (None, "alone " + prose(rng, 30)), (None, line), (1, ""), (1, ""), (2, long_text), (3, long_text), (3, long_text), (4, " \t\n "), (5, "a"), (6, "a b"), (7, "A B"), (8, "...!!! 123"), (9, "né à l'été"), (10, "x" * 100_000), (11, "日本語 " * 50), (12, "\x00 nul\x00")]
    rows += [(20 + i, f"{prose(rng, 15)}\n{line}\n{prose(rng, 9)}") for i in range(6)]
    base = [rng.choice(WORDS) for _ in range(120)]
    for i in range(8):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(len(copy))] = f"edit{i}"
        rows.append((40 + i, " ".join(copy)))
    return rows


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.select("*", *(F.lit(None).cast("string").alias(c) for c in CLASHES)) if clash else df
