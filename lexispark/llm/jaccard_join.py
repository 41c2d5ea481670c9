"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and their components.

Documents and shingles form a sparse incidence matrix; a link is an entry of its product
with its transpose that is large enough for the two sizes. Four ideas keep the product small
and lose no link:

* Documents with the same set are one vertex.
* At similarity t, two sets of which the larger has n shingles share at least one
  of the first n - ceil(t n) + 1 of each in any order common to all. The order here puts
  frequent shingles last, so a first shingle has few documents.
* Each first shingle links its documents to one hub document, that which has the fewest shingles before it, where exact counts allow. First shingles whose
  documents are then all in one component are done with; so a group of near copies costs
  a comparison for each, not for each pair.
* Of the others, pairs of different components that the sizes allow at an open shingle that they share are compared, once.

The columns are in blocks. A vertex carries its number of shingles in each block, and a pair is discarded
unless the smaller numbers add up to the overlap that its sizes call for. The rest is a product of the rows of many vertices with that
of the one they are compared with, which is sent once for all of them: counts add up block by block, and a pair leaves as soon as its count
can't reach that bound any more. Shingles and vertices that very many pairs share are dealt over several tasks.
Frequencies steer the work only; results are exact.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import Scratch, map_batches, match_rows, without_rows
from .components import connected_components

#: Most frequent shingles that tasks get to know; their least frequency rises until they are that few.
MOST_FREQUENT = 1 << 20
#: Rows of a shingle, and shingles of the vertices compared with one, that a task takes together, about; more are dealt over more tasks.
ROWS_TOGETHER, SHINGLES_TOGETHER = 1024, 1 << 20
#: Earlier open shingles that a row carries to tell that a pair has met before. A pair that shares none of them meets again and is one pair all the same.
CARRIED = 32
#: A shingle that was counted less often isn't called frequent. A task's counters, and shingles that it counts with them.
LEAST_FREQUENCY, COUNTERS, WINDOW = 32, 1 << 25, 4 << 20
#: The product takes n-gram columns in so many blocks; vertices carry counts for more, narrower ones.
COLUMN_BLOCKS, COUNTED_BLOCKS = 8, 128


def _first(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _signature(s: np.ndarray) -> int:
    """64 bits of a set of hashes."""
    with np.errstate(over="ignore"):
        x = ngrams.finalise(np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(ngrams.finalise(s)), len(s)], dtype=np.uint64))
        return int(ngrams.finalise(x[:1] + x[1:2] * np.uint64(3) + x[2:] * np.uint64(7)).view(np.int64)[0])


def frequent_shingles(docs: DataFrame, k: int, scratch: Scratch) -> np.ndarray:
    """Sorted hashes of shingles of many documents; MOST_FREQUENT at most.

    Tasks see all shingles of all documents. A table of small counters, two for each hash, tells which were seen
    before, and only these are passed on, with how often they are seen; so rare shingles, nearly all, don't leave
    their task. The counters begin anew after WINDOW shingles.
    """

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = np.zeros(COUNTERS, dtype=np.uint8), 0
        for b in batches:
            tokens, numbers = [], []
            sets = ngrams.shingle_sets(b.column(0), k)
            while some := list(itertools.islice(sets, 64)):
                token, n = np.unique(np.concatenate(some), return_counts=True)
                one, two = (token & np.uint64(COUNTERS - 1)).astype(np.int64), (token >> np.uint64(39)).astype(np.int64) % COUNTERS
                before = np.minimum(seen[one], seen[two])
                again = before + n > 1
                tokens.append(token[again])
                numbers.append((n + (before == 1))[again])
                for at in (one, two):
                    seen[at] = np.minimum(seen[at] + n, 255)
                size += len(token)
                if size >= WINDOW:
                    seen[:], size = 0, 0
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(numbers).astype(np.int64))], names=["token", "n"])

    counts = map_batches(docs.select("text"), repeated, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    least = LEAST_FREQUENCY
    found = scratch.table(counts.where(F.col("n") >= least), "frequent")
    while found.where(F.col("n") >= least).count() > MOST_FREQUENT:
        least *= 2
    return np.sort(found.where(F.col("n") >= least).select("token").toArrow().column(0).to_numpy().view(np.uint64))


def _described(docs: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, h, n, v, blocks, head): the set's size and signature, its counts by block, and its first shingles in the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for b in batches:
            sizes, signs, heads, blocks = [], [], [], []
            for s in ngrams.shingle_sets(b.column("text"), k):
                sizes.append(len(s))
                signs.append(_signature(s) if len(s) else None)
                blocks.append(block_counts(s))
                if len(s) and len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    is_hot = hot[at] == s
                    s = np.concatenate([s[~is_hot], s[is_hot]])
                heads.append(s[: _first(len(s), percent)] if len(s) else s)
            flat = np.concatenate(heads) if heads else np.zeros(0, dtype=np.uint64)
            at = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), pa.array(sizes, pa.int64()), pa.array(signs, pa.int64()), pa.array(blocks, pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))],
                names=["doc_id", "h", "n", "v", "blocks", "head"],
            )

    return map_batches(docs.select("doc_id", "h", "text"), describe, "doc_id long, h long, n long, v long, blocks binary, head array<long>")


def block_counts(s: np.ndarray) -> bytes:
    """A set's numbers of shingles in COUNTED_BLOCKS blocks of columns, a byte each; 255 stands for that or more."""
    return np.minimum(np.bincount((s >> np.uint64(64 - COUNTED_BLOCKS.bit_length() + 1)).astype(np.int64), minlength=COUNTED_BLOCKS), 255).astype(np.uint8).tobytes()


def least_overlap(nl: np.ndarray, nr: np.ndarray, percent: int) -> np.ndarray:
    """The overlap i that two sizes call for: 100 i >= percent (nl + nr - i)."""
    return -(-percent * (nl + nr) // (100 + percent))


def _allowed(percent: int) -> Callable[..., Column]:
    """Whether sizes and places of a shared first shingle allow a link.

    The sets share nothing before their first shared shingle, so what follows it, itself included, bounds the overlap. A
    linked pair is allowed where it meets first, if not at every shingle that it shares.
    """

    def allowed(n: str, place: str, n2: str, place2: str) -> Column:
        most = F.least(F.col(n) - F.col(place), F.col(n2) - F.col(place2))
        return most * (100 + percent) >= (F.col(n) + F.col(n2)) * percent

    return allowed


def _possible(pairs: DataFrame, where: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sizes and counts by block allow a link."""
    side = lambda x: where.select(F.col("v").alias(x), F.col("n").alias(f"n_{x}"), F.col("blocks").alias(f"blocks_{x}"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                l, r = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(-1, COUNTED_BLOCKS) for c in ("blocks_a", "blocks_b"))
                most = np.minimum(l, r).sum(axis=1, dtype=np.int64)
                open_ended = ((l == 255) & (r == 255)).any(axis=1)
                ok = pa.array(open_ended | (most >= least_overlap(b.column("n_a").to_numpy(), b.column("n_b").to_numpy(), percent)))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return map_batches(pairs.join(side("a"), "a").join(side("b"), "b"), bound, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets reach the similarity: the counts add up over blocks of columns, and a pair leaves when its bound is out of reach."""
    nl, nr = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    need = least_overlap(nl, nr, percent)
    alive = np.minimum(nl, nr) >= need
    pair_l, pair_r = np.repeat(np.arange(len(left)), nl), np.repeat(np.arange(len(right)), nr)
    all_l, all_r = (np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in (left, right))
    block_l, block_r = ((x >> np.uint64(61)).astype(np.int64) * COLUMN_BLOCKS // 8 for x in (all_l, all_r))
    count, rest_l, rest_r = np.zeros(len(left), dtype=np.int64), nl.copy(), nr.copy()
    for c in range(COLUMN_BLOCKS):
        in_l, in_r = (block_l == c) & alive[pair_l], (block_r == c) & alive[pair_r]
        with np.errstate(over="ignore"):
            key_l, key_r = (ngrams.finalise(h[m] + p[m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for h, m, p in ((all_l, in_l, pair_l), (all_r, in_r, pair_r)))
        met = pair_l[in_l][np.isin(key_l, key_r)]
        count += np.bincount(met, minlength=len(left))
        rest_l -= np.bincount(pair_l[in_l], minlength=len(left))
        rest_r -= np.bincount(pair_r[in_r], minlength=len(left))
        alive &= count + np.minimum(rest_l, rest_r) >= need
        if not alive.any():
            break
    return alive & (count >= need)


def _dealt(df: DataFrame, name: str, by: Column, size: Column, each: int) -> DataFrame:
    """df with the number of a part, size / each parts dealt by a hash."""
    return df.withColumn(name, F.pmod(F.xxhash64(by), F.greatest(F.ceil(size / each), F.lit(1))).cast("int"))


def _all_parts(df: DataFrame, name: str, size: Column, each: int) -> DataFrame:
    """df with a row for each part that _dealt() has."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(size / each), F.lit(1)).cast("int") - 1)))


def _verified(pairs: DataFrame, where: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Of pairs (a, b) of vertices, those that link.

    The vertex of a pair that has more pairs is its centre. A centre's text is sent once for each part of its members, which follow it in order.
    """
    pairs = scratch.table(_possible(pairs, where, percent), "possible")
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("pairs"))
    wanted = scratch.table(degrees.join(where, "v").select("v", "pairs", "n", F.col("doc_id").alias("__d"), F.col("h").alias("__h")), "wanted")
    texts = docs.join(wanted, (F.col("h") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__d"))).groupBy("v").agg(F.first("text").alias("text"))
    texts = scratch.table(texts, "texts").hint("merge")  # one plan at every size
    side = lambda x: wanted.select(F.col("v").alias(x), F.col("pairs").alias(f"pairs_{x}"), F.col("n").alias(f"n_{x}"))
    turned = F.col("pairs_a") >= F.col("pairs_b")
    pick = lambda x, y, name: F.when(turned, F.col(x)).otherwise(F.col(y)).alias(name)
    directed = scratch.table(pairs.join(side("a"), "a").join(side("b"), "b").select(pick("a", "b", "centre"), pick("b", "a", "member"), pick("n_b", "n_a", "size")), "directed")
    centres = scratch.table(directed.groupBy("centre").agg(F.sum("size").alias("total")), "centres")
    members = _dealt(directed.join(centres, "centre"), "part", F.col("member"), F.col("total"), SHINGLES_TOGETHER).join(texts.withColumnRenamed("v", "member"), "member")
    heads = _all_parts(centres, "part", F.col("total"), SHINGLES_TOGETHER).join(texts.withColumnRenamed("v", "centre"), "centre").withColumn("member", F.lit(None).cast("long"))
    columns = ("centre", "part", "member", "text")
    rows = members.select(*columns).union(heads.select(*columns)).repartition("centre", "part").sortWithinPartitions("centre", "part", F.col("member").asc_nulls_first())

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                left, right, at = [], [], []
                for i, (member, own) in enumerate(zip(b.column("member").to_pylist(), ngrams.shingle_sets(b.column("text"), k), strict=True)):
                    if member is None:
                        head = own
                    else:
                        left.append(head)
                        right.append(own)
                        at.append(i)
                linked = pa.array(np.array(at, dtype=np.int64)[overlaps(left, right, percent)] if at else [], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("centre").take(linked), b.column("member").take(linked)], names=["a", "b"])

    return map_batches(rows, product, "a long, b long")


def link_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, n_shingles, component_id, component) of each row of docs; h is xxhash64 of the text, null counting as empty.

    Rows link when their sets of k-word shingles have a Jaccard similarity of at least
    percent / 100; component_id is the smallest id that links reach, the row's own included.
    Words are runs of bytes other than ASCII white space, A-Z in lower case. A text with fewer than k words has
    its whole sequence as its only shingle; one without words, or null, links with nothing and is its own component.
    Rows may repeat and ids may be null: a null id is never a component_id unless the component has no
    other. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = scratch.table(_described(docs, k, percent, frequent_shingles(docs, k, scratch)), "rows", keep=True)
    vertices = scratch.table(rows.where("n > 0").dropDuplicates(["v"]), "vertices")
    where = vertices.select("v", "n", "blocks", "doc_id", "h")
    postings = vertices.select(F.posexplode("head").alias("place", "token"), "v", "n")
    repeated = postings.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1")
    postings = scratch.table(postings.join(repeated, "token"), "postings")

    allowed = _allowed(percent)
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    hubs = postings.groupBy("token").agg(F.min(F.struct("place", "n", "v")).alias("hub"), F.count("*").alias("rows"))
    star = _dealt(postings, "part", F.col("v"), F.col("docs"), ROWS_TOGETHER).join(_all_parts(hubs, "part", F.col("rows"), ROWS_TOGETHER), ["token", "part"])
    star = star.where((F.col("v") != F.col("hub.v")) & allowed("n", "place", "hub.n", "hub.place")).select(*ordered(F.col("v"), F.col("hub.v")))
    star = scratch.table(star.distinct(), "star")
    links = scratch.table(_verified(star, where, docs, k, percent, scratch), "star-links")
    labels = connected_components(links, scratch)

    wide = postings.where("docs > 2").select("token", "docs", "v", "n", "place").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    open_tokens = wide.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("rows")).where("lo < hi").select("token", "rows")
    # A pair meets at the first open shingle that both sets have. Each row knows the first of its vertex's open shingles before it, so that most pairs
    # meet only there; all of them would grow with the square of a text. Pairs that meet several times are one after distinct().
    own = wide.join(open_tokens, "token").groupBy("v", "n", "label").agg(F.sort_array(F.collect_list(F.struct("place", "token", "rows"))).alias("own"))
    each = own.select("v", "n", "label", F.transform("own", lambda t: t["token"]).alias("tokens"), F.posexplode("own").alias("i", "t"))
    left = scratch.table(each.select("t.token", "t.rows", "v", "n", "label", "t.place", F.slice("tokens", F.lit(1), F.least(F.col("i"), F.lit(CARRIED))).alias("before")), "open")
    right = _all_parts(left, "part", F.col("rows"), ROWS_TOGETHER).select("token", "part", *(F.col(c).alias(f"{c}2") for c in ("v", "n", "label", "place", "before")))
    differ = (F.col("v") < F.col("v2")) & (F.col("label") != F.col("label2")) & allowed("n", "place", "n2", "place2")
    more = _dealt(left, "part", F.col("v"), F.col("rows"), ROWS_TOGETHER).join(right, ["token", "part"]).where(differ & ~F.arrays_overlap("before", "before2"))
    pairs = more.select(F.col("v").alias("a"), F.col("v2").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more_links = scratch.table(_verified(pairs, where, docs, k, percent, scratch), "more-links")
    if more_links.limit(1).count():
        labels = connected_components(links.union(more_links), scratch)
    labels = Scratch(spark, "jaccard").table(labels, "labels", keep=True)
    scratch.drop()

    placed = rows.select("doc_id", "h", "n", "v").join(labels, "v", "left").withColumn("c", F.coalesce("label", "v"))
    # Written, so that the join below has exchanges of its own, which Spark splits where a component is large.
    least = Scratch(spark, "jaccard").table(placed.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least")), "least", keep=True)
    return placed.join(least, "c", "left").select("doc_id", "h", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.col("c").alias("component"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text and other columns) with one row of each component: the smallest doc_id's, a null one being smallest, then the smallest h's.

    Of rows with the same id and text one stays. Rows without words all stay.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    placed = scratch.table(link_components(docs, k, percent).where("component is not null").select("doc_id", "h", "component"), "placed", keep=True)
    best = scratch.table(placed.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("best")), "best", keep=True)
    row = F.struct("doc_id", "h")
    left = without_rows(docs, placed.join(best, "component").where(~row.eqNullSafe(F.col("best"))).select("doc_id", "h"))
    repeated = placed.groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h")
    if repeated.limit(1).count():  # rows with the same id and text
        left = without_rows(left, repeated).unionByName(match_rows(left, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
    return left
