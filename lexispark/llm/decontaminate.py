"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item's sketch is the bottom of its shingles by a 64-bit hash. Items are
partitioned by size, and a partition's sketch length is chosen for its largest
item: a document that holds at least `percent` % of an item's s shingles misses at most
s - ceil(percent s / 100) of them, so it holds one of the item's first
s - ceil(percent s / 100) + 1 sketch hashes. Documents of any length are looked up
by those hashes alone; each candidate is then verified by exact containment.
Nothing is lost by the sketches: they are long enough for certainty, not for a likely hit.

Items of up to BLOCK_BYTES are told to all tasks, which look a document's shingles up among the sketches, so the
work for a document doesn't grow with the number of items. More items are met by a join of sketch hashes with document shingles.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import Scratch, map_batches, without_rows

#: Bytes of item texts up to which tasks are told all items.
BLOCK_BYTES = 16 << 20


class ItemIndex:
    """Sketches and shingle sets of a block of items."""

    def __init__(self, ids: list[int | None], texts: list[str | None], k: int, percent: int):
        self.ids, self.k, self.percent = pa.array(ids, pa.int64()), k, percent
        column = pa.array([t or "" for t in texts], pa.string())
        self.sets = list(ngrams.shingle_sets(column, k, ngrams.NON_ALNUM))
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        words = [int(np.diff(at)[i]) for lo, hi, data, off in ngrams.chunks(column) for at in [ngrams.word_hashes(data, off, ngrams.NON_ALNUM)[1]] for i in range(hi - lo)]
        #: A shorter item's only shingle is its whole sequence: documents are then looked at in runs of that many words.
        self.lengths = sorted({min(w, k) for w in words if w})
        sketch, owner = [], []
        for low, high, members in self.size_partitions():
            longest = high - -(-percent * high // 100) + 1
            for i in members:
                own = self.sets[i][:longest]
                sketch.append(own)
                owner.append(np.full(len(own), i))
        flat, owners = (np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in ((sketch, np.uint64), (owner, np.int64)))
        order = np.argsort(flat, kind="stable")
        #: Sketch hashes, sorted and each once, and the items that have each.
        self.sketch, first = np.unique(flat[order], return_index=True)
        self.owners = np.split(owners[order], first[1:])

    def size_partitions(self) -> Iterator[tuple[int, int, list[int]]]:
        """Items by size: the bounds of a partition are powers of two apart."""
        by: dict[int, list[int]] = {}
        for i, n in enumerate(self.sizes.tolist()):
            if n:
                by.setdefault(n.bit_length(), []).append(i)
        for members in by.values():
            yield int(self.sizes[members].min()), int(self.sizes[members].max()), members

    def found_in(self, shingles: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item, shared shingles) of the items that documents contain, whose shingles, of all of them, are shingles[at[i] : at[i + 1]]."""
        if not len(self.sketch) or not len(shingles):
            return
        place = np.minimum(np.searchsorted(self.sketch, shingles), len(self.sketch) - 1)
        met = np.flatnonzero(self.sketch[place] == shingles)
        for d, some in itertools.groupby(zip((np.searchsorted(at, met, side="right") - 1).tolist(), place[met].tolist(), strict=True), key=lambda x: x[0]):
            own = np.unique(shingles[at[d] : at[d + 1]])
            for item in np.unique(np.concatenate([self.owners[p] for p in {p for _, p in some}])).tolist():
                shared = shared_shingles(own, self.sets[item])
                if 100 * shared >= self.percent * len(self.sets[item]):
                    yield d, item, shared


def shared_shingles(a: np.ndarray, b: np.ndarray) -> int:
    """How many of b's hashes a has; both are sorted and have each once."""
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) if len(a) else 0


def document_shingles(data: np.ndarray, offsets: np.ndarray, k: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of texts in runs of each of these numbers of words, and the number of them before each text."""
    words, starts = ngrams.word_hashes(data, offsets, ngrams.NON_ALNUM)
    runs = [ngrams.shingle_hashes(words, starts, n, short=False) for n in lengths]
    if len(runs) == 1:
        return runs[0]
    text = np.concatenate([np.repeat(np.arange(len(offsets) - 1), np.diff(at)) for _, at in runs]) if runs else np.zeros(0, dtype=np.int64)
    flat = np.concatenate([h for h, _ in runs]) if runs else np.zeros(0, dtype=np.uint64)
    return flat[np.argsort(text, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(offsets) - 1))])


_FOUND = "doc_id long, h long, item_id long, item_shingles long, shared_shingles long, containment double"


def _found(ids: pa.Array, h: pa.Array, items: pa.Array, sizes: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, h, items, pa.array(sizes), pa.array(shared), pa.array(shared / sizes)], names=["doc_id", "h", "item_id", "item_shingles", "shared_shingles", "containment"])


def _by_broadcast(docs: DataFrame, items: DataFrame, k: int, percent: int) -> DataFrame:
    rows = items.select("item_id", "text").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(ItemIndex(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), k, percent))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            rows = []
            for lo, _, data, offsets in ngrams.chunks(b.column("text")):
                rows += [(lo + d, item, n) for d, item, n in index.found_in(*document_shingles(data, offsets, index.k, index.lengths))]
            if rows:
                at, item, n = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
                yield _found(b.column("doc_id").take(pa.array(at)), b.column("h").take(pa.array(at)), index.ids.take(pa.array(item)), index.sizes[item], n)

    return map_batches(docs, search, _FOUND)


def _by_join(docs: DataFrame, items: DataFrame, k: int, percent: int) -> DataFrame:
    """The same for items that no task could hold: sketch hashes meet document shingles, and the pairs that come of it are verified."""
    scratch = Scratch(docs.sparkSession, "leaks")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = ItemIndex(b.column("item_id").to_pylist(), b.column("text").to_pylist(), k, percent)
            at = np.repeat(np.arange(len(index.sketch)), [len(o) for o in index.owners])
            own = np.concatenate(index.owners) if index.owners else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(index.sketch[at].view(np.int64)), b.column("item").take(pa.array(own, pa.int64()))], names=["hash", "item"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, offsets in ngrams.chunks(b.column("text")):
                flat, at = document_shingles(data, offsets, k, list(range(1, k + 1)))
                row = pa.array(lo + np.repeat(np.arange(len(offsets) - 1), np.diff(at)))
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), b.column("doc_id").take(row), b.column("h").take(row)], names=["hash", "doc_id", "h"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, sizes, n = [], [], []
            for i, (text, item) in enumerate(zip(b.column("text"), b.column("item_text").to_pylist(), strict=True)):
                index = ItemIndex([0], [item], k, percent)
                for _, _, data, offsets in ngrams.chunks(pa.array([text.as_py()], pa.string())):
                    for _, _, shared in index.found_in(*document_shingles(data, offsets, k, index.lengths)):
                        at.append(i)
                        sizes.append(int(index.sizes[0]))
                        n.append(shared)
            if at:
                rows = pa.array(at)
                yield _found(b.column("doc_id").take(rows), b.column("h").take(rows), b.column("item_id").take(rows), np.array(sizes), np.array(n))

    keyed = scratch.table(items.withColumn("item", F.xxhash64("item_id", "text")), "items", keep=True)
    sketch = map_batches(keyed.select("item", "item_id", "text").dropDuplicates(["item"]), sketches, "hash long, item long")
    seen = map_batches(docs, shingles, "hash long, doc_id long, h long").join(sketch, "hash").select("doc_id", "h", "item").distinct()
    pairs = scratch.table(seen.withColumnsRenamed({"doc_id": "__d", "h": "__h"}), "pairs", keep=True)
    met = docs.join(pairs, (F.col("h") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__d"))).join(keyed.select("item", "item_id", F.col("text").alias("item_text")), "item")
    return map_batches(met.select("doc_id", "h", "text", "item_id", "item_text"), verify, _FOUND)


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, h, item_id, item_shingles, shared_shingles, containment) of documents that hold an item.

    A document holds an item if it has at least percent / 100 of the item's distinct k-word shingles. Words are runs of letters, digits
    and non-ASCII bytes, A-Z in lower case, so punctuation and white space don't matter.
    An item of fewer than k words has its whole sequence as its only shingle; one without words, or null, is in nothing, and so is anything
    in a null or empty text. Rows may repeat in either table: each document row meets each item row. h is xxhash64 of the text, null counting
    as empty. Either table may be empty, texts may be of any length, other columns are ignored. Documents are read once with items of up to BLOCK_BYTES, twice with more.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    items = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    return (_by_broadcast if size <= BLOCK_BYTES else _by_join)(docs, items, k, percent)


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text and other columns) without the rows that hold an item; repeated and null-id rows are told apart by their text."""
    found = contained_items(docs, items, k, percent).select("doc_id", "h")
    return without_rows(docs, Scratch(docs.sparkSession, "leaks").table(found, "rows", keep=True))
