"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

A document's token ids, then the closing id, are cut into pieces of at most one
sequence's length. Full pieces are sequences by themselves. Documents are dealt into groups by a hash of their id and text, and each
group is packed on its own: longest piece first, each into the first bin with room, which the
tree of the bins' capacities finds in as many steps as it has levels.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import Scratch, map_batches, partitions_for, text_hash

#: Documents in a group, about.
GROUP_DOCUMENTS = 16384
#: Words whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 1 << 19

_SPACE, _ALNUM, _LETTER, _MARK = (np.zeros(256, dtype=bool) for _ in range(4))
_SPACE[list(b" \n")] = True
for _b in range(128):
    _ALNUM[_b] = chr(_b).isalnum()
    # Not those that special tokens are written with.
    _MARK[_b] = chr(_b).isprintable() and not chr(_b).isalnum() and chr(_b) not in " <|>"
_VALUES = ngrams.finalise(np.arange(5001, 5257, dtype=np.uint64))


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write bytes with: printable Latin-1 as itself, the others from U+0100 on, in order."""
    own = [b for b in range(256) if chr(b).isprintable() and chr(b) not in " \u00ad"]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class WordTable:
    """Ids by a word's 64-bit hash: open addressing in numpy arrays, so that a batch of words is looked up at once."""

    def __init__(self, most: int):
        self.most, self.mask = most, (1 << (2 * most - 1).bit_length()) - 1
        self.clear()

    def clear(self) -> None:
        self.n, self.used = 0, 0
        self.keys = np.zeros(self.mask + 1, dtype=np.uint64)
        self.first, self.count = (np.zeros(self.mask + 1, dtype=np.int32) for _ in range(2))
        self.pool = np.zeros(1 << 20, dtype=np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of hashes, -1 where unknown."""
        out, left = np.full(len(h), -1, dtype=np.int64), np.arange(len(h))
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = slot[hit]
            go = ~hit & (key != 0)
            left, slot = left[go], (slot[go] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        """Distinct unknown hashes with their words' ids."""
        sizes = np.array([len(x) for x in ids], dtype=np.int32)
        flat = np.fromiter((y for x in ids for y in x), dtype=np.uint32, count=int(sizes.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + len(flat), self.n + len(h)
        left, slot = np.arange(len(h)), (h & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            at, one = np.unique(slot[free], return_index=True)
            new = left[free][one]
            self.keys[at], self.first[at], self.count[at] = h[new], starts[new], sizes[new]
            go = ~np.isin(left, new)
            left, slot = left[go], (slot[go] + (self.keys[slot[go]] != h[left[go]])) & self.mask


class WordTokenizer:
    """Ids of whole texts by a byte-level tokenizer of words that drops white space.

    For such a tokenizer a text's ids are those of its space-separated words in
    order, so each distinct word is encoded once. Punctuation between an ASCII letter or digit and a
    space is a piece of its own to it, so it is parted off first. Words are known by 64-bit hashes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.letters = Tokenizer.from_file(path), WordTable(REMEMBERED), _byte_letters()

    @classmethod
    def get(cls, path: str) -> WordTokenizer:
        """One for each Python worker, kept between its tasks."""
        kept = sys.modules.setdefault("_lexispark_tokenizers", SimpleNamespace(by_path={}))
        if path not in kept.by_path:
            kept.by_path[path] = cls(path)
        return kept.by_path[path]

    def word_ids(self, words: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(words)
        model, letters, rest = self.tokenizer.model, self.letters, []
        for i, w in enumerate(words):
            # A word of Latin-1 letters is one piece, and normal but for its case.
            if w.isalpha() and max(w) <= "\u00ff":
                out[i] = [t.id for t in model.tokenize("".join([letters[b] for b in w.lower().encode()]))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Each text's ids; null counts as empty."""
        for _, _, data, offsets in ngrams.chunks(column):
            n = len(data)
            if not n:
                yield from (np.zeros(0, dtype=np.uint32) for _ in offsets[1:])
                continue
            full = offsets[:-1] < offsets[1:]
            heads, tails = offsets[:-1][full], offsets[1:][full] - 1
            if b"<|" not in data.tobytes():  # ASCII texts don't need their capitals, unless a special token might come of it
                wide = np.concatenate([[0], np.cumsum(data >= 128)])
                ascii_text = np.repeat(wide[offsets[1:]] == wide[offsets[:-1]], np.diff(offsets))
                data = data + np.where(ascii_text & (data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
            inside, mark, alnum = ~_SPACE[data], _MARK[data], _ALNUM[data]
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            first[heads], last[tails] = inside[heads], inside[tails]
            opens, closes = mark.copy(), mark.copy()
            opens[1:] &= ~mark[:-1]
            closes[:-1] &= ~mark[1:]
            opens[heads], closes[tails] = mark[heads], mark[tails]
            a, b = np.flatnonzero(opens), np.flatnonzero(closes)
            parted = a[last[b] & (a > 0) & alnum[a - 1] & ~first[a]]
            first[parted], last[parted - 1] = True, True
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            h = ngrams.span_hashes(_VALUES[data], s, e)
            h[h == 0] = 1
            slot = self.known.find(h)
            if (unknown := np.flatnonzero(slot < 0)).size:
                if self.known.n + unknown.size > self.known.most:
                    self.known.clear()
                    unknown = np.arange(len(h))
                new, one = np.unique(h[unknown], return_index=True)
                raw = data.tobytes()
                at = unknown[one]
                self.known.add(new, self.word_ids([raw[x:y].decode() for x, y in zip(s[at].tolist(), e[at].tolist(), strict=True)]))
                slot[unknown] = self.known.find(h[unknown])
            count = self.known.count[slot].astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(count)])
            ids = self.known.pool[np.repeat(self.known.first[slot] - ends[:-1], count) + np.arange(ends[-1])]
            bounds = ends[np.searchsorted(s, offsets, side="left")].tolist()
            yield from (ids[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True))


def cut(docs: DataFrame, tokenizer: str, closing_id: int, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, start, length, ids_crc32, doc_tokens): the pieces of each row of docs, in order; h is the text's xxhash64."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, step = WordTokenizer.get(tokenizer), np.array([closing_id], dtype="<u4").tobytes(), 4 * length
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                row, start, size, crc, total = [], [], [], [], []
                for i, ids in enumerate(coder.encode(b.column("text"))):
                    ids = ids.astype("<u4").tobytes() + end
                    for at in range(0, len(ids), step):
                        piece = ids[at : at + step]
                        row.append(i)
                        start.append(at // 4)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids) // 4)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(at), b.column("h").take(at), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))], names=["doc_id", "h", "start", "length", "ids_crc32", "doc_tokens"]
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_hash(text_col).alias("h"), F.col(f"`{text_col}`").alias("text"))
    return map_batches(rows, pieces, "doc_id long, h long, start long, length long, ids_crc32 long, doc_tokens long")


class CapacityTree:
    """A tournament tree: each node has the largest free capacity of the bins below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> tuple[int, int]:
        """The first bin with room for size, and its capacity so far; takes the room."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        room = best[node]
        leaf, best[node] = node - self.leaves, room - size
        node //= 2
        while node:
            top = max(best[2 * node], best[2 * node + 1])
            if best[node] == top:
                break
            best[node] = top
            node //= 2
        return leaf, room


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (1 to capacity); equal sizes go in their given order."""
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    tree = CapacityTree(max(1, len(sizes)), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        leaf, room = tree.first_fit(int(sizes[i]))
        bins[i], offsets[i] = leaf, capacity - room
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, closing_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece of each row.

    Null and empty texts have one piece, the closing id. Rows may repeat and ids may be null; each row is packed
    for itself. An empty table gives an empty result. Texts may be of any length. Other columns are ignored. The pieces are written to the shared folder
    before they are dealt into groups, so their texts aren't tokenized twice. All pieces of a document are in its group, and which group that is
    depends on its id and text and on the number of rows only, not on how the input is split; rows equal in both are numbered, so that they go to different groups.
    sequence_id has the group above bit 32 and the bin in the group below.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.table(cut(docs, tokenizer, closing_id, capacity, id_col, text_col), "pieces", keep=True)
    groups = partitions_for(pieces.where("start = 0").count(), GROUP_DOCUMENTS)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [x.split()[0] for x in schema.split(", ")]
    # Equal rows are counted first and numbered then, so their number is no load on one task.
    counted = pieces.groupBy(*pieces.columns).agg(F.count("*").alias("rows"))
    dealt = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).withColumn("salt", F.xxhash64("doc_id", "h", "copy"))

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("salt", "start", "doc_id", "h", "copy")])
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        return pa.table([*(table.column(c) for c in names[:5]), pa.array((key[0].as_py() << 32) + bins), pa.array(offsets)], names=names)

    return dealt.withColumn("bucket", F.pmod("salt", F.lit(groups))).groupBy("bucket").applyInArrow(packed, schema)
