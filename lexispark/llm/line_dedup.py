"""Line dedup with a log-template tree.

All lines are parsed into a tree of fixed depth: the number of tokens, then the leading tokens, in which
tokens with a digit count as variable. A leaf's lines are generalised: a token that few of the leaf's lines have at its
place is variable too. What is left is the line's template. Templates that recur
across documents are dropped from all documents but the first that has them, and so are lines that recur as they are: a template
without variable tokens tells as much from two texts on as others from several. Equal lines are in one leaf, as are lines that are equal
but for masked tokens, so counts of either are counts within leaves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import Scratch, fresh, map_batches, text_hash

#: Leading tokens in the tree, below the level of token counts.
DEPTH = 3
#: A template recurs if so many different texts have it. Shorter lines than so many tokens have no template.
LEAST_TEXTS, LEAST_TOKENS = 4, 4
#: A line as it is (but for case and spaces between tokens) recurs if so many different texts have it.
EXACT_TEXTS = 2
#: If it is short, of fewer than LEAST_TOKENS tokens and so many characters without spaces, it takes so many. (Scripts without spaces have long lines of one token.)
LEAST_CHARS, SHORT_TEXTS = 24, 8
#: Share of a template's tokens, in percent, that must not be variable.
CONSTANT_PERCENT = 75
#: Share of a leaf's different lines, in percent, that have a token at its place if it isn't variable; and LEAST_TEXTS lines at least, as fewer tell nothing.
#: A place has at most 100 / SHARE_PERCENT such tokens, so a leaf's templates don't grow in number with the corpus.
SHARE_PERCENT = 5
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_VARIABLE = np.uint64(0x5851F42D4C957F2D)


def parse_lines(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> dict[str, np.ndarray]:
    """Lines of texts: text, line (its number there), n (tokens), chars (without spaces), leaf, whole (hash of the line as it is), masked (hash of the line with variables masked), tokens, starts."""
    breaks = np.flatnonzero(data == 10) + 1
    edges = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], breaks[breaks < len(data)], [len(data)]])) if len(data) else np.zeros(1, dtype=np.int64)
    # A text that ends in a line break has an empty last line, which is never looked at.
    tokens, starts = ngrams.word_hashes(data, edges)
    inside = ~ngrams.SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    # Digits by token: the token that begins last at or before a digit.
    s = np.flatnonzero(first)
    digits = np.flatnonzero(_DIGIT[data])
    begun = np.concatenate([[0], np.cumsum(inside & (data & 0xC0 != 0x80))])
    chars = begun[edges[1:]] - begun[edges[:-1]]
    plain, tokens = tokens, tokens.copy()
    if len(digits):
        tokens[np.unique(np.searchsorted(s, digits, side="right") - 1)] = _VARIABLE
    n = np.diff(starts)
    text = np.searchsorted(offsets, edges[:-1], side="right") - 1
    line = np.arange(len(text)) - np.searchsorted(text, text, side="left")
    with np.errstate(over="ignore"):
        place = (np.arange(len(tokens)) - np.repeat(starts[:-1], n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        running = lambda x: np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(ngrams.finalise(x + place))])
        line_hash = lambda sums: ngrams.finalise(sums[starts[1:]] - sums[starts[:-1]] + n.astype(np.uint64))
        sums = running(tokens)
        masked = line_hash(sums)
        whole = line_hash(running(plain)) if len(digits) else masked
        upto = np.minimum(starts[:-1] + depth, starts[1:])
        leaf = ngrams.finalise((sums[upto] - sums[starts[:-1]]) * np.uint64(3) + n.astype(np.uint64))
    return {"text": text, "line": line, "n": n, "chars": chars, "leaf": leaf, "whole": whole, "masked": masked, "tokens": tokens, "starts": starts}


def _take_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with a token, each in its leaf. Those of fewer than LEAST_TOKENS aren't masked and have no tokens here; least is the number of texts from which a line as it is recurs."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, ids = b.column("h").to_numpy(), b.column("doc_id")
            for lo, _, data, offsets in ngrams.chunks(b.column("text")):
                x = parse_lines(data, offsets)
                few = x["n"] < LEAST_TOKENS
                x["masked"] = np.where(few, x["whole"], x["masked"])
                x["least"] = np.where(few & (x["chars"] < LEAST_CHARS), SHORT_TEXTS, EXACT_TEXTS)
                keep = np.flatnonzero(x["n"] > 0)
                row = lo + x["text"][keep]
                n = np.where(few[keep], 0, x["n"][keep])
                ends = np.concatenate([[0], np.cumsum(n)])
                # 32 bits of a token tell it from others at its place.
                flat = (x["tokens"][np.repeat(x["starts"][keep] - ends[:-1], n) + np.arange(ends[-1])] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array(h[row]), *(_take_long(x[c][keep]) for c in ("leaf", "line", "whole", "masked", "least")), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    names=["doc_id", "h", "leaf", "line", "whole", "masked", "least", "tokens"],
                )

    return map_batches(docs, parse, "doc_id long, h long, leaf long, line long, whole long, masked long, least long, tokens array<int>")


def recurring_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, h, line) of lines to drop from docs (doc_id, h, text); h tells texts apart."""
    whole_lines = scratch.table(_lines(docs), "lines")
    # Joins below don't carry tokens along.
    lines = whole_lines.select("doc_id", "h", "line", "whole", "masked", "least", (F.size("tokens") > 0).alias("parsed"))

    def first_texts(df: DataFrame, key: str, least: int) -> DataFrame:
        """(key, texts, owner) of keys that `least` different texts have; the owner is the text of the smallest doc_id."""
        by_text = df.groupBy(key, "h").agg(F.min("doc_id").alias("doc_id"))
        return by_text.groupBy(key).agg(F.count("*").alias("texts"), F.min(F.struct("doc_id", "h")).alias("first")).where(F.col("texts") >= least).select(key, "texts", F.col("first.h").alias("owner"))

    # Owners are written, so that joins with them have exchanges of their own, which Spark splits where a line or template is very common.
    # Lines that are equal are equal when masked, so those that recur as they are are among these.
    shared = scratch.table(first_texts(lines, "masked", min(EXACT_TEXTS, LEAST_TEXTS)), "shared")
    again = scratch.table(lines.join(shared.select("masked").hint("merge"), "masked", "left_semi"), "again")
    repeated = again.join(scratch.table(first_texts(again, "whole", EXACT_TEXTS), "owners"), "whole").where("texts >= least and h <> owner").select("doc_id", "h", "line")
    exact = shared.where(F.col("texts") >= LEAST_TEXTS).select("masked", "owner")
    # Leaves with enough lines. Those that recur as they are take part: in a large corpus all lines of a template may.
    long_lines = whole_lines.where(F.size("tokens") > 0)
    leaves = scratch.table(long_lines.select("leaf", "masked").distinct().groupBy("leaf").agg(F.count("*").alias("lines")).where(F.col("lines") >= LEAST_TEXTS), "leaves")
    parsed = long_lines.select("leaf", "masked", "tokens").join(leaves, "leaf", "left_semi")
    parsed = scratch.table(parsed.groupBy("leaf", "masked").agg(F.first("tokens").alias("tokens")), "parsed")
    placed = parsed.select("leaf", "masked", F.size("tokens").alias("n"), F.posexplode("tokens").alias("place", "token"))
    have = placed.groupBy("leaf", "place", "token").agg(F.count("*").alias("have")).where(F.col("have") >= LEAST_TEXTS)
    constant = have.join(leaves, "leaf").where(F.col("have") * 100 >= F.col("lines") * SHARE_PERCENT).select("leaf", "place", "token")
    constants = placed.join(scratch.table(constant, "constant"), ["leaf", "place", "token"]).groupBy("leaf", "masked", "n").agg(F.count("*").alias("constants"), F.sum(F.xxhash64("place", "token").cast("decimal(38,0)")).alias("mark"))
    templates = constants.where(F.col("constants") * 100 >= F.col("n") * CONSTANT_PERCENT).select("masked", F.xxhash64("leaf", "mark").alias("template"))
    templated = scratch.table(lines.join(templates, "masked"), "templated")
    general = scratch.table(first_texts(templated, "template", LEAST_TEXTS), "general")
    of_masked, of_template = (x.where("h <> owner").select("doc_id", "h", "line") for x in (again.where("parsed").join(exact, "masked"), templated.join(general, "template")))
    return repeated.union(of_masked).union(of_template).distinct()


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its text without dropped lines, and n_lines, n_dropped.

    Lines end at line feeds. Exact copies of a text count as one text and are treated alike, so they stay for a document-level
    operator. A text left without any line becomes empty; null stays null and has no lines; an empty text has one, which is empty. Rows may repeat, ids may be
    null. An empty table stays empty. Texts may be of any length and have any number of lines. Other columns stay; where one is named n_lines or n_dropped, the new one's name gets underscores until it is new.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.coalesce(text, F.lit("")).alias("text"))
    own = uuid.uuid4().hex  # no name of docs
    h, lines = f"h{own}", f"lines{own}"
    drop = recurring_lines(keyed, scratch).groupBy(F.col("h").alias(h)).agg(F.collect_set(F.col("line").cast("int")).alias(lines))
    drop = Scratch(docs.sparkSession, "lines").table(drop, "drop", keep=True)
    scratch.drop()
    # One plan at every size: texts are shuffled once, whether few or many have lines to drop.
    kept = docs.join(drop.hint("merge"), text_hash(text_col) == F.col(h), "left")
    split = F.split(text, "\n", -1)
    return kept.select(
        *(F.when(F.col(lines).isNull(), text).otherwise(_without(split, F.col(lines))).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns),
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias(fresh(docs.columns, "n_lines")),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(fresh(docs.columns, "n_dropped")),
    )


def _without(split: Column, gone: Column) -> Column:
    """The lines whose numbers aren't in gone, joined again: numbers and lines are sorted together, so a line that goes has its number before it."""
    rows = F.concat(
        F.transform(gone, lambda i: F.struct(i.alias("i"), F.lit(1).alias("line"), F.lit("").alias("text"))),
        F.transform(split, lambda x, i: F.struct(i.alias("i"), F.lit(2).alias("line"), x.alias("text"))),
    )
    before = lambda e: F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(1).alias("line"), F.lit("").alias("text"))), F.slice(e, F.lit(1), F.size(e) - 1))
    kept = lambda e: F.zip_with(e, before(e), lambda x, y: F.when((x["line"] == 2) & ((y["line"] == 2) | (x["i"] != y["i"])), x["text"]))
    return F.array_join(F.transform(F.array(F.sort_array(rows)), kept)[0], "\n")
