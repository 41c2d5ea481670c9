"""Language identification with string kernels.

The kernel of two texts counts the byte n-grams of lengths 1 to 3 that both have (a blended
spectrum of presences), divided by the root of the product of their own counts. Landmark texts give
a Nyström feature map; one kernel ridge regression for each language, on targets of
plus and minus 1, is solved there. For scoring, the landmarks' n-grams and the solution
fold into one matrix of n-grams by languages, and a batch of texts is one sparse product with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ngrams
from .common import fresh, map_batches

LENGTHS = (1, 2, 3)
#: The fit sees so many rows of each language at most, of all languages; so many rows in all, unless there are more languages: then one of each.
ROWS_PER_LANGUAGE, ROWS_IN_ALL = 400, 16 * 400
#: Texts of more bytes are drawn for the fit only for languages without others. The driver gets a drawn text's set of n-grams, of the whole text, and not the text.
LONGEST_FITTED = 64 << 10
#: Landmarks of each language at most, and in all, unless there are more languages: then one of each.
LANDMARKS_PER_LANGUAGE, LANDMARKS_IN_ALL = 64, 16 * 64
#: The fit's incidence matrices are made for so many n-grams at a time.
COLUMNS_TOGETHER = 1 << 13
RIDGE = 1e-4
UNDETERMINED = "und"
#: Texts below both are in no learned language: the winner's value on a scale where 0 is that of a text without any known n-gram and 1 the target,
#: and the share of the text's n-grams of letters and spaces that the landmarks have. Neither scale depends on the number of languages.
LEAST_EVIDENCE, LEAST_KNOWN = 0.3, 0.85
#: A single language has no others to be told from, so only the share tells.
LEAST_KNOWN_ALONE = 0.7


def presences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of each distinct n-gram of each text, by text; an n-gram's code has its length above bit 24."""
    low = data.astype(np.int64)
    low[(data >= 65) & (data <= 90)] += 32
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    keys = []
    for n in LENGTHS:
        m = len(low) - n + 1
        if m <= 0:
            continue
        code = np.full(m, n << 24, dtype=np.int64)
        for i in range(n):
            code += low[i : i + m] << (8 * (n - 1 - i))
        inside = text[:m] == text[n - 1 :]
        keys.append(np.unique(((text[:m] << 28) | code)[inside]))
    all_keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
    return all_keys >> 28, all_keys & ((1 << 28) - 1)


def _rows(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for lo, hi, data, offsets in ngrams.chunks(pa.array(texts, pa.string())):
        row, code = presences(data, offsets)
        out += np.split(code, np.searchsorted(row, np.arange(1, hi - lo)))
    return out


class KernelModel:
    """codes: the landmarks' n-grams; weights: their row for each language, and `bias`."""

    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.codes, self.weights, self.bias = languages, codes, weights, bias

    @classmethod
    def fit(cls, texts: list[str] | list[np.ndarray], labels: list[str], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> KernelModel:
        """A model from texts, or their sorted n-gram codes, and their languages; without any, one that knows no language."""
        languages = sorted(set(labels))
        if not languages:
            return cls([], np.zeros(0, dtype=np.int64), np.zeros((0, 0)), np.zeros(0))
        landmarks_per_language = min(landmarks_per_language, max(1, LANDMARKS_IN_ALL // len(languages)))
        rows = _rows(texts) if isinstance(texts[0], str) else texts
        y = np.searchsorted(np.array(languages, dtype=object), np.array(labels, dtype=object))
        marks = np.concatenate([np.flatnonzero(y == c)[:landmarks_per_language] for c in range(len(languages))])
        codes = np.unique(np.concatenate([rows[i] for i in marks]))

        def incidence(some: np.ndarray, block: np.ndarray) -> np.ndarray:
            b = np.zeros((len(some), len(block)), dtype=np.float32)
            for r, i in enumerate(some):
                own = rows[i][np.searchsorted(rows[i], block[0]) : np.searchsorted(rows[i], block[-1], side="right")]
                at = np.searchsorted(block, own)
                b[r, at[block[at] == own]] = 1 / max(1, len(rows[i])) ** 0.5
            return b

        blocks = np.split(codes, range(COLUMNS_TOGETHER, len(codes), COLUMNS_TOGETHER)) if len(codes) else []
        k_nm, k_mm = np.zeros((len(rows), len(marks))), np.zeros((len(marks), len(marks)))
        for block in blocks:
            base = incidence(marks, block)
            k_mm += base @ base.T
            for some in np.array_split(np.arange(len(rows)), -(-len(rows) // 256)):
                k_nm[some] += incidence(some, block) @ base.T
        values, vectors = np.linalg.eigh(k_mm)
        kept = values > 1e-6 * values[-1]
        root = vectors[:, kept] / np.sqrt(values[kept])  # K_mm to the power -1/2, on its range
        phi = k_nm @ root
        target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
        bias = target.mean(axis=0)
        beta = np.linalg.solve(phi.T @ phi + ridge * len(rows) * np.eye(phi.shape[1]), phi.T @ (target - bias))
        folded = root @ beta
        weights = np.concatenate([incidence(marks, block).T.astype(np.float64) @ folded for block in blocks]) if blocks else np.zeros((0, len(languages)))
        return cls(languages, codes, weights, bias)

    def values(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The regressions' values, a row per text: the batch's sparse incidence times the folded matrix."""
        return self.judged(data, offsets)[0]

    def judged(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """values(), and whether each text is in a learned language by LEAST_EVIDENCE and LEAST_KNOWN."""
        n = len(offsets) - 1
        row, code = presences(data, offsets)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        met = self.codes[at] == code
        own = np.maximum(1, np.bincount(row, minlength=n)) ** 0.5
        over = np.stack([np.bincount(row[met], self.weights[at[met], c], minlength=n) for c in range(len(self.languages))], axis=1) / own[:, None]
        plain = _PLAIN[code & 255] & _PLAIN[code >> 8 & 255] & _PLAIN[code >> 16 & 255]
        share = np.bincount(row[plain & met], minlength=n) / np.maximum(1, np.bincount(row[plain], minlength=n))
        if len(self.languages) == 1:
            return over + self.bias, share >= LEAST_KNOWN_ALONE
        best = (over + self.bias).argmax(axis=1)
        evidence = over[np.arange(n), best] / np.maximum(1 - self.bias[best], 1e-9)
        return over + self.bias, (evidence >= LEAST_EVIDENCE) | (share >= LEAST_KNOWN)


def labelled_sample(docs: DataFrame) -> tuple[list[np.ndarray], list[str]]:
    """N-gram codes and labels of (key, text, lang) rows for the fit: of each language at most ROWS_PER_LANGUAGE different texts, fewer if there are many languages, by a hash of the text.

    Rows without text or language teach nothing, and an empty table gives nothing. Copies of a text are one text.
    """
    rows = docs.where("lang is not null and text is not null and text <> ''").select("lang", "text", (F.octet_length("text") > LONGEST_FITTED).alias("long"), (F.pmod(F.xxhash64("text"), F.lit(1 << 53)) / F.lit(float(1 << 53))).alias("u"))
    found = rows.groupBy("lang", "long").agg(F.approx_count_distinct("u").alias("n"), F.min("u").alias("least")).collect()
    counts = list({r["lang"]: r for r in sorted(found, key=lambda r: -r["long"])}.values())  # long texts only where there are no others
    if not counts:
        return [], []
    each = min(ROWS_PER_LANGUAGE, max(1, ROWS_IN_ALL // len(counts)))
    # The hash draws at least twice as many as needed, or all, the row of the least hash among them; the rest is exact.
    share = docs.sparkSession.createDataFrame([(r["lang"], r["long"], max(r["least"], (2 * each + 16) / max(r["n"], 1))) for r in counts], "lang string, long boolean, share double")
    # Copies of a text have the same hash; they are one row before the bound counts them.
    drawn = rows.join(F.broadcast(share), ["lang", "long"]).where("u <= share").groupBy("lang", "u").agg(F.min("text").alias("text"))  # a row for each language
    place = F.row_number().over(Window.partitionBy("lang").orderBy("u"))
    chosen = drawn.withColumn("place", place).where(F.col("place") <= each).select("lang", "u", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = _rows(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("u"), pa.array(codes, pa.list_(pa.int64()))], names=["lang", "u", "codes"])

    got = map_batches(chosen, sets, "lang string, u double, codes array<bigint>").toArrow().sort_by([("u", "ascending"), ("lang", "ascending")])
    return [c.values.to_numpy() for c in got.column("codes")], got.column("lang").to_pylist()


def predict(docs: DataFrame, model: KernelModel, text_col: str = "text", reject: bool = False) -> DataFrame:
    """docs with lang_pred and score; a name that docs has already gets underscores until it is new.

    score is the winner's regression value, moved from [-1, 1] to [0, 1]. Null texts, texts without a letter, and all texts if
    the fit saw no language, are UNDETERMINED with score 0; with reject, so are texts that are in no learned language. Ties go to the first language by name.
    Rows may repeat, texts may be of any length, and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            column, preds, scores = b.column(text_col), [], []
            for lo, hi, data, offsets in ngrams.chunks(column):
                letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
                has = letters[offsets[1:]] > letters[offsets[:-1]]
                for i in np.flatnonzero(~has):
                    has[i] = any(map(str.isalpha, column[lo + int(i)].as_py() or ""))
                if m.languages:
                    f, learned = m.judged(data, offsets)
                    if reject:
                        has &= learned
                    best = f.argmax(axis=1)
                    top = np.clip((f[np.arange(hi - lo), best] + 1) / 2, 0, 1)
                    preds += [m.languages[c] if ok else UNDETERMINED for c, ok in zip(best, has, strict=True)]
                    scores += np.where(has, top, 0.0).tolist()
                else:
                    preds += [UNDETERMINED] * (hi - lo)
                    scores += [0.0] * (hi - lo)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField(names[-2], T.StringType()), T.StructField(names[-1], T.DoubleType())])
    return map_batches(docs, score, schema)


_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
#: Bytes of letters and spaces, and the 0 above the bytes of a short n-gram's code.
_PLAIN = _ASCII_LETTER | ngrams.SPACES | (np.arange(256) >= 128) | (np.arange(256) == 0)
