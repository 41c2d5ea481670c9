"""The corpus pipeline: documents in, packed training sequences out.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of documents. run() writes each stage's result to the shared folder and rereads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import decontaminate, jaccard_join, language, line_dedup, packing
from lexispark.llm.common import Scratch, fresh, kept_tables, read_table, release
from lexispark.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones have, by prediction; those without letters or in no learned language go."""
    model = language.KernelModel.fit(*language.labelled_sample(docs.select(F.col("doc_id").alias("key"), "text", "lang")))
    found = language.predict(docs, model, reject=True)
    return found.where(F.col(fresh(docs.columns, "lang_pred")) != language.UNDETERMINED).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines; documents of which nothing is left go, and n_chars follows the text."""
    found = line_dedup.drop_recurring_lines(docs).where((F.col(fresh(docs.columns, "n_dropped")) == 0) | F.col("text").rlike(r"\S"))
    return found.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: word 5-gram Jaccard similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, previous = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        before = kept_tables()
        made = stage(spark, docs, sf_dir)
        used = [t for t in kept_tables() if t not in before]
        docs = Scratch(spark, "pipeline").table(made, name.replace(" ", "-"), keep=True)
        release(spark, used + previous)
        previous = kept_tables()[-1:]
    return docs
