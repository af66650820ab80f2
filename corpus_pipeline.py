"""The corpus pipeline: toxicity, near duplicates, repeated passages, contamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared folder and reads back as the next stage's
docs. All stages but the last return the columns of ``documents``.

In every stage: null texts count as empty and pass (no score, word or token);
repeated rows of one text are one class, of which one row stays; a null doc_id
is carried along; ties go as the operator's docstring says; texts of any
length are one row and used whole; an empty table gives an empty one of the
same columns; further columns of ``docs`` are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidlake.llm import bpe, common, decontam, neardup, substrings, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier calls toxic go; labels train it, and never decide by themselves."""
    model = toxicity.fit(docs, common.read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS).where("predicted = 0").select(*COLUMNS)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal or near-equal texts stays."""
    return neardup.near_duplicates(docs, COLUMNS).where("is_kept").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; every row stays, its text and n_chars follow."""
    kept = substrings.dedup(docs, COLUMNS, texts=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the benchmark rule calls contaminated go."""
    return decontam.decontaminate(docs, common.read_table(spark, sf_dir, "benchmark"), COLUMNS).where("not contaminated").select(*COLUMNS)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their digest and that of the text decoded from them."""
    return bpe.encode_decode(docs, bpe.read_ranks(), ["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_class),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("byte_bpe", to_token_ids),
]

#: The first stage is a fitted model: no SQL gives run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.drop_staged(*before)
        before = [docs]
    return docs
