"""A corpus pipeline of five stages, each one operator of archive_lens.llm over all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archive_lens.llm import decontamination, near_dedup, packing, quality, substring_dedup
from archive_lens.llm.common import spare, table
from archive_lens.session import materialize

TOKENIZER = "word_bpe_49k.json"
#: Words of a passage that is removed where it repeats.
WINDOW = 20


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from all labels."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), F.lit(True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8), the one of least doc_id.

    Of rows that repeat that doc_id and text one stays; a row with a null doc_id is compared as the others are, and texts
    that share a doc_id as if they did not.
    """
    return near_dedup.keep_one(docs, k=5, num=80, den=100)


def substring_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of WINDOW words or more that an earlier place holds are cut; a text that loses none stays as it was."""
    out, p = substring_dedup.remove_repeats(docs, WINDOW), spare(docs)
    cut = F.col(p + "n_removed") > 0
    new = {"text": F.when(cut, F.col(p + "kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length(p + "kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER)).drop("ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_duplicates),
    ("substring_dedup", substring_repeats),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
