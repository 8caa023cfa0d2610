"""Five stages from raw documents to packed sequences, each on all that the one before kept.

Language identification, line dedup, near-duplicate dedup, benchmark decontamination, best-fit
packing.  Every stage is written as Parquet into the shared folder and read again, so a lost
executor costs at most one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placegauge.llm import decontaminate, language, line_templates, near_text, packing
from placegauge.llm.common import keep, own_name, table
from placegauge.llm.queries import VOCABULARY

# Texts of a learnt language score near 1, very short ones about 0.4; strange texts stay below this.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; without letters or likeness they go."""
    lang, score = own_name("lang"), own_name("score")
    found = language.identified(docs, lang_column=lang, score_column=score)
    known = (F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)
    return found.where(known).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but their first; documents left empty go."""
    gone = own_name("gone")
    found = line_templates.deduplicated(docs, counts=gone)
    emptied = (F.col(gone) > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    columns = [F.col(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        size = F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars"))
        columns[docs.columns.index("n_chars")] = size.cast("bigint").alias("n_chars")
    return found.where(~F.coalesce(emptied, F.lit(False))).select(*columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return near_text.without_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of at most 1024 tokens."""
    return packing.packed(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

# Scores, sketches, templates and token ids are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
