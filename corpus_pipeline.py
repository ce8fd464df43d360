"""Documents to a training mix: languages, toxicity, near-duplicates, benchmark leaks, source weights.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. Every stage but the last returns the columns of ``documents``. Null ids
are kept by every stage; null and empty texts are rejected by the first, as
they have no language.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import stored
from sieveline.llm.decontam import decontaminated
from sieveline.llm.langid import UNDETERMINED, identify_language
from sieveline.llm.mixing import mix
from sieveline.llm.neardup import near_duplicates
from sieveline.llm.queries import language_model, table, toxicity_model
from sieveline.llm.toxicity import THRESHOLD, toxicity
from sieveline.plans.registry import query
from sieveline.session import ship_package

#: A text whose likeliest language has less than this posterior is rejected, like one without a letter.
MIN_LANGUAGE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose language is determined."""
    ship_package()
    identify = identify_language(language_model(spark, docs), spark)
    found = docs.withColumn("_found", identify(F.col("text")))
    sure = (F.col("_found.lang_pred") != UNDETERMINED) & (F.col("_found.score") >= MIN_LANGUAGE)
    return found.where(sure).drop("_found")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that score below the threshold."""
    ship_package()
    score = toxicity(toxicity_model(spark, docs, sf_dir), spark)
    return docs.withColumn("_score", score(F.col("text"))).where(F.col("_score") < THRESHOLD).drop("_score")


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, that with the smallest id."""
    ship_package()
    # Rows that share an id are one document: they stay or go together.
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(stored(gone, "gone"), "doc_id", "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that repeat no benchmark item."""
    ship_package()
    return decontaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document that bring sources to their targets; documents without a copy go."""
    ship_package()
    return mix(docs).where("copies > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", language_stage),
    ("toxicity", toxicity_stage),
    ("near-duplicates", neardup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
]

#: SQL expresses neither of the trained stages nor the dual's solution.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
