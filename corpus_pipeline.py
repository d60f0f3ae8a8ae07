"""The corpus pipeline: language ID, line dedup, near duplicates, decontamination, packing.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame that is written as Parquet and read again
as the next one's ``docs``.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailforge.llm import common, decontam, jaccard, langid, linededup, packing
from retailforge.llm.queries import VOCABULARY
from retailforge.session import stage


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; without a letter or a likely language they go."""
    common.prepare(spark)
    return langid.keep_identified(docs)


def without_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates; ``n_chars`` follows the text."""
    common.prepare(spark)
    out = linededup.deduplicate_lines(docs)
    changed = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")
    new = {"text": F.col("kept_text").alias("text"), "n_chars": changed}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    common.prepare(spark)
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract's rule does not call contaminated."""
    common.prepare(spark)
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    common.prepare(spark)
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_templates),
    ("jaccard_join", one_of_each_group),
    ("decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: Language ID, tokenisation and packing are beyond SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
