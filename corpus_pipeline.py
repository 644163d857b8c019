"""A corpus pipeline: five stages, each of which calls one operator of ``typeloom.llm``.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.

Defined cases, for every stage: further columns stay, whatever their names; an empty table gives no
rows; doc_ids may be null or repeated, and each row is judged by its own text; texts are read whole,
however long. By stage:

* language_id: null texts and texts without a letter go, as they have no language; so do texts whose
  language is told with a posterior below MIN_SCORE.
* line_dedup: a null text becomes the empty text and n_chars follows; a document goes only if all its
  words fell with dropped lines, so empty and blank ones stay here.
* simhash: equal rows and all documents without words are groups like any other; the row with the
  smallest doc_id stays (null last), then the one with the least text hash; of equal rows, one.
* decontamination: null and empty texts stay; without a benchmark all stay.
* packing: null and empty texts count the end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm import decontaminate, language_id, line_dedup, packing, simhash
from typeloom.llm.common import discard, free_name, stored, table

#: A document is rejected if its language can't be told, or only with less than this posterior.
MIN_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told from their text; ``lang`` stays as it was."""
    pred, score = names = [free_name(c, docs) for c in language_id.ADDED]
    judged = language_id.tag(docs, language_id.train(docs), tuple(names))
    return judged.where((F.col(pred) != "und") & (F.col(score) >= MIN_SCORE)).select([f"`{c}`" for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents are dropped; ``n_chars`` follows the text. Documents left without a word go.

    Copies of a document count once, so that they don't empty each other: SimHash keeps one of them.
    """
    _, n_dropped = names = [free_name(c, docs) for c in line_dedup.ADDED]
    out = line_dedup.drop_frequent_lines(docs, copies_once=True, added=tuple(names))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.where((F.col(n_dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select([f"`{c}`" for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.one_of_each(docs).select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: its bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # of the stages' tables, only the last one stays
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID, SimHash and the packing's dynamic programming aren't expressible in SQL; see tests/llm.
ORACLE_SQL = None
