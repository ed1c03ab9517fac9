"""The corpus pipeline: language ID, line dedup, near duplicates, benchmark
decontamination and packing, each on all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``docs``. ``run`` writes each stage's rows and reads them again.
Decisions are made per row through the operators' ids: rows that repeat a ``doc_id``
share its decision, and rows without an id are kept by every filtering stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import decontam, jaccard, langcrf, linededup, packing
from corpusloom.llm.common import table
from corpusloom.session import lookup_join, stage

# A text whose best language is less probable than this is rejected, like one
# without any letter.
LEAST_SCORE = 0.3

ORACLE_SQL = None  # a learned model decides in the first stage


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids``. The ids are written once, as
    the join measures them before it reads them."""
    gone = stage(ids.filter("doc_id is not null").distinct().select(F.col("doc_id").alias("_gone_id"), F.lit(True).alias("_gone")))
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_gone_id"))
    return lookup_join(keyed, gone, ["_gone_id"]).filter("_gone is null").select("_row.*")


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with a language."""
    found = langcrf.identify(docs, langcrf.learn(docs))
    rejected = found.filter((F.col("lang_pred") == langcrf.UNKNOWN) | (F.col("score") < LEAST_SCORE))
    return _without(docs, rejected.select("doc_id"))


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that many documents share, and count the characters anew."""
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    kept = linededup.dedup_rows(docs)
    return kept.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each component."""
    found = jaccard.near_duplicates(docs)
    copies = found.filter(F.col("doc_id") != F.col("component_id"))
    return _without(docs, copies.select("doc_id"))


def benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id"))


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the documents into sequences of power-of-two lengths."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("packing", pack),
]


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
