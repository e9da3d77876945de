"""A corpus pipeline of five operators: toxicity, line dedup, SimHash
near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and reread as the next stage's docs.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditline.llm.common import read_table, stored
from creditline.llm.decontam import decontaminate
from creditline.llm.linededup import line_dedup
from creditline.llm.packing import digest, pack
from creditline.llm.simhash import near_dedup
from creditline.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any toxicity is below one half."""
    return reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of 50 or more words that earlier documents
    hold; a document that is left without any word by this goes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = line_dedup(docs, keep=others).where("words_removed = 0 or length(trim(text)) > 0")
    cols = {c: F.col(f"kept.c{i}") for i, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("words_removed") > 0, F.length("text")).otherwise(cols["n_chars"])
    return rows.select(*[cols[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each SimHash component."""
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return digest(pack(docs, with_ids=False))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Word hashing, patience diff and tokenizing have no SQL form; tests/llm holds
#: every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
