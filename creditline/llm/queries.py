"""Queries of the training-data operators: name -> builder, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditline.llm.attribution import token_counts
from creditline.llm.common import read_table
from creditline.llm.conversations import damage, repair
from creditline.llm.crosstoken import alignments
from creditline.llm.decontam import SQL as DECONTAM_SQL
from creditline.llm.decontam import contaminated
from creditline.llm.htmltext import extract
from creditline.llm.knn import SQL as KNN_SQL
from creditline.llm.knn import voronoi_topk
from creditline.llm.linededup import line_dedup
from creditline.llm.packing import digest, pack
from creditline.llm.pii import pseudonymise
from creditline.llm.quality import quality_scores
from creditline.llm.simhash import simhash_components
from creditline.llm.substrings import substring_dedup
from creditline.llm.toxicity import score, train


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents")).drop("kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"), size=4, bits=4)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    scores = quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), train_on=fold != 1)
    return scores.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents")).withColumn("n_tokens", F.col("n_tokens").cast("bigint"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_topk(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogates under the key of ``spark.creditline.surrogateKey``; without this setting under a public word,
    which makes a repeatable report but protects nobody."""
    key = spark.conf.get("spark.creditline.surrogateKey", "surrogates")
    return pseudonymise(read_table(spark, sf_dir, "documents"), key)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(read_table(spark, sf_dir, "documents"), with_ids=False))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(read_table(spark, sf_dir, "documents"), min_words=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(read_table(spark, sf_dir, "conversations"))).withColumn("conv_id", F.col("conv_id").cast("bigint"))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_text, op2_toxicity, op3_line_dedup, op4_simhash, op5_quality, op6_token_counts, op7_topk,
              op8_surrogates, op9_packing, op10_decontamination, op11_substring_dedup, op12_conversation_repair,
              op13_cross_tokenizer)
}
ORACLE: dict[str, str] = {"op7_topk": KNN_SQL, "op10_decontamination": DECONTAM_SQL}
