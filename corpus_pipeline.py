"""From raw documents to packed training sequences: quality, near duplicates, repeats, leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their own columns; the last returns the
packed pieces. Stages read their input more than once, so run() writes each result to the shared folder.

Defined cases, beyond those of the operators: nulls in other columns pass through; documents that share an id and a text
are one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontamination, near_dedup, packing, quality, substring_dedup
from foliospark.llm.shared import Written


def _beside_text(docs: DataFrame) -> DataFrame:
    """`text`, and all other columns in one; so the operators' own columns clash with none, and the text goes along once."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("own_columns_"), "text")


def _own_columns(docs: DataFrame, **new) -> list:
    return [(new[c] if c in new else F.col("text") if c == "text" else F.col(f"own_columns_.`{c}`")).alias(c) for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labelled ones among `docs`, predicts to be of low quality."""
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(_beside_text(docs), weights).filter("predicted = 1").select(_own_columns(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id (of several texts with this id, one);
    a text that only shares its id with a document that goes, stays. Documents without words or id are in no group."""
    judged = Written(near_dedup.near_duplicates(docs), "groups").df
    linked = judged.filter("n_shingles > 0 and doc_id is not null")
    stays = linked.filter("kept").groupBy("component_id").agg(F.min("text_key").alias("text_key")).select(F.col("component_id").alias("doc_id"), "text_key")
    goes = linked.select("doc_id", "text_key").distinct().join(stays, ["doc_id", "text_key"], "left_anti")
    keyed = docs.withColumn("own_key_", F.xxhash64(F.col("text").cast("string")))
    rows = F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id_")) & (F.col("own_key_") == F.col("gone_key_"))
    gone = Written(goes.select(F.col("doc_id").alias("gone_id_"), F.col("text_key").alias("gone_key_")), "gone").df
    kept = keyed.join(gone.hint("merge"), rows, "left_anti").drop("own_key_")
    twice = Written(judged.filter("doc_id is not null").groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id"), "twice").df
    if twice.isEmpty():
        return kept
    once = kept.join(twice.distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; n_chars follows."""
    cut = substring_dedup.remove_repeats(_beside_text(docs))
    new = {"text": F.col("dedup_text")}
    if "n_chars" in docs.columns:
        length = F.length("dedup_text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(F.col("own_columns_.n_chars"))
    return cut.select(_own_columns(docs, **new))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    found = decontamination.find_leaks(_beside_text(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("size(leaks) = 0").select(_own_columns(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that are left."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: No SQL for FTRL training, SuperMinHash and packing: tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Written(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
