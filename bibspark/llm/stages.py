"""The stages of the pipeline over documents: language ID, exact and near duplicates, personal data, packing.

Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exactdedup, langid, neardup, packing, privacy
from .common import materialize, scratch_dir, small

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: a null text or one without a letter, also if no language was learned."""
    model = langid.learn(docs.select("doc_id", "text", "lang").where(~langid.held_out()))
    named = F.col("lang_pred") != "und" if model.langs else F.col("text").rlike(r"\p{L}")
    return langid.identify(docs, model, COLUMNS).where(named).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the row with the largest doc_id; one without an id only if no equal text has one."""
    at = scratch_dir(spark)
    docs.select("doc_id", "text").write.parquet(f"{at}/docs")
    rows = spark.read.parquet(f"{at}/docs")
    state = materialize(exactdedup.digest_state(spark, f"{at}/docs", rows.schema), "state")
    dropped = exactdedup.deduplicate(rows, state).where("not kept").select(F.col("doc_id").alias("x_id"), F.col("text_sha256").alias("x_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("x_id")) & (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("x_key"))
    return docs.select(*COLUMNS).join(small(materialize(dropped, "dropped")), same, "left_anti").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keeps the row with the smallest doc_id.

    Rows without a doc_id stay. So do the rows of an id that has several different texts, which are one document to the
    operator: none of them is lost for what another one resembles.
    """
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).distinct()
    several = materialize(texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "several")
    dropped = neardup.near_duplicates(docs).where("component_id <> doc_id").select("doc_id").distinct().join(small(several), "doc_id", "left_anti")
    return docs.select(*COLUMNS).join(small(materialize(dropped, "dropped")), "doc_id", "left_anti").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that disclose it, by placeholders; n_chars follows the new text."""
    terms = materialize(privacy.disclosing_terms(docs), "terms")
    found = privacy.with_spans(docs, terms).where(F.size("spans") > 0).select(F.col("doc_id").alias("x_id"), F.col("text_key").alias("x_key"), "spans").dropDuplicates(["x_id", "x_key"])
    rows = docs.select(*COLUMNS)
    joined = rows.join(small(materialize(found, "found")), rows["doc_id"].eqNullSafe(F.col("x_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("x_key")), "left")
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(privacy.redacted(F.col("text"), F.col("spans")))
    return joined.withColumn("clean", clean).select("doc_id", F.col("clean").alias("text"), "lang", "source", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("clean")).cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(packing.VOCABULARY))
