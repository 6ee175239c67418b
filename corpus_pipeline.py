"""A training-data pipeline over documents: language ID, exact and near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from bibspark.llm.common import materialize, table
from bibspark.llm.stages import COLUMNS, exact, language, near, packed, private
from pyspark.sql import DataFrame, SparkSession

STAGES = [("language_id", language), ("exact_dedup", exact), ("near_duplicates", near), ("personal_data", private), ("packing", packed)]
#: A learned language model and a tokenizer can't be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
