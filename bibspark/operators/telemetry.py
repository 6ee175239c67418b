"""Run telemetry: how long stages took."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_totals(records: DataFrame) -> DataFrame:
    """(stage, runs, errors, elapsed_seconds): a row per stage, and a total with a null stage; seconds to three places."""
    named = records.withColumn("stage", F.coalesce("stage", F.lit("")))
    out = named.rollup("stage").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "error").alias("errors"), F.sum(F.coalesce("elapsed_seconds", F.lit(0.0)).cast("decimal(28,9)")).alias("s"))
    return out.select("stage", "runs", "errors", F.round("s", 3).cast("double").alias("elapsed_seconds"))


def write_totals(records: DataFrame, path: str) -> None:
    stage_totals(records).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/totals")
    records.write.mode("overwrite").json(f"{path}/records")
