"""What the library writes: assembled texts, record bundles, tables as CSV, graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, safe_stem

#: Fixed value: the line before each page.
PAGE_MARK = "\n==================== 第 %d 页 ====================\n"


def assemble_documents(pages: DataFrame, mark: bool = True) -> DataFrame:
    """(pdf_id, text): page texts (pdf_id, page, text) in page order, each after its mark, cleaned."""
    body = F.coalesce("text", F.lit(""))
    piece = F.concat(F.format_string(PAGE_MARK, "page"), body) if mark else body
    joined = pages.select("pdf_id", F.struct("page", piece.alias("t")).alias("p")).groupBy("pdf_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return joined.select("pdf_id", clean_text(F.array_join(F.transform("ps", lambda p: p["t"]), "")).alias("text"))


#: The parts of a bundle, and the versions of a whole one and of one with structures alone.
BUNDLE_PARTS = ("single_paper_structures", "direction_mapping", "direction_schemas", "direction_records", "cross_direction_comparison")
WHOLE, SINGLE = "v2_direction_adaptive", "v2_single_paper_only"


def bundle_manifest(parts: dict[str, DataFrame], topic: str, source: str, version: str | None = None) -> DataFrame:
    """(topic, generated_at, pipeline_version, input_source, part, rows): a row for each part of a bundle."""
    unknown = set(parts) - set(BUNDLE_PARTS)
    if unknown or "single_paper_structures" not in parts:
        raise ValueError(f"a bundle has structures and known parts, not {sorted(unknown or parts)}")
    version = version or (SINGLE if len(parts) == 1 else WHOLE)
    head = [F.lit(topic).alias("topic"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("generated_at"), F.lit(version).alias("pipeline_version"), F.lit(source).alias("input_source")]
    counts = [df.agg(F.count("*").alias("rows")).select(*head, F.lit(name).alias("part"), "rows") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, counts)


def write_bundle(parts: dict[str, DataFrame], path: str, topic: str, source: str = "bibspark", version: str | None = None) -> None:
    """A bundle is a folder: each part as JSON lines below its name, and a manifest with topic, time, version, source and
    row counts. A bundle of structures alone is one with that part only. No part is gathered in one row."""
    manifest = bundle_manifest(parts, topic, source, version)
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The manifest of a written bundle, and its parts."""
    manifest = spark.read.json(f"{path}/manifest")
    return manifest, {r.part: spark.read.json(f"{path}/{r.part}") for r in manifest.select("part").collect()}


def direction_stems(df: DataFrame) -> DataFrame:
    return df.withColumn("stem", safe_stem(F.concat_ws("_", "direction_id", "direction_name")))


def write_directions(df: DataFrame, path: str) -> None:
    """One folder of JSON lines per direction, named after its safe stem."""
    direction_stems(df).write.mode("overwrite").partitionBy("stem").json(path)


def table_cells(rows: Column) -> Column:
    """Cells trimmed, null as empty; null for a table without a filled cell."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    return F.when(F.exists(F.flatten(clean), lambda c: c != ""), clean)


def write_table_csv(tables: DataFrame, path: str) -> None:
    """Tables (table_id, rows) as CSV, a folder per table; empty tables are left out. A line keeps its place in row."""
    filled = tables.withColumn("rows", table_cells(F.col("rows"))).where("rows is not null")
    lines = filled.select("table_id", F.posexplode("rows").alias("row", "cells"))
    text = F.array_join(F.transform("cells", lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))), ",")
    lines.select("table_id", "row", text.alias("value")).repartition("table_id").sortWithinPartitions("table_id", "row").select("table_id", "value").write.mode("overwrite").partitionBy("table_id").text(path)


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, relation_types): one row."""
    e = edges.agg(F.count("*").alias("edges"), F.sort_array(F.collect_set("type")).alias("relation_types"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(e)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    graph_summary(nodes, edges).write.mode("overwrite").json(f"{path}/summary")
