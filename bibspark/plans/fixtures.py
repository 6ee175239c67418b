"""Input views over the driver tables, in SQL that Spark and DuckDB both accept, and the means to use them.

Each view stands for an input of the library (papers, plans, judgements, records, page geometry); all of them read
whole tables and whole texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.library import Index, build_index
from ..scratch import scratch_dir

TABLES = ("documents", "labels", "benchmark", "conversations", "embeddings", "events", "part", "pages")

VIEWS = {
    "papers": """
SELECT doc_id AS paper_id, trim(replace(split_part(text, '.', 1), chr(10), ' ')) AS title, source AS authors, text AS abstract,
  CASE WHEN doc_id % 3 = 1 THEN 'ar' || cast(cast(floor(doc_id / 6) AS BIGINT) AS STRING) || 'v1' ELSE '' END AS arxiv_id,
  CASE WHEN doc_id % 3 = 0 THEN '10.1000/D' || cast(cast(floor(doc_id / 6) AS BIGINT) AS STRING) ELSE '' END AS doi,
  CASE WHEN doc_id % 7 = 0 THEN cast(doc_id AS STRING) ELSE '' END AS ieee_id,
  CASE doc_id % 4 WHEN 0 THEN 'openalex' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'ieee' ELSE 'crossref' END AS source,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '/home/u/library/pdfs/' || cast(doc_id AS STRING) || '.pdf'
    WHEN 2 THEN 'pdfs/' || cast(doc_id AS STRING) || '.pdf' ELSE cast(doc_id AS STRING) || '.pdf' END AS pdf_path,
  cast(2000 + doc_id % 25 AS INT) AS year, 1704067200 + cast(floor(doc_id / 2) AS BIGINT) * 60 AS added_epoch
FROM documents""",
    "plan_queries": """
SELECT cast(1 + item_id % 2 AS INT) AS round, item_id AS q_pos,
  CASE WHEN item_id % 11 = 10 THEN '  ' ELSE ' ' || split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' '
    || split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4) END AS query,
  CASE item_id % 4 WHEN 0 THEN ' OpenAlex' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'ieee' ELSE NULL END AS source,
  CASE WHEN item_id % 5 = 0 THEN 'Venue A' ELSE '' END AS venue, '' AS author
FROM benchmark""",
    "judgements": """
SELECT doc_id AS paper_id, cast(quality * 7 + (1 - toxic) * 4 + doc_id % 3 - 2 AS DOUBLE) AS score,
  CASE WHEN quality = 1 THEN 'high' WHEN toxic = 1 THEN 'low' ELSE NULL END AS verdict
FROM labels""",
    "work_refs": """
SELECT doc_id AS paper_id, (doc_id * 7 + 1) % (SELECT count(*) FROM documents) AS ref_id FROM documents
UNION ALL SELECT doc_id AS paper_id, (doc_id * 13 + 12) % (SELECT count(*) FROM documents) AS ref_id FROM documents""",
    "structures": """
SELECT cast(doc_id AS STRING) AS paper_id, trim(replace(split_part(text, '.', 1), chr(10), ' ')) AS title,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE cast(2000 + doc_id % 25 AS INT) END AS year,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS problem_to_solve,
  CASE WHEN doc_id % 8 = 0 THEN ' ' ELSE lang || ': ' || text END AS research_task,
  split(replace(text, chr(10), ' '), ' ') AS input_variables, split(text, ',') AS method_family, split(text, chr(10)) AS model_outputs
FROM documents""",
    "assignments": """
SELECT cast(d.doc_id AS STRING) AS paper_id,
  CASE d.lang WHEN 'en' THEN 'D1' WHEN 'fr' THEN 'D2' WHEN 'de' THEN 'D3' ELSE 'D4' END AS direction_id
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "memberships": """
SELECT a.direction_id, CASE WHEN l.quality = 1 THEN 'included' ELSE 'borderline' END AS list_kind, a.paper_id
FROM assignments a JOIN labels l ON a.paper_id = cast(l.doc_id AS STRING)
UNION ALL SELECT CASE a.direction_id WHEN 'D1' THEN 'D2' WHEN 'D2' THEN 'D3' WHEN 'D3' THEN 'D4' ELSE 'D1' END, 'included', a.paper_id
FROM assignments a JOIN labels l ON a.paper_id = cast(l.doc_id AS STRING) WHERE l.toxic = 1
UNION ALL SELECT a.direction_id, 'representative', cast(min(cast(a.paper_id AS BIGINT)) AS STRING) FROM assignments a GROUP BY a.direction_id
UNION ALL SELECT 'D4', 'borderline', cast(1000000 + item_id AS STRING) FROM benchmark WHERE text LIKE 'T%'""",
    "page_texts": "SELECT conv_id AS pdf_id, turn + 1 AS page, text FROM conversations",
    "page_lines": """
SELECT cast(floor(doc_id / 60) AS BIGINT) AS pdf_id, cast(floor((doc_id % 60) / 30) AS BIGINT) + 1 AS page, doc_id AS line_id,
  cast(CASE WHEN doc_id % 30 < 15 THEN 50 ELSE 320 END + doc_id % 3 AS DOUBLE) AS x0,
  cast(60 + 14 * (doc_id % 15) + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS DOUBLE) AS y0,
  cast(CASE WHEN doc_id % 30 < 15 THEN 280 ELSE 550 END AS DOUBLE) AS x1, cast(70 + 14 * (doc_id % 15) AS DOUBLE) AS y1,
  cast(9 + (doc_id % 2) * 0.5 AS DOUBLE) AS font_size,
  CASE WHEN doc_id % 10 = 0 THEN 'Fig. 0' || cast(doc_id % 9 AS STRING) || 'A ' ELSE CASE WHEN doc_id % 10 = 5 THEN 'TABLE IV ' ELSE '' END END
    || replace(text, chr(10), ' ') AS text
FROM documents""",
    "page_words": """
SELECT pdf_id, page, line_id * 3 + k AS word_id, x0 + k * 76 AS x0, y0, x0 + k * 76 + 70 AS x1, y1
FROM page_lines CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks""",
    "page_dims": "SELECT DISTINCT pdf_id, page, cast(612 AS DOUBLE) AS width, cast(792 AS DOUBLE) AS height FROM page_lines",
    "page_regions": """
SELECT cast(floor(p_partkey / 16) AS BIGINT) AS pdf_id, p_partkey % 2 + 1 AS page, p_partkey AS region_id,
  CASE p_partkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'vector' ELSE 'image' END AS kind,
  cast(CASE WHEN p_size % 2 = 0 THEN 55 ELSE 325 END AS DOUBLE) AS x0, cast(70 + 80 * (p_partkey % 8) AS DOUBLE) AS y0,
  cast(CASE WHEN p_size % 2 = 0 THEN 55 ELSE 325 END + 60 + 3 * p_size AS DOUBLE) AS x1,
  cast(70 + 80 * (p_partkey % 8) + 40 + p_size AS DOUBLE) AS y1, CASE WHEN p_partkey % 12 = 0 THEN '' ELSE p_name END AS cell
FROM part""",
    "run_records": """
SELECT event_type AS stage, cast(user_id AS STRING) AS item, ts AS started_at, value AS elapsed_seconds,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status
FROM events""",
}


def _needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        inner = [v for v in VIEWS if re.search(rf"\b{v}\b", VIEWS[name]) and v != name and re.search(rf"(FROM|JOIN) {v}\b", VIEWS[name])]
        for v in [*_needed(tuple(inner)), name]:
            if v not in out:
                out.append(v)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a driver table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for table in TABLES:
        if any(re.search(rf"(FROM|JOIN) {table}\b", VIEWS[v]) for v in _needed((name,))):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    for v in _needed((name,)):
        df = spark.sql(VIEWS[v])
        df.createOrReplaceTempView(v)
    return df


_indexes: dict[tuple, Index] = {}


def paper_index(spark: SparkSession, sf_dir: str, since: int | None = None) -> Index:
    """The stored index of the papers, built by the first query of a session that asks for it. With since, of the papers
    of that year or later, each source a collection of its own."""
    key = (spark.sparkContext.applicationId, sf_dir, since)
    if key not in _indexes:
        papers = view(spark, sf_dir, "papers")
        papers = papers if since is None else papers.where(F.col("year") >= since).withColumn("corpus", F.col("source"))
        _indexes[key] = build_index(papers, f"{scratch_dir(spark)}/index")
    return _indexes[key]


def with_views(sql: str, *names: str) -> str:
    """A DuckDB query with the views it names in front. sql may start with further "name AS (...)" parts and a bar of
    three dashes before its SELECT."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in _needed(names)]
    more, _, body = sql.rpartition("---")
    if more.strip():
        parts.append(more.strip().rstrip(","))
    return f"WITH {', '.join(parts)} {body}" if parts else body
