"""Queries of sources, sinks, telemetry and incremental jobs, with their DuckDB texts. Raw dumps are made from documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.text import positions
from ..operators import graph as G
from ..operators import telemetry as H
from ..scratch import scratch_dir
from ..sources import readers as A
from ..sources import sinks as W
from ..streaming import incremental as S
from .fixtures import view, with_views
from .library_queries import E_SQL, e12_build_graph
from .text_queries import SPECS


def _docs(spark, sf_dir):
    return view(spark, sf_dir, "documents").withColumn("words", F.filter(F.split("text", r"\s+"), lambda w: w != ""))


def _index():
    """The inverted index of each text, made where the text is read; null without words."""
    return F.map_from_entries(positions(F.col("words"), "w", "ps"))


def _openalex(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("index", _index())
    k = F.col("doc_id")
    name = lambda c: F.struct(F.struct(c.alias("display_name")).alias("author"))
    raw = d.select(
        F.concat(F.lit("https://openalex.org/W"), k).alias("id"), F.when(k % 10 > 0, F.get("words", F.lit(0))).alias("title"), F.when(k % 3 > 0, F.concat(F.lit("https://doi.org/10.1/"), k)).alias("doi"), F.when(k % 2 == 0, F.col("text")).otherwise("").alias("abstract"),
        (k % 30 + 1990).cast("int").alias("publication_year"), F.when(k % 4 > 0, k).alias("cited_by_count"), F.array(name(F.col("source")), name(F.lit(None).cast("string")), name(F.lit("")), name(F.col("lang"))).alias("authorships"),
        F.when(k % 5 > 0, F.struct(F.struct(F.col("lang").alias("display_name"), F.lit("journal").alias("type")).alias("source"))).alias("primary_location"), F.transform(F.slice("words", 1, 12), lambda w: F.struct(w.alias("display_name"))).alias("concepts"),
        F.when(k % 7 > 0, F.struct((k % 2 == 0).alias("is_oa"), F.lit("u").alias("oa_url"))).alias("open_access"), F.col("index").alias("abstract_inverted_index"), F.array(F.concat(F.lit("W"), k)).alias("referenced_works"),
    )
    return A.openalex_works(raw)


def a1_read_openalex(spark, sf_dir):
    return _openalex(spark, sf_dir).withColumn("concepts", F.array_join("concepts", "|")).withColumn("abstract", F.md5("abstract")).drop("referenced_works")


def a2_inverted_index(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("index", _index()).select("doc_id", A.abstract_from_inverted_index(F.col("index")).alias("abstract"))


def _crossref(spark, sf_dir):
    d, k = _docs(spark, sf_dir), F.col("doc_id")
    date = F.struct(F.array(F.array((k % 30 + 1990).cast("int"), F.lit(1))).alias("date-parts"))
    raw = d.select(
        F.when(k % 9 > 0, F.array("text", "lang")).alias("title"), F.array(F.struct(F.get("words", F.lit(0)).alias("given"), F.col("lang").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.col("source").alias("family"))).alias("author"), F.col("text").alias("abstract"), F.concat(F.lit("10.1/"), k).alias("DOI"),
        F.when(k % 2 == 0, F.concat(F.lit("http://arxiv.org/abs/"), k, F.lit("v2"))).otherwise(F.concat(F.lit("http://x.org/"), k)).alias("URL"), F.when(k % 3 == 0, date).alias("published-print"), F.when(k % 3 == 1, date).alias("published-online"), F.when(k % 5 == 0, F.struct(F.struct(F.concat(F.lit("https://arxiv.org/abs/r"), k).alias("url")).alias("arxiv"))).alias("relation"),
    )
    return A.crossref_works(raw)


def a3_read_crossref(spark, sf_dir):
    return _crossref(spark, sf_dir).withColumn("title", F.md5("title")).withColumn("abstract", F.md5("abstract"))


def _arxiv(spark, sf_dir):
    k = F.col("doc_id")
    raw = _docs(spark, sf_dir).select(F.get("words", F.lit(0)).alias("title"), F.array(F.struct(F.col("source").alias("name")), F.struct(F.col("lang").alias("name"))).alias("authors"), F.col("text").alias("summary"), F.concat(F.lit("http://arxiv.org/abs/"), k, F.lit("v1")).alias("entry_id"), F.timestamp_seconds(k * 86_400 * 10).alias("published"), F.when(k % 2 == 0, F.concat(F.lit("10.2/"), k)).alias("doi"))
    return A.arxiv_works(raw)


def a4_read_arxiv(spark, sf_dir):
    return _arxiv(spark, sf_dir).withColumn("abstract", F.md5("abstract"))


def _ieee(spark, sf_dir):
    k = F.col("doc_id")
    raw = _docs(spark, sf_dir).select(F.get("words", F.lit(0)).alias("title"), F.struct(F.array(F.struct(F.col("source").alias("name")), F.struct(F.col("lang").alias("name"))).alias("authors")).alias("authors"), F.col("text").alias("abstract"), F.when(k % 2 == 0, k.cast("string")).alias("article_number"), F.when(k % 2 == 1, k.cast("string")).alias("articleNumber"), F.lit(None).cast("string").alias("doi"), (k % 30 + 1990).cast("int").alias("year"), F.when(k % 2 == 0, F.col("lang")).alias("publication_title"), F.when(k % 2 == 1, F.col("source")).alias("publicationTitle"))
    return A.ieee_works(raw)


def a5_read_ieee(spark, sf_dir):
    return _ieee(spark, sf_dir).withColumn("abstract", F.md5("abstract"))


def a6_union_sources(spark, sf_dir):
    errors = _docs(spark, sf_dir).where("lang = 'de'").select(F.lit("ieee").alias("source"), F.concat(F.lit("failed "), "doc_id").alias("error"))
    papers, bad = A.union_sources(_openalex(spark, sf_dir), _crossref(spark, sf_dir), _arxiv(spark, sf_dir), _ieee(spark, sf_dir), errors)
    return papers.groupBy("source").agg(F.count("*").alias("papers"), F.count("year").alias("with_year"), F.count("venue").alias("with_venue"), F.count("arxiv_id").alias("with_arxiv")).join(bad.groupBy("source").agg(F.count("*").alias("errors")), "source", "left").fillna(0, ["errors"])


def a7_structure_violations(spark, sf_dir):
    k = F.col("doc_id")
    body = F.when(k % 10 == 0, F.to_json(F.array("text"))).when(k % 10 == 1, F.to_json(F.struct(F.lit(" ").alias("paper_id"), "text"))).when(k % 10 == 2, F.to_json(F.struct((k / 100).cast("int").cast("string").alias("paper_id"), "text"))).otherwise(F.to_json(F.struct(F.concat(F.lit("p"), k).alias("paper_id"), "text")))
    return A.structure_violations(_docs(spark, sf_dir).select(F.concat(F.lpad(k.cast("string"), 9, "0"), F.lit(".json")).alias("file"), body.alias("value")))


def a8_direction_records(spark, sf_dir):
    k = F.col("doc_id")
    d = F.concat(F.lit("D"), (k % 50).cast("string"))
    body = F.when(k % 4 == 0, F.to_json(F.struct(d.alias("direction_id"), "text"))).when(k % 4 == 1, F.to_json(F.struct(F.lit(" ").alias("direction_id"), F.array(F.struct(F.struct("lang").alias("paper"), d.alias("direction_id"))).alias("records")))).when(k % 4 == 2, F.to_json(F.struct(F.array(F.struct(F.struct(d.alias("direction_id")).alias("meta"))).alias("records")))).otherwise(F.to_json(F.struct("text")))
    out = A.direction_records(_docs(spark, sf_dir).select(F.concat(F.lpad(k.cast("string"), 9, "0"), F.lit(".json")).alias("file"), F.parse_json(body).alias("v")))
    return out.select("direction_id", "file")


def a9_pdf_inventory(spark, sf_dir):
    """Files written from the documents, one per source and language; those of a source that is asked for, and of how many."""
    at = scratch_dir(spark)
    docs = _docs(spark, sf_dir).select(F.concat_ws("_", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))).alias("stem"), F.col("doc_id").cast("string").alias("value"))
    docs.repartition("stem").write.partitionBy("stem").text(at)
    files = A.pdf_inventory(spark, at, suffix=".txt")
    return files.select(F.regexp_extract("path", "stem=([^/]+)/", 1).alias("stem"), (F.col("length") > 0).alias("filled"))


def a10_assemble_documents(spark, sf_dir):
    return W.assemble_documents(view(spark, sf_dir, "page_texts"))


def _bundle(spark, sf_dir):
    """A written bundle, read back: structures, mapping, schemas and records by direction, and a comparison."""
    names = {"single_paper_structures": "structures", "direction_mapping": "assignments", "direction_records": "memberships"}
    parts = {part: view(spark, sf_dir, name) for part, name in names.items()}
    directions = parts["direction_mapping"].select("direction_id").distinct()
    parts["direction_schemas"] = directions.select("direction_id", F.array(F.lit("x")).alias("fields"))
    parts["cross_direction_comparison"] = directions.where("direction_id < 'D3'")
    at = scratch_dir(spark)
    W.write_bundle(parts, at, "papers", "documents")
    return W.read_bundle(spark, at)


def a11_bundle_manifest(spark, sf_dir):
    """The manifest, beside the rows and the different keys that each part holds."""
    manifest, parts = _bundle(spark, sf_dir)
    there = reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("rows_read"), F.count_distinct("paper_id" if "paper_id" in df.columns else "direction_id").alias("keys")).withColumn("part", F.lit(name)) for name, df in parts.items()])
    return manifest.join(there, "part").select("topic", "pipeline_version", "input_source", "part", "rows", "rows_read", "keys")


def a12_direction_stems(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("D"), F.col("doc_id") % 4).alias("direction_id"), F.concat(F.lit(" a/b: "), "text").alias("direction_name"))
    return W.direction_stems(rows).select("doc_id", "stem")


def a13_table_cells(spark, sf_dir):
    rows = F.array(F.array(F.concat(F.lit("  "), "text"), F.lit(None).cast("string")), F.array(F.lit(" "), F.col("lang")))
    blank = F.array(F.array(F.lit(" "), F.lit(None).cast("string")))
    t = _docs(spark, sf_dir).select("doc_id", W.table_cells(F.when(F.col("doc_id") % 5 == 0, blank).otherwise(rows)).alias("rows")).where("rows is not null")
    return t.select("doc_id", F.array_join(F.flatten("rows"), "|").alias("cells"))


def a14_graph_summary(spark, sf_dir):
    nodes = G.newest(view(spark, sf_dir, "papers"))
    return W.graph_summary(nodes, e12_build_graph(spark, sf_dir)).withColumn("relation_types", F.array_join("relation_types", "|"))


def h1_stage_totals(spark, sf_dir):
    return H.stage_totals(view(spark, sf_dir, "run_records"))


def s1_pending(spark, sf_dir):
    inputs = _docs(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("stem"))
    return S.pending(inputs, view(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("stem")))


def _arrivals(spark, sf_dir, run, parts=3):
    """Documents arrive in a folder by ranges of doc_id, the first of them twice; after each arrival run takes up the
    stream of the folder where it stopped."""
    docs, at = view(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/arriving"
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    place = F.least(F.floor((F.col("doc_id") - low) * parts / (high - low + 1)), F.lit(parts - 1))
    for i in [*range(parts), 0]:
        docs.where(place == i).write.mode("append").parquet(at)
        run(S.as_stream(spark, at, docs.schema, 100_000))


def s1_process_pending(spark, sf_dir):
    """The same items as a stream."""
    at, done = scratch_dir(spark), view(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("stem"))
    item = lambda stream: stream.select("doc_id", F.col("doc_id").cast("string").alias("stem"))
    _arrivals(spark, sf_dir, lambda stream: S.process_pending(item(stream), lambda df: df.select("doc_id", "stem"), f"{at}/done", f"{at}/checkpoint", outputs=done))
    return spark.read.parquet(f"{at}/done").drop("batch")


def s2_ingest_papers(spark, sf_dir):
    """Documents arrive as a stream of files, in several batches; the library after it."""
    at = scratch_dir(spark)
    title = F.trim(F.replace(F.split_part("text", F.lit("."), F.lit(1)), F.lit("\n"), F.lit(" ")))
    empty = spark.createDataFrame([], "paper_id long, title string, source string")
    paper = lambda df: df.select(title.alias("title"), "source", F.col("doc_id").alias("pos"))
    _arrivals(spark, sf_dir, lambda stream: S.ingest_papers(stream, empty, f"{at}/library", f"{at}/checkpoint", paper))
    return S.library_of(spark, f"{at}/library")


_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
_FIRST = f"{_WORDS}[1]"
SQL = {
    "a1_read_openalex": rf"""SELECT CASE WHEN doc_id % 10 > 0 THEN {_FIRST} ELSE '' END AS title, source || '; ' || lang AS authors, md5(CASE WHEN doc_id % 2 = 0 AND text <> '' THEN text ELSE array_to_string({_WORDS}, ' ') END) AS abstract, CASE WHEN doc_id % 3 > 0 THEN '10.1/' || doc_id ELSE '' END AS doi,
 'https://openalex.org/W' || doc_id AS openalex_id, CASE WHEN doc_id % 3 > 0 THEN 'https://doi.org/10.1/' || doc_id ELSE 'https://openalex.org/W' || doc_id END AS url, doc_id % 30 + 1990 AS year, CASE WHEN doc_id % 5 > 0 THEN lang ELSE '' END AS venue, CASE WHEN doc_id % 5 > 0 THEN 'journal' ELSE '' END AS venue_type,
 CASE WHEN doc_id % 4 > 0 THEN doc_id ELSE 0 END AS cited_by_count, array_to_string(list_slice({_WORDS}, 1, 8), '|') AS concepts, 'openalex' AS source, doc_id % 7 > 0 AND doc_id % 2 = 0 AS is_open_access, CASE WHEN doc_id % 7 > 0 THEN 'u' ELSE '' END AS oa_url FROM documents""",
    "a2_inverted_index": f"SELECT doc_id, array_to_string({_WORDS}, ' ') AS abstract FROM documents",
    "a3_read_crossref": f"SELECT md5(CASE WHEN doc_id % 9 > 0 THEN text ELSE '' END) AS title, {_FIRST} || ' ' || lang || '; ' || source AS authors, md5(text) AS abstract, '10.1/' || doc_id AS doi, CASE WHEN doc_id % 2 = 0 THEN 'http://arxiv.org/abs/' || doc_id || 'v2' ELSE 'http://x.org/' || doc_id END AS url, CASE WHEN doc_id % 3 < 2 THEN doc_id % 30 + 1990 ELSE 0 END AS year, 'crossref' AS source, CASE WHEN doc_id % 5 = 0 THEN 'r' || doc_id WHEN doc_id % 2 = 0 THEN doc_id || 'v2' ELSE '' END AS arxiv_id FROM documents",
    "a4_read_arxiv": f"SELECT {_FIRST} AS title, source || ', ' || lang AS authors, md5(text) AS abstract, doc_id || 'v1' AS arxiv_id, 'http://arxiv.org/abs/' || doc_id || 'v1' AS url, year(make_timestamp(doc_id * 864000000000)) AS year, CASE WHEN doc_id % 2 = 0 THEN '10.2/' || doc_id ELSE '' END AS doi, 'arxiv' AS source FROM documents",
    "a5_read_ieee": f"SELECT {_FIRST} AS title, source || '; ' || lang AS authors, md5(text) AS abstract, cast(doc_id AS VARCHAR) AS ieee_id, '' AS doi, '{A.IEEE_PAGE}' || doc_id AS url, doc_id % 30 + 1990 AS year, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS venue, 'ieee' AS source, '{A.IEEE_STAMP}' || doc_id AS pdf_url FROM documents",
    "a6_union_sources": """SELECT s AS source, count(*) AS papers, count(*) FILTER (WHERE s <> 'crossref' OR doc_id % 3 < 2) AS with_year, count(*) FILTER (WHERE s IN ('openalex', 'ieee')) AS with_venue, count(*) FILTER (WHERE s IN ('crossref', 'arxiv')) AS with_arxiv, CASE WHEN s = 'ieee' THEN (SELECT count(*) FROM documents WHERE lang = 'de') ELSE 0 END AS errors
 FROM documents, (SELECT unnest(['openalex', 'crossref', 'arxiv', 'ieee']) AS s) GROUP BY s""",
    "a7_structure_violations": """SELECT lpad(cast(doc_id AS VARCHAR), 9, '0') || '.json' AS file, '' AS paper_id, CASE doc_id % 10 WHEN 0 THEN 'not an object' ELSE 'no paper_id' END AS rule FROM documents WHERE doc_id % 10 < 2
 UNION ALL SELECT lpad(cast(max(doc_id) AS VARCHAR), 9, '0') || '.json', cast(doc_id // 100 AS VARCHAR), 'repeated paper_id' FROM documents WHERE doc_id % 10 = 2 GROUP BY doc_id // 100 HAVING count(*) > 1""",
    "a8_direction_records": "SELECT 'D' || doc_id % 50 AS direction_id, lpad(cast(max(doc_id) AS VARCHAR), 9, '0') || '.json' AS file FROM documents WHERE doc_id % 4 < 3 GROUP BY doc_id % 50",
    "a10_assemble_documents": f"SELECT pdf_id, {SPECS['b1_clean_text'][3]} AS text FROM (SELECT conv_id AS pdf_id, string_agg(chr(10) || '==================== 第 ' || (turn + 1) || ' 页 ====================' || chr(10) || coalesce(text, ''), '' ORDER BY turn) AS x FROM conversations GROUP BY conv_id)",
    "a9_pdf_inventory": "SELECT DISTINCT coalesce(source, 'none') || '_' || coalesce(lang, 'none') AS stem, true AS filled FROM documents",
    "a11_bundle_manifest": with_views("""dir_ AS (SELECT DISTINCT direction_id FROM assignments),
part_ AS (SELECT 'single_paper_structures' AS part, count(*) AS rows, count(DISTINCT paper_id) AS keys FROM structures UNION ALL SELECT 'direction_mapping', count(*), count(DISTINCT paper_id) FROM assignments UNION ALL SELECT 'direction_records', count(*), count(DISTINCT paper_id) FROM memberships
 UNION ALL SELECT 'direction_schemas', count(*), count(*) FROM dir_ UNION ALL SELECT 'cross_direction_comparison', count(*), count(*) FROM dir_ WHERE direction_id < 'D3')
--- SELECT 'papers' AS topic, 'v2_direction_adaptive' AS pipeline_version, 'documents' AS input_source, part, rows, rows AS rows_read, keys FROM part_""", "structures", "memberships"),
    "a12_direction_stems": f"SELECT doc_id, {SPECS['b3_safe_stem'][3]} AS stem FROM (SELECT doc_id, 'D' || doc_id % 4 || '_' || ' a/b: ' || text AS x FROM documents)",
    "a13_table_cells": "SELECT doc_id, trim(text) || '||' || '|' || lang AS cells FROM documents WHERE doc_id % 5 > 0",
    "a14_graph_summary": "SELECT (SELECT least(50, count(*)) FROM documents) AS nodes, count(*) AS edges, array_to_string(list_sort(list(DISTINCT type)), '|') AS relation_types FROM (" + E_SQL["e12_build_graph"] + ")",
    "h1_stage_totals": with_views("SELECT stage, count(*) AS runs, count(*) FILTER (WHERE status = 'error') AS errors, CAST(round(sum(CAST(coalesce(elapsed_seconds, 0) AS DECIMAL(28, 9))), 3) AS DOUBLE) AS elapsed_seconds FROM run_records GROUP BY ROLLUP (stage)", "run_records"),
    "s1_pending": "SELECT doc_id, cast(doc_id AS VARCHAR) AS stem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "s1_process_pending": "SELECT doc_id, cast(doc_id AS VARCHAR) AS stem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "s2_ingest_papers": with_views("SELECT row_number() OVER (ORDER BY pos) AS paper_id, title, source FROM (SELECT title, min(paper_id) AS pos, arg_min(p.authors, paper_id) AS source FROM papers p GROUP BY title)", "papers"),
}
QUERIES = {k: f for k, f in globals().items() if k[0] in "ahs" and k[1:2].isdigit()}
