"""Readers of scholarly metadata dumps and of record folders, each as one normalised table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPENALEX = (
    "id string, title string, doi string, abstract string, publication_year int, cited_by_count bigint, authorships array<struct<author:struct<display_name:string>>>, "
    "primary_location struct<source:struct<display_name:string,type:string>>, concepts array<struct<display_name:string>>, open_access struct<is_oa:boolean,oa_url:string>, "
    "abstract_inverted_index map<string,array<int>>, referenced_works array<string>"
)
CROSSREF = "title array<string>, author array<struct<given:string,family:string>>, abstract string, DOI string, URL string, `published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>, relation struct<arxiv:struct<url:string>>"
ARXIV = "title string, authors array<struct<name:string>>, summary string, entry_id string, published timestamp, doi string"
IEEE = "title string, authors struct<authors:array<struct<name:string>>>, abstract string, article_number string, articleNumber string, doi string, year int, publication_title string, publicationTitle string"
IEEE_PAGE, IEEE_STAMP = "https://ieeexplore.ieee.org/document/", "https://ieeexplore.ieee.org/stamp/stamp.jsp?tp=&arnumber="


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def abstract_from_inverted_index(index: Column) -> Column:
    """The words of an inverted index in order of position; words at one position in alphabetical order."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(placed), lambda s: s["w"]), " "), F.lit(""))


def openalex_works(raw: DataFrame) -> DataFrame:
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    concepts = F.filter(F.transform("concepts", lambda c: c["display_name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return raw.select(
        _text("title").alias("title"),
        _text(F.array_join(names, "; ")).alias("authors"),
        F.coalesce(F.nullif("abstract", F.lit("")), abstract_from_inverted_index(F.col("abstract_inverted_index"))).alias("abstract"),
        F.regexp_replace(_text("doi"), "^https://doi\\.org/", "").alias("doi"),
        _text("id").alias("openalex_id"),
        F.coalesce(F.nullif("doi", F.lit("")), F.nullif("id", F.lit("")), F.lit("")).alias("url"),
        F.col("publication_year").alias("year"),
        _text("primary_location.source.display_name").alias("venue"),
        _text("primary_location.source.type").alias("venue_type"),
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"),
        F.coalesce(F.slice(concepts, 1, 8), F.array().cast("array<string>")).alias("concepts"),
        F.lit("openalex").alias("source"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("is_open_access"),
        _text("open_access.oa_url").alias("oa_url"),
        "referenced_works",
    )


def crossref_works(raw: DataFrame) -> DataFrame:
    """Year is the print date's, else the online date's, else 0; the arXiv id is the last part of a related or own
    arxiv.org address."""
    authors = F.transform("author", lambda a: F.trim(F.concat(F.coalesce(a["given"], F.lit("")), F.lit(" "), F.coalesce(a["family"], F.lit("")))))
    year = lambda c: F.get(F.get(F.col(f"`{c}`.`date-parts`"), F.lit(0)), F.lit(0))
    related = F.when(F.contains(_text("relation.arxiv.url"), F.lit("arxiv.org/abs")), F.element_at(F.split("relation.arxiv.url", "/"), -1))
    own = F.get(F.filter(F.split(_text("URL"), r"\s+"), lambda u: F.contains(u, F.lit("arxiv.org/abs"))), F.lit(0))
    return raw.select(
        _text(F.get("title", F.lit(0))).alias("title"),
        _text(F.array_join(authors, "; ")).alias("authors"),
        _text("abstract").alias("abstract"),
        _text("DOI").alias("doi"),
        _text("URL").alias("url"),
        F.coalesce(F.when(F.col("`published-print`").isNotNull(), year("published-print")).otherwise(year("published-online")), F.lit(0)).alias("year"),
        F.lit("crossref").alias("source"),
        F.coalesce(related, F.element_at(F.split(own, "/"), -1), F.lit("")).alias("arxiv_id"),
    )


def arxiv_works(raw: DataFrame) -> DataFrame:
    return raw.select("title", _text(F.array_join(F.transform("authors", lambda a: a["name"]), ", ")).alias("authors"), F.col("summary").alias("abstract"), F.element_at(F.split("entry_id", "/"), -1).alias("arxiv_id"), F.col("entry_id").alias("url"), F.year("published").alias("year"), _text("doi").alias("doi"), F.lit("arxiv").alias("source"))


def ieee_works(raw: DataFrame) -> DataFrame:
    """Search hits (article_number, publication_title) and single documents (articleNumber, publicationTitle) alike."""
    number = _text(F.coalesce("article_number", "articleNumber"))
    names = F.transform("authors.authors", lambda a: F.coalesce(a["name"], F.lit("")))
    return raw.select(
        _text("title").alias("title"), _text(F.array_join(names, "; ")).alias("authors"), _text("abstract").alias("abstract"), number.alias("ieee_id"), _text("doi").alias("doi"), F.concat(F.lit(IEEE_PAGE), number).alias("url"), "year",
        _text(F.coalesce("publication_title", "publicationTitle")).alias("venue"), F.lit("ieee").alias("source"), F.concat(F.lit(IEEE_STAMP), number).alias("pdf_url"),
    )


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_openalex(spark: SparkSession, path: str) -> DataFrame:
    return openalex_works(_json(spark, path, OPENALEX))


def read_crossref(spark: SparkSession, path: str) -> DataFrame:
    return crossref_works(_json(spark, path, CROSSREF))


def read_arxiv(spark: SparkSession, path: str) -> DataFrame:
    return arxiv_works(_json(spark, path, ARXIV))


def read_ieee(spark: SparkSession, path: str) -> DataFrame:
    return ieee_works(_json(spark, path, IEEE))


def union_sources(*works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(papers, errors): all sources with all columns, missing ones null and year 0 as null; replies with an error apart."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), works)
    if "error" not in every.columns:
        every = every.withColumn("error", F.lit(None).cast("string"))
    papers = every.where("error is null").drop("error").withColumn("year", F.nullif("year", F.lit(0)))
    return papers, every.where("error is not null").select("source", "error")


def structure_violations(rows: DataFrame) -> DataFrame:
    """(file, paper_id, rule) of raw structure files (file, value): not an object, no paper_id, an id given twice."""
    parsed = rows.select("file", F.try_parse_json("value").alias("v"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    ids = parsed.select("file", is_object.alias("ok"), F.trim(F.coalesce(F.try_variant_get("v", "$.paper_id", "string"), F.lit(""))).alias("paper_id"))
    bad = ids.where("not ok").select("file", "paper_id", F.lit("not an object").alias("rule")).unionByName(ids.where("ok and paper_id = ''").select("file", "paper_id", F.lit("no paper_id").alias("rule")))
    twice = ids.where("ok and paper_id <> ''").groupBy("paper_id").agg(F.count("*").alias("n"), F.max("file").alias("file")).where("n > 1")
    return bad.unionByName(twice.select("file", "paper_id", F.lit("repeated paper_id").alias("rule")))


def read_structures(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All *.json paper structures of a folder, in order of lower-case file name; an error if any breaks a rule."""
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    bad = structure_violations(raw).take(5)
    if bad:
        raise ValueError("; ".join(f"{r.file}: {r.rule} {r.paper_id}" for r in bad))
    return raw.select("file", F.from_json("value", schema).alias("s")).select("file", "s.*").orderBy(F.lower("file"))


def direction_records(raw: DataFrame) -> DataFrame:
    """Records keyed by direction: raw (file, v VARIANT). A blank id is taken from the first record's own direction_id (if
    it has a paper object) or its meta; files without any id are dropped; the last file of an id wins."""
    get = lambda path: F.nullif(F.trim(F.coalesce(F.try_variant_get("v", path, "string"), F.lit(""))), F.lit(""))
    kind = lambda path: F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("OBJECT")), F.lit(False))
    inner = F.when(kind("$.records[0].paper"), get("$.records[0].direction_id")).when(kind("$.records[0].meta"), get("$.records[0].meta.direction_id"))
    keyed = raw.withColumn("direction_id", F.coalesce(get("$.direction_id"), inner)).where("direction_id is not null")
    return keyed.withColumn("r", F.row_number().over(Window.partitionBy("direction_id").orderBy(F.desc("file")))).where("r = 1").select("direction_id", "file", F.col("v").alias("record"))


def read_direction_records(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path)
    return direction_records(raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.parse_json("value").alias("v")))


def pdf_inventory(spark: SparkSession, path: str, names: list[str] | None = None, max_papers: int | None = None, suffix: str = ".pdf") -> DataFrame:
    """(path, name, length): files with the suffix below a folder, each path once, sorted by name; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    if names is not None:
        files = files.where(F.col("name").isin(names))
    files = files.dropDuplicates(["path"]).orderBy("name", "path")
    return files.limit(max_papers) if max_papers else files
