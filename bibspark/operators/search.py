"""Federated search over works tables: plans, retrieval, merging, scoring and ranking for many topics in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_query, ws_lower
from ..scratch import materialize
from .library import Index, dense_number, search_text, tokenised

#: Synonyms of field terms.
GLOSSARY = {
    "SCUC": ["Security Constrained Unit Commitment", "security-constrained unit commitment", "SCUC"],
    "UC": ["Unit Commitment", "unit commitment", "UC"],
    "并行计算": ["parallel computing", "GPU acceleration", "distributed computing", "high-performance computing", "HPC"],
    "Benders分解": ["Benders decomposition", "Benders' decomposition", "L-shaped method"],
    "电力系统": ["power system", "electrical grid", "power grid", "electricity system"],
    "优化": ["optimization", "mathematical programming", "mixed-integer programming", "MILP"],
}
#: Fixed values: (words of which all must occur, query tried next).
REWRITES = [
    (["scuc", "benders"], "SCUC Benders decomposition"),
    (["security constrained unit commitment", "benders"], "security constrained unit commitment Benders decomposition"),
    (["unit commitment", "benders"], "unit commitment Benders decomposition"),
    (["parallel", "scuc"], "SCUC parallel computing"),
    (["parallel", "scuc"], "unit commitment parallel computing"),
    (["parallel", "unit commitment"], "SCUC parallel computing"),
    (["parallel", "unit commitment"], "unit commitment parallel computing"),
]
SUFFIXES = ("", " optimization methods", " survey review")
FIRST_TOP, MERGED_TOP, FOLLOWUP_FROM = 12, 18, 6
#: Characters by which a glossary term is met.
HEAD = 4
#: Sources with a collection of their own; all others are searched in the last one.
SOURCES = ("openalex", "ieee", "arxiv")


def normalize_plan(queries: DataFrame, max_q: int | None = 6) -> DataFrame:
    """Per round, the first max_q queries (None: all) that aren't blank; query trimmed, source lower-case, openalex by default."""
    q = queries.withColumn("query", F.trim("query")).withColumn("source", F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("openalex"))).where("query <> ''")
    if max_q is None:
        return q
    return q.withColumn("r", F.row_number().over(Window.partitionBy("round").orderBy("q_pos"))).where(F.col("r") <= max_q).drop("r")


def fallback_plan(topics: DataFrame, n: int = 3) -> DataFrame:
    """(topic_id, q_pos, query, source): the topic itself, then with each suffix, at most three."""
    made = F.slice(F.array(*[F.concat(F.col("topic"), F.lit(s)) for s in SUFFIXES]), 1, min(len(SUFFIXES), n))
    return topics.select("topic_id", F.posexplode(made).alias("q_pos", "query"), F.lit("openalex").alias("source"))


def glossary(spark, entries: dict[str, list[str]] = GLOSSARY) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in entries.items()], "term string, synonyms array<string>")


def expand_terms(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(q_id, query, synonyms): synonyms of every glossary term that the query holds, each once, sorted; none, an empty list.

    A term is met by its first HEAD characters (all of a shorter one) among the stretches of that length of the query, and
    only then looked for as a whole, so glossaries of any size join by key.
    """
    heads = terms.where("term <> ''").withColumn("head", F.substring("term", 1, HEAD))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("query") - n + 1, F.lit(1))), lambda i: F.substring(F.col("query"), i, F.lit(n)))
    stretches = queries.select("q_id", "query", F.explode(F.array_distinct(F.flatten(F.array(*[at(n) for n in range(1, HEAD + 1)])))).alias("head"))
    met = stretches.join(heads, "head").where(F.contains(F.col("query"), F.col("term"))).select("q_id", "synonyms")
    found = met.groupBy("q_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("synonyms")))).alias("synonyms"))
    return queries.select("q_id", "query").join(found, "q_id", "left").select("q_id", "query", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"))


def rules(spark, entries: list = REWRITES) -> DataFrame:
    return spark.createDataFrame([(i + 1, w, r) for i, (w, r) in enumerate(entries)], "rule int, needs array<string>, rewrite string")


def rewrite_attempts(queries: DataFrame, rule_table: DataFrame) -> DataFrame:
    """(q_id, attempt, query): the cleaned query, then the rewrites whose words it holds; blanks and repeats left out."""
    clean = queries.select("q_id", clean_query(F.col("query")).alias("clean"))
    hit = clean.join(F.broadcast(rule_table), F.forall("needs", lambda w: F.contains(F.lower("clean"), w)), "inner").select("q_id", F.col("rule"), F.col("rewrite").alias("query"))
    every = clean.select("q_id", F.lit(0).alias("rule"), F.col("clean").alias("query")).unionByName(hit).where("query <> ''")
    first = every.groupBy("q_id", "query").agg(F.min("rule").alias("rule"))
    return first.withColumn("attempt", F.row_number().over(Window.partitionBy("q_id").orderBy("rule"))).select("q_id", "attempt", "query")


def routed(source: Column) -> Column:
    """The collection that a source is searched in: its own, or arXiv's for an unknown one."""
    return F.when(source.isin(*SOURCES), source).otherwise(SOURCES[-1])


def retrieve(attempts: DataFrame, works: DataFrame | Index, per_query: int = 8, min_year: int | None = None) -> DataFrame:
    """(q_id, paper_id, used_query, score, hit_pos): the hits of the first attempt that has any, at most per_query.

    All attempts of all queries are scored in one job; a window keeps each query's first successful one. If attempts have
    a source, each is searched among the works of the collection it is routed to. works may be `tokenised` before, or a
    stored index, of the works of min_year if that is asked for.
    """
    stored = isinstance(works, Index)
    if min_year is not None and not stored:
        works = works.where(F.col("year") >= min_year)
    keyed = attempts.select("q_id", "attempt", F.col("query").alias("used_query"), F.struct("q_id", "attempt").alias("k"), *([routed(F.col("source")).alias("corpus")] if "source" in attempts.columns else []))
    if "source" in attempts.columns and not stored and "corpus" not in works.columns:
        works = works.withColumn("corpus", F.col("source"))
    hits = search_text(works, keyed.select(F.col("k").alias("q_id"), F.col("used_query").alias("query"), *([c for c in keyed.columns if c == "corpus"])), per_query)
    hits = hits.select(F.col("q_id.q_id").alias("q_id"), F.col("q_id.attempt").alias("attempt"), "paper_id", "score", "hit_pos")
    first = hits.withColumn("first", F.min("attempt").over(Window.partitionBy("q_id"))).where("attempt = first").drop("first")
    return first.join(keyed.select("q_id", "attempt", "used_query"), ["q_id", "attempt"]).select("q_id", "paper_id", "used_query", "score", "hit_pos")


def stamped(hits: DataFrame, plan: DataFrame) -> DataFrame:
    """hits (q_id, ...) with what was asked: search_query, search_source, search_venue_hint and search_author_hint of the
    planned query. Hints are told, never filtered by."""
    hint = lambda c: F.coalesce(F.col(c), F.lit("")).alias(f"search_{c}_hint")
    return hits.join(plan.select("q_id", F.col("query").alias("search_query"), F.col("source").alias("search_source"), hint("venue"), hint("author")), "q_id")


def paper_key(doi: Column, arxiv_id: Column, ieee_id: Column, title: Column) -> Column:
    """What makes two hits the same paper: DOI, else arXiv id, else IEEE id, else the title in lower case. Empty ids are
    missing ones."""
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(there(doi), F.concat(F.lit("doi:"), F.lower(doi))).when(there(arxiv_id), F.concat(F.lit("arxiv:"), arxiv_id)).when(there(ieee_id), F.concat(F.lit("ieee:"), ieee_id)).otherwise(F.concat(F.lit("title:"), ws_lower(title)))


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", paper_key(F.col("doi"), F.col("arxiv_id"), F.col("ieee_id"), F.col("title")))


def dedupe_first(hits: DataFrame, by: tuple[str, ...] = ("round",)) -> DataFrame:
    """The first hit of each key within a round, by query position, then hit position."""
    w = Window.partitionBy(*by, "key").orderBy("q_pos", "hit_pos")
    return hits.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def diagnostics(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(q_id, result_count, error) of every planned query, before hits are merged. hits has q_id and error (null for a
    paper); an error reply counts as one result."""
    counts = hits.groupBy("q_id").agg(F.count("*").alias("result_count"), F.max("error").alias("error"))
    return queries.select("q_id").join(counts, "q_id", "left").select("q_id", F.coalesce("result_count", F.lit(0)).alias("result_count"), "error")


def merge_rounds(first: DataFrame, second: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Both rounds, a row for each key: at the place of its first occurrence, with the values of its last. Each has key
    and pos."""
    values = [c for c in first.columns if c not in ("key", "pos", *by)]
    both = first.withColumn("o", F.struct(F.lit(1), "pos")).unionByName(second.withColumn("o", F.struct(F.lit(2), "pos")))
    out = both.groupBy(*by, "key").agg(F.min("o").alias("place"), F.max_by(F.struct(*values), "o").alias("v")).select(*by, "key", "place", "v.*")
    if not by:
        return dense_number(out, "place", "n").withColumn("pos", F.col("n") - 1).drop("place", "n")
    return out.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("place")) - 1).drop("place")


def score_join(cands: DataFrame, judged: DataFrame, top_k: int = FIRST_TOP, by: tuple[str, ...] = ()) -> DataFrame:
    """The first top_k candidates (by pos) with score and verdict. judged has id (text: the candidate's number from 0, by
    the same keys), score, verdict, arrays, and j_pos; the last judgement of an id wins, and ids that aren't whole numbers
    are ignored. Without a judgement the score is 5 and the verdict medium; scores are clamped to 0..10."""
    w = Window.partitionBy(*by).orderBy("pos") if by else Window.orderBy("pos")
    top = (cands if by else cands.orderBy("pos").limit(top_k)).withColumn("n", F.row_number().over(w) - 1).where(F.col("n") < top_k)
    last = judged.withColumn("n", F.col("id").try_cast("int")).where("n is not null").groupBy(*by, "n").agg(F.max_by(F.struct("score", "verdict", "aspects", "followups"), "j_pos").alias("j"))
    j = top.join(last, [*by, "n"], "left")
    none = F.array().cast("array<string>")
    return j.select(
        *top.columns,
        F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce("j.score", F.lit(5.0)))).alias("relevance_score"),
        F.coalesce("j.verdict", F.lit("medium")).alias("relevance_verdict"),
        F.coalesce("j.aspects", none).alias("matched_aspects"),
        F.coalesce("j.followups", none).alias("followup_terms"),
    ).drop("n")


def final_rank(scored: DataFrame, n: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """The n best by score; equal scores keep their order."""
    order = [F.desc("relevance_score"), F.asc("pos")]
    if not by:
        return scored.orderBy(*order).limit(n)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def followup_queries(scored: DataFrame, n: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., q_pos, query): followup terms of the six best, in order, blanks left out; the first n."""
    best = final_rank(scored, FOLLOWUP_FROM, by)
    terms = best.select(*by, "relevance_score", "pos", F.posexplode("followup_terms").alias("i", "query")).where("trim(query) <> ''")
    w = Window.partitionBy(*by).orderBy(F.desc("relevance_score"), "pos", "i") if by else Window.orderBy(F.desc("relevance_score"), "pos", "i")
    return terms.withColumn("q_pos", F.row_number().over(w) - 1).where(F.col("q_pos") < n).select(*by, "q_pos", "query")


def round_summary(topics: DataFrame, papers: DataFrame) -> DataFrame:
    """(topic_id, round1, round2, error): papers found per round; a topic without any in the first round is an error.
    papers has topic_id and round."""
    found = papers.groupBy("topic_id").agg(F.count_if(F.col("round") == 1).alias("round1"), F.count_if(F.col("round") == 2).alias("round2"))
    out = topics.select("topic_id").join(found, "topic_id", "left").fillna(0, ["round1", "round2"])
    return out.withColumn("error", F.when(F.col("round1") == 0, "no papers found")).withColumn("round2", F.when(F.col("round1") == 0, 0).otherwise(F.col("round2")))


def _hits(plan: DataFrame, works: DataFrame, tokens: DataFrame | Index, rule_table: DataFrame, per_query: int) -> DataFrame:
    keyed = plan.withColumn("q_id", F.struct("topic_id", "q_pos"))
    attempts = materialize(rewrite_attempts(keyed.select("q_id", "query"), rule_table), "attempts")
    found = retrieve(attempts, tokens, per_query)
    hits = found.select(F.col("q_id.topic_id").alias("topic_id"), F.col("q_id.q_pos").alias("q_pos"), "paper_id", "hit_pos")
    full = with_key(hits.join(works.select("paper_id", "title", "doi", "arxiv_id", "ieee_id"), "paper_id"))
    once = dedupe_first(full, ("topic_id",))
    return materialize(once.withColumn("pos", F.row_number().over(Window.partitionBy("topic_id").orderBy("q_pos", "hit_pos")) - 1).select("topic_id", "key", "pos", "paper_id", "title"), "hits")


def search_corpus(topics: DataFrame, works: DataFrame, judged: DataFrame, rule_table: DataFrame, n: int = 10, per_query: int = 8, index: Index | None = None) -> tuple[DataFrame, DataFrame]:
    """The two-round search of many topics: ranked papers (topic_id, rank, paper_id, relevance_score), and the summary.

    judged has paper_id, score, verdict, followups: judgements of papers, used in both rounds. Round 1 runs the fallback
    plan of each topic, round 2 the followup terms of its best papers; rounds are merged, scored again and ranked. Papers
    are tokenised once, and each round's hits written once. A topic without hits gives no papers and an error row in
    the summary.
    """
    j = judged.select("paper_id", "score", "verdict", "followups")

    def scored(cands: DataFrame, top: int) -> DataFrame:
        w = Window.partitionBy("topic_id").orderBy("pos")
        first = cands.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top).drop("n").join(j, "paper_id", "left")
        return first.withColumn("relevance_score", F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce("score", F.lit(5.0))))).withColumn("followup_terms", F.coalesce("followups", F.array().cast("array<string>")))

    tokens = index or materialize(tokenised(works), "tokens")
    one = _hits(fallback_plan(topics), works, tokens, rule_table, per_query)
    two = _hits(followup_queries(scored(one, FIRST_TOP), 4, ("topic_id",)), works, tokens, rule_table, per_query)
    merged = merge_rounds(one, two, ("topic_id",))
    ranked = final_rank(scored(merged, MERGED_TOP), n, ("topic_id",)).select("topic_id", "rank", "paper_id", "relevance_score")
    summary = round_summary(topics, one.select("topic_id", F.lit(1).alias("round")).unionByName(two.select("topic_id", F.lit(2).alias("round"))))
    return ranked, summary
