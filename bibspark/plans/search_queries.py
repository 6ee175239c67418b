"""Queries of the federated search, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.library import TOKEN
from ..scratch import materialize
from .fixtures import paper_index, view, with_views
from .library_queries import BM25
from .text_queries import SPECS

_CLEAN = SPECS["b11_clean_query"][3]
_KEY = r"CASE WHEN doi <> '' THEN 'doi:' || lower(doi) WHEN arxiv_id <> '' THEN 'arxiv:' || arxiv_id WHEN ieee_id <> '' THEN 'ieee:' || ieee_id ELSE 'title:' || regexp_replace(lower(regexp_replace(title, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') END"


def _plan(spark, sf_dir, n=None):
    return S.normalize_plan(view(spark, sf_dir, "plan_queries"), n)


def d1_normalize_plan(spark, sf_dir):
    return _plan(spark, sf_dir, 6).select("round", "q_pos", "query", "source", "venue", "author")


def _topics(spark, sf_dir):
    """Every benchmark passage's first two words are a topic."""
    words = F.split("text", " ")
    return view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic_id"), F.concat_ws(" ", words[0], words[1]).alias("topic"))


def d2_fallback_plan(spark, sf_dir):
    return S.fallback_plan(_topics(spark, sf_dir))


def _glossary(spark, sf_dir):
    """Each benchmark passage's third word has its next two as synonyms, beside the fixed glossary."""
    w = F.split("text", " ")
    own = view(spark, sf_dir, "benchmark").select(w[2].alias("term"), F.array(w[3], w[4]).alias("synonyms"))
    return S.glossary(spark).unionByName(own)


def d3_expand_terms(spark, sf_dir):
    q = view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.concat(F.col("text"), F.lit(" SCUC")).alias("query"))
    return S.expand_terms(q, _glossary(spark, sf_dir)).withColumn("synonyms", F.array_join("synonyms", "|"))


def d4_rewrite_attempts(spark, sf_dir):
    q = view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.concat(F.when(F.col("item_id") % 3 == 0, "SCUC (Benders) ").when(F.col("item_id") % 3 == 1, "title: Parallel Unit Commitment BENDERS ").otherwise(""), F.split("text", " ")[0]).alias("query"))
    return S.rewrite_attempts(q, S.rules(spark))


def _asked(spark, sf_dir):
    """The plan by q_id; some queries name a source that the library has no collection of."""
    source = F.when(F.col("q_pos") % 7 == 3, "elsewhere").otherwise(F.col("source"))
    return _plan(spark, sf_dir).select("round", F.col("q_pos").alias("q_id"), "query", source.alias("source"), "venue", "author")


def _attempts(spark, sf_dir):
    """A query's four words, then its first two, then its first."""
    plan = _asked(spark, sf_dir).select("q_id", "source", F.split("query", " ").alias("w"))
    return plan.select("q_id", "source", F.posexplode(F.array(F.concat_ws(" ", "w"), F.concat_ws(" ", F.slice("w", 1, 2)), F.col("w")[0])).alias("attempt", "query"))


def _retrieved(spark, sf_dir):
    return S.stamped(S.retrieve(_attempts(spark, sf_dir), paper_index(spark, sf_dir, since=2005), 8), _asked(spark, sf_dir))


STAMPS = ("search_query", "search_source", "search_venue_hint", "search_author_hint")


def d5_retrieve(spark, sf_dir):
    return _retrieved(spark, sf_dir).withColumn("score", F.round("score", 4))


def d6_paper_key(spark, sf_dir):
    return S.with_key(view(spark, sf_dir, "papers")).select("paper_id", "key")


def _round_hits(spark, sf_dir):
    hits = _retrieved(spark, sf_dir).join(view(spark, sf_dir, "papers"), "paper_id").join(_plan(spark, sf_dir).select("round", F.col("q_pos").alias("q_id")), "q_id")
    return S.with_key(hits.withColumn("q_pos", F.col("q_id"))).select("round", "q_id", "q_pos", "hit_pos", "key", "paper_id", "title", *STAMPS)


def d7_dedupe_first(spark, sf_dir):
    return S.dedupe_first(_round_hits(spark, sf_dir)).select("round", "key", "q_pos", "hit_pos", "paper_id", *STAMPS)


def d8_diagnostics(spark, sf_dir):
    plan = _plan(spark, sf_dir).select(F.col("q_pos").alias("q_id"), "source")
    hits = _round_hits(spark, sf_dir).select("q_id", F.lit(None).cast("string").alias("error"))
    errors = plan.where("source = 'ieee'").select("q_id", F.lit("IEEE request failed").alias("error"))
    return S.diagnostics(hits.unionByName(errors), plan)


def _rounds(spark, sf_dir):
    # both rounds, and each count and sample of their numbering, read what was found once
    once = materialize(S.dedupe_first(_round_hits(spark, sf_dir)).withColumn("pos", F.col("q_pos") * 100 + F.col("hit_pos")).select("round", "key", "pos", "paper_id", "title"), "once")
    return once.where("round = 1").drop("round"), once.where("round = 2").drop("round")


def _merged(spark, sf_dir):
    return S.merge_rounds(*_rounds(spark, sf_dir))


def d9_merge_rounds(spark, sf_dir):
    return _merged(spark, sf_dir).select("key", "pos", "paper_id")


def _judged(spark, sf_dir):
    """Judgements by candidate number; some numbers aren't whole."""
    j = view(spark, sf_dir, "judgements")
    return j.select(F.when(F.col("paper_id") % 11 == 5, F.concat("paper_id", F.lit("x"))).otherwise((F.col("paper_id") % 40).cast("string")).alias("id"), "score", "verdict", F.array(F.col("verdict")).alias("aspects"), F.when(F.col("paper_id") % 2 == 0, F.array(F.concat(F.lit("term "), "paper_id"), F.lit(" "))).alias("followups"), F.col("paper_id").alias("j_pos"))


def _scored(spark, sf_dir):
    return S.score_join(_merged(spark, sf_dir), _judged(spark, sf_dir), S.MERGED_TOP)


def d10_score_join(spark, sf_dir):
    return _scored(spark, sf_dir).select("key", "pos", "paper_id", "relevance_score", "relevance_verdict", F.array_join("matched_aspects", "|").alias("matched_aspects"), F.array_join("followup_terms", "|").alias("followup_terms"))


def d11_final_rank(spark, sf_dir):
    return S.final_rank(_scored(spark, sf_dir)).select("paper_id", "relevance_score", "pos")


def d12_followup_queries(spark, sf_dir):
    return S.followup_queries(_scored(spark, sf_dir))


def d13_round_summary(spark, sf_dir):
    """Topics are the planned queries; papers those found for them."""
    plan = _plan(spark, sf_dir).select(F.col("q_pos").alias("topic_id"))
    return S.round_summary(plan, _round_hits(spark, sf_dir).select(F.col("q_id").alias("topic_id"), "round"))


def _corpus_judged(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.array(F.split("text", " ")[0], F.lit("")).alias("followups"))
    return view(spark, sf_dir, "judgements").join(docs, "paper_id")


def d14_search_corpus(spark, sf_dir):
    return S.search_corpus(_topics(spark, sf_dir), view(spark, sf_dir, "papers"), _corpus_judged(spark, sf_dir), S.rules(spark), index=paper_index(spark, sf_dir))[0]


def d14_search_summary(spark, sf_dir):
    return S.search_corpus(_topics(spark, sf_dir), view(spark, sf_dir, "papers"), _corpus_judged(spark, sf_dir), S.rules(spark), index=paper_index(spark, sf_dir))[1]


_PLAN = "plan_ AS (SELECT round, q_pos, trim(query) AS query, coalesce(nullif(lower(trim(source)), ''), 'openalex') AS source, venue, author FROM plan_queries WHERE trim(query) <> '')"
_RETRIEVE = _PLAN + rf""",
ask_ AS (SELECT round, q_pos, query, CASE WHEN q_pos % 7 = 3 THEN 'elsewhere' ELSE source END AS source, coalesce(venue, '') AS venue, coalesce(author, '') AS author FROM plan_),
att_ AS (SELECT q_pos, attempt, CASE WHEN source IN ('openalex', 'ieee') THEN source ELSE 'arxiv' END AS corpus, array_to_string(list_slice(w, 1, CASE attempt WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END), ' ') AS query FROM (SELECT q_pos, source, string_split(query, ' ') AS w FROM ask_), (SELECT unnest([0, 1, 2]) AS attempt)),
toks_ AS (SELECT paper_id, source AS corpus, regexp_extract_all(lower(title || ' ' || abstract || ' ' || authors), '{TOKEN}') AS w FROM papers WHERE year >= 2005),
size_ AS (SELECT corpus, count(*) AS n, avg(len(w)) AS mean FROM toks_ GROUP BY corpus),
post_ AS (SELECT corpus, paper_id, len(w) AS length, term, count(*) AS tf FROM (SELECT corpus, paper_id, w, unnest(w) AS term FROM toks_) GROUP BY ALL),
df_ AS (SELECT corpus, term, count(*) AS df FROM post_ GROUP BY ALL),
asked_ AS (SELECT DISTINCT q_pos, attempt, corpus, unnest(regexp_extract_all(lower(query), '{TOKEN}')) AS term FROM att_),
hits_ AS (SELECT q_pos, attempt, p.paper_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS c
  FROM asked_ a JOIN post_ p USING (corpus, term) JOIN df_ USING (corpus, term) JOIN size_ USING (corpus) GROUP BY ALL),
found_ AS (SELECT h.q_pos, h.attempt, paper_id, score, row_number() OVER (PARTITION BY h.q_pos, h.attempt ORDER BY score DESC, paper_id DESC) AS hit_pos FROM hits_ h JOIN (SELECT q_pos, attempt, count(*) AS n FROM asked_ GROUP BY ALL) q ON q.q_pos = h.q_pos AND q.attempt = h.attempt AND n = c),
ret_ AS (SELECT g.q_pos AS q_id, paper_id, a.query AS used_query, score, hit_pos, k.query AS search_query, k.source AS search_source, venue AS search_venue_hint, author AS search_author_hint
  FROM (SELECT *, min(attempt) OVER (PARTITION BY q_pos) AS f FROM found_ WHERE hit_pos <= 8) g JOIN att_ a ON a.q_pos = g.q_pos AND a.attempt = g.attempt JOIN ask_ k ON k.q_pos = g.q_pos WHERE g.attempt = f)"""
_HITS = _RETRIEVE + f""",
hit_ AS (SELECT pl.round, r.q_id, r.q_id AS q_pos, hit_pos, {_KEY} AS key, r.paper_id, title, {', '.join(STAMPS)} FROM ret_ r JOIN papers p ON p.paper_id = r.paper_id JOIN plan_ pl ON pl.q_pos = r.q_id),
once_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY round, key ORDER BY q_pos, hit_pos) AS r FROM hit_) WHERE r = 1)"""
_MERGE = _HITS + """,
merge_ AS (SELECT key, row_number() OVER (ORDER BY o) - 1 AS pos, paper_id FROM (SELECT key, min((round, q_pos * 100 + hit_pos)) AS o, arg_max(paper_id, (round, q_pos * 100 + hit_pos)) AS paper_id FROM once_ GROUP BY key))"""
_SCORE = _MERGE + """,
j_ AS (SELECT n, arg_max((score, verdict, f), paper_id) AS j FROM (SELECT paper_id, paper_id % 40 AS n, score, verdict, CASE WHEN paper_id % 2 = 0 THEN 'term ' || cast(paper_id AS VARCHAR) || '| ' END AS f FROM judgements WHERE paper_id % 11 <> 5) GROUP BY n),
score_ AS (SELECT key, pos, paper_id, greatest(0.0, least(10.0, coalesce(j[1], 5.0))) AS relevance_score, coalesce(j[2], 'medium') AS relevance_verdict, coalesce(j[2], '') AS matched_aspects, coalesce(j[3], '') AS followup_terms FROM merge_ LEFT JOIN j_ ON n = pos WHERE pos < 18)"""
_W = ("papers", "plan_queries", "judgements")
_REWRITES = ", ".join("({}, {}, '{}')".format(i + 1, "[" + ", ".join(f"'{w}'" for w in needs) + "]", q) for i, (needs, q) in enumerate(S.REWRITES))
_SUFFIX = ", ".join(f"'{s}'" for s in S.SUFFIXES)
_GLOSSARY = ", ".join("('{}', [{}])".format(k, ", ".join("'" + v.replace("'", "''") + "'" for v in vs)) for k, vs in S.GLOSSARY.items())


def _round(name: str, source: str) -> str:
    """Attempts, hits and deduplicated candidates of a plan table (topic_id, q_pos, query), as CTEs named after name."""
    return f""",
clean_{name} AS (SELECT topic_id, q_pos, {_CLEAN.replace('(x,', '(query,')} AS clean FROM {source}),
every_{name} AS (SELECT topic_id, q_pos, 0 AS rule, clean AS query FROM clean_{name} WHERE clean <> '' UNION ALL SELECT topic_id, q_pos, rule, rewrite FROM clean_{name}, rules_ WHERE len(list_filter(needs, lambda q: NOT contains(lower(clean), q))) = 0),
att_{name} AS (SELECT topic_id, q_pos, query, row_number() OVER (PARTITION BY topic_id, q_pos ORDER BY min(rule)) AS attempt FROM every_{name} GROUP BY topic_id, q_pos, query),
asking_{name} AS (SELECT (topic_id, q_pos, attempt) AS q_id, query FROM att_{name}),{BM25.replace('toks_', f'toks_{name}').replace('post_', f'post_{name}').replace('asked_', f'asked_{name}').replace('asking_', f'asking_{name}').replace('hits_', f'hits_{name}').replace('found_', f'found_{name}')},
first_{name} AS (SELECT * FROM (SELECT q_id[1] AS topic_id, q_id[2] AS q_pos, q_id[3] AS attempt, min(q_id[3]) OVER (PARTITION BY q_id[1], q_id[2]) AS f, paper_id, hit_pos FROM found_{name} WHERE hit_pos <= 8) WHERE attempt = f),
cand_{name} AS (SELECT topic_id, key, paper_id, row_number() OVER (PARTITION BY topic_id ORDER BY q_pos, hit_pos) - 1 AS pos FROM (SELECT f.*, {_KEY} AS key, row_number() OVER (PARTITION BY topic_id, {_KEY} ORDER BY q_pos, hit_pos) AS r FROM first_{name} f JOIN papers USING (paper_id)) WHERE r = 1)"""


_CORPUS = (
    f"""topics_ AS (SELECT item_id AS topic_id, string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] AS topic FROM benchmark), rules_ AS (SELECT * FROM (VALUES {_REWRITES}) AS t(rule, needs, rewrite)),
fall_ AS (SELECT topic_id, i - 1 AS q_pos, topic || [{_SUFFIX}][i] AS query FROM topics_, (SELECT unnest([1, 2, 3]) AS i)),
jud_ AS (SELECT paper_id, score, string_split(text, ' ')[1] AS followup FROM judgements JOIN documents ON doc_id = paper_id)"""
    + _round("a", "fall_")
    + """,
sa_ AS (SELECT c.*, greatest(0.0, least(10.0, coalesce(score, 5.0))) AS s, followup FROM cand_a c LEFT JOIN jud_ USING (paper_id) WHERE pos < 12),
fu_ AS (SELECT topic_id, q_pos, query FROM (SELECT topic_id, followup AS query, row_number() OVER (PARTITION BY topic_id ORDER BY s DESC, pos) - 1 AS q_pos FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY s DESC, pos) AS r FROM sa_) WHERE r <= 6 AND trim(followup) <> '') WHERE q_pos < 4)"""
    + _round("b", "fu_")
    + """,
mer_ AS (SELECT topic_id, key, min(o) AS place, arg_max(paper_id, o) AS paper_id FROM (SELECT *, (1, pos) AS o FROM cand_a UNION ALL SELECT *, (2, pos) FROM cand_b) GROUP BY topic_id, key),
num_ AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY place) - 1 AS pos FROM mer_)"""
)
SQL = {
    "d1_normalize_plan": with_views(_PLAN + "--- SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY round ORDER BY q_pos) AS r FROM plan_) WHERE r <= 6", "plan_queries"),
    "d2_fallback_plan": f"SELECT item_id AS topic_id, i - 1 AS q_pos, string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] || [{_SUFFIX}][i] AS query, 'openalex' AS source FROM benchmark, (SELECT unnest([1, 2, 3]) AS i)",
    "d3_expand_terms": f"WITH g_ AS (SELECT * FROM (VALUES {_GLOSSARY}) AS t(term, synonyms) UNION ALL SELECT string_split(text, ' ')[3], [string_split(text, ' ')[4], string_split(text, ' ')[5]] FROM benchmark) SELECT item_id AS q_id, text || ' SCUC' AS query, array_to_string(list_sort(list_distinct(flatten(list(synonyms)))), '|') AS synonyms FROM benchmark JOIN g_ ON contains(text || ' SCUC', term) GROUP BY item_id, text",
    "d4_rewrite_attempts": f"""WITH q_ AS (SELECT item_id AS q_id, CASE item_id % 3 WHEN 0 THEN 'SCUC (Benders) ' WHEN 1 THEN 'title: Parallel Unit Commitment BENDERS ' ELSE '' END || string_split(text, ' ')[1] AS x FROM benchmark), c_ AS (SELECT q_id, {_CLEAN} AS clean FROM q_), rules_ AS (SELECT * FROM (VALUES {_REWRITES}) AS t(rule, needs, rewrite)),
e_ AS (SELECT q_id, 0 AS rule, clean AS query FROM c_ WHERE clean <> '' UNION ALL SELECT q_id, rule, rewrite FROM c_, rules_ WHERE len(list_filter(needs, lambda q: NOT contains(lower(clean), q))) = 0)
SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY min(rule)) AS attempt, query FROM e_ GROUP BY q_id, query""",
    "d5_retrieve": with_views(_RETRIEVE + "--- SELECT * REPLACE (round(score, 4) AS score) FROM ret_", *_W),
    "d6_paper_key": with_views(f"SELECT paper_id, {_KEY} AS key FROM papers", "papers"),
    "d7_dedupe_first": with_views(_HITS + f"--- SELECT round, key, q_pos, hit_pos, paper_id, {', '.join(STAMPS)} FROM once_", *_W),
    "d8_diagnostics": with_views(_HITS + "--- SELECT p.q_pos AS q_id, (SELECT count(*) FROM hit_ h WHERE h.q_id = p.q_pos) + CASE WHEN source = 'ieee' THEN 1 ELSE 0 END AS result_count, CASE WHEN source = 'ieee' THEN 'IEEE request failed' END AS error FROM plan_ p", *_W),
    "d9_merge_rounds": with_views(_MERGE + "--- SELECT * FROM merge_", *_W),
    "d10_score_join": with_views(_SCORE + "--- SELECT * FROM score_", *_W),
    "d11_final_rank": with_views(_SCORE + "--- SELECT paper_id, relevance_score, pos FROM score_ ORDER BY relevance_score DESC, pos LIMIT 10", *_W),
    "d12_followup_queries": with_views(_SCORE + "--- SELECT q_pos, query FROM (SELECT row_number() OVER (ORDER BY relevance_score DESC, pos) - 1 AS q_pos, split_part(followup_terms, '|', 1) AS query FROM (SELECT * FROM score_ ORDER BY relevance_score DESC, pos LIMIT 6) WHERE followup_terms <> '') WHERE q_pos < 4", *_W),
    "d13_round_summary": with_views(_HITS + "--- SELECT q_pos AS topic_id, r1 AS round1, CASE WHEN r1 = 0 THEN 0 ELSE r2 END AS round2, CASE WHEN r1 = 0 THEN 'no papers found' END AS error FROM (SELECT q_pos, (SELECT count(*) FROM hit_ h WHERE h.q_id = p.q_pos AND h.round = 1) AS r1, (SELECT count(*) FROM hit_ h WHERE h.q_id = p.q_pos AND h.round = 2) AS r2 FROM plan_ p)", *_W),
    "d14_search_corpus": with_views(_CORPUS + "--- SELECT topic_id, rank, paper_id, s AS relevance_score FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY s DESC, pos) AS rank FROM (SELECT n.*, greatest(0.0, least(10.0, coalesce(score, 5.0))) AS s FROM num_ n LEFT JOIN jud_ USING (paper_id) WHERE pos < 18)) WHERE rank <= 10", "papers", "judgements"),
    "d14_search_summary": with_views(_CORPUS + "--- SELECT topic_id, r1 AS round1, CASE WHEN r1 = 0 THEN 0 ELSE r2 END AS round2, CASE WHEN r1 = 0 THEN 'no papers found' END AS error FROM (SELECT topic_id, (SELECT count(*) FROM cand_a c WHERE c.topic_id = t.topic_id) AS r1, (SELECT count(*) FROM cand_b c WHERE c.topic_id = t.topic_id) AS r2 FROM topics_ t)", "papers", "judgements"),
}
QUERIES = {f.__name__: f for f in (d1_normalize_plan, d2_fallback_plan, d3_expand_terms, d4_rewrite_attempts, d5_retrieve, d6_paper_key, d7_dedupe_first, d8_diagnostics, d9_merge_rounds, d10_score_join, d11_final_rank, d12_followup_queries, d13_round_summary, d14_search_corpus, d14_search_summary)}
