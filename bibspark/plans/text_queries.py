"""Queries over the text rules: each applied to every document (or page address), whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .fixtures import view, with_views

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_INLINE = r"regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^ | $', '', 'g')"


def _names() -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.TERM_NAMES.items()) + "}"


def _first_each(words: str, n: int) -> str:
    """The first n words without those that repeat an earlier one in another case, joined by blanks."""
    return f"(SELECT coalesce(string_agg(w, ' ' ORDER BY i), '') FROM (SELECT arg_min(w, i) AS w, min(i) AS i FROM (SELECT unnest(l) AS w, unnest(range(len(l))) AS i FROM (SELECT {words} AS l)) GROUP BY lower(w) ORDER BY 2 LIMIT {n}))"


#: name: (view, input SQL in both engines, rule, the rule in DuckDB SQL over x)
SPECS = {
    "b1_clean_text": ("documents", "replace(text, '. ', chr(13) || chr(10) || chr(10) || chr(13) || '  ')", T.clean_text, _TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(x, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")),
    "b2_clean_inline": ("documents", "CASE WHEN doc_id % 10 = 0 THEN NULL ELSE '  ' || text END", T.clean_inline, _INLINE.format("coalesce(x, '')")),
    "b3_safe_stem": ("documents", "source || ': ' || text || '?'", T.safe_stem, r"""(SELECT CASE WHEN b = '' THEN 'item' ELSE b END FROM (SELECT regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+', '_', 'g'), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 64), '[._]+$', '') AS b)) || '_' || substr(sha1(x), 1, 10)"""),
    "b4_slug": ("documents", "text", T.slug, r"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(x, '[^\p{L}\p{N}_-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'figure')"),
    "b4_file_stem": ("documents", "text", T.file_stem, r"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[^\p{L}\p{N}_-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'pdf')"),
    "b5_title_key": ("documents", "text", T.title_key, "trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))"),
    "b6_ws_lower": ("documents", "text", T.ws_lower, r"regexp_replace(lower(regexp_replace(x, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"),
    "b7_term_key": ("documents", "text", T.term_key, r"regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')"),
    "b8_strip_doi": ("documents", "CASE doc_id % 3 WHEN 0 THEN ' https://doi.org/10.1/' WHEN 1 THEN 'doi:10.1/' ELSE '10.1/https://doi.org/' END || text", T.strip_doi, r"regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^(https://doi\.org/)?(doi:)?', '')"),
    "b9_truncate_dots": ("documents", "text", lambda c: T.truncate(c, 500), r"(SELECT CASE WHEN length(t) <= 500 THEN t ELSE substr(t, 1, 500) || '...' END FROM (SELECT regexp_replace(x, '^\s+|\s+$', '', 'g') AS t))"),
    "b9_truncate_fit": ("documents", "text", lambda c: T.truncate(c, 700, "fit"), f"(SELECT CASE WHEN length(t) <= 700 THEN t ELSE substr(t, 1, 697) || '...' END FROM (SELECT {_INLINE.format('x')} AS t))"),
    "b9_truncate_ellipsis": ("documents", "text", lambda c: T.truncate(c, 86, "ellipsis"), rf"(SELECT CASE WHEN length(t) <= 86 THEN t ELSE regexp_replace(substr(t, 1, 85), '\s+$', '') || '…' END FROM (SELECT {_INLINE.format('x')} AS t))"),
    "b9_truncate_label": ("documents", "text", lambda c: T.truncate(c, 54, "label"), "CASE WHEN length(x) <= 54 THEN x ELSE substr(x, 1, 51) || '...' END"),
    "b10_head_tail": ("documents", "text", lambda c: T.head_tail(c, 1000), f"CASE WHEN length(x) <= 1000 THEN x ELSE substr(x, 1, 500) || '{T.CUT_MARK}' || right(x, 500) END"),
    "b11_clean_query": ("documents", "'Title: (' || text || ') AND NOT venue :x'", T.clean_query, _first_each(r"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(x, '(?i)\b(title|venue|abstract|document title|publication title)\s*:\s*', ' ', 'g'), '(?i)\b(AND|OR|NOT)\b', ' ', 'g'), '[()"'']', ' ', 'g'), '\s+'), lambda q: q <> '')""", 22)),
    "b12_portable_path": ("papers", "CASE paper_id % 6 WHEN 0 THEN replace(pdf_path, '/', chr(92)) WHEN 1 THEN '/a/library' ELSE pdf_path END", T.portable_path, r"""(SELECT CASE WHEN x IS NULL OR r = '' THEN NULL WHEN list_contains(p, 'library') THEN nullif(array_to_string(p[len(p) - list_position(list_reverse(p), 'library') + 2:], '/'), '')
      WHEN list_contains(p, 'pdfs') THEN array_to_string(p[len(p) - list_position(list_reverse(p), 'pdfs') + 1:], '/') WHEN len(p) = 1 AND lower(p[1]) LIKE '%.pdf' THEN 'pdfs/' || p[1] ELSE r END
      FROM (SELECT trim(x) AS r, list_filter(string_split(replace(trim(x), chr(92), '/'), '/'), lambda q: q <> '') AS p))"""),
    "b13_pretty_term": ("documents", "CASE doc_id % 5 WHEN 0 THEN 'pumping_cycle' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'MSE_vs_oracle ' ELSE 'figure8_' || text END", T.pretty_term, f"""(SELECT CASE WHEN lower(t) IN ('', 'unknown', 'not_applicable', 'not applicable') THEN '' ELSE coalesce({_names()}[t], {_INLINE.format("replace(replace(replace(t, 'figure_8', 'figure-8'), 'figure8', 'figure-8'), '_', ' ')")}) END FROM (SELECT {_INLINE.format('x')} AS t))"""),
    "b14_parse_score": ("documents", "text", T.parse_score, r"greatest(0.0, least(10.0, coalesce(try_cast(regexp_extract(x, '\d+(?:\.\d+)?') AS DOUBLE), 5.0)))"),
    "b15_parse_figure_number": ("documents", "CASE doc_id % 4 WHEN 0 THEN '00' || cast(doc_id AS STRING) || 'B' WHEN 1 THEN ' x' || substr('IVXLCDM', cast(1 + doc_id % 7 AS INT), 1) || 'iv ' WHEN 2 THEN 'S 1' || lang ELSE '' END", T.parse_figure_number, r"""(SELECT CASE WHEN t = '' THEN NULL WHEN regexp_full_match(t, '\d+[A-Za-z]?') THEN regexp_replace(regexp_extract(t, '^(\d+)', 1), '^0+(\d)', '\1') || lower(regexp_extract(t, '([A-Za-z]?)$', 1))
      WHEN regexp_full_match(t, '[IVXLCDMivxlcdm]+[A-Za-z]?') THEN (SELECT cast(CAST(sum(CASE WHEN v < coalesce(nx, 0) THEN -v ELSE v END) AS BIGINT) AS VARCHAR) FROM (SELECT v, lead(v) OVER (ORDER BY i) AS nx FROM (SELECT i, MAP {'I': 1, 'V': 5, 'X': 10, 'L': 50, 'C': 100, 'D': 500, 'M': 1000}[substr(upper(g), i::INT, 1)] AS v FROM (SELECT regexp_extract(t, '^([IVXLCDMivxlcdm]+)', 1) AS g), range(1, 20) r(i) WHERE i <= length(g))))
        || lower(regexp_extract(t, '^[IVXLCDMivxlcdm]+([A-Za-z]?)$', 1)) ELSE lower(regexp_replace(t, '\s+', '', 'g')) END FROM (SELECT trim(x) AS t))"""),
    "b16_contains_tokens": ("documents", "text", lambda c: F.array_join(T.contains_tokens(c, F.lit("Δx(t)")), " "), "(SELECT array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda q: list_position(l, q[1]) = q[2]), lambda q: q[1]), ' ') FROM (SELECT list_concat(regexp_extract_all(x, '" + T.TOKEN + "'), ['Δx(t)']) AS l))"),
}


def _query(spec: tuple):
    name, source, rule, _ = spec

    def run(spark, sf_dir):
        key = "paper_id" if name == "papers" else "doc_id"
        return view(spark, sf_dir, name).select(F.col(key).alias("id"), F.expr(source).alias("x")).select("id", rule(F.col("x")).alias("value"))

    return run


def clean_corpus_counts(spark, sf_dir):
    """Rows that each rule changes, over all documents."""
    docs = view(spark, sf_dir, "documents")
    return T.clean_corpus(docs, {"text": "clean_text", "lang": "ws_lower", "key": ("text", T.title_key), "query": ("text", T.clean_query)})[1]


QUERIES = {k: _query(v) for k, v in SPECS.items()} | {"b_clean_corpus": clean_corpus_counts}


def _oracle(spec: tuple) -> str:
    name, source, _, sql = spec
    key = "paper_id" if name == "papers" else "doc_id"
    return with_views(f"SELECT id, {sql} AS value FROM (SELECT {key} AS id, {source} AS x FROM {name})", *([name] if name == "papers" else []))


SQL = {k: _oracle(v) for k, v in SPECS.items()} | {
    "b_clean_corpus": f"""SELECT unnest(['text', 'lang', 'key', 'query']) AS rule, unnest([count(*) FILTER (WHERE {SPECS['b1_clean_text'][3]} <> x), count(*) FILTER (WHERE lower(lang) <> lang), count(*) FILTER (WHERE {SPECS['b5_title_key'][3]} <> x), count(*) FILTER (WHERE {SPECS['b11_clean_query'][3]} <> x)]) AS changed FROM (SELECT text AS x, lang FROM documents)"""
}
