"""Queries of the page-geometry operators, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rects as R
from ..operators import pages as P
from ..scratch import materialize
from .fixtures import view, with_views

_SIDES = ", ".join(f"{{0}}.{s} AS {{1}}{s}" for s in R.SIDES)


def _v(spark, sf_dir, name):
    return view(spark, sf_dir, name)


def _flat(df, column: str, prefix: str = ""):
    return [F.col(f"{column}.{s}").alias(f"{prefix}{s}") for s in R.SIDES]


def _dims(spark, sf_dir, once=None):
    """Pages of lines and of regions, all of one size."""
    regions = _v(spark, sf_dir, "page_regions").select("pdf_id", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return _v(spark, sf_dir, "page_dims").union(regions).distinct()


def g1_rects(spark, sf_dir):
    """Rectangle arithmetic on each region and its page neighbour."""
    r = _v(spark, sf_dir, "page_regions")
    a, b = r.select("pdf_id", "page", "region_id", R.of().alias("a")), r.select("pdf_id", "page", F.col("region_id").alias("other"), R.of().alias("b"))
    j = a.join(b, ["pdf_id", "page"]).where("region_id < other")
    x, y = F.col("a"), F.col("b")
    return j.select("region_id", "other", F.round(R.area(R.union(x, y)), 4).alias("union_area"), F.round(R.horizontal_overlap(x, y), 6).alias("overlap_x"), F.round(R.vertical_overlap(x, y), 6).alias("overlap_y"), R.horizontal_gap(x, y).alias("gap_x"), R.vertical_gap(x, y).alias("gap_y"), F.round(R.covered(x, y), 6).alias("covered"), F.round(R.area(R.clip(x, R.rect(0, 0, 612, 792))), 4).alias("clipped"))


def g2_valid_regions(spark, sf_dir):
    v = P.valid_regions(_v(spark, sf_dir, "page_regions"), _dims(spark, sf_dir))
    return v.select("region_id", *_flat(v, "rect"))


def g3_columns_by_anchor(spark, sf_dir):
    return P.columns_by_anchor(_v(spark, sf_dir, "page_lines"), _v(spark, sf_dir, "page_dims")).select("pdf_id", "page", F.round("gutter_x0", 4).alias("gutter_x0"), F.round("gutter_x1", 4).alias("gutter_x1"))


def g4_columns_by_gap(spark, sf_dir):
    g = P.columns_by_gap(_v(spark, sf_dir, "page_words"), _v(spark, sf_dir, "page_dims"))
    return g.select("pdf_id", "page", *[F.round(c, 4).alias(c) for c in ("gutter_x0", "gutter_x1", "left_x0", "left_x1", "right_x0", "right_x1")])


class _Once(dict):
    """Tables of a query that several steps read: each is written once, when it is first asked for."""

    def __init__(self, spark, sf_dir):
        super().__init__()
        self.where = spark, sf_dir

    def __call__(self, make):
        if make not in self:
            self[make] = materialize(make(*self.where, self), make.__name__.strip("_"))
        return self[make]


def _sizes(spark, sf_dir, once):
    return once(_dims) if once else _dims(spark, sf_dir)


def _layout(spark, sf_dir, once=None):
    return P.layouts(_v(spark, sf_dir, "page_lines"), _v(spark, sf_dir, "page_words"), _sizes(spark, sf_dir, once))


def _lines(spark, sf_dir, once=None):
    lines = _v(spark, sf_dir, "page_lines").withColumn("rect", R.of()).drop(*R.SIDES)
    return P.assign_column(lines, once(_layout) if once else _layout(spark, sf_dir))


def g5_assign_column(spark, sf_dir):
    return _lines(spark, sf_dir).select("line_id", "column_id")


def g6_caption_starts(spark, sf_dir):
    return P.caption_starts(_lines(spark, sf_dir)).select("line_id", "kind", "number_token")


def _captions(spark, sf_dir, once):
    return P.captions(once(_lines))


def g7_captions(spark, sf_dir):
    c = _captions(spark, sf_dir, _Once(spark, sf_dir))
    return c.select("pdf_id", "page", "column_id", "kind", *_flat(c, "rect"), F.md5("text").alias("text_md5"), "number_token", "lines")


def _tables(spark, sf_dir, once=None):
    regions = _v(spark, sf_dir, "page_regions").withColumn("rows", F.array(F.array(F.lit(None).cast("string"), "cell")))
    return P.table_regions(regions, _sizes(spark, sf_dir, once))


def g8_figure_primitives(spark, sf_dir):
    return P.figure_primitives(_v(spark, sf_dir, "page_regions"), _tables(spark, sf_dir), _dims(spark, sf_dir)).select("region_id", "kind")


def g9_table_regions(spark, sf_dir):
    return _tables(spark, sf_dir).select("region_id")


def _figures(spark, sf_dir, once):
    prims = P.figure_primitives(_v(spark, sf_dir, "page_regions"), once(_tables), once(_dims)).withColumn("source", F.col("kind"))
    return P.merge_primitives(P.assign_column(prims, once(_layout)))


def g10_merge_primitives(spark, sf_dir):
    f = _figures(spark, sf_dir, _Once(spark, sf_dir))
    return f.select("pdf_id", "page", "region_id", "column_id", *_flat(f, "rect"), F.array_join("sources", "|").alias("sources"))


def _candidates(spark, sf_dir, once):
    tables = P.assign_column(once(_tables), once(_layout)).select("pdf_id", "page", "region_id", F.lit("table").alias("kind"), "rect", "column_id")
    return _figures(spark, sf_dir, once).select("pdf_id", "page", "region_id", F.lit("figure").alias("kind"), "rect", "column_id").unionByName(tables)


def _scores(spark, sf_dir, once):
    return P.caption_region_scores(once(_captions), once(_candidates), once(_dims))


def g11_caption_region_scores(spark, sf_dir):
    """Every line against every valid region of its page: lines of even number stand for figure captions."""
    caps = _lines(spark, sf_dir).select("pdf_id", "page", F.col("line_id").alias("caption_id"), F.when(F.col("line_id") % 2 == 0, "figure").otherwise("table").alias("kind"), "rect", "column_id")
    return P.caption_region_scores(caps, _regions(spark, sf_dir), _dims(spark, sf_dir)).select("caption_id", "region_id", F.round("score", 6).alias("score"))


def _assigned(spark, sf_dir, once):
    return P.assign_regions(once(_captions), once(_candidates), _scores(spark, sf_dir, once))


def g12_assign_regions(spark, sf_dir):
    return _assigned(spark, sf_dir, _Once(spark, sf_dir)).select("pdf_id", "page", "caption_id", F.array_join("region_ids", "|").alias("region_ids"), F.round("confidence", 6).alias("confidence"))


def _labelled(spark, sf_dir, once=None):
    """Caption starts as captions, for the jobs that follow."""
    return P.caption_starts(once(_lines) if once else _lines(spark, sf_dir)).withColumnRenamed("line_id", "caption_id")


def g13_caption_ids(spark, sf_dir):
    return P.caption_ids(_labelled(spark, sf_dir)).select("caption_id", "label_id")


def g14_fallback_band(spark, sf_dir):
    once = _Once(spark, sf_dir)
    b = P.fallback_band(_labelled(spark, sf_dir, once), once(_layout))
    return b.select("caption_id", *[F.round(f"content.{s}", 4).alias(s) for s in R.SIDES])


def _shown(out):
    return out.select("pdf_id", "page", "label_id", "kind", "status", "confidence", "needs_review", *_flat(out, "content_bbox", "content_"), *_flat(out, "crop_bbox", "crop_"))


def _numbered(spark, sf_dir, once):
    return P.caption_ids(once(_captions).drop("text"))


def g15_items(spark, sf_dir):
    once = _Once(spark, sf_dir)
    caps = once(_numbered)
    return _shown(P.items(caps, once(_assigned), P.fallback_band(caps, once(_layout)), once(_dims)))


def _starts(spark, sf_dir, once):
    return P.caption_ids(_labelled(spark, sf_dir, once)).drop("text")


def _regions(spark, sf_dir, once=None):
    v = P.valid_regions(_v(spark, sf_dir, "page_regions"), _dims(spark, sf_dir))
    return v.select("pdf_id", "page", "region_id", F.when(F.col("kind") == "table", "table").otherwise("figure").alias("kind"), "rect", F.lit("full").alias("column_id"))


def _given(spark, sf_dir, once):
    """An assignment made without a walk: each caption start has its best region, which others may have too."""
    scores = P.caption_region_scores(once(_starts), once(_regions), _dims(spark, sf_dir)).withColumn("score", F.round("score", 6))
    best = scores.groupBy("pdf_id", "page", "caption_id", "kind").agg(F.max_by(F.struct("region_id", "score"), F.struct("score", "region_id")).alias("b"))
    named = best.select("pdf_id", "page", "caption_id", "kind", "b.region_id", "b.score").join(once(_regions).select("pdf_id", "page", "region_id", "rect"), ["pdf_id", "page", "region_id"])
    return named.select("pdf_id", "page", "caption_id", "kind", F.array("region_id").alias("region_ids"), "rect", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / 115)).alias("confidence"))


def g15_items_given(spark, sf_dir):
    """Items of a given assignment; captions of every third number have none."""
    once = _Once(spark, sf_dir)
    caps = once(_starts)
    out = _shown(P.items(caps, once(_given).where("caption_id % 3 > 0"), P.fallback_band(caps, once(_layout)), _dims(spark, sf_dir)))
    return out.select("pdf_id", "page", "label_id", "kind", "status", "confidence", "needs_review", *[F.round(c, 2).alias(c) for c in out.columns if c.startswith(("content_", "crop_"))])


def g16_orphans(spark, sf_dir):
    once = _Once(spark, sf_dir)
    kinds = once(_captions).select("pdf_id", "page", "caption_id", "kind")
    o = P.orphans(once(_candidates), once(_assigned).join(kinds, ["pdf_id", "page", "caption_id"]))
    return o.select("pdf_id", "page", "kind", "region_id")


def g16_orphans_given(spark, sf_dir):
    once = _Once(spark, sf_dir)
    return P.orphans(once(_regions), once(_given)).select("pdf_id", "page", "kind", "region_id")


def g17_page_summary(spark, sf_dir):
    once, regions = _Once(spark, sf_dir), P.valid_regions(_v(spark, sf_dir, "page_regions"), _dims(spark, sf_dir))
    return P.page_summary(once(_layout), _labelled(spark, sf_dir, once), regions.where("kind <> 'table'"), _tables(spark, sf_dir))


def g18_item_order(spark, sf_dir):
    caps = P.caption_ids(_labelled(spark, sf_dir))
    n, suffix = P.item_order(F.col("label_id"))
    return caps.select("caption_id", "label_id", n.alias("n"), suffix.alias("suffix")).orderBy("n", "suffix")


_AREA = "greatest(0, least({0}x1, {1}x1) - greatest({0}x0, {1}x0)) * greatest(0, least({0}y1, {1}y1) - greatest({0}y0, {1}y0))"
_ALL_DIMS = "dims_ AS (SELECT pdf_id, page, width, height FROM page_dims UNION SELECT pdf_id, page, 612.0::DOUBLE, 792.0::DOUBLE FROM page_regions)"
_VALID = _ALL_DIMS + """,
clip_ AS (SELECT r.pdf_id, r.page, region_id, kind, cell, greatest(x0 - 4, 0) AS x0, greatest(y0 - 4, 0) AS y0, least(x1 + 4, width) AS x1, least(y1 + 4, height) AS y1, width * height AS pa FROM page_regions r JOIN dims_ d ON r.pdf_id = d.pdf_id AND r.page = d.page),
valid_ AS (SELECT * FROM clip_ WHERE x1 - x0 >= 80 AND y1 - y0 >= 60 AND (x1 - x0) * (y1 - y0) BETWEEN 0.01 * pa AND 0.7 * pa),
tab_ AS (SELECT * FROM valid_ WHERE kind = 'table' AND trim(cell) <> '')"""
_RUNS = """cand_ AS (SELECT pdf_id, page, x0, x1, y0, row_number() OVER (PARTITION BY pdf_id, page ORDER BY x0, x1, y0) AS r FROM page_lines WHERE length(text) >= 12 AND x1 - x0 BETWEEN 612 * 0.18 AND 612 * 0.62),
walk_ AS (SELECT pdf_id, page, r, x0, x1, 1 AS g, 1 AS n, x0 AS s FROM cand_ WHERE r = 1
  UNION ALL SELECT c.pdf_id, c.page, c.r, c.x0, c.x1, CASE WHEN abs(c.x0 - w.s / w.n) <= 24 THEN w.g ELSE w.g + 1 END, CASE WHEN abs(c.x0 - w.s / w.n) <= 24 THEN w.n + 1 ELSE 1 END, CASE WHEN abs(c.x0 - w.s / w.n) <= 24 THEN w.s + c.x0 ELSE c.x0 END FROM walk_ w JOIN cand_ c ON c.pdf_id = w.pdf_id AND c.page = w.page AND c.r = w.r + 1),
grp_ AS (SELECT pdf_id, page, g, count(*) AS n, avg(x0) AS mean, list(x1 ORDER BY x1) AS ends, list(x0 ORDER BY x0) AS starts FROM walk_ GROUP BY ALL HAVING count(*) >= 6),
one_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pdf_id, page ORDER BY n DESC, g) AS q FROM grp_) WHERE q = 1),
two_ AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY b.pdf_id, b.page ORDER BY b.n DESC, b.g) AS q FROM grp_ b JOIN one_ a ON a.pdf_id = b.pdf_id AND a.page = b.page AND abs(a.mean - b.mean) >= 612 * 0.18) WHERE q = 1),
edge_ AS (SELECT pdf_id, page, lm, rm, le[len(le) // 2 + 1] AS le, re[len(re) // 2 + 1] AS re FROM (SELECT a.pdf_id, a.page, least(a.mean, b.mean) AS lm, greatest(a.mean, b.mean) AS rm, CASE WHEN a.mean <= b.mean THEN a.ends ELSE b.ends END AS le, CASE WHEN a.mean <= b.mean THEN b.starts ELSE a.starts END AS re FROM one_ a JOIN two_ b ON a.pdf_id = b.pdf_id AND a.page = b.page)),
anchor_ AS (SELECT pdf_id, page, CASE WHEN re - le < 8 THEN (lm + rm) / 2 - greatest(8, 9.18) ELSE (le + re) / 2 - greatest(6, (re - le) / 2) END AS gutter_x0, CASE WHEN re - le < 8 THEN (lm + rm) / 2 + greatest(8, 9.18) ELSE (le + re) / 2 + greatest(6, (re - le) / 2) END AS gutter_x1 FROM edge_)"""
_GAP = """
w_ AS (SELECT w.pdf_id, w.page, x0, x1, width, greatest(0, least(119, floor(greatest(0, least(x0, width)) / width * 120)))::INT AS a, greatest(0, least(119, floor(greatest(0, least(x1, width)) / width * 120)))::INT AS b FROM page_words w JOIN page_dims d ON w.pdf_id = d.pdf_id AND w.page = d.page),
cnt_ AS (SELECT pdf_id, page, unnest(range(a, b + 1)) AS bin FROM w_), occ_ AS (SELECT pdf_id, page, bin, count(*) AS c FROM cnt_ GROUP BY ALL),
grid_ AS (SELECT pdf_id, page, width, words, unnest(range(30, 90)) AS bin FROM (SELECT pdf_id, page, width, count(*) AS words FROM w_ GROUP BY ALL)),
sparse_ AS (SELECT g.*, g.bin - row_number() OVER (PARTITION BY g.pdf_id, g.page ORDER BY g.bin) AS isl FROM grid_ g LEFT JOIN occ_ o ON o.pdf_id = g.pdf_id AND o.page = g.page AND o.bin = g.bin WHERE coalesce(c, 0) <= greatest(1, floor(words / 800))),
run_ AS (SELECT pdf_id, page, width, min(bin) AS s, max(bin) AS e FROM sparse_ GROUP BY pdf_id, page, width, isl),
seg_ AS (SELECT pdf_id, page, width, width * s / 120 AS gutter_x0, width * (e + 1) / 120 AS gutter_x1 FROM (SELECT *, row_number() OVER (PARTITION BY pdf_id, page ORDER BY e - s DESC, s) AS q FROM run_) WHERE q = 1),
gap_ AS (SELECT * FROM (SELECT s.pdf_id, s.page, s.width, gutter_x0, gutter_x1, count(*) FILTER (WHERE x1 <= (gutter_x0 + gutter_x1) / 2) AS nl, count(*) FILTER (WHERE x0 >= (gutter_x0 + gutter_x1) / 2) AS nr, min(x0) FILTER (WHERE x1 <= (gutter_x0 + gutter_x1) / 2) AS left_x0, max(x1) FILTER (WHERE x1 <= (gutter_x0 + gutter_x1) / 2) AS left_x1, min(x0) FILTER (WHERE x0 >= (gutter_x0 + gutter_x1) / 2) AS right_x0, max(x1) FILTER (WHERE x0 >= (gutter_x0 + gutter_x1) / 2) AS right_x1
  FROM seg_ s JOIN w_ w ON w.pdf_id = s.pdf_id AND w.page = s.page GROUP BY ALL) WHERE gutter_x1 - gutter_x0 >= 0.035 * width AND nl >= 25 AND nr >= 25 AND right_x0 - left_x1 >= 0.03 * width)"""
_LAYOUT = _VALID + "," + _RUNS + "," + _GAP + """,
lay_ AS (SELECT d.pdf_id, d.page, d.width, d.height, CASE WHEN a.pdf_id IS NOT NULL OR g.pdf_id IS NOT NULL THEN 'two_column' ELSE 'single' END AS layout_type, coalesce(a.gutter_x0, g.gutter_x0) AS g0, coalesce(a.gutter_x1, g.gutter_x1) AS g1,
  CASE WHEN a.pdf_id IS NOT NULL THEN 0 ELSE g.left_x0 END AS lx0, CASE WHEN a.pdf_id IS NOT NULL THEN a.gutter_x0 ELSE g.left_x1 END AS lx1, CASE WHEN a.pdf_id IS NOT NULL THEN a.gutter_x1 ELSE g.right_x0 END AS rx0, CASE WHEN a.pdf_id IS NOT NULL THEN d.width ELSE g.right_x1 END AS rx1
  FROM dims_ d LEFT JOIN anchor_ a ON a.pdf_id = d.pdf_id AND a.page = d.page LEFT JOIN gap_ g ON g.pdf_id = d.pdf_id AND g.page = d.page),
ov_ AS (SELECT l.*, y.layout_type, y.width, y.height, g0, g1, lx0, lx1, rx0, rx1, CASE WHEN least(x1, lx1) > greatest(x0, lx0) THEN (least(x1, lx1) - greatest(x0, lx0)) / least(x1 - x0, lx1 - lx0) ELSE 0 END AS lo, CASE WHEN least(x1, rx1) > greatest(x0, rx0) THEN (least(x1, rx1) - greatest(x0, rx0)) / least(x1 - x0, rx1 - rx0) ELSE 0 END AS ro FROM page_lines l JOIN lay_ y ON y.pdf_id = l.pdf_id AND y.page = l.page),
line_ AS (SELECT *, CASE WHEN layout_type <> 'two_column' OR x1 - x0 >= 0.82 * width THEN 'full' WHEN x1 <= (g0 + g1) / 2 + 6 AND lo >= greatest(0.28, ro) THEN 'left' WHEN x0 >= (g0 + g1) / 2 - 6 AND ro >= greatest(0.28, lo) THEN 'right' WHEN lo >= 0.55 AND ro < 0.2 THEN 'left' WHEN ro >= 0.55 AND lo < 0.2 THEN 'right' ELSE 'full' END AS column_id FROM ov_),
prev_ AS (SELECT *, lag(y1) OVER q AS py1, lag(x0) OVER q AS px0, lag(x1) OVER q AS px1 FROM line_ WINDOW q AS (PARTITION BY pdf_id, page, column_id ORDER BY y0, x0)),
start_ AS (SELECT *, line_id AS caption_id, CASE WHEN lower(substr(text, 1, 3)) = 'fig' THEN 'figure' ELSE 'table' END AS kind, regexp_extract(text, '^(?:Fig|Figure|FIG|FIGURE|Table|TABLE)\\.?\\s*((?:\\d+|[IVXLCDMivxlcdm]+)(?:[A-Za-z])?)\\b', 1) AS num FROM prev_
  WHERE regexp_matches(text, '^(?:Fig|Figure|FIG|FIGURE|Table|TABLE)\\.?\\s*(?:\\d+|[IVXLCDMivxlcdm]+)(?:[A-Za-z])?\\b') AND NOT coalesce(y0 - py1 < greatest(1.8, font_size * 0.45) AND CASE WHEN least(x1, px1) > greatest(x0, px0) THEN (least(x1, px1) - greatest(x0, px0)) / least(x1 - x0, px1 - px0) ELSE 0 END > 0.6, false)),
tok_ AS (SELECT *, CASE WHEN num = 'IV' THEN '4' ELSE regexp_replace(lower(num), '^0+(\\d)', '\\1') END AS number_token FROM start_),
lab_ AS (SELECT *, base || CASE WHEN r > 1 THEN '_' || r ELSE '' END AS label_id FROM (SELECT *, row_number() OVER (PARTITION BY pdf_id, kind, base ORDER BY page, y0, x0, caption_id) AS r FROM (SELECT *, CASE kind WHEN 'figure' THEN 'fig' ELSE 'tab' END || number_token AS base FROM tok_)))"""
_L = ("page_dims", "page_regions", "page_words")
#: Captions and the lines that follow each, line by line: those that fit join, far ones end it.
_WALKED = """
order_ AS (SELECT *, row_number() OVER (PARTITION BY pdf_id, page, column_id ORDER BY y0, x0, line_id) AS r, regexp_matches(text, '^(?:Fig|Figure|FIG|FIGURE|Table|TABLE)\\.?\\s*(?:\\d+|[IVXLCDMivxlcdm]+)(?:[A-Za-z])?\\b') AS opens FROM line_),
go_ AS (SELECT o.pdf_id, o.page, o.column_id, o.line_id AS caption_id, o.r, o.line_id, o.x0 AS sx0, o.x1 AS sx1, o.font_size AS sf, o.y1 AS ly1, o.font_size AS lf, 1 AS n, true AS took FROM order_ o JOIN tok_ t ON t.line_id = o.line_id
  UNION ALL SELECT pdf_id, page, column_id, caption_id, r, line_id, sx0, sx1, sf, CASE WHEN fits THEN y1 ELSE ly1 END, CASE WHEN fits THEN font_size ELSE lf END, CASE WHEN fits THEN n + 1 ELSE n END, fits
  FROM (SELECT g.pdf_id, g.page, g.column_id, caption_id, o.r, o.line_id, sx0, sx1, sf, ly1, lf, n, o.y1, o.font_size, o.y0 - ly1 AS gap,
    NOT opens AND o.y0 - ly1 <= greatest(5, 1.45 * greatest(sf, lf)) AND abs(o.font_size - sf) <= 1.6 AND (abs(o.x0 - sx0) <= 40 OR (least(o.x1, sx1) > greatest(o.x0, sx0) AND (least(o.x1, sx1) - greatest(o.x0, sx0)) / least(o.x1 - o.x0, sx1 - sx0) >= 0.25)) AS fits
    FROM go_ g JOIN order_ o ON o.pdf_id = g.pdf_id AND o.page = g.page AND o.column_id = g.column_id AND o.r = g.r + 1 WHERE n < 8) WHERE fits OR gap <= greatest(8, 1.8 * sf)),
cap_ AS (SELECT g.pdf_id, g.page, g.column_id, t.kind, min(o.x0) AS x0, min(o.y0) AS y0, max(o.x1) AS x1, max(o.y1) AS y1, md5(string_agg(o.text, ' ' ORDER BY g.n)) AS text_md5, t.number_token, count(*) AS lines
  FROM go_ g JOIN order_ o ON o.line_id = g.line_id JOIN tok_ t ON t.line_id = g.caption_id WHERE took GROUP BY g.pdf_id, g.page, g.column_id, g.caption_id, t.kind, t.number_token)"""
_BAND = """
b_ AS (SELECT c.*, (SELECT max(o.y1) FROM tok_ o WHERE o.pdf_id = c.pdf_id AND o.page = c.page AND o.caption_id <> c.caption_id AND (o.column_id = c.column_id OR o.column_id = 'full' OR c.column_id = 'full') AND o.y1 <= c.y0) AS upper_, (SELECT min(o.y0) FROM tok_ o WHERE o.pdf_id = c.pdf_id AND o.page = c.page AND o.caption_id <> c.caption_id AND (o.column_id = c.column_id OR o.column_id = 'full' OR c.column_id = 'full') AND o.y0 >= c.y1) AS lower_ FROM tok_ c),
 x_ AS (SELECT *, CASE WHEN column_id = 'left' AND layout_type = 'two_column' THEN greatest(8, lx0 - 8) WHEN column_id = 'right' AND layout_type = 'two_column' THEN greatest(8, rx0 - 8) ELSE 8 END AS bx0, CASE WHEN column_id = 'left' AND layout_type = 'two_column' THEN least(width - 8, lx1 + 8) WHEN column_id = 'right' AND layout_type = 'two_column' THEN least(width - 8, rx1 + 8) ELSE width - 8 END AS bx1,
  CASE WHEN kind = 'figure' THEN greatest(greatest(8, greatest(24, y0 - 4) - least(height * 0.4, 260)), coalesce(upper_ + 4, -1e9)) ELSE least(height - 28, y1 + 4) END AS by0, CASE WHEN kind = 'figure' THEN greatest(24, y0 - 4) ELSE least(least(height - 8, least(height - 28, y1 + 4) + least(height * 0.34, 230)), coalesce(lower_ - 4, 1e9)) END AS by1 FROM b_),
 f_ AS (SELECT *, least(by1, height) - greatest(by0, 0) < greatest(72, height * 0.12) AS low FROM x_),
 band_ AS (SELECT caption_id, bx0 AS cx0, CASE WHEN NOT low THEN by0 WHEN kind = 'figure' THEN greatest(8, y0 - 140) ELSE least(height - 44, y1 + 4) END AS cy0, bx1 AS cx1, CASE WHEN NOT low THEN by1 WHEN kind = 'figure' THEN greatest(44, y0 - 4) ELSE least(height - 8, y1 + 140) END AS cy1 FROM f_)"""
#: The best region of each caption start, and where the content of each start should be.
_GIVEN = """
gs_ AS (SELECT c.pdf_id, c.page, c.caption_id, c.kind, c.column_id AS cc, v.region_id, v.x0, v.y0, v.x1, v.y1, abs((v.x0 + v.x1) / 2 - (c.x0 + c.x1) / 2) AS dx, CASE WHEN least(v.x1, c.x1) > greatest(v.x0, c.x0) THEN (least(v.x1, c.x1) - greatest(v.x0, c.x0)) / least(v.x1 - v.x0, c.x1 - c.x0) ELSE 0 END AS ov,
  v.y1 <= c.y0 + 8 AS above, v.y0 >= c.y1 - 8 AS below, c.y0 - v.y1 AS ga, v.y0 - c.y1 AS gb FROM tok_ c JOIN valid_ v ON v.pdf_id = c.pdf_id AND v.page = c.page AND c.kind = CASE WHEN v.kind = 'table' THEN 'table' ELSE 'figure' END),
gt_ AS (SELECT *, CASE WHEN kind = 'figure' THEN CASE WHEN above THEN 100 WHEN below THEN 45 ELSE 25 END ELSE CASE WHEN below THEN 100 WHEN above THEN 45 ELSE 25 END END AS bonus, CASE WHEN kind = 'figure' THEN CASE WHEN above THEN ga WHEN below THEN gb ELSE 0 END ELSE CASE WHEN below THEN gb WHEN above THEN ga ELSE 0 END END AS gap FROM gs_),
gu_ AS (SELECT *, round(bonus + ov * 28 + least((x1 - x0) * (y1 - y0) / (612 * 792), 0.3) * 50 - gap * 0.2 - dx / 612 * 24, 6) AS score FROM gt_ WHERE NOT gap > 792 * CASE WHEN kind = 'figure' THEN 0.52 ELSE 0.4 END AND NOT (cc <> 'full' AND ov < 0.05 AND dx > 612 * 0.22)),
given_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pdf_id, page, caption_id ORDER BY score DESC, region_id DESC) AS q FROM gu_) WHERE q = 1)"""
_CAPS = """
c_ AS (SELECT pdf_id, page, line_id, column_id AS cc, x0 AS cx0, y0 AS cy0, x1 AS cx1, y1 AS cy1, CASE WHEN line_id % 2 = 0 THEN 'figure' ELSE 'table' END AS ck FROM line_),
s_ AS (SELECT c.*, v.region_id, v.x0, v.y0, v.x1, v.y1, abs((x0 + x1) / 2 - (cx0 + cx1) / 2) AS dx, CASE WHEN least(x1, cx1) > greatest(x0, cx0) THEN (least(x1, cx1) - greatest(x0, cx0)) / least(x1 - x0, cx1 - cx0) ELSE 0 END AS ov, y1 <= cy0 + 8 AS above, y0 >= cy1 - 8 AS below FROM c_ c JOIN valid_ v ON v.pdf_id = c.pdf_id AND v.page = c.page AND ck = CASE WHEN v.kind = 'table' THEN 'table' ELSE 'figure' END),
t_ AS (SELECT *, CASE WHEN ck = 'figure' THEN CASE WHEN above THEN 100 WHEN below THEN 45 ELSE 25 END ELSE CASE WHEN below THEN 100 WHEN above THEN 45 ELSE 25 END END AS bonus, CASE WHEN ck = 'figure' THEN CASE WHEN above THEN cy0 - y1 WHEN below THEN y0 - cy1 ELSE 0 END ELSE CASE WHEN below THEN y0 - cy1 WHEN above THEN cy0 - y1 ELSE 0 END END AS gap FROM s_)"""
SQL = {
    "g1_rects": with_views(f"""SELECT a.region_id, b.region_id AS other, round((greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)), 4) AS union_area,
 round(CASE WHEN least(a.x1, b.x1) > greatest(a.x0, b.x0) THEN (least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0) ELSE 0 END, 6) AS overlap_x, round(CASE WHEN least(a.y1, b.y1) > greatest(a.y0, b.y0) THEN (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) ELSE 0 END, 6) AS overlap_y,
 greatest(0, b.x0 - a.x1, a.x0 - b.x1) AS gap_x, greatest(0, b.y0 - a.y1, a.y0 - b.y1) AS gap_y, round({_AREA.format('a.', 'b.')} / ((a.x1 - a.x0) * (a.y1 - a.y0)), 6) AS covered, round((least(a.x1 + 4, 612) - greatest(a.x0 - 4, 0)) * greatest(0, least(a.y1 + 4, 792) - greatest(a.y0 - 4, 0)), 4) AS clipped
FROM page_regions a JOIN page_regions b ON a.pdf_id = b.pdf_id AND a.page = b.page AND a.region_id < b.region_id""", "page_regions"),
    "g2_valid_regions": with_views(_VALID + "--- SELECT region_id, x0, y0, x1, y1 FROM valid_", "page_dims", "page_regions"),
    "g3_columns_by_anchor": "WITH RECURSIVE " + with_views(_RUNS + "--- SELECT pdf_id, page, round(gutter_x0, 4) AS gutter_x0, round(gutter_x1, 4) AS gutter_x1 FROM anchor_", "page_lines")[5:],
    "g4_columns_by_gap": with_views(_GAP + "--- SELECT pdf_id, page, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("gutter_x0", "gutter_x1", "left_x0", "left_x1", "right_x0", "right_x1")) + " FROM gap_", "page_words", "page_dims"),
    "g5_assign_column": "WITH RECURSIVE " + with_views(_LAYOUT + "--- SELECT line_id, column_id FROM line_", *_L)[5:],
    "g6_caption_starts": "WITH RECURSIVE " + with_views(_LAYOUT + "--- SELECT line_id, kind, number_token FROM tok_", *_L)[5:],
    "g8_figure_primitives": with_views(_VALID + f""", once_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pdf_id, page, round(x0, 2), round(y0, 2), round(x1, 2), round(y1, 2) ORDER BY region_id) AS r FROM valid_ WHERE kind = 'image') WHERE r = 1 UNION ALL SELECT *, 1 FROM valid_ WHERE kind = 'vector')
--- SELECT region_id, kind FROM once_ o WHERE coalesce((SELECT max({_AREA.format('o.', 't.')} / ((o.x1 - o.x0) * (o.y1 - o.y0))) FROM tab_ t WHERE t.pdf_id = o.pdf_id AND t.page = o.page), 0) <= CASE kind WHEN 'image' THEN 0.75 ELSE 0.45 END""", "page_dims", "page_regions"),
    "g9_table_regions": with_views(_VALID + "--- SELECT region_id FROM tab_", "page_dims", "page_regions"),
    "g11_caption_region_scores": "WITH RECURSIVE " + with_views(_LAYOUT + "," + _CAPS + "--- SELECT line_id AS caption_id, region_id, round(bonus + ov * 28 + least((x1 - x0) * (y1 - y0) / (612 * 792), 0.3) * 50 - gap * 0.2 - dx / 612 * 24, 6) AS score FROM t_ WHERE NOT gap > 792 * CASE WHEN ck = 'figure' THEN 0.52 ELSE 0.4 END AND NOT (cc <> 'full' AND ov < 0.05 AND dx > 612 * 0.22)", *_L)[5:],
    "g13_caption_ids": "WITH RECURSIVE " + with_views(_LAYOUT + "--- SELECT caption_id, label_id FROM lab_", *_L)[5:],
    "g14_fallback_band": "WITH RECURSIVE " + with_views(_LAYOUT + "," + _BAND + "--- SELECT caption_id, round(cx0, 4) AS x0, round(cy0, 4) AS y0, round(cx1, 4) AS x1, round(cy1, 4) AS y1 FROM band_", *_L)[5:],
    "g7_captions": "WITH RECURSIVE " + with_views(_LAYOUT + "," + _WALKED + "--- SELECT * FROM cap_", *_L)[5:],
    "g15_items_given": "WITH RECURSIVE " + with_views(_LAYOUT + "," + _BAND + "," + _GIVEN + """,
 it_ AS (SELECT l.pdf_id, l.page, l.label_id, l.kind, l.x0, l.y0, l.x1, l.y1, g.caption_id IS NOT NULL AS matched, coalesce(least(1, greatest(0, g.score / 115)), 0) AS conf,
  CASE WHEN g.caption_id IS NULL THEN cx0 ELSE greatest(0, g.x0 - 2) END AS bx0, CASE WHEN g.caption_id IS NULL THEN b.cy0 ELSE greatest(0, g.y0 - 2) END AS by0, CASE WHEN g.caption_id IS NULL THEN cx1 ELSE least(612, g.x1 + 2) END AS bx1, CASE WHEN g.caption_id IS NULL THEN b.cy1 ELSE least(792, g.y1 + 2) END AS by1
  FROM lab_ l JOIN band_ b ON b.caption_id = l.caption_id LEFT JOIN (SELECT * FROM given_ WHERE caption_id % 3 > 0) g ON g.caption_id = l.caption_id)
--- SELECT pdf_id, page, label_id, kind, CASE WHEN matched THEN 'matched' ELSE 'fallback' END AS status, round_even(conf, 3) AS confidence, NOT matched OR conf < 0.6 AS needs_review, round(bx0, 2) AS content_x0, round(by0, 2) AS content_y0, round(bx1, 2) AS content_x1, round(by1, 2) AS content_y1,
 round(greatest(0, least(x0, bx0) - 4), 2) AS crop_x0, round(greatest(0, least(y0, by0) - 4), 2) AS crop_y0, round(least(612, greatest(x1, bx1) + 4), 2) AS crop_x1, round(least(792, greatest(y1, by1) + 4), 2) AS crop_y1 FROM it_""", *_L)[5:],
    "g16_orphans_given": "WITH RECURSIVE " + with_views(_LAYOUT + "," + _GIVEN + "--- SELECT pdf_id, page, CASE WHEN kind = 'table' THEN 'table' ELSE 'figure' END AS kind, region_id FROM valid_ v WHERE NOT EXISTS (SELECT 1 FROM given_ g WHERE g.pdf_id = v.pdf_id AND g.page = v.page AND g.region_id = v.region_id)", *_L)[5:],
    "g17_page_summary": "WITH RECURSIVE " + with_views(_LAYOUT + "--- SELECT pdf_id, page, layout_type, (SELECT count(*) FROM tok_ t WHERE t.pdf_id = y.pdf_id AND t.page = y.page) AS captions, (SELECT count(*) FROM valid_ t WHERE t.pdf_id = y.pdf_id AND t.page = y.page AND kind <> 'table') AS figures, (SELECT count(*) FROM tab_ t WHERE t.pdf_id = y.pdf_id AND t.page = y.page) AS tables FROM lay_ y", *_L)[5:],
    "g18_item_order": "WITH RECURSIVE " + with_views(_LAYOUT + "--- SELECT caption_id, label_id, CAST(regexp_extract(label_id, '^[a-z]+([0-9]+)', 1) AS BIGINT) AS n, regexp_extract(label_id, '^[a-z]+[0-9]+(.*)$', 1) AS suffix FROM lab_", *_L)[5:],
}
QUERIES = {k: f for k, f in globals().items() if k[0] == "g" and k[1:2].isdigit()}
