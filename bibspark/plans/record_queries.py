"""Queries of the nested-record operators, with their DuckDB texts. Nested and JSON inputs are made from the documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.text import truncate
from ..operators import records as R
from ..scratch import materialize
from .fixtures import view, with_views


def _v(spark, sf_dir, name):
    return view(spark, sf_dir, name)


def f1_parse_replies(spark, sf_dir):
    js = F.to_json(F.struct("doc_id", "lang", "text"))
    k = F.col("doc_id") % 5
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), js, F.lit("\n``` ok"))).when(k == 1, F.concat(F.lit("Answer: "), js, F.lit(" thanks"))).when(k == 2, F.concat(F.lit("x "), F.replace(js, F.lit("\\n"), F.lit("\n")))).when(k == 3, F.lit("no answer")).otherwise(F.expr("left(to_json(struct(doc_id, lang, text)), length(to_json(struct(doc_id, lang, text))) - 1)"))
    out = R.parse_replies(_v(spark, sf_dir, "documents").withColumn("reply", reply), "doc_id long, lang string, text string")
    return out.select("doc_id", "status", F.col("record.lang").alias("lang"), F.md5("record.text").alias("text_md5"))


def f1_parse_lists(spark, sf_dir):
    """Replies that are lists: plain, fenced, after which an object comes, never closed, closed by the wrong bracket, and
    with line breaks inside strings."""
    js, k = F.to_json(F.struct("doc_id", "lang", "text")), F.col("doc_id") % 6
    first = F.expr("left(to_json(struct(doc_id, lang, text)), length(to_json(struct(doc_id, lang, text))) - 1)")
    reply = (
        F.when(k == 0, F.concat(F.lit("Answer: ["), js, F.lit(', {"doc_id": -1}] thanks }'))).when(k == 1, F.concat(F.lit("```json\n["), js, F.lit("]\n``` ok"))).when(k == 2, F.concat(F.lit("see [1] then "), js))
        .when(k == 3, F.concat(F.lit("["), js)).when(k == 4, F.concat(F.lit("["), first, F.lit("]"))).otherwise(F.concat(F.lit("["), F.replace(js, F.lit("\\n"), F.lit("\n")), F.lit("]")))
    )
    out = R.parse_replies(_v(spark, sf_dir, "documents").withColumn("reply", reply), "doc_id long, lang string, text string")
    return out.select("doc_id", "status", F.size("records").alias("n"), F.md5(F.try_element_at("records", F.lit(1))["text"]).alias("text_md5"))


def _nested(spark, sf_dir):
    s = _v(spark, sf_dir, "structures")
    return s.select("paper_id", F.struct("title", "year").alias("bibliography"), F.struct("problem_to_solve").alias("problem_context"), F.struct("research_task").alias("task_object"), F.struct("input_variables").alias("inputs"), F.struct("method_family").alias("methods"), F.struct("model_outputs").alias("outputs"))


def f2_compact(spark, sf_dir):
    c = R.compact(_nested(spark, sf_dir))
    return c.select("paper_id", "title", "year", F.col("problem_context.problem_to_solve").alias("problem"), F.size("inputs.input_variables").alias("n_inputs"), F.col("evaluation").cast("string").alias("evaluation"))


def f3_trim_nested(spark, sf_dir):
    t = R.trim_nested(_nested(spark, sf_dir))
    return t.select("paper_id", F.col("bibliography.title").alias("title"), F.col("problem_context.problem_to_solve").alias("problem"), F.array_join("methods.method_family", "|").alias("methods"))


#: Papers that a nested list of these queries may hold, so that none grows with the corpus.
LIST_IDS = 500


def _part():
    return F.floor(F.col("paper_id").cast("long") / LIST_IDS)


def f4_explode_mapping(spark, sf_dir):
    """Mappings of LIST_IDS papers each; of one, all three tables are told apart by kind."""
    m = _v(spark, sf_dir, "memberships").withColumn("part", _part())
    lists = m.groupBy("part", "direction_id").pivot("list_kind", list(R.LISTS)).agg(F.array_sort(F.collect_list("paper_id")))
    d = lists.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("direction_id", F.col("direction_id").alias("direction_name"), F.lit("").alias("direction_definition"), *[F.col(k).alias(f"{k}_paper_ids") for k in R.LISTS]))).alias("directions"))
    a = _v(spark, sf_dir, "assignments").withColumn("part", _part()).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("paper_id", "direction_id"))).alias("paper_assignments"))
    directions, memberships, assignments = R.explode_mapping(d.join(a, "part", "full"))
    none = F.lit(None).cast("string")
    out = [directions.select("direction_id", F.lit("direction").alias("list_kind"), F.col("direction_pos").alias("pos"), none.alias("paper_id")), memberships.select("direction_id", "list_kind", "pos", "paper_id"), assignments.select("direction_id", F.lit("assignment").alias("list_kind"), "pos", "paper_id")]
    return reduce(lambda x, y: x.unionByName(y), out)


def _directions(spark, sf_dir):
    a = _v(spark, sf_dir, "assignments").select("direction_id").distinct()
    return a.unionByName(a.where("direction_id = 'D1'").select(F.lit("D9").alias("direction_id")))


def _violations(spark, sf_dir):
    d = materialize(_directions(spark, sf_dir), "directions")
    schemas = d.where("direction_id <> 'D2'").unionByName(d.where("direction_id = 'D1'").select(F.lit("D7").alias("direction_id"))).unionByName(d.where("direction_id = 'D3'"))
    return R.validate_mapping(_v(spark, sf_dir, "structures"), d, _v(spark, sf_dir, "memberships"), _v(spark, sf_dir, "assignments"), schemas, d.where("direction_id <> 'D4'"))


def f5_validate_mapping(spark, sf_dir):
    return _violations(spark, sf_dir)


def f5_type_violations(spark, sf_dir):
    """A synthesis reply made of each document: parts are left out or of another kind by its number."""
    k = F.col("doc_id")
    made = F.to_json(F.struct(F.when(k % 2 == 0, F.struct(F.when(k % 3 == 0, F.array("lang")).alias("directions"), F.array("text").alias("paper_assignments"))).alias("direction_mapping"), F.when(k % 5 > 0, F.array("source")).alias("direction_schemas"), F.col("text").alias("direction_records"), F.struct(F.array("lang").alias("cross_direction_differences")).alias("cross_direction_comparison")))
    return R.type_violations(_v(spark, sf_dir, "documents").select("doc_id", F.parse_json(made).alias("v")), "doc_id", "v", R.SYNTHESIS_TYPES)


def _placed(spark, sf_dir):
    return _v(spark, sf_dir, "memberships").withColumn("pos", F.col("paper_id").cast("long"))


def _direction_papers(spark, sf_dir):
    s, a = _v(spark, sf_dir, "structures"), _v(spark, sf_dir, "assignments")
    titles = a.where("direction_id = 'D2'").join(s.select("paper_id", "title"), "paper_id").select("paper_id", F.lit("D9").alias("direction_id"), "title")
    return R.direction_papers(_placed(spark, sf_dir), a.withColumn("pos", F.col("paper_id").cast("long")), s, titles)


def f6_direction_papers(spark, sf_dir):
    return _direction_papers(spark, sf_dir)


def _records(spark, sf_dir):
    """One JSON record of a document, with its identity in one of three places."""
    d = _v(spark, sf_dir, "structures").withColumn("n", F.col("paper_id").cast("long"))
    me = F.struct("paper_id", F.concat(F.lit(" "), "title").alias("title"), "year")
    js = F.when(F.col("n") % 3 == 0, F.to_json(F.struct(me.alias("paper")))).when(F.col("n") % 3 == 1, F.to_json(F.struct(me.alias("meta"), F.lit("x").alias("paper")))).otherwise(F.to_json(me))
    return d.select(F.col("n").alias("doc_id"), F.parse_json(js).alias("record"))


def f7_record_identity(spark, sf_dir):
    return R.record_identity(_records(spark, sf_dir)).select("doc_id", "paper_id", "title", "year")


def _cited(spark, sf_dir):
    s, a = _v(spark, sf_dir, "structures"), _v(spark, sf_dir, "assignments").select("paper_id").distinct()
    titled = a.join(s.select("paper_id", "title"), "paper_id")
    known = s.where("cast(paper_id AS BIGINT) % 10 = 0").groupBy("title").agg(F.concat(F.lit("Known "), F.min(F.col("paper_id").cast("long"))).alias("citation"))
    return R.citations(titled, s, known)


def f8_citations(spark, sf_dir):
    return _cited(spark, sf_dir)


def f9_format_citations(spark, sf_dir):
    lists = _v(spark, sf_dir, "memberships").groupBy(F.concat_ws("/", "direction_id", "list_kind", _part().cast("string")).alias("list_id")).agg(F.array_sort(F.collect_list("paper_id")).alias("paper_ids"))
    return R.format_citations(lists, _cited(spark, sf_dir)).withColumn("citations", F.array_join("citations", "|"))


def f10_unique_terms(spark, sf_dir):
    return _v(spark, sf_dir, "structures").select("paper_id", F.array_join(R.unique_terms(F.col("input_variables")), "|").alias("terms"), R.join_terms(F.col("method_family"), 2, 24).alias("joined"))


def f11_problem_text(spark, sf_dir):
    return _v(spark, sf_dir, "structures").select("paper_id", R.problem_text(F.col("problem_to_solve"), F.col("research_task"), F.col("title")).alias("problem"))


def _generic():
    none = F.lit(None).cast("array<string>")
    return R.generic_slots(F.col("input_variables"), none, F.col("method_family"), F.col("model_outputs"), F.col("model_outputs"), none)


def f12_generic_slots(spark, sf_dir):
    return _v(spark, sf_dir, "structures").select("paper_id", *[F.array_join(c, "|").alias(k) for k, c in _generic().items()])


def _shaped(spark, sf_dir):
    """A record of each document: two of five shapes each time its number allows, records of no shape in between. The JSON
    texts are put together from plain values, so their lines can be told from the documents' columns."""
    n, lang, source = F.col("n"), F.coalesce("lang", F.lit("xx")), F.coalesce("source", F.lit("yy"))
    at = lambda text, *values: F.concat(*[x for i, t in enumerate(text.split("@")) for x in ([F.lit(t)] + ([values[i].cast("string")] if i < len(values) else []))])
    turn = F.floor(n / 8)
    made = {
        0: at('{"task":{"control_level":"@"},"rl":{"algorithm":{"instance":"algo @"}},"mdp":{"state":{"definition":{"dimension":@,"observables":["@","@","obs","more"]}},"action":{"definition":{"control_targets":["pitch","@"]}}},"outputs":{"action_semantics":"set @"},"evaluation":{"key_results":["gain @"]}}', lang, n, 19 + turn % 2, lang, source, source, lang, n),
        1: at('{"paper":{"core_setting":{"system_scope":"scope @"}},"inputs":{"required_sensors_minimal_set":["@","imu","@"]},"wind_adaptation":{"enabled":true,"update_target":{"updated_variable":"delta_phi"}}}', n, lang, lang),
        2: at('{"paper":"x","outputs":{"primary_commands":["alpha","@"]}}', lang),
        3: at('{"paper":{"directional_summary":{},"inputs_directional":{"within_iteration_signals_for_J":["power","@"]},"learning_model":{"response_surface":{"form":"quadratic @"}}}}', lang, n),
        4: at('{"meta":{},"offline_bank":{},"inputs":{"wind_measurement":{"measured_variable":"w @","bias_model":{"value":@}}},"outputs":{"selected_setpoint_trajectory":{"representation":"roll_plus_period_plus_@"}},"evaluation":{"key_results":["x",{"improvement_percent":{"over_stationary":@.5}}]}}', lang, (turn % 10 / 4).cast("decimal(9,2)"), lang, n % 7),
        5: at('{"paper":{"mdp":{"state_definition":{"state_dim":@,"num_waypoints":5},"action_definition":{"action_levels_N":[200.0,@.5]}},"wind_handling":{"wind_measurement_in_state":false},"method":{"algorithms":[{"name":"A2C"},{"x":1},{"name":"dqn_@"}]},"output":{"policy_artifacts":{"actor":1,"critic":2}},"evaluation":{"results_by_wind":[{"algorithm":"A2C","percent_reduction_vs_optimal":1.5},{"algorithm":"A2C","percent_reduction_vs_optimal":@.25},{"algorithm":"X","percent_reduction_vs_optimal":99}]}}}', n, n % 1000 + 300, lang, n % 50),
        6: F.lit('{"paper":"x"}'),
    }
    js = reduce(lambda c, k: c.when(n % 8 == k, made[k]), list(made)[1:], F.when(n % 8 == 0, made[0])).otherwise("{}")
    d = _v(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), F.col("doc_id").cast("string").alias("paper_id"), "lang", "source")
    # lists are made where the texts are, so no text meets its record
    lists = _v(spark, sf_dir, "structures").select("paper_id", *[c.alias(f"generic_{k}") for k, c in _generic().items()])
    return lists.join(d, "paper_id").withColumn("record", F.parse_json(js))


def f12_spec_slots(spark, sf_dir):
    out = R.slots(_shaped(spark, sf_dir), {k: F.col(f"generic_{k}") for k in R.SLOTS})
    return out.select("paper_id", "shape", *[F.array_join(x, "|").alias(x) for x in R.SLOTS])


def _order(spark, sf_dir):
    return R.baseline(_placed(spark, sf_dir), _v(spark, sf_dir, "structures").where("year is not null"))


def f13_baseline(spark, sf_dir):
    return _order(spark, sf_dir)


def f14_relative_slots(spark, sf_dir):
    s = _v(spark, sf_dir, "structures").select("paper_id", "model_outputs")
    order = materialize(_order(spark, sf_dir), "order")
    base = order.where("pos = 0").join(s, "paper_id").select("direction_id", F.col("model_outputs").alias("base"))
    rows = R.with_base(order.where("pos > 0"), s, base)
    return rows.select("direction_id", "paper_id", F.array_join(R.relative_slots(F.col("model_outputs"), F.col("base")), "|").alias("outputs"))


def f15_flatten_differences(spark, sf_dir):
    d = _v(spark, sf_dir, "documents")
    js = F.concat(F.lit("["), F.to_json(F.array("lang")).substr(F.lit(2), F.length(F.to_json(F.array("lang"))) - 2), F.lit(","), F.to_json(F.struct(F.col("doc_id").cast("string").alias("paper_id"), F.split("text", "\n").alias("differences"))), F.lit(',{"differences":["z"]}]'))
    rows = d.select(F.col("doc_id").cast("string").alias("direction_id"), F.parse_json(js).alias("differences"))
    return R.flatten_differences(rows, _cited(spark, sf_dir)).select("direction_id", F.array_join("items", "|").alias("items"))


def f16_cross_summary(spark, sf_dir):
    d = _v(spark, sf_dir, "structures").withColumnRenamed("paper_id", "direction_id")
    lists = {"commons": "model_outputs", "differences": "method_family", "common_items": "input_variables", "structure": "method_family", "visual_ideas": "model_outputs"}
    out = R.cross_summary(d.select("direction_id", "title"), d.where("year is not null").select("direction_id", *[F.col(c).alias(k) for k, c in lists.items()]))
    return out.select("direction_id", "title", *[F.array_join(k, "|").alias(k) for k in lists])


def f17_direction_context(spark, sf_dir):
    s = _v(spark, sf_dir, "structures")
    papers = s.join(_cited(spark, sf_dir).select("paper_id", "citation"), "paper_id").select("paper_id", "citation", F.lit("main").alias("role"), F.col("research_task").alias("reason"), R.problem_text(F.col("problem_to_solve"), F.col("research_task"), F.col("title")).alias("problem"), *[c.alias(k) for k, c in _generic().items()], F.struct("title", F.col("method_family").alias("methods")).alias("structure"))
    directions = _directions(spark, sf_dir).select("direction_id", F.lower("direction_id").alias("direction_name"), F.lit("a  definition").alias("definition"))
    ctx = R.direction_papers_in_context(_order(spark, sf_dir), papers, directions)
    return ctx.select("direction_id", "direction_name", "definition", "baseline_paper_id", "baseline_citation", "pos", "paper_id", "citation", "reason", "problem", F.array_join("outputs", "|").alias("outputs"), F.col("structure.title").alias("structure_title"), F.array_join("structure.methods", "|").alias("structure_methods"))


def f18_validate_payloads(spark, sf_dir):
    k = F.col("doc_id")
    base = F.struct(F.col("doc_id").cast("string").alias("paper_id"), F.when(k % 2 == 0, F.col("lang")).alias("citation_cn"), F.array("lang").alias("input_box_cn"), F.when(k % 3 == 0, F.array("source")).alias("method_box_cn"), F.array("text").alias("output_box_cn"))
    row = F.struct(F.lit("p").alias("paper_id"), F.lit("c").alias("citation_cn"), F.array("lang").alias("input_diff_cn"), F.array("lang").alias("method_diff_cn"), F.when(k % 5 > 0, F.array("text")).alias("output_diff_cn"))
    check = F.struct(F.when(k % 7 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("open_points"))
    js = F.to_json(F.struct(F.col("source").alias("direction_id"), F.when(k % 11 > 0, F.col("lang")).alias("direction_name"), F.col("text").alias("core_problem_cn"), base.alias("baseline_paper"), F.array(row, row).alias("comparison_rows"), F.array("lang").alias("symbol_glossary_cn"), check.alias("self_check")))
    return R.validate_payloads(_v(spark, sf_dir, "documents").select("doc_id", F.parse_json(js).alias("payload")), "doc_id")


def f19_coverage(spark, sf_dir):
    return R.coverage(_direction_papers(spark, sf_dir), _violations(spark, sf_dir))


def f20_formula_list(spark, sf_dir):
    lines = _v(spark, sf_dir, "page_lines")
    return R.formula_list(lines.select(F.col("pdf_id").alias("doc_id"), F.concat((F.col("line_id") % 13).cast("string"), F.when(F.col("line_id") % 2 == 0, "a").otherwise("")).alias("number"), "page", "y0"))


_INL = r"regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^ | $', '', 'g')"
_KEYOF = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _short(x: str, n: int) -> str:
    x = _INL.format(x)
    return rf"CASE WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace(substr({x}, 1, {n - 1}), '\s+$', '') || '…' END"


def _first(name: str, items: str, n: int, chars: int, sep: str = "、") -> str:
    """CTEs that give (paper_id, s): the first n different terms of a list of structures, as R.join_terms gives for plain
    words; each list is read once."""
    return f"""{name}_w AS (SELECT paper_id, unnest({items}) AS w, generate_subscripts({items}, 1) AS i FROM structures),
{name}_v AS (SELECT paper_id, i, {_short("w", chars)} AS v FROM {name}_w),
{name}_k AS (SELECT paper_id, {_KEYOF.format("v")} AS k, min(i) AS i, arg_min(v, i) AS v FROM {name}_v GROUP BY paper_id, k),
{name} AS (SELECT paper_id, string_agg(v, '{sep}' ORDER BY i) AS s FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY i) AS r FROM {name}_k WHERE k <> '') WHERE r <= {n} GROUP BY paper_id)"""


_DIRS = "dirs_ AS (SELECT DISTINCT direction_id FROM assignments UNION ALL SELECT DISTINCT 'D9' FROM assignments WHERE direction_id = 'D1')"
_VIOLATIONS = _DIRS + """,
sch_ AS (SELECT * FROM dirs_ WHERE direction_id <> 'D2' UNION ALL SELECT 'D7' FROM dirs_ WHERE direction_id = 'D1' UNION ALL SELECT * FROM dirs_ WHERE direction_id = 'D3'), rec_ AS (SELECT * FROM dirs_ WHERE direction_id <> 'D4'),
per_ AS (SELECT paper_id, list_sort(list(DISTINCT direction_id)) AS ds FROM memberships GROUP BY paper_id),
viol_ AS (
SELECT 'list holds unknown paper' AS rule, direction_id, paper_id, 'list=' || list_kind AS detail FROM memberships WHERE paper_id NOT IN (SELECT paper_id FROM structures)
UNION ALL SELECT 'direction is empty', direction_id, NULL, NULL FROM dirs_ WHERE direction_id NOT IN (SELECT direction_id FROM memberships WHERE list_kind IN ('included', 'borderline'))
UNION ALL SELECT 'direction has no papers', direction_id, NULL, NULL FROM dirs_ WHERE direction_id NOT IN (SELECT direction_id FROM memberships)
UNION ALL SELECT 'assignment repeated', NULL, paper_id, 'times=' || count(*) FROM assignments GROUP BY paper_id HAVING count(*) > 1
UNION ALL SELECT 'structure without assignment', NULL, paper_id, NULL FROM structures WHERE paper_id NOT IN (SELECT paper_id FROM assignments)
UNION ALL SELECT 'paper in several directions', NULL, paper_id, 'lists=' || array_to_string(ds, ',') FROM per_ WHERE len(ds) > 1
UNION ALL SELECT 'assignment not in its lists', a.direction_id, a.paper_id, 'lists=' || array_to_string(ds, ',') FROM (SELECT paper_id, max(direction_id) AS direction_id FROM assignments GROUP BY paper_id) a JOIN per_ p USING (paper_id) WHERE NOT list_contains(ds, a.direction_id)
UNION ALL SELECT 'schema repeated', direction_id, NULL, 'times=' || count(*) FROM sch_ GROUP BY direction_id HAVING count(*) > 1
UNION ALL SELECT 'schema of unknown direction', direction_id, NULL, NULL FROM sch_ WHERE direction_id NOT IN (SELECT direction_id FROM dirs_)
UNION ALL SELECT 'direction without schema', direction_id, NULL, NULL FROM dirs_ WHERE direction_id NOT IN (SELECT direction_id FROM sch_)
UNION ALL SELECT 'direction without record', direction_id, NULL, NULL FROM dirs_ WHERE direction_id NOT IN (SELECT direction_id FROM rec_))"""
_PAPERS = """
want_ AS (SELECT direction_id, paper_id, min((CASE list_kind WHEN 'included' THEN 0 WHEN 'borderline' THEN 1 WHEN 'representative' THEN 2 ELSE 3 END, cast(paper_id AS BIGINT))) AS o FROM (SELECT direction_id, list_kind, paper_id FROM memberships UNION ALL SELECT direction_id, 'z', paper_id FROM assignments) GROUP BY ALL),
direct_ AS (SELECT direction_id, paper_id, o, 'id' AS how FROM want_ WHERE paper_id IN (SELECT paper_id FROM structures)),
title_ AS (SELECT DISTINCT 'D9' AS direction_id, title FROM assignments JOIN structures USING (paper_id) WHERE direction_id = 'D2'),
dp_ AS (SELECT direction_id, row_number() OVER (PARTITION BY direction_id ORDER BY o, paper_id) - 1 AS pos, paper_id, how FROM (SELECT * FROM direct_ UNION ALL SELECT direction_id, paper_id, (9, 0), 'title' FROM title_ JOIN structures USING (title)))"""
_CITED = """
known_ AS (SELECT title, 'Known ' || min(cast(paper_id AS BIGINT)) AS citation FROM structures WHERE cast(paper_id AS BIGINT) % 10 = 0 GROUP BY title),
year_ AS (SELECT title, arg_max(coalesce(cast(year AS VARCHAR), ''), paper_id) AS year FROM structures WHERE title <> '' GROUP BY title),
cited_ AS (SELECT a.paper_id, s.title, coalesce(y.year, '') AS year, coalesce(k.citation, CASE WHEN length(s.title) <= 20 THEN s.title ELSE substr(s.title, 1, 18) || '…' END || CASE WHEN coalesce(y.year, '') <> '' THEN '（' || y.year || '）' ELSE '' END) AS citation
  FROM (SELECT DISTINCT paper_id FROM assignments) a JOIN structures s USING (paper_id) LEFT JOIN year_ y ON y.title = s.title LEFT JOIN known_ k ON k.title = s.title)"""
_BASE = """
have_ AS (SELECT direction_id, list_kind, paper_id, cast(paper_id AS BIGINT) AS pos FROM memberships WHERE paper_id IN (SELECT paper_id FROM structures WHERE year IS NOT NULL)),
base_ AS (SELECT direction_id, coalesce(arg_min(paper_id, pos) FILTER (WHERE list_kind = 'representative'), arg_min(paper_id, pos) FILTER (WHERE list_kind = 'included')) AS base FROM have_ GROUP BY direction_id),
order_ AS (SELECT direction_id, paper_id, row_number() OVER (PARTITION BY direction_id ORDER BY o) - 1 AS pos FROM (SELECT direction_id, base AS paper_id, -1 AS o FROM base_ WHERE base IS NOT NULL UNION ALL SELECT h.direction_id, paper_id, min(pos) FROM have_ h JOIN base_ b ON b.direction_id = h.direction_id AND base <> paper_id WHERE list_kind = 'included' GROUP BY ALL))"""
_GENERIC = ",\n".join([_first("gi_", "input_variables", 3, 22), _first("gm_", "method_family", 2, 24), _first("go_", "model_outputs", 2, 26)]) + f""",
generic_ AS (SELECT s.paper_id, '变量：' || coalesce(gi_.s, '') AS inputs, '方法：' || coalesce(gm_.s, '') || '|' || {_short('model_outputs[1]', 72)} AS methods, '输出：' || coalesce(go_.s, '') AS outputs
  FROM structures s LEFT JOIN gi_ ON gi_.paper_id = s.paper_id LEFT JOIN gm_ ON gm_.paper_id = s.paper_id LEFT JOIN go_ ON go_.paper_id = s.paper_id)"""
_SHAPED = """
doc_ AS (SELECT doc_id AS n, cast(doc_id AS VARCHAR) AS paper_id, coalesce(lang, 'xx') AS l, coalesce(source, 'yy') AS o, doc_id // 8 AS t FROM documents),
spec_ AS (SELECT paper_id, CASE n % 8 WHEN 0 THEN 'learning' WHEN 1 THEN 'control' WHEN 2 THEN 'control' WHEN 3 THEN 'iterative' WHEN 4 THEN 'bank' WHEN 5 THEN 'batch' ELSE 'none' END AS shape,
 CASE n % 8 WHEN 0 THEN '状态：' || CASE WHEN t % 2 = 1 THEN '20维状态：' ELSE '' END || l || '、' || o || '、obs|环境：；层级：' || l WHEN 1 THEN '传感：' || l || '、imu|任务：scope ' || n WHEN 3 THEN '反馈：；圈内信号：power、' || l
  WHEN 4 THEN '测量：w ' || l || '，偏差约 ' || regexp_replace(cast(t % 10 / 4 AS VARCHAR), '\\.0$', '') || ' m/s' WHEN 5 THEN '状态：5 航点聚合的 ' || n || ' 维向量|动作：离散张力 200–' || (n % 1000 + 300) || '.5 N|条件：reel-out + 预定义 figure-8 + 无显式风测量' END AS inputs,
 CASE n % 8 WHEN 0 THEN '算法：algo ' || n || '|动作：pitch、' || o || '（set ' || l || '）' WHEN 1 THEN '导航/引导：极坐标航迹量 + waypoint/heading 参考|监督：风向自适应 delta phi' WHEN 2 THEN '导航/引导：极坐标航迹量 + waypoint/heading 参考|监督：混合状态机协同绞盘/俯仰' WHEN 3 THEN '响应面：+quadratic ' || n || '|更新：'
  WHEN 4 THEN '离线生成 Fourier 轨迹库与周期 T|在线 ES 修正有效风速 w eff 并插值选轨|饱和约束 + stationary/adaptive/nonadaptive 模式切换' WHEN 5 THEN '离线 replay buffer + 全动作/多风速采样|批量强化学习：A2C / dqn ' || l END AS methods,
 CASE n % 8 WHEN 0 THEN '控制输出：set ' || l || '|结果：gain ' || n WHEN 1 THEN '风向对齐输出：delta phi' WHEN 2 THEN '输出命令：alpha、' || l WHEN 4 THEN '输出设定：roll+period|在线量：w eff / w corr / 当前模式|结果：相对 stationary 净功率提升 ' || (n % 7) || '.5%'
  WHEN 5 THEN '策略产物：actor / critic|控制输出：期望系绳张力序列|结果：A2C 相对穷举最优损失 ' || printf('%.2f', least(1.5, n % 50 + 0.25)) || '%–' || printf('%.2f', greatest(1.5, n % 50 + 0.25)) || '%' END AS outputs
 FROM doc_)"""
_PROBLEM = _short(f"coalesce(nullif({_INL.format('problem_to_solve')}, ''), nullif({_INL.format('research_task')}, ''), title)", 180)
_REST = "CASE WHEN year IS NULL THEN '' WHEN len({0}) <= {1} THEN array_to_string({0}, '|') ELSE array_to_string(list_slice({0}, 1, {1}), '|') || '|其余 ' || (len({0}) - {1}) || ' 项见结构化结果' END"
_M = ("structures", "memberships", "assignments")
_SPLIT = "string_split(text, chr(10))"
SQL = {
    "f1_parse_lists": """SELECT doc_id, CASE doc_id % 6 WHEN 3 THEN 'unclosed' WHEN 4 THEN 'mismatched' WHEN 5 THEN CASE WHEN contains(text, chr(10)) THEN 'repaired' ELSE 'ok' END ELSE 'ok' END AS status,
CASE doc_id % 6 WHEN 0 THEN 2 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 1 END AS n, CASE WHEN doc_id % 6 IN (0, 1, 5) THEN md5(text) END AS text_md5 FROM documents""",
    "f1_parse_replies": "SELECT doc_id, status, CASE WHEN status IN ('ok', 'repaired') THEN lang END AS lang, CASE WHEN status IN ('ok', 'repaired') THEN md5(text) END AS text_md5 FROM (SELECT *, CASE doc_id % 5 WHEN 3 THEN 'no_json' WHEN 4 THEN 'unclosed' WHEN 2 THEN CASE WHEN contains(text, chr(10)) THEN 'repaired' ELSE 'ok' END ELSE 'ok' END AS status FROM documents)",
    "f2_compact": with_views("SELECT paper_id, title, year, problem_to_solve AS problem, len(input_variables) AS n_inputs, CAST(NULL AS VARCHAR) AS evaluation FROM structures", "structures"),
    "f3_trim_nested": with_views(f"SELECT paper_id, {_short('title', 260)} AS title, {_short('problem_to_solve', 260)} AS problem, array_to_string(list_transform(list_slice(method_family, 1, 6), lambda w: {_short('w', 260)}), '|') AS methods FROM structures", "structures"),
    "f4_explode_mapping": with_views(f"""m_ AS (SELECT DISTINCT cast(paper_id AS BIGINT) // {LIST_IDS} AS part, direction_id FROM memberships)
--- SELECT direction_id, list_kind, row_number() OVER (PARTITION BY cast(paper_id AS BIGINT) // {LIST_IDS}, direction_id, list_kind ORDER BY paper_id) - 1 AS pos, paper_id FROM memberships
UNION ALL SELECT direction_id, 'direction', row_number() OVER (PARTITION BY part ORDER BY direction_id) - 1, NULL FROM m_
UNION ALL SELECT direction_id, 'assignment', row_number() OVER (PARTITION BY cast(paper_id AS BIGINT) // {LIST_IDS} ORDER BY paper_id, direction_id) - 1, paper_id FROM assignments""", "memberships"),
    "f5_validate_mapping": with_views(_VIOLATIONS + "--- SELECT * FROM viol_", *_M),
    "f5_type_violations": """SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 2 = 1 THEN 'direction_mapping must be an object' END, CASE WHEN doc_id % 5 = 0 THEN 'direction_schemas must be an array' END, 'direction_records must be an array',
      CASE WHEN NOT (doc_id % 2 = 0 AND doc_id % 3 = 0) THEN 'directions must be an array' END, CASE WHEN doc_id % 2 = 1 THEN 'paper_assignments must be an array' END], lambda q: q IS NOT NULL)) AS rule FROM documents""",
    "f6_direction_papers": with_views(_PAPERS + "--- SELECT * FROM dp_", *_M),
    "f7_record_identity": with_views("SELECT cast(paper_id AS BIGINT) AS doc_id, paper_id, trim(title) AS title, year FROM structures", "structures"),
    "f8_citations": with_views(_CITED + "--- SELECT * FROM cited_", *_M),
    "f9_format_citations": with_views(_CITED + "--- SELECT direction_id || '/' || list_kind || '/' || cast(m.paper_id AS BIGINT) // 500 AS list_id, string_agg(coalesce(nullif(citation, ''), nullif(title, ''), m.paper_id), '|' ORDER BY m.paper_id) AS citations FROM memberships m LEFT JOIN cited_ c ON c.paper_id = m.paper_id GROUP BY ALL", *_M),
    "f10_unique_terms": with_views(_first("a_", "input_variables", 3, 78, "|") + ",\n" + _first("b_", "method_family", 2, 24) + "--- SELECT s.paper_id, coalesce(a_.s, '') AS terms, coalesce(b_.s, '') AS joined FROM structures s LEFT JOIN a_ ON a_.paper_id = s.paper_id LEFT JOIN b_ ON b_.paper_id = s.paper_id", "structures"),
    "f11_problem_text": with_views(f"SELECT paper_id, {_PROBLEM} AS problem FROM structures", "structures"),
    "f12_generic_slots": with_views(_GENERIC + "--- SELECT * FROM generic_", "structures"),
    "f12_spec_slots": with_views(_GENERIC + "," + _SHAPED + "--- SELECT g.paper_id, shape, coalesce(s.inputs, g.inputs) AS inputs, coalesce(s.methods, g.methods) AS methods, coalesce(s.outputs, g.outputs) AS outputs FROM generic_ g JOIN spec_ s ON s.paper_id = g.paper_id", "structures"),
    "f13_baseline": with_views(_BASE + "--- SELECT * FROM order_", *_M),
    "f14_relative_slots": with_views(_BASE + f""", row_ AS (SELECT o.*, model_outputs AS cur FROM order_ o JOIN structures USING (paper_id)), two_ AS (SELECT r.direction_id, r.paper_id, r.cur, b.cur AS base FROM row_ r JOIN row_ b ON b.direction_id = r.direction_id AND b.pos = 0 WHERE r.pos > 0),
new_ AS (SELECT direction_id, paper_id, list_filter(cur, lambda w: w <> '' AND NOT list_contains(list_transform(list_filter(base, lambda u: u <> ''), lambda u: {_KEYOF.format('u')}), {_KEYOF.format('w')})) AS n FROM two_)
--- SELECT direction_id, paper_id, CASE WHEN len(n) = 0 THEN '同主线' ELSE array_to_string(list_slice(n, 1, 3), '|') END AS outputs FROM new_""", *_M),
    "f15_flatten_differences": with_views(_CITED + f"--- SELECT cast(doc_id AS VARCHAR) AS direction_id, array_to_string(list_concat([lang], list_transform({_SPLIT}, lambda w: coalesce(nullif(citation, ''), cast(doc_id AS VARCHAR)) || '：' || w), ['文献：z']), '|') AS items FROM documents LEFT JOIN cited_ ON paper_id = cast(doc_id AS VARCHAR)", *_M),
    "f16_cross_summary": with_views("SELECT paper_id AS direction_id, title, " + ", ".join(f"{_REST.format(c, n)} AS {k}" for k, c, n in (("commons", "model_outputs", 2), ("differences", "method_family", 2), ("common_items", "input_variables", 5), ("structure", "method_family", 4), ("visual_ideas", "model_outputs", 4))) + " FROM structures", "structures"),
    "f17_direction_context": with_views(_BASE + "," + _CITED + "," + _GENERIC + f"""--- SELECT o.direction_id, lower(o.direction_id) AS direction_name, 'a definition' AS definition, first_value(o.paper_id) OVER w AS baseline_paper_id, first_value(citation) OVER w AS baseline_citation, pos, o.paper_id, citation, {_short('research_task', 220)} AS reason, {_PROBLEM.replace('title', 's.title')} AS problem, g.outputs,
  {_short('s.title', 260)} AS structure_title, array_to_string(list_transform(list_slice(method_family, 1, 6), lambda w: {_short('w', 260)}), '|') AS structure_methods
FROM order_ o JOIN cited_ c ON c.paper_id = o.paper_id JOIN structures s ON s.paper_id = o.paper_id JOIN generic_ g ON g.paper_id = o.paper_id WHERE o.direction_id IN (SELECT direction_id FROM assignments) WINDOW w AS (PARTITION BY o.direction_id ORDER BY pos)""", *_M),
    "f18_validate_payloads": """SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'missing direction_name' END, CASE WHEN doc_id % 2 = 1 THEN 'baseline lacks citation_cn' END, CASE WHEN doc_id % 3 > 0 THEN 'baseline lacks method_box_cn' END, CASE WHEN doc_id % 3 > 0 THEN 'baseline method_box_cn must be an array' END,
      CASE WHEN doc_id % 5 = 0 THEN 'row 0 lacks output_diff_cn' END, CASE WHEN doc_id % 5 = 0 THEN 'row 1 lacks output_diff_cn' END, CASE WHEN doc_id % 7 = 0 THEN 'self_check open_points' END], lambda q: q IS NOT NULL)) AS rule FROM documents""",
    "f19_coverage": with_views(_VIOLATIONS + "," + _PAPERS + "--- SELECT direction_id, CAST(sum(papers) AS BIGINT) AS papers, CAST(sum(by_title) AS BIGINT) AS by_title, CAST(sum(violations) AS BIGINT) AS violations FROM (SELECT direction_id, count(*) AS papers, count(*) FILTER (WHERE how = 'title') AS by_title, 0 AS violations FROM dp_ GROUP BY 1 UNION ALL SELECT direction_id, 0, 0, count(*) FROM viol_ WHERE direction_id IS NOT NULL GROUP BY 1) GROUP BY ROLLUP (direction_id)", *_M),
    "f20_formula_list": with_views("SELECT pdf_id AS doc_id, number, arg_min(page, (page, y0)) AS page, arg_min(y0, (page, y0)) AS y0 FROM (SELECT *, cast(line_id % 13 AS VARCHAR) || CASE WHEN line_id % 2 = 0 THEN 'a' ELSE '' END AS number FROM page_lines) GROUP BY ALL", "page_lines"),
}
QUERIES = {k: f for k, f in globals().items() if k[0] == "f" and k[1:2].isdigit()}
