"""Hand examples and properties of the library's operators."""

import json
import random
import re
import shutil
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from bibspark.functions import text as T
from bibspark.operators import graph as G
from bibspark.operators import library as L
from bibspark.operators import pages as P
from bibspark.operators import records as R
from bibspark.operators import search as S
from bibspark.plans.fixtures import view
from bibspark.sources import readers, sinks
from bibspark.streaming import incremental
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("rule", "value", "want"),
    [
        (T.clean_text, " a\x00b \r\n\r\r\n\n c\t\t d ", "ab \n\n c d"),
        (T.clean_inline, None, ""),
        (T.normalize_inline, "a\x00b  c", "a b c"),
        (T.safe_stem, " .: ", "item_" + "7df0a7d05a"[:0]),
        (T.slug, "??", "figure"),
        (T.file_stem, " a b.pdf ", "a_b_pdf"),
        (T.title_key, "A  Tale: of-2", "a tale of 2"),
        (T.term_key, "Ab_c-Ü 中", "abcü中"),
        (T.strip_doi, " https://doi.org/10.1/x ", "10.1/x"),
        (T.strip_doi, "doi:10.1/x", "10.1/x"),
        (T.clean_query, 'title: (Deep AND "deep") Nets OR nets x', "Deep Nets x"),
        (T.portable_path, "C:\\u\\library\\pdfs\\a.pdf", "pdfs/a.pdf"),
        (T.portable_path, "/x/pdfs/y/pdfs/b.pdf", "pdfs/b.pdf"),
        (T.portable_path, "c.PDF", "pdfs/c.PDF"),
        (T.portable_path, " ", None),
        (T.pretty_term, "figure8_path", "figure-8 path"),
        (T.pretty_term, "Not_Applicable", ""),
        (T.pretty_term, "towing", "牵引工况"),
        (T.parse_score, "score: 8.5/10", 8.5),
        (T.parse_score, "99", 10.0),
        (T.parse_score, None, 5.0),
        (T.parse_figure_number, "007B", "7b"),
        (T.parse_figure_number, "XIVa", "14a"),
        (T.parse_figure_number, "iv", "4"),
        (T.parse_figure_number, "S 1", "s1"),
    ],
)
def test_text_rules(spark, rule, value, want):
    got = one(spark, rule, value)
    assert got.startswith(want) if rule is T.safe_stem else got == want


def test_truncation_styles(spark):
    long = "word " * 30
    assert one(spark, lambda c: T.truncate(c, 10), long) == "word word ..."
    assert one(spark, lambda c: T.truncate(c, 10, "fit"), long) == "word wo..."
    assert one(spark, lambda c: T.truncate(c, 11, "ellipsis"), long) == "word word…"
    assert one(spark, lambda c: T.head_tail(c, 5), "abcdefgh") == "ab" + T.CUT_MARK + "fgh"


def test_paper_key_and_merge(spark):
    df = spark.createDataFrame([("10.1/A", "x", "", "T", 0), ("", "2001.1", "9", "T", 1), (None, "", "9", "T", 2), ("", None, "", " A  b ", 3)], "doi string, arxiv_id string, ieee_id string, title string, pos int")
    assert [r.key for r in S.with_key(df).orderBy("pos").collect()] == ["doi:10.1/a", "arxiv:2001.1", "ieee:9", "title:a b"]
    a = spark.createDataFrame([("k1", 0, "old"), ("k2", 1, "two")], "key string, pos int, v string")
    b = spark.createDataFrame([("k3", 0, "three"), ("k1", 1, "new")], "key string, pos int, v string")
    assert [(r.key, r.v) for r in S.merge_rounds(a, b).orderBy("pos").collect()] == [("k1", "new"), ("k2", "two"), ("k3", "three")]


def test_scores_default_and_clamp(spark):
    c = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "key string, pos int")
    j = spark.createDataFrame([("0", 14.0, None, None, None, 1), ("0", -3.0, "low", ["x"], ["t"], 2), ("1.5", 9.0, "high", None, None, 3)], "id string, score double, verdict string, aspects array<string>, followups array<string>, j_pos int")
    got = S.score_join(c, j, 2).orderBy("pos").collect()
    assert [(r.key, r.relevance_score, r.relevance_verdict) for r in got] == [("a", 0.0, "low"), ("b", 5.0, "medium")]
    assert [r.query for r in S.followup_queries(S.score_join(c, j, 2)).collect()] == ["t"]


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_block_pairs_equal_the_plain_join(spark, blocks):
    papers = view(spark, SF, "papers")
    w = G.tfidf(G.tokens(papers), papers.count()).cache()
    x, y = w.select(F.col("paper_id").alias("a"), "term", F.col("w").alias("u")), w.select(F.col("paper_id").alias("b"), "term", F.col("w").alias("v"))
    plain = {(r.a, r.b): r.s for r in x.join(y, "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("u") * F.col("v")).alias("s")).where("s >= 0.18").collect()}
    got = {(r.a, r.b): r.score for r in G.cosine_pairs(w, 0.18, blocks).collect()}
    assert set(got) == set(plain) and all(abs(got[k] - plain[k]) < 1e-9 for k in got)


def test_edges_run_from_the_first_chooser(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.2)], "a long, b long, score double")
    pos = spark.createDataFrame([(3, 0), (2, 1), (1, 2)], "paper_id long, pos long")
    assert sorted(tuple(r) for r in G.knn_edges(pairs, pos, 1).collect()) == [(1, 2, 0.9), (3, 2, 0.9)]


def test_relation_types(spark):
    sim = spark.createDataFrame([(1, 2, 0.5), (3, 4, 0.6), (5, 6, 0.7)], "source_id long, target_id long, weight double")
    cit = spark.createDataFrame([(2, 1, 1, 2, 1), (4, 3, 1, 4, 3), (8, 7, 2, 7, 8)], "citing_id long, cited_id long, cites long, first_citing_id long, first_cited_id long")
    judged = spark.createDataFrame([("1--2", "extends"), ("3--4", "extends"), ("7--8", "extends")], "edge_id string, type string")
    docs = spark.createDataFrame([(3, 4, "weak_or_unclear"), (5, 6, "same_method")], "a long, b long, type string")
    got = {(r.source_id, r.target_id): (r.type, r.weight, r.evidence, r.supporting_cites) for r in G.merge_relations(sim, cit, judged, docs).collect()}
    assert got == {(1, 2): ("extends", 0.5, None, 1), (3, 4): ("cites", 0.6, "pdf", 1), (5, 6): ("same_method", 0.7, "pdf", 0), (7, 8): ("extends", 1.0, "openalex", 1)}


def test_document_attempts_stop(spark):
    e = spark.createDataFrame([(i, i + 100, i) for i in range(30)], "source_id long, target_id long, pos long")
    ok = spark.createDataFrame([(i, i + 100, i % 2 == 0) for i in range(1, 30)], "source_id long, target_id long, ok boolean")
    assert [r.pos for r in G.document_attempts(e, ok, 3).orderBy("pos").collect()] == [1, 2, 3, 4, 5, 6]


def test_document_attempts_of_many_graphs(spark):
    r = random.Random(13)
    rows = [(f"g{g}", i, i + 1000, i, r.random() < 0.3) for g in range(6) for i in range(r.choice([0, 2, 5, 40]))]
    e = spark.createDataFrame(rows, "graph string, source_id long, target_id long, pos long, ok boolean")
    got = {}
    for x in G.document_attempts(e.drop("ok"), e.drop("pos"), 3, ("graph",)).collect():
        got.setdefault(x.graph, []).append(x.pos)
    for g in {x[0] for x in rows}:
        want, good = [], 0
        for x in [x for x in rows if x[0] == g][:9]:
            if good < 3:
                want.append(x[3])
                good += x[4]
        assert sorted(got[g]) == want


def test_library_insert(spark):
    lib = spark.createDataFrame([(7, "A", "s")], "paper_id long, title string, source string")
    batch = spark.createDataFrame([("B", None, 5), ("A", "new", 1), ("a", "z", 9), ("B", "later", 6)], "title string, source string, pos long")
    got = sorted(tuple(r) for r in L.add_papers(lib, batch).collect())
    assert got == [(7, "A", "s"), (8, "B", "unknown"), (9, "a", "z")]
    n = spark.createDataFrame([(r,) for r in random.Random(1).sample(range(10_000), 500)], "x long")
    assert [r.n for r in L.dense_number(n, "x", "n", 7).orderBy("x").collect()] == list(range(1, 501))


def test_replies(spark):
    rows = [(1, 'x ```json\n{"a": 1, "b": "t"}\n``` y'), (2, 'so: {"a": 2, "b": "p"} trailing }'), (3, '{"a": 3, "b": "line\nbreak"}'), (4, "nothing"), (5, '{"a": 5, "b": "open'), (6, None)]
    got = {r.id: (r.status, r.record and (r.record.a, r.record.b)) for r in R.parse_replies(spark.createDataFrame(rows, "id int, reply string"), "a int, b string").collect()}
    assert got == {1: ("ok", (1, "t")), 2: ("ok", (2, "p")), 3: ("repaired", (3, "line\nbreak")), 4: ("no_json", None), 5: ("unclosed", None), 6: ("no_json", None)}


def plain_reply(text):
    """(status, value) of a reply, read character by character."""
    text = (text or "").strip(" ")
    fence = re.search(r"```(?:json)?\s*(\{.*\}|\[.*\])\s*```", text, re.DOTALL)
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=None)
    if not fence and at is None:
        return "no_json", None
    body, stack, inside, skip, end = fence and fence.group(1), [], False, False, None
    if not fence:
        for i in range(at, len(text)):
            c = text[i]
            if inside:
                inside, skip = (skip or c != '"'), (not skip and c == "\\")
            elif c == '"':
                inside = True
            elif c in "{[":
                stack.append(c)
            elif c in "}]":
                if stack.pop() + c not in ("{}", "[]"):
                    return "mismatched", None
                if not stack:
                    end = i + 1
                    break
        if end is None:
            return "unclosed", None
        body = text[at:end]
    for strict in (True, False):
        try:
            value = json.JSONDecoder(strict=strict).raw_decode(body)[0] if body[0] == "{" else json.loads(body, strict=strict)
            if strict or isinstance(value, dict) or not any(isinstance(x, list) for x in value):
                return "ok" if strict else "repaired", value
        except ValueError:
            pass
    return "invalid", None


def test_list_replies(spark):
    r = random.Random(12)
    bits = ['{"a": 1, "b": "x"}', '{"a": 2}', "[", "]", "{", "}", ", ", '"', "\\", '\\"', "1", "text ", '{"b": "q [ } \\" ]"}', "```json\n", "\n```", '[{"a": 3, "b": "y"}, {"a": 4}]', "null", '{"b": "l\nm"}', '[{"b": "t\tu"}]', ":"]
    texts = [None, "", "see [1] then {}", "[]", "[1, {\"a\": 5}]", '```json\n[{"a": 1}]\n```', '[{"a":1}]', '[{"a":1]', "[[{]]", *("".join(r.choices(bits, k=r.randint(1, 6))) for _ in range(3000))]
    rows = [(i, t) for i, t in enumerate(texts)]
    out = R.parse_replies(spark.createDataFrame(rows, "id int, reply string"), "a int, b string").collect()
    seen = set()
    for row in out:
        status, value = plain_reply(row.reply)
        assert row.status == status, row
        seen.add((status, type(value)))
        part = lambda x: (x.get("a"), x.get("b")) if isinstance(x, dict) else None
        assert (row.record and tuple(row.record)) == (part(value) if isinstance(value, dict) else None), row
        assert (None if row.records is None else [x and tuple(x) for x in row.records]) == ([part(x) for x in value] if isinstance(value, list) else None), row
    assert len(seen) >= 8


def test_mapping_rules(spark):
    s = spark.createDataFrame([("p1",), ("p2",)], "paper_id string")
    d = spark.createDataFrame([("D1",), ("D2",)], "direction_id string")
    m = [("D1", "included", "p1"), ("D2", "included", "p2")]
    a = [("p1", "D1"), ("p2", "D2")]
    frames = lambda m, a: (spark.createDataFrame(m, "direction_id string, list_kind string, paper_id string"), spark.createDataFrame(a, "paper_id string, direction_id string"))
    assert R.validate_mapping(s, d, *frames(m, a), d, d).count() == 0
    faults = {
        "list holds unknown paper": ([*m, ("D1", "included", "px")], a),
        "assignment repeated": (m, [*a, ("p1", "D1")]),
        "assignment to unknown direction": (m, a),
        "structure without assignment": (m, a[:1]),
        "paper in several directions": ([*m, ("D2", "borderline", "p1")], a),
    }
    for rule, (fm, fa) in faults.items():
        if rule == "assignment to unknown direction":
            fa = [("p1", "D1"), ("p2", "D2"), ("p2", "D9")]
        found = {r.rule for r in R.validate_mapping(s, d, *frames(fm, fa), d, d).collect()}
        assert rule in found, rule
    assert {r.rule for r in R.validate_mapping(s, d, *frames(m, a), d.where("direction_id = 'D1'"), d.union(d)).collect()} == {"direction without schema", "record repeated"}


def plain_violations(structures, directions, lists, assigned, schemas, records):
    """validate_mapping, rule by rule over Python lists."""
    clean = lambda x: (x or "").strip() or None
    structures, directions = [clean(x) for x in structures], [clean(x) for x in directions]
    lists, assigned = [(clean(d), k, clean(p)) for d, k, p in lists], [(clean(p), clean(d)) for p, d in assigned]
    out = [("structure id missing", None, None, None) for x in structures if not x] + [("direction id missing", None, None, None) for x in directions if not x]
    many = lambda rule, ids, paper: [(rule, None if paper else x, x if paper else None, f"times={n}") for x, n in Counter(filter(None, ids)).items() if n > 1]
    out += many("structure id repeated", structures, True) + many("direction id repeated", directions, False) + many("assignment repeated", [p for p, _ in assigned], True)
    lists = [x for x in lists if x[0] and x[2]]
    out += [("list holds unknown paper", d, p, f"list={k}") for d, k, p in lists if p not in structures]
    known = set(filter(None, directions))
    out += [("direction is empty", d, None, None) for d in known if not any(x[0] == d and x[1] != "representative" for x in lists)]
    out += [("direction has no papers", d, None, None) for d in known if not any(x[0] == d for x in lists)]
    for p, d in assigned:
        out += [("assignment without paper", d, None, None)] if not p else []
        out += [("assignment of unknown paper", d, p, None)] if p and p not in structures else []
        out += [("assignment without direction", None, p, None)] if p and not d else []
        out += [("assignment to unknown direction", d, p, None)] if p and d and d not in known else []
    out += [("structure without assignment", None, p, None) for p in set(filter(None, structures)) if p not in [x for x, _ in assigned]]
    for p in {x[2] for x in lists}:
        ds = sorted({x[0] for x in lists if x[2] == p})
        out += [("paper in several directions", None, p, "lists=" + ",".join(ds))] if len(ds) > 1 else []
        mine = [d for q, d in assigned if q == p]
        last = max(filter(None, mine), default=None)
        out += [("assignment not in its lists", last, p, "lists=" + ",".join(ds))] if mine and last not in ds else []
    for name, ids in (("schema", schemas), ("record", records)):
        if ids is not None:
            ids = [clean(x) for x in ids]
            out += [(f"{name} without direction", None, None, None) for x in ids if not x] + many(f"{name} repeated", ids, False)
            out += [(f"{name} of unknown direction", x, None, None) for x in ids if x and x not in known]
            out += [(f"direction without {name}", d, None, None) for d in known if d not in ids]
    return Counter(out)


def test_mapping_rules_against_plain_ones(spark):
    r, seen = random.Random(5), set()
    ids, dirs, kinds = ["p1", " p2", "p2", "p3", "", None, "px"], ["D1", "D2 ", "D2", "D3", " ", None, "D9"], ["included", "borderline", "representative"]
    one = lambda c, rows: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    for i in range(8):
        n = 0 if i == 0 else 6
        some = lambda xs, n=n: r.choices(xs, k=r.randint(0, n))
        structures, directions, schemas, records = some(ids), some(dirs), some(dirs), some(dirs) if i % 3 else None
        lists = [(r.choice(dirs), r.choice(kinds), r.choice(ids)) for _ in some(ids)]
        assigned = [(r.choice(ids), r.choice(dirs)) for _ in some(ids)]
        got = R.validate_mapping(
            one("paper_id", structures), one("direction_id", directions), spark.createDataFrame(lists, "direction_id string, list_kind string, paper_id string"),
            spark.createDataFrame(assigned, "paper_id string, direction_id string"), one("direction_id", schemas), None if records is None else one("direction_id", records),
        )
        want = plain_violations(structures, directions, lists, assigned, schemas, records)
        assert Counter(map(tuple, got.collect())) == want
        seen |= {x[0] for x in want}
    assert len(seen) >= 20


def test_unique_terms(spark):
    got = spark.createDataFrame([(["A b", "a_B", None, "unknown", "...", "c", "d", "e"],)], "x array<string>").select(R.unique_terms(F.col("x")).alias("t"), R.clamp_items(F.col("x"), 6).alias("c")).first()
    assert got.t == ["A b", "c", "d"] and got.c[-1] == "其余 2 项见结构化结果"


# page walks, against plain versions written from their descriptions


def boxes(r, n):
    out = []
    for i in range(n):
        x, y = r.randrange(0, 500, 5), r.randrange(0, 700, 5)
        out.append((i, {"x0": float(x), "y0": float(y), "x1": float(x + r.randrange(20, 200)), "y1": float(y + r.randrange(20, 150))}, r.choice(["left", "right", "full"])))
    return out


def gap(a0, a1, b0, b1):
    return max(0.0, b0 - a1, a0 - b1)


def share(a0, a1, b0, b1):
    n, base = min(a1, b1) - max(a0, b0), min(a1 - a0, b1 - b0)
    return n / base if n > 0 and base > 0 else 0.0


RECORDS = [
    ('{"paper":{"a":1},"methods":{},"outputs":{"primary_commands":["alpha"]}}', "control", ["g"], ["导航/引导：极坐标航迹量 + waypoint/heading 参考", "监督：混合状态机协同绞盘/俯仰"], ["输出命令：alpha"]),
    ('{"paper":"x"}', "none", ["g"], ["g"], ["g"]),
    ('{"paper":{}}', "batch", ["g"], ["离线 replay buffer + 全动作/多风速采样"], ["控制输出：期望系绳张力序列"]),
    ('{"paper":null,"inputs":{}}', "control", ["g"], ["导航/引导：极坐标航迹量 + waypoint/heading 参考", "监督：混合状态机协同绞盘/俯仰"], ["g"]),
    ('{"paper":{"directional_summary":{},"inputs_directional":{"within_iteration_signals_for_J":["power"],"path_parameter_history":["h_1"]},"learning_model":{"response_surface":{"form":"quadratic  form"}}}}', "iterative", ["反馈：；圈内信号：power", "待调参数：h 1"], ["响应面：+quadratic form", "更新："], ["g"]),
    ('{"meta":1,"offline_bank":{},"paper":{},"inputs":{"wind_measurement":{"measured_variable":"w","bias_model":{"value":"1"}}}}', "bank", ["测量：w"], ["离线生成 Fourier 轨迹库与周期 T", "在线 ES 修正有效风速 w eff 并插值选轨", "饱和约束 + stationary/adaptive/nonadaptive 模式切换"], ["输出设定：roll 轨迹 + 周期 T", "在线量：w eff / w corr / 当前模式"]),
    ('{"task":{},"rl":{},"mdp":{"state":{"definition":{"dimension":24,"observables":["a","b"]}}},"environment":{"wind_model":{"type":"turbulent"}},"outputs":{"action_semantics":"s"}}', "learning", ["状态：24维状态：a、b", "环境：湍流风场；层级："], ["动作：（s）"], ["控制输出：s"]),
    ('{"paper":{},"outputs":{},"wind_adaptation":{"enabled":false,"update_target":{"updated_variable":"d"}},"control":{"inner_loop_type_and_controlled_variable":{"controlled_variable":"roll"}}}', "control", ["g"], ["导航/引导：极坐标航迹量 + waypoint/heading 参考", "控制： roll", "监督：混合状态机协同绞盘/俯仰"], ["风向对齐输出：d"]),
]


def test_record_shapes_and_lines(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RECORDS)], "i int, js string").select("i", F.parse_json("js").alias("record"))
    got = R.slots(df, {k: F.array(F.lit("g")) for k in R.SLOTS}).orderBy("i").collect()
    for row, (_, *want) in zip(got, RECORDS, strict=True):
        assert [row.shape, row.inputs, row.methods, row.outputs] == want


def test_numbers_as_texts(spark):
    values = [0.0, 0.25, 2.0, -1.5, 1234567.0, 0.00001234, 3.14159265, 100.0, 1e20]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", R.general(F.col("x")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [f"{v:g}" for v in values]


def test_vectors_meet_alike_in_any_blocks(spark):
    r = random.Random(5)
    rows = [(i, [round(r.gauss(0, 1), 1) for _ in range(3)]) for i in range(120)] + [(200, [1.0, 0.0, 0.0]), (201, [2.0, 0.0, 0.0]), (202, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [sorted(map(tuple, G.vector_knn_edges(df, 0.9, 2, blocks=b).collect())) for b in (1, 5)]
    unit = {i: np.array(v, np.float32).astype(float) / n for i, v in rows if (n := np.linalg.norm(np.array(v, np.float32).astype(float)))}
    best = {}
    for i in unit:
        near = sorted((-round(float(unit[i] @ unit[j]), 9), j) for j in unit if j != i and unit[i] @ unit[j] >= 0.9)[:2]
        for s, j in near:
            best.setdefault((min(i, j), max(i, j)), (i, j, round(-s, 3)))
    assert got[0] == got[1] and [x[:2] for x in got[0]] == sorted(x[:2] for x in best.values())


def test_stop_words_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "the whereupon method", "of", "")], "paper_id long, title string, abstract string, authors string")
    terms = lambda **k: {r.term for r in G.tokens(df, **k).collect()}
    assert terms() == {"whereupon", "method", "whereupon method"} and terms(stop_words=["the", "of", "whereupon"]) == {"method"}


def test_merge_primitives_plain(spark):
    r = random.Random(1)
    rows = [(p, 1, i, box, col, f"s{i % 3}") for p in range(6) for i, box, col in boxes(r, 12)]
    df = spark.createDataFrame(rows, f"pdf_id long, page long, region_id long, rect {P.RECT}, column_id string, source string")
    got = {(x.pdf_id, x.region_id): (tuple(x.rect), x.column_id, tuple(x.sources)) for x in P.merge_primitives(df).collect()}
    want = {}
    for p in range(6):
        groups = []
        for row in sorted((x for x in rows if x[0] == p), key=lambda x: (x[3]["y0"], x[3]["x0"], x[2])):
            b = row[3]
            for g in groups:
                u = {"x0": min(m[3]["x0"] for m in g), "y0": min(m[3]["y0"] for m in g), "x1": max(m[3]["x1"] for m in g), "y1": max(m[3]["y1"] for m in g)}
                col = "full" if any(m[4] == "full" for m in g) else g[0][4]
                if not (col == b or col == row[4] or "full" in (col, row[4])):
                    continue
                near_x, near_y = gap(u["x0"], u["x1"], b["x0"], b["x1"]), gap(u["y0"], u["y1"], b["y0"], b["y1"])
                over_x, over_y = share(u["x0"], u["x1"], b["x0"], b["x1"]), share(u["y0"], u["y1"], b["y0"], b["y1"])
                if over_y > 0.32 and near_x <= 48 or over_x > 0.32 and near_y <= 14 or near_x < 14 and near_y < 14:
                    g.append(row)
                    break
            else:
                groups.append([row])
        for g in groups:
            u = (min(m[3]["x0"] for m in g), min(m[3]["y0"] for m in g), max(m[3]["x1"] for m in g), max(m[3]["y1"] for m in g))
            want[p, g[0][2]] = (u, "full" if any(m[4] == "full" for m in g) else g[0][4], tuple(dict.fromkeys(m[5] for m in g)))
    assert got == want


def test_assignment_takes_each_region_once(spark):
    from bibspark.plans import page_queries as Q

    got = Q._assigned(spark, SF, Q._Once(spark, SF)).collect()
    taken = [(r.pdf_id, r.page, i, "f" if len(r.region_ids) > 1 else None) for r in got for i in r.region_ids]
    assert len({t[:3] for t in taken}) == len(taken) and all(0 <= r.confidence <= 1 for r in got)


def test_assignment_prefers_the_later_of_equals_and_grows(spark):
    box = lambda x0, y0, x1, y1: {"x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)}
    caps = spark.createDataFrame([(1, 1, 10, "figure", box(50, 300, 250, 320), "full"), (1, 1, 11, "table", box(50, 500, 250, 520), "full")], f"pdf_id long, page long, caption_id long, kind string, rect {P.RECT}, column_id string")
    regions = spark.createDataFrame([(1, 1, 0, "figure", box(50, 200, 150, 290), "full"), (1, 1, 1, "figure", box(160, 200, 260, 290), "full"), (1, 1, 2, "figure", box(50, 20, 150, 60), "full"), (1, 1, 3, "table", box(50, 525, 250, 600), "full")], f"pdf_id long, page long, region_id long, kind string, rect {P.RECT}, column_id string")
    scores = spark.createDataFrame([(1, 1, 10, 0, "figure", 90.0), (1, 1, 10, 1, "figure", 90.0), (1, 1, 11, 3, "table", 150.0)], "pdf_id long, page long, caption_id long, region_id long, kind string, score double")
    got = {r.caption_id: (r.region_ids, round(r.confidence, 4)) for r in P.assign_regions(caps, regions, scores).collect()}
    assert got == {10: ([1, 0], round(90 / 115, 4)), 11: ([3], 1.0)}


def plain_figure(anchor, caption, lane, boxes, lanes, free):
    """The rule by one region after the other, until a whole round adds none."""
    group, grown = [anchor], list(boxes[anchor])
    share = lambda a0, a1, b0, b1: max(0, min(a1, b1) - max(a0, b0)) / min(a1 - a0, b1 - b0)
    apart = lambda a0, a1, b0, b1: max(0, b0 - a1, a0 - b1)
    above, more = boxes[anchor][3] <= caption[1] + 8, True
    while more:
        more = False
        for i, b in enumerate(boxes):
            lane_fits = lane == lanes[i] or "full" in (lane, lanes[i])
            if i in group or not free[i] or not lane_fits or (b[3] > caption[1] + 12 if above else b[1] < caption[3] - 12):
                continue
            rows = share(b[1], b[3], grown[1], grown[3]) >= 0.35 and apart(b[0], b[2], grown[0], grown[2]) <= (180 if lane == "full" else 56)
            edges = abs(b[1] - boxes[anchor][1]) <= 56 or abs(b[3] - boxes[anchor][3]) <= 56
            stack = apart(b[1], b[3], grown[1], grown[3]) <= 36 and share(b[0], b[2], grown[0], grown[2]) >= 0.18
            if rows or edges or stack:
                group.append(i)
                grown = [*map(min, grown[:2], b[:2]), *map(max, grown[2:], b[2:])]
                more = True
    return group


def test_figures_equal_the_plain_rule():
    r, several = random.Random(31), 0
    for _ in range(1500):
        starts = [(r.choice([50, 60, 120, 200, 320, 330]), r.randint(40, 700)) for _ in range(r.randint(1, 9))]
        boxes = sorted((x, y, x + r.randint(30, 250), y + r.randint(20, 160)) for x, y in starts)
        lanes, free = [r.choice(["left", "right", "full"]) for _ in boxes], [r.random() < 0.85 for _ in boxes]
        anchor, lane, y = r.randrange(len(boxes)), r.choice(["left", "right", "full"]), r.randint(40, 760)
        free[anchor] = True
        got = P.figure_of(anchor, [50, y, 300, y + 20], lane, np.array(boxes, float), np.array(lanes, object), np.array(free))
        assert got == plain_figure(anchor, [50, y, 300, y + 20], lane, boxes, lanes, free)
        several += len(got) > 2
    assert several > 100


def test_captions_of_late_pages_keep_apart(spark):
    """Line ids count within a page, and page 100 of one document isn't page 0 of the next."""
    rect = lambda y: {"x0": 50.0, "y0": y, "x1": 250.0, "y1": y + 10}
    places = [(d, p) for d in (1, 2) for p in (0, 1, 100, 1000)]
    lines = [(d, p, i, rect(100.0 + 30 * i), f"Fig. {i + 1} of {d} {p}", 9.0) for d, p in places for i in range(2)]
    df = spark.createDataFrame(lines, f"pdf_id long, page long, line_id long, rect {P.RECT}, text string, font_size double").withColumn("column_id", F.lit("full"))
    caps = P.captions(df)
    assert sorted(r.text for r in caps.collect()) == sorted(x[4] for x in lines)
    layout = spark.createDataFrame(places, "pdf_id long, page long").select("*", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit("single").alias("layout_type"), F.lit(None).cast(P.RECT).alias("left"), F.lit(None).cast(P.RECT).alias("right"))
    bands = P.fallback_band(caps, layout)
    regions = spark.createDataFrame([(d, p, 7, "figure", rect(20.0), "full") for d, p in places], f"pdf_id long, page long, region_id long, kind string, rect {P.RECT}, column_id string")
    first = caps.where("caption_id = 0 and page = 100")
    scores = first.select("pdf_id", "page", "caption_id", F.lit(7).cast("long").alias("region_id"), "kind", F.lit(100.0).alias("score"))
    assigned = P.assign_regions(caps, regions, scores)
    items = P.items(P.caption_ids(caps), assigned, bands, layout.select("pdf_id", "page", "width", "height")).collect()
    assert len(items) == len(lines) and sorted((r.pdf_id, r.page, r.caption_id) for r in items if r.status == "matched") == [(1, 100, 0), (2, 100, 0)]
    left = P.orphans(regions, assigned.withColumn("kind", F.lit("figure"))).collect()
    assert len(left) == len(places) - 2


def test_caption_lines(spark):
    rect = lambda y, x=50.0: {"x0": x, "y0": y, "x1": x + 200, "y1": y + 10}
    lines = [(1, 1, 0, rect(100.0), "Fig. 2 First", 9.0), (1, 1, 1, rect(113.0), "second", 9.0), (1, 1, 2, rect(126.0), "large", 14.0), (1, 1, 3, rect(200.0), "far", 9.0), (1, 1, 4, rect(300.0), "TABLE IV Top", 9.0), (1, 1, 5, rect(311.0), "Fig. 9 not a start", 9.0)]
    df = spark.createDataFrame(lines, f"pdf_id long, page long, line_id long, rect {P.RECT}, text string, font_size double").withColumn("column_id", F.lit("left"))
    got = {(r.kind, r.number_token): (r.text, r.lines) for r in P.captions(df).collect()}
    assert got == {("figure", "2"): ("Fig. 2 First second", 2), ("table", "4"): ("TABLE IV Top", 1)}


# sources and sinks


def test_read_openalex_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "W1", "title": "T", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "authorships": [{"author": {"display_name": "X"}}, {"author": null}], "doi": null}\n{"id": "W2"}\n')
    a, b = readers.read_openalex(spark, str(tmp_path / "a.json")).orderBy("openalex_id").collect()
    assert (a.abstract, a.authors, a.url, a.cited_by_count, a.is_open_access) == ("a b a", "X", "W1", 0, False) and (b.title, b.abstract, b.concepts) == ("", "", [])


def test_read_structures(spark, tmp_path):
    (tmp_path / "B.json").write_text('{"paper_id": "2", "bibliography": {"title": "t"}}')
    (tmp_path / "a.json").write_text('{"paper_id": "1"}')
    schema = "paper_id string, bibliography struct<title:string,year:int>"
    assert [r.paper_id for r in readers.read_structures(spark, str(tmp_path), schema).collect()] == ["1", "2"]
    (tmp_path / "c.json").write_text('{"paper_id": "1"}')
    with pytest.raises(ValueError, match="repeated paper_id 1"):
        readers.read_structures(spark, str(tmp_path), schema)


def test_inventory(spark, tmp_path):
    for name in ("b.pdf", "a.pdf", "x.txt"):
        (tmp_path / name).write_text(name)
    assert [r.name for r in readers.pdf_inventory(spark, str(tmp_path)).collect()] == ["a.pdf", "b.pdf"]
    assert [r.name for r in readers.pdf_inventory(spark, str(tmp_path), ["b.pdf", "c.pdf"]).collect()] == ["b.pdf"]


def test_sinks(spark, tmp_path):
    nodes, edges = spark.range(3).withColumnRenamed("id", "paper_id"), spark.createDataFrame([(0, 1, "cites"), (1, 2, "a")], "source_id long, target_id long, type string")
    sinks.export_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/summary")).first().asDict() == {"nodes": 3, "edges": 2, "relation_types": ["a", "cites"]}
    sinks.write_bundle({"single_paper_structures": nodes}, str(tmp_path / "one"), "t")
    (only,) = sinks.read_bundle(spark, str(tmp_path / "one"))[0].collect()
    assert (only.part, only.rows, only.pipeline_version) == ("single_paper_structures", 3, "v2_single_paper_only") and re.fullmatch(r"\d{4}(-\d\d){2} \d\d(:\d\d){2}", only.generated_at)
    sinks.write_bundle({"single_paper_structures": nodes, "direction_mapping": edges}, str(tmp_path / "b"), "t")
    manifest, parts = sinks.read_bundle(spark, str(tmp_path / "b"))
    assert {r.part: r.rows for r in manifest.collect()} == {k: df.count() for k, df in parts.items()} == {"single_paper_structures": 3, "direction_mapping": 2}
    with pytest.raises(ValueError, match="known parts"):
        sinks.write_bundle({"edges": edges}, str(tmp_path / "x"), "t")
    tables = spark.createDataFrame([(1, [["a ", None], ['q"x', "b"]]), (2, [[" ", None]])], "table_id long, rows array<array<string>>")
    sinks.write_table_csv(tables, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), escape='"').collect()
    assert sorted((r._c0, r._c1) for r in back) == [('a', None), ('q"x', "b")]
    sinks.write_directions(spark.createDataFrame([("D1", "x/y", 1)], "direction_id string, direction_name string, n int"), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first().stem.startswith("D1_x_y_")


# streams


def test_ingest_equals_one_insert(spark, tmp_path):
    docs = view(spark, SF, "papers").select("paper_id", "title", "source")
    for i in range(4):
        docs.where(F.col("paper_id") % 4 == i).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    for i in range(4):
        for f in (tmp_path / f"in/part{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}.parquet")
    flat = str(tmp_path / "in")
    stream = incremental.as_stream(spark, flat, docs.schema, 1)
    empty = spark.createDataFrame([], "paper_id long, title string, source string")
    incremental.ingest_papers(stream.where("title is not null"), empty, str(tmp_path / "lib"), str(tmp_path / "cp"), lambda df: df.withColumnRenamed("paper_id", "pos"))
    lib = incremental.library_of(spark, str(tmp_path / "lib"))
    ids = [r.paper_id for r in lib.orderBy("paper_id").collect()]
    assert ids == list(range(1, docs.select("title").distinct().count() + 1)) and lib.select("title").distinct().count() == len(ids)


def test_ingest_goes_on_after_a_stop(spark, tmp_path):
    """A batch that dies and is run again gives the same ids, and reads nothing that others have written but one number."""
    write = lambda *rows: spark.createDataFrame(rows, "title string, source string, pos long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    lib = spark.createDataFrame([(7, "Old", "s")], "paper_id long, title string, source string")
    write(("B", None, 5), ("A", "x", 9), ("B", "late", 6), (None, "n", 1))
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    run = lambda: incremental.ingest_papers(incremental.as_stream(spark, f"{tmp_path}/in", schema), lib, f"{tmp_path}/lib", f"{tmp_path}/cp")
    got = lambda: sorted(tuple(r) for r in incremental.library_of(spark, f"{tmp_path}/lib").collect())
    run()
    assert got() == [(8, "B", "unknown"), (9, "A", "x")]
    write(("A", "again", 1), ("C", "y", 3), ("Old", "z", 2), ("D", "y", 1))
    run()
    want = [(8, "B", "unknown"), (9, "A", "x"), (10, "D", "y"), (11, "C", "y")]
    assert got() == want
    (tmp_path / "cp/commits/1").unlink()  # as if it had died before the batch was committed
    (tmp_path / "cp/commits/.1.crc").unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "lib/papers/batch=0")  # no later batch needs it
    run()
    assert got() == want[2:]


def test_process_pending_skips_done(spark, tmp_path):
    write = lambda *stems: spark.createDataFrame([(x,) for x in stems], "stem string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    write("a", "b", "b", None, "old")
    schema, ran, dies = spark.read.parquet(f"{tmp_path}/in").schema, [], []

    def step(df):
        if dies:
            raise RuntimeError(dies.pop())
        ran.append(sorted(r.stem for r in df.collect() if r.stem))
        return df.withColumn("out", F.upper("stem"))

    done = spark.createDataFrame([("old",)], "stem string")
    run = lambda **more: incremental.process_pending(incremental.as_stream(spark, f"{tmp_path}/in", schema), step, f"{tmp_path}/out", f"{tmp_path}/cp", outputs=done, **more)
    run()
    write("b", "c")
    dies.append("killed")
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    assert ran == [["a", "b"], ["c"]]
    assert sorted(r.out for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["A", "B", "C"]
    incremental.process_pending(incremental.as_stream(spark, f"{tmp_path}/in", schema), step, f"{tmp_path}/all", f"{tmp_path}/cp2", True, done)
    assert ran[2] == ["a", "b", "c", "old"]


def test_windowed_telemetry(spark):
    df = view(spark, SF, "run_records").withColumn("started_at", F.col("started_at").cast("timestamp"))
    assert incremental.event_counts(df).agg(F.sum("runs")).first()[0] == df.count()


def test_clean_corpus_counts(spark):
    cleaned, counts = T.clean_corpus(spark.createDataFrame([("a  b", "x"), ("c", "x")], "t string, u string"), {"t": "clean_inline", "k": ("u", T.title_key)})
    assert sorted(tuple(r) for r in counts.collect()) == [("k", 0), ("t", 1)] and sorted(r.t for r in cleaned.collect()) == ["a b", "c"]


def test_plan_without_a_cap(spark):
    rows = spark.range(1_000_013).selectExpr("0L round", "id q_pos", "if(id % 500000 = 1, ' ', concat(' q', id)) query", "'X ' source")
    assert S.normalize_plan(rows, None).count() == 1_000_010 and S.normalize_plan(rows).count() == 6
    assert "Window" not in S.normalize_plan(rows, None)._jdf.queryExecution().executedPlan().toString()


def test_index_gives_what_the_whole_library_gives(spark, tmp_path):
    """Blocks of two papers and one seed block, so that most blocks are left out by their bounds; ties, nulls, empty and
    repeated texts, a corpus of its own, an appended part, and a part that is written again."""
    r = random.Random(11)
    words = ["alpha", "beta", "gamma", "Été", "x_1", "delta"]
    rows = [(i, " ".join(r.choices(words, [9, 5, 3, 2, 1, 1], k=r.randint(0, 12))) if i % 9 else None, None if i % 7 else "beta beta", "", r.choice(["a", "b"])) for i in range(120)]
    papers = spark.createDataFrame(rows, "paper_id long, title string, abstract string, authors string, corpus string")
    asked = [(i, " ".join(r.choices([*words, "unknown"], k=r.randint(0, 3))), r.choice(["a", "b", "c"])) for i in range(60)]
    queries = spark.createDataFrame(asked, "q_id long, query string, corpus string")
    path = f"{tmp_path}/index"
    for part in (0, 1, 1):
        index = L.build_index(papers.where(F.col("paper_id") % 2 == part), path, part, buckets=7, block=2)
    got = lambda k: sorted(map(tuple, L.search_index(index, queries, k, seeds=1).collect()))
    for k in (1, 3, None):
        want = sorted(map(tuple, L.search_text(papers, queries, k).collect()))
        assert got(k) == want and len(want) > 20
    empty = L.build_index(papers.limit(0), f"{tmp_path}/none")
    assert L.search_text(empty, queries).count() == 0 and L.search_text(index, queries.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [0, 3, 10**9])
def test_block_products_equal_brute_force(spark, dense, monkeypatch):
    """Entry by entry or in dense columns, in one block or many, with few products at once; ties by place in the list."""
    monkeypatch.setattr(G, "DENSE", dense)
    monkeypatch.setattr(G, "PRODUCTS", 5)
    r = random.Random(dense)
    vectors = {i: {f"t{x}": r.random() for x in r.sample(range(30), r.randint(1, 6))} for i in range(40)} | {100 + i: {"same": 1.0} for i in range(15)} | {200: {"alone": 1.0}}
    for v in vectors.values():
        norm = sum(w * w for w in v.values()) ** 0.5
        v.update({t: w / norm for t, w in v.items()})
    score = lambda a, b: sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items())
    weights = spark.createDataFrame([(i, t, w) for i, v in vectors.items() for t, w in v.items()], "paper_id long, term string, w double")
    places = spark.createDataFrame([(i, -i) for i in vectors], "paper_id long, pos long")
    want = {(a, b): round(score(a, b), 9) for a in vectors for b in vectors if a < b and score(a, b) >= 0.4}
    best = {a: sorted(((-round(score(a, b), 9), -b, b) for b in vectors if b != a and score(a, b) >= 0.4))[:2] for a in vectors}
    edges = {}
    for a in sorted(vectors, key=lambda x: -x):
        for s, _, b in best[a]:
            edges.setdefault((min(a, b), max(a, b)), (a, b))
    for blocks in (1, 4):
        assert {(x.a, x.b): round(x.score, 9) for x in G.cosine_pairs(weights, 0.4, blocks).collect()} == want
        got = G.similar_edges(weights, places, 0.4, 2, blocks).collect()
        assert sorted((x.source_id, x.target_id) for x in got) == sorted(edges.values())
        assert sorted((x.source_id, x.target_id) for x in G.knn_edges(G.cosine_pairs(weights, 0.4, blocks), places, 2).collect()) == sorted(edges.values())


def test_copies_give_no_more_than_k_neighbours():
    """3,000 copies of one vector: each has k neighbours of a pair of blocks, the first in the list."""
    n, k = 3000, 3
    ids = np.arange(n)
    out = G.directed(np.ones((n, n)), ids, -ids, ids, -ids, True, 0.18, k)
    assert len(out) == n * k and set(out["t"].to_pylist()) == {n - 1, n - 2, n - 3, n - 4}


def test_far_blocks_are_skipped():
    block = lambda words: G.Block.of(pa.table({"terms": [[1, 2], [words]], "ws": [[0.1, 0.2], [0.1]], "paper_id": [1, 2], "pos": [0, 0]}))
    assert G.block_scores(block(7), block(8), 0.18) is None and G.block_scores(block(7), block(7), 0.04) is not None
    assert G.block_scores(block(7), G.Block.of(pa.table({"terms": pa.array([[]], pa.list_(pa.int64())), "ws": pa.array([[]], pa.list_(pa.float64())), "paper_id": [3], "pos": [0]})), 0.1) is None
