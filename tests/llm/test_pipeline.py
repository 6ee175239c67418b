import corpus_pipeline as cp
from bibspark.llm.common import connected_components, materialize, table

from .test_operators import brute_components, plain_base

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents").select(*cp.COLUMNS)
    extra = spark.createDataFrame([(90_001, None, "en", "s", None), (90_002, "... 12", None, None, 6), (None, "no id at all", None, None, 12)], docs.schema)
    docs = materialize(docs.union(extra), "docs")
    kept = {"documents": docs}
    for name, stage in cp.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == list(cp.COLUMNS)
        rows_in = [(r.doc_id, r.text) for r in before.collect()]
        rows = [(r.doc_id, r.text) for r in docs.collect()] if name != "packing" else []
        if name == "language_id":
            assert sorted(rows, key=repr) == sorted((r for r in rows_in if r[0] not in (90_001, 90_002)), key=repr)
        elif name == "exact_dedup":
            last = {}
            for i, t in rows_in:
                last[t] = max(last.get(t, -1), -1 if i is None else i)
            assert {t: -1 if i is None else i for i, t in rows} == last and len(rows) == len(last)
        elif name == "near_duplicates":
            want = brute_components([r for r in rows_in if r[0] is not None])
            assert {i for i, _ in rows if i is not None} == {i for i, (_, c) in want.items() if i == c}
        elif name == "personal_data":
            assert len(rows) == len(rows_in) and not any(plain_base(t) for _, t in rows)
            before_text = {i: t for i, t in rows_in}
            assert all(before_text[i] == t for i, t in rows if not plain_base(before_text[i]))
            assert all(r.n_chars == len(r.text) for r in docs.where("doc_id < 1000").collect())
        else:
            assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096
            assert docs.select("doc_id").distinct().count() == before.count()


def test_language_without_labels(spark):
    rows = [(1, "some words", None, "s", 10), (2, "", None, None, 0), (3, None, None, None, None), (4, "12 ...", None, "s", 6), (5, "中文", None, None, 2), (None, "no id", None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.text for r in cp.language(spark, docs, SF).collect()} == {"some words", "中文", "no id"}


def test_near_stage_loses_no_text_of_a_shared_id(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (5, " ".join([*words[:-1], "x"])), (5, "a text of its own that shares the id"), (7, " ".join([*words[1:], "y"])), (None, " ".join(words[2:])), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(((r.doc_id, r.text) for r in cp.near(spark, docs, SF).collect()), key=repr) == sorted((r for r in rows if r[0] != 7), key=repr)


def test_run_is_the_stages(spark):
    out = cp.run(spark, SF)
    assert out.count() > 0 and [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "near_duplicates", "personal_data", "packing"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, 90), (95, 100), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, 90: 90, 95: 90, 100: 90, 7: 7}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_private_stage_removes_terms_of_independent_documents(spark):
    """After the stages before it, a term beside one address in documents of their own goes; one beside copies doesn't."""
    own = lambda i, n: " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + j)}word" for j in range(n))
    rows = [(i, f"{own(i, 20)} projectx ann@corp.org {own(i + 300, 20)}") for i in range(6)]
    rows += [(10 + i, f"{own(400, 20)} copyterm bob@corp.net {own(401, 20)}{' end' * (i > 3)}") for i in range(6)]
    rows += [(100 + i, own(i + 100, 30)) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES[1:4]:
        docs = materialize(stage(spark, docs, SF), name)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(texts) == 207  # one of the copies
    assert not any("projectx" in t or "@" in t for t in texts.values())
    assert any("copyterm [EMAIL]" in t for t in texts.values())
