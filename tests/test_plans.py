"""Plans: no cross products where keys exist, top-k cut before the exchange, columns pruned at the scan."""

import pyarrow as pa
import pytest
from bibspark.plans import library_queries, page_queries, record_queries
from bibspark.plans.fixtures import view
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("f", [library_queries.e3_cosine_pairs, library_queries.e6_vector_knn_edges, page_queries.g1_rects, page_queries.g8_figure_primitives], ids=lambda f: f.__name__)
def test_no_cross_product(spark, f):
    p = plan(f(spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_top_k_is_cut_before_the_exchange(spark):
    assert "WindowGroupLimit" in plan(library_queries.e5_knn_edges(spark, SF))
    assert "TakeOrderedAndProject" in plan(library_queries.c2_list_papers(spark, SF))


def test_block_products_shuffle_vectors_once(spark):
    """Of the similar pairs only the vectors are exchanged after the weights: by paper for the vector, by pair of blocks."""
    weights = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0)], "paper_id long, term string, w double")
    from bibspark.operators.graph import cosine_pairs

    p = plan(cosine_pairs(weights, blocks=2))
    p = p.split("== Initial Plan ==")[-1]
    assert p.count("Exchange") == 2 and "FlatMapGroupsInArrow" in p and "Join" not in p


def test_scan_reads_the_needed_columns(spark):
    from bibspark.operators.telemetry import stage_totals

    p = plan(stage_totals(view(spark, SF, "run_records")))
    assert "event_type" in p and "props" not in p.split("ReadSchema")[-1]


def test_no_python_in_relational_jobs(spark):
    for f in (library_queries.e2_tfidf, library_queries.c4_search_text, page_queries.g3_columns_by_anchor):
        p = plan(f(spark, SF))
        assert "Python" not in p and "Arrow" not in p and "Pandas" not in p


def test_index_reads_the_buckets_of_asked_terms_only(spark, tmp_path):
    from bibspark.operators import library as L

    papers = view(spark, SF, "papers")
    index = L.build_index(papers, f"{tmp_path}/index")
    term = L.tokenised(papers).selectExpr("explode(w) as t").first().t
    asked = spark.createDataFrame([(1, term)], "q_id int, query string")
    p = plan(L.search_text(index, asked))
    scans = [x for x in p.split("PartitionFilters: [")[1:] if "bucket" in x.split("]")[0]]
    bucket = asked.select(L._bucket(F.col("query"), L.BUCKETS).alias("b")).first().b
    assert scans and all(f"(bucket#" in x.split("]")[0] and f" = {bucket})" in x.split("]")[0] for x in scans)
    assert index.postings.select("bucket").distinct().count() > 10


def test_places_of_terms_are_summed_where_their_lists_are(spark, tmp_path, monkeypatch):
    """Lists move by query and block, to as many tasks as their places ask for; no place moves alone, and the hits of a
    query without a bound are numbered in ranges, not in one group."""
    from bibspark.operators import library as L

    monkeypatch.setattr(L, "PLACES", 20)
    papers = spark.range(300).selectExpr("id as paper_id", "'alpha beta' as title", "'' as abstract", "'' as authors")
    index = L.build_index(papers, f"{tmp_path}/index", buckets=3, block=16)
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "q_id int, query string")
    p = plan(L.search_text(index, asked, 5)).split("== Initial Plan ==")[-1]
    dealt = [x.split("(", 1)[1] for x in p.split("Exchange hashpartitioning")[1:] if "REPARTITION_BY_NUM" in x.split("\n")[0]]
    assert dealt and all("block" in x.split("REPARTITION")[0] for x in dealt) and any(int(x.split("), REPARTITION")[0].rsplit(" ", 1)[-1]) > 5 for x in dealt)
    assert not any("paper_id" in x.split("\n")[0] for x in p.split("Exchange hashpartitioning")[1:])
    every = L.search_text(index, asked, None)
    assert "row_number" not in plan(every)
    assert sorted((x.q_id, x.hit_pos, x.paper_id) for x in every.collect()) == [(q, i + 1, 299 - i) for q in (1, 2) for i in range(300)]


def test_papers_are_listed_in_small_bunches(spark, tmp_path):
    from bibspark.operators import library as L

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    L.build_index(view(spark, SF, "papers"), f"{tmp_path}/index", buckets=2)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_both_rounds_read_hits_found_once(spark):
    from bibspark.plans import search_queries

    for half in search_queries._rounds(spark, SF):
        p = plan(half)
        assert "Join" not in p and "Window" not in p and "Exchange" not in p


def test_no_text_meets_its_record(spark):
    p = plan(record_queries.f12_spec_slots(spark, SF)).split("== Initial Plan ==")[-1]
    assert "Join" in p and "model_outputs#" not in p.split("Join")[0]


def test_long_lists_are_read_ahead_only(spark):
    """The same terms, whether the first items give enough, too few, or blanks and repeats."""
    from bibspark.operators import records as R

    r = [["a", "b", "c", "d"] * 9, ["", "x", "X", "x_"] * 9 + ["y", "z"], [""] * 40, [], None, ["q"], [None, "m", "n", "o"]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(r)], "i int, v array<string>")
    got = df.select("i", R.unique_terms(F.col("v"), 3, 20, 4).alias("ahead"), R.unique_terms(F.col("v"), 3, 20).alias("whole")).orderBy("i").collect()
    assert all(x.ahead == x.whole for x in got) and got[0].ahead == ["a", "b", "c"] and got[1].ahead == ["x", "y", "z"]


def test_a_baseline_is_copied_for_its_papers(spark):
    from bibspark.operators import records as R

    order = spark.range(1, 40).selectExpr("if(id < 35, 'a', 'b') as direction_id", "id as paper_id", "if(id < 35, id, id - 34) as pos")
    papers = spark.range(100).selectExpr("id as paper_id", "id * 2 as own")
    base = spark.createDataFrame([("a", 7), ("b", 8)], "direction_id string, base int")
    out = R.with_base(order, papers, base, 10)
    assert sorted((x.direction_id, x.paper_id, x.own, x.base) for x in out.collect()) == [("a" if i < 35 else "b", i, 2 * i, 7 if i < 35 else 8) for i in range(1, 40)]


def test_items_read_page_sizes_and_caption_numbers_once(spark):
    """They are written once: no step of the last plan reads the given tables or numbers the captions again."""
    p = plan(page_queries.g15_items(spark, SF))
    assert "documents.parquet" not in p and "part.parquet" not in p and "row_number" not in p


def test_mapping_is_checked_in_one_pass(spark):
    """Facts are read as written: one aggregate, one anti join, none for each rule."""
    p = plan(record_queries.f5_validate_mapping(spark, SF)).split("== Initial Plan ==")[-1]
    assert p.count("Exchange") <= 3 and p.count("FileScan") <= 4 and "NestedLoop" not in p


def test_merged_relations_work_out_the_products_once(spark, monkeypatch):
    from bibspark.operators import graph

    calls, similar = [], graph.similar_edges
    monkeypatch.setattr(graph, "similar_edges", lambda *a, **k: calls.append("edges") or similar(*a, **k))
    monkeypatch.setattr(graph, "cosine_pairs", lambda *a, **k: calls.append("pairs"))
    library_queries.QUERIES["e9_merge_relations"](spark, "/root/testdata/sf0.001")
    assert calls == ["edges"]


def test_terms_are_counted_where_texts_are_read(spark):
    """No term is exchanged to be counted, and once only, by term, for the weights; copies of an id are added up."""
    papers = view(spark, SF, "papers")
    from bibspark.operators import graph as G

    assert "Exchange" not in plan(G.tokens(papers))
    p = plan(G.tfidf(G.tokens(papers), 100)).split("== Initial Plan ==")[-1]
    assert p.count("hashpartitioning(term#") == p.count("Window [") and p.count("hashpartitioning(paper_id#") == 1 and "BroadcastHashJoin" in p
    rows = [(1, "Deep nets", "deep", None), (1, None, "nets deep", ""), (2, "", "of the", ""), (None, "x1", "", ""), (None, "x1 x1", "", "")]
    df = spark.createDataFrame(rows, "paper_id long, title string, abstract string, authors string")
    got = {(r.paper_id, r.term): r.tf for r in G.tokens(df).collect()}
    assert got == {(1, "deep"): 3, (1, "nets"): 2, (1, "deep nets"): 1, (1, "nets deep"): 2, (None, "x1"): 3, (None, "x1 x1"): 1}


def test_terms_of_one_paper_count_for_norms_only(spark):
    from bibspark.operators import graph as G

    papers = view(spark, SF, "papers")
    counts, n = G.tokens(papers).cache(), papers.count()
    every, met = ({(r.paper_id, r.term): round(r.w, 9) for r in G.tfidf(counts, n, **how).collect()} for how in ({}, {"for_papers": True, "shared": True}))
    df = {}
    for _, term in every:
        df[term] = df.get(term, 0) + 1
    assert met == {k: w for k, w in every.items() if df[k[1]] > 1} and met != every


def test_inverted_indexes_are_made_within_rows(spark):
    from bibspark.plans import source_queries

    for f in (source_queries.a1_read_openalex, source_queries.a2_inverted_index):
        assert "Exchange" not in plan(f(spark, SF))
    from bibspark.functions.text import positions

    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None)], "k long, w array<string>")
    got = {r.k: r.m for r in df.select("k", F.map_from_entries(positions(F.col("w"), "w", "p")).alias("m")).collect()}
    assert got == {1: {"a": [1], "b": [0, 2]}, 2: None, 3: None}


@pytest.mark.parametrize(("levels", "compared"), [((0.999, 0.8), 0), ((0.95,), 0), ((), 1)])
def test_heaviest_edges_are_those_of_all_pairs(spark, monkeypatch, levels, compared):
    """Copies in order and out of order, edits, short and empty texts; the pairs of all papers are left alone if they can be."""
    from bibspark.operators import graph as G

    text = [" ".join(f"w{(i * j) % 97}x{i}" if j % 4 else f"c{j}" for j in range(1, 60)) for i in range(6)]
    rows = [(i, text[i % 6] + (" more" if i % 5 == 4 else f" u{i} v{i}" if i % 7 == 6 else "")) for i in range(40)] + [(50, ""), (51, "the of"), (52, "x9"), (53, "x9")]
    papers = spark.createDataFrame([(i, "", t, "") for i, t in rows], "paper_id long, title string, abstract string, authors string").withColumn("pos", (F.col("paper_id") * 7) % 53)
    every = G.similar_edges(G.tfidf(G.tokens(papers), papers.count()), papers)
    best = lambda edges: [tuple(r) for r in edges.orderBy(F.desc("weight"), "source_id", "target_id").limit(12).collect()]
    want, calls, similar = best(every), [], G.similar_edges
    monkeypatch.setattr(G, "similar_edges", lambda *a, **k: calls.append(1) or similar(*a, **k))
    assert best(G.heaviest_edges(papers, levels=levels)) == want and len(want) == 12 and len(calls) == compared


def test_blocks_are_few_and_compared_part_by_part(spark, monkeypatch):
    """What is shuffled is rows times blocks: 512,820 papers meet in 33 blocks, not in 257; parts of three rows give what
    one part gives, and no more than top_k rows of a paper leave a task."""
    from bibspark.operators import graph as G

    assert G.block_count(512_820, G.PAPERS) == 33 and G.block_count(512_820, G.VECTORS) == 9
    assert [G.block_count(n, G.PAPERS) for n in (0, 1, 2_001, 10_000, 100_000)] == [1, 1, 2, 5, 8]
    papers = view(spark, SF, "papers").limit(60)
    weights, places = G.tfidf(G.tokens(papers), 60).cache(), G.newest(papers, None)
    vectors = view(spark, SF, "embeddings").limit(60)
    got = []
    for part in (2_000, 3):
        monkeypatch.setattr(G, "BLOCK", part)
        made = (G.cosine_pairs(weights, 0.05, 2).selectExpr("a", "b", "round(score, 9)"), G.similar_edges(weights, places, 0.05, 3, 2), G.vector_knn_edges(vectors, 0.1, 3, 2))
        got.append([sorted(map(tuple, df.collect())) for df in made])
    assert got[0] == got[1] and all(len(x) > 30 for x in got[0])
    rows = [pa.table({"s": [1, 1, 1, 2], "t": [i, i + 3, i + 6, 9], "score": [0.5, 0.5, 0.9, 0.2], "ps": [0] * 4, "pt": [i, i + 3, i + 6, 9]}) for i in (2, 1)]
    assert [(r["s"], r["t"]) for r in G.best_of(rows, 2).to_pylist()] == [(1, 7), (1, 8), (2, 9), (2, 9)]


def test_as_many_queries_as_papers_write_no_postings(spark, monkeypatch):
    """Neither occurrences of words nor pairs of a query and a paper are written: what a query keeps is its best hits."""
    from bibspark.operators import library as L

    papers = spark.range(100).selectExpr("id paper_id", "concat('own', id) title", "concat_ws(' ', transform(sequence(1, 60), i -> concat('w', i))) abstract", "'' authors")
    written, write = [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, label: written.append(out := write(df, label)) or out)
    hits = L.search_text(papers, papers.selectExpr("paper_id q_id", "concat(abstract, ' ', title) query"), 3)
    assert sorted((r.q_id, r.paper_id, r.hit_pos) for r in hits.collect()) == [(i, i, 1) for i in range(100)]
    assert max(df.count() for df in written) <= 100


@pytest.mark.parametrize("k", [2, None])
def test_matched_blocks_are_all_hits(spark, monkeypatch, k):
    """Small blocks and few places at once, collections, papers of several rows and queries of equal words."""
    import math
    from collections import Counter

    from bibspark.operators import library as L

    monkeypatch.setattr(L, "MATCH_LEAST", 7)
    monkeypatch.setattr(L, "AT_ONCE", 5)
    rows = [(i, "ab"[i % 2], " ".join(f"w{j}" for j in range(12) if (i * 7 + j * j) % 5 < 3) + " w1" * (i % 3)) for i in range(40)]
    rows += [(3, "b", "w1 w2"), (4, "a", "w0 w3 w5"), (5, "b", rows[5][2]), (99, None, "w1"), (98, "a", "")]
    asked = [(q, "ab"[q % 2], " ".join(f"w{j}" for j in range(12) if (q >> j % 4) & 1)) for q in range(24)] + [(50, "a", "w1 none"), (51, None, "w1")]
    papers = spark.createDataFrame(rows, "paper_id long, corpus string, title string").selectExpr("*", "'' abstract", "'' authors")
    got = L.search_text(papers, spark.createDataFrame(asked, "q_id long, corpus string, query string"), k).collect()
    want = set()
    for q, c, text in asked:
        whole = {}
        for i, d, t in rows:  # rows of a paper that are as long count together
            if d == c and c is not None:
                whole.setdefault((i, len(t.split())), Counter()).update(t.split())
        n, mean, df = len(whole), sum(x[1] for x in whole) / max(1, len(whole)), Counter(t for w in whole.values() for t in w)
        terms, met = set(text.split()), {}
        for (i, length), w in whole.items():
            met.setdefault(i, []).extend(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * w[t] * 2.2 / (w[t] + 1.2 * (0.25 + 0.75 * length / mean)) for t in terms & set(w))
        hits = sorted(((round(sum(s), 6), i) for i, s in met.items() if terms and len(s) == len(terms)), reverse=True)
        want |= {(q, i, s, at) for at, (s, i) in enumerate(hits[:k], 1)}
    assert {(r.q_id, r.paper_id, round(r.score, 6), r.hit_pos) for r in got} == want and len(want) > 20


def test_later_parts_add_few_cells(spark, monkeypatch):
    """Once a vector has its neighbours, only better ones are looked at: all cells over the threshold were before."""
    import numpy as np
    from bibspark.operators import graph as G

    r = np.random.default_rng(3)
    v = r.random((400, 6))
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    v[50] = v[150] = v[250] = v[350]
    parts = [G.Dense(v[a : a + 100], np.arange(a, a + 100), np.arange(a, a + 100)) for a in range(0, 400, 100)]
    cells, nearest = [], G.nearest
    monkeypatch.setattr(G, "nearest", lambda i, *a: cells.append(len(i)) or nearest(i, *a))
    got = G.best_neighbours(((a, parts[a], b, parts[b]) for a in range(4) for b in range(a, 4)), lambda x, y, least: x.v @ y.v.T, 0.1, 3)
    scores = np.round(v @ v.T, 9)
    want = {(s, t) for s in range(400) for t in sorted((t for t in range(400) if t != s), key=lambda t: (-scores[s, t], t))[:3]}
    assert set(zip(got["s"].to_pylist(), got["t"].to_pylist(), strict=True)) == want
    assert sum(cells) < 400 * 399 / 2


def test_parts_of_many_papers_are_stored_once(spark, monkeypatch):
    """Beyond a block's papers no vector is copied for each block that it meets; the rows are those of the blocks."""
    from bibspark.operators import graph as G

    papers = view(spark, SF, "papers")
    hashed = G.tokens(papers).withColumn("term", F.xxhash64("term"))
    weights, places = G.tfidf(hashed, papers.count(), for_papers=True, shared=True).cache(), G.newest(papers, None)
    rows = lambda df: sorted(map(tuple, df.collect()))
    ways = (lambda **how: rows(G.cosine_pairs(weights, 0.18, **how).selectExpr("a", "b", "round(score, 9)")), lambda **how: rows(G.similar_edges(weights, places, 0.18, 3, **how)))
    want, written, write = [f(blocks=3) for f in ways], [], G.materialize
    monkeypatch.setattr(G, "PAPERS", 20)
    monkeypatch.setattr(G, "materialize", lambda df, label: written.append((label, out := write(df, label))) or out)
    monkeypatch.setattr(G, "_blocks", None)
    assert [f() for f in ways] == want and all(len(x) > 100 for x in want)
    assert [label for label, _ in written] == ["parts", "parts"] and all(1 < df.count() <= papers.count() for _, df in written)


def test_texts_without_words_are_read(spark, tmp_path):
    """A blank text has no first word, which was an error of all four readers."""
    from bibspark.plans import source_queries as Q

    rows = [(0, "a b a", "en", "web", 5), (1, "", "en", "web", 0), (2, None, "en", "web", 0), (3, " \n ", "fr", "x", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for f in (Q.a1_read_openalex, Q.a3_read_crossref, Q.a4_read_arxiv, Q.a5_read_ieee):
        assert f(spark, str(tmp_path)).count() == len(f(spark, str(tmp_path)).collect()) == 4
    assert {(r.openalex_id[-1], r.title, r.concepts) for r in Q.a1_read_openalex(spark, str(tmp_path)).collect()} == {("0", "", "a|b|a"), ("1", "", ""), ("2", "", ""), ("3", "", "")}


def test_top_terms_are_cut_before_they_go_to_their_paper(spark, monkeypatch):
    from bibspark.operators import graph as G

    papers = view(spark, SF, "papers")
    counts, n = G.tokens(papers).cache(), papers.count()
    want = sorted(map(tuple, G.top_terms(G.tfidf(counts, n)).collect()))
    moved, rank = [], G.top_terms
    monkeypatch.setattr(G, "top_terms", lambda weights, k: moved.append(weights.count()) or rank(weights, k))
    assert sorted(map(tuple, G.top_terms_of(counts, n).collect())) == want and len(want) == n
    assert len(moved) == 1 and moved[0] < counts.count() / 4


def test_near_pairs_exchange_vectors_of_met_papers_only(spark, monkeypatch):
    from bibspark.operators import graph as G

    plans, near = [], G.near_pairs
    monkeypatch.setattr(G, "near_pairs", lambda *a: plans.append(plan(out := near(*a))) or out)
    assert library_queries.e10_judgement_candidates(spark, SF).count() == 12
    assert plans and all("Window" not in p and p.count("LeftSemi") == 2 for p in plans)


def test_norms_are_added_up_in_a_bounded_number_of_tasks(spark):
    """Each task that adds up squares has most papers, so as many tasks as partitions would exchange partitions times papers."""
    from bibspark.operators import graph as G

    p = plan(G.tfidf(G.tokens(view(spark, SF, "papers")), 100)).split("== Initial Plan ==")[-1]
    assert p.count(f"Coalesce {G.SUMS}") == 1 and p.index("hashpartitioning(paper_id#") < p.index(f"Coalesce {G.SUMS}")
