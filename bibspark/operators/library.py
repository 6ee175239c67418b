"""The paper library as a table: insertion, listing, lookup, search, paths."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import portable_path
from ..scratch import materialize

K1, B = 1.2, 0.75
#: Buckets of a stored index, papers of a block by id, and blocks of a query that are scored first.
BUCKETS, PAPER_BLOCK, SEED_BLOCKS = 64, 4096, 4
#: Blocks of a file of the index, words that are listed at once, and places of terms that a task scores, about.
SPAN, WORDS_AT_ONCE, PLACES = 64, 1 << 19, 1_000_000
#: Papers of a block that queries stream past, blocks that there are at least, of so many papers, and places that are looked
#: up at once.
MATCH_BLOCK, MATCH_SHARES, MATCH_LEAST, AT_ONCE = 16_384, 16, 512, 1 << 21
TOKEN = r"[\p{L}\p{N}_]+"
FIELDS = ("title", "abstract", "authors")
DEFAULTS = {"authors": "", "abstract": "", "arxiv_id": "", "doi": "", "ieee_id": "", "source": "unknown"}


def add_papers(library: DataFrame, batch: DataFrame) -> DataFrame:
    """The library with the batch's new titles (exact, case-sensitive); in the batch the first (by pos) wins.

    New ids continue the library's in batch order (see `dense_number`), so the batch is never sorted in one task. A paper
    that is there is left as it is.
    """
    first = batch.where("title is not null").withColumn("r", F.row_number().over(Window.partitionBy("title").orderBy("pos"))).where("r = 1").drop("r")
    new = first.join(library.select("title"), "title", "left_anti")
    top = library.agg(F.coalesce(F.max("paper_id"), F.lit(0)).alias("top"))
    numbered = dense_number(new, "pos", "n").crossJoin(F.broadcast(top)).withColumn("paper_id", F.col("top") + F.col("n")).drop("top", "n", "pos")
    return library.unionByName(numbered.fillna({k: v for k, v in DEFAULTS.items() if k in numbered.columns}), allowMissingColumns=True)


def dense_number(df: DataFrame, order: str, name: str, per_range: int = 1_000_000) -> DataFrame:
    """df with 1, 2, ... in the order of a column, without a global window.

    Rows are dealt out by ranges of the order, as many as the count asks for, whose bounds Spark samples; sorted ranges are
    written once. A row's number is its place in its range plus the counts of the ranges before, a number each.
    """
    ranges = max(1, -(-df.count() // per_range))
    cut = df.repartitionByRange(ranges, order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("__g"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("__i"))
    cut = materialize(cut, "numbered")
    counts = cut.groupBy("__g").agg(F.count("*").alias("c"))
    before = counts.select("__g", F.coalesce(F.sum("c").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return cut.join(F.broadcast(before), "__g").withColumn(name, F.col("__i") + F.col("__before") + 1).drop("__g", "__i", "__before")


def list_papers(library: DataFrame, limit: int = 50) -> DataFrame:
    return library.orderBy(F.desc("added_epoch"), F.desc("paper_id")).limit(limit)


def id_kind(c: Column) -> Column:
    """Which id a string is: 10. starts a DOI, all else an arXiv id."""
    return F.when(c.startswith("10."), "doi").otherwise("arxiv")


def get_papers(library: DataFrame, ids: DataFrame) -> DataFrame:
    """(kind, id, paper_id, title): for each wanted (kind, id) the library's paper, at most one (the smallest paper_id).
    Unknown kinds mean arxiv."""
    wanted = ids.select("kind", "id").distinct().withColumn("by", F.when(F.col("kind").isin("doi", "ieee"), F.col("kind")).otherwise("arxiv"))
    have = library.select("paper_id", "title", F.inline(F.array(*[F.struct(F.lit(k).alias("by"), F.col(f"{k}{'' if k == 'doi' else '_id'}").alias("id")) for k in ("doi", "arxiv", "ieee")]))).where("id <> ''")
    return wanted.join(have, ["by", "id"]).groupBy("kind", "id").agg(F.min_by(F.struct("paper_id", "title"), "paper_id").alias("p")).select("kind", "id", "p.paper_id", "p.title")


def words(*fields: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", *fields)), F.lit(TOKEN), F.lit(0))


def tokenised(library: DataFrame) -> DataFrame:
    """(paper_id, corpus, w, length): a paper's words. corpus, if the library has it, names the collection that it is in."""
    corpus = F.col("corpus") if "corpus" in library.columns else F.lit("").alias("corpus")
    return library.select("paper_id", corpus, words(*[F.coalesce(F.col(f), F.lit("")) for f in FIELDS]).alias("w")).withColumn("length", F.size("w"))


class Index(NamedTuple):
    """A stored inverted index.

    postings has a row for each term of a corpus and block of papers: how many papers (n), the largest tf, the smallest
    length, and their ids, tfs and lengths as arrays. It is stored by part (what was added at once) and bucket (a hash of
    the term), sorted by term. sizes has the papers and words (n, words) of each corpus and part.
    """

    postings: DataFrame
    sizes: DataFrame
    buckets: int


def build_index(library: DataFrame, path: str, part: int = 0, buckets: int = BUCKETS, block: int = PAPER_BLOCK) -> Index:
    """Index a library's papers (one row an id) into a folder, as one part of the index there; parts are of different papers.

    Appended papers are a new part, and a part that is written again replaces itself. Words are counted and listed where the
    texts are read (`_listed`), so a term crosses the network once for many papers, with three numbers for each. A file
    holds one bucket's terms for so many blocks of papers, so none grows with the library, however frequent a term is.
    """
    spark = library.sparkSession
    # a Python worker gets papers in small bunches, whatever a task reads
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    words = library if "w" in library.columns else tokenised(library)
    lists = words.where("corpus is not null").select("corpus", "paper_id", "w").mapInArrow(lambda batches: (t for b in batches for t in _listed(b, block)), LISTED)
    # as many tasks as there are files, each with one of them if ids are dense
    tasks = buckets * (1 + words.count() // (block * SPAN))
    lists = lists.withColumn("bucket", _bucket(F.col("term"), buckets)).withColumn("file", F.pmod(F.floor(F.col("block") / SPAN) * buckets + F.col("bucket"), F.lit(tasks)).cast("int")).repartitionById(tasks, "file")
    # the groups hold the key of the exchange, so nothing is moved again
    whole = lists.groupBy("file", "bucket", "term", "block", "corpus").agg(F.array_sort(F.collect_list(F.struct("ids", "tfs", "lengths"))).alias("l"))
    rows = whole.select("bucket", "corpus", "term", "block", *[F.flatten(F.col(f"l.{c}")).alias(c) for c in ("ids", "tfs", "lengths")]).select(
        "bucket", "corpus", "term", "block", F.size("ids").cast("long").alias("n"), F.array_max("tfs").alias("max_tf"), F.array_min("lengths").alias("min_length"), "ids", "tfs", "lengths",
    )
    rows.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/part={part}")
    said = spark.read.schema("corpus string, tfs array<int>").parquet(f"{path}/postings/part={part}").groupBy("corpus").agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words"))
    sizes = words.groupBy("corpus").agg(F.count("*").alias("n")).join(said, "corpus", "left").select("corpus", "n", F.coalesce("words", F.lit(0)).cast("long").alias("words"))
    sizes.write.mode("overwrite").parquet(f"{path}/sizes/part={part}")
    return open_index(spark, path, buckets)


LISTED = "corpus string, term string, block long, ids array<long>, tfs array<int>, lengths array<int>"


def _listed(batch: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
    """The lists of a batch of papers (corpus, paper_id, w): a row for each corpus, term and block of papers, ids ascending.

    So many papers are worked on at once that their words stay below a bound; a longer paper is one by itself.
    """
    size = pc.fill_null(pc.list_value_length(batch["w"]), 0).to_numpy().astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + WORDS_AT_ONCE, "right")))
        some, n = batch.slice(start, stop - start), size[start:stop]
        start = stop
        terms = some["w"].flatten().dictionary_encode()
        if not len(terms):
            continue
        corpus, paper = some["corpus"].dictionary_encode(), some["paper_id"].to_numpy()
        code = corpus.indices.to_numpy()
        order = np.lexsort((paper, code))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        # one number an occurrence, by term and then the paper's place
        key, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * len(order) + np.repeat(place, n), return_counts=True)
        term, at = np.divmod(key, len(order))
        at = order[at]
        of = (term, code[at], paper[at] // block)
        first = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in of], axis=0)]))
        offsets = pa.array(np.append(first, len(key)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                corpus.dictionary.take(pa.array(of[1][first])), terms.dictionary.take(pa.array(term[first])), pa.array(of[2][first], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(paper[at], pa.int64())),
                pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(n[at], pa.int32())),
            ],
            ["corpus", "term", "block", "ids", "tfs", "lengths"],
        )


def open_index(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Index:
    """The index in a folder, with all its parts; buckets is what it was built with."""
    listed = "bucket int, corpus string, term string, block long, n long, max_tf int, min_length int, ids array<long>, tfs array<int>, lengths array<int>, part int"
    return Index(spark.read.schema(listed).parquet(f"{path}/postings"), spark.read.schema("corpus string, n long, words long, part int").parquet(f"{path}/sizes"), buckets)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _bm25(n: Column, df: Column, tf: Column, length: Column, mean: Column) -> Column:
    """A term's part of the score; it grows with tf and falls with the length."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def search_index(index: Index, queries: DataFrame, k: int | None = 10, seeds: int = SEED_BLOCKS) -> DataFrame:
    """What `search_text` gives, from a stored index.

    Only the buckets of asked terms are read, and first only the figures of their blocks. A block of papers is a query's
    candidate if it has all of its terms; the largest tf and smallest length of each bound the score there. The most
    promising blocks of each query are scored first; of the others only those whose bound reaches the k-th score so
    far. Nothing is approximate.
    """
    corpus = F.col("corpus") if "corpus" in queries.columns else F.lit("").alias("corpus")
    asked = materialize(queries.select("q_id", corpus, F.explode(F.array_distinct(words(F.col("query")))).alias("term")).withColumn("bucket", _bucket(F.col("term"), index.buckets)), "asked")
    n_terms = asked.groupBy("q_id").agg(F.count("*").alias("n_terms"))
    terms = materialize(asked.select("bucket", "corpus", "term").distinct(), "terms")
    read = index.postings.where(F.col("bucket").isin([r.bucket for r in asked.select("bucket").distinct().collect()]))
    figures = materialize(read.select("bucket", "corpus", "term", "block", "n", "max_tf", "min_length").join(terms, ["bucket", "corpus", "term"], "left_semi"), "figures")
    # a table of terms as small as the optimizer's own bound is broadcast, so other terms' lists are never moved
    read = read.drop("n", "max_tf", "min_length").join(terms, ["bucket", "corpus", "term"], "left_semi")
    size = index.sizes.groupBy("corpus").agg(F.sum("n").alias("papers"), (F.sum("words") / F.sum("n")).alias("mean"))
    df = materialize(figures.groupBy("corpus", "term").agg(F.sum("n").alias("df")).join(size, "corpus"), "df")
    bound = figures.groupBy("corpus", "term", "block").agg(F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"), F.sum("n").alias("places")).join(df, ["corpus", "term"])
    bound = bound.select("corpus", "term", "block", "places", _bm25(F.col("papers"), F.col("df"), F.col("max_tf"), F.col("min_length"), F.col("mean")).alias("bound"))
    found = bound.join(asked, ["corpus", "term"]).groupBy("q_id", "block").agg(F.sum("bound").alias("bound"), F.sum("places").alias("places"), F.count("*").alias("c")).join(n_terms, "q_id").where("c = n_terms")
    best = Window.partitionBy("q_id").orderBy(F.desc("bound"), "block")
    blocks = materialize(found.select("q_id", "n_terms", "block", "bound", "places", F.row_number().over(best).alias("turn")), "blocks")

    def scored(chosen: DataFrame) -> DataFrame:
        # a query's lists of one block meet in one task, and there are as many tasks as the places on all lists ask for:
        # places are opened and summed where the lists are, and neither they nor a task's papers grow with the library
        places = chosen.agg(F.sum("places")).first()[0] or 0
        lists = chosen.select("q_id", "n_terms", "block").join(asked.join(df, ["corpus", "term"]), "q_id").join(read, ["bucket", "corpus", "term", "block"])
        dealt = lists.select("q_id", "n_terms", "block", "papers", "df", "mean", "ids", "tfs", "lengths").repartition(1 + places // PLACES, "q_id", "block")
        part = dealt.select("q_id", "n_terms", "block", "papers", "df", "mean", F.inline(F.arrays_zip("ids", "tfs", "lengths"))).select("q_id", "n_terms", "block", F.col("ids").alias("paper_id"), _bm25(F.col("papers"), F.col("df"), F.col("tfs"), F.col("lengths"), F.col("mean")).alias("w"))
        sums = part.groupBy("q_id", "block", "paper_id", "n_terms").agg(F.round(F.sum("w"), 6).alias("score"), F.count("*").alias("c"))
        return sums.where("c = n_terms").select("q_id", "paper_id", "score")

    if k is None:
        return numbered_hits(materialize(scored(blocks), "every"))
    hits = Window.partitionBy("q_id").orderBy(F.desc("score"), F.desc("paper_id"))
    first = materialize(scored(blocks.where(F.col("turn") <= seeds)).withColumn("hit_pos", F.row_number().over(hits)).where(F.col("hit_pos") <= k), "first")
    least = first.where(F.col("hit_pos") == k).select("q_id", F.col("score").alias("least"))
    open_ = materialize(blocks.where(F.col("turn") > seeds).join(least, "q_id", "left").where("least is null or bound >= least - 0.00001"), "open")
    every = first.drop("hit_pos").unionByName(scored(open_))
    return every.withColumn("hit_pos", F.row_number().over(hits)).where(F.col("hit_pos") <= k).select("q_id", "paper_id", "score", "hit_pos")


def numbered_hits(hits: DataFrame) -> DataFrame:
    """hits (q_id, paper_id, score) with hit_pos, however many one query has: all are numbered by query and place in
    ranges, and a query's first number is taken away."""
    placed = dense_number(hits.select("*", F.struct("q_id", -F.col("score"), -F.col("paper_id")).alias("o")), "o", "n").drop("o")
    first = placed.groupBy("q_id").agg(F.min("n").alias("first"))
    return placed.join(first, "q_id").select("q_id", "paper_id", "score", (F.col("n") - F.col("first") + 1).cast("int").alias("hit_pos"))


def search_text(library: DataFrame | Index, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """(q_id, paper_id, score, hit_pos): papers that hold all terms of a query, by BM25, best first; equal scores newest first.

    A stored index (`build_index`) is read where the terms are; without one, the whole library is matched with the queries
    block by block (`match_blocks`), which suits as many queries as papers. A query without terms has no hits. library may
    be `tokenised` before. With a corpus column in queries (and library), a query searches its corpus alone, which has its
    own statistics.
    """
    if isinstance(library, Index):
        return search_index(library, queries, k)
    tokens = (library if "w" in library.columns else tokenised(library)).where("corpus is not null")
    corpus = F.col("corpus") if "corpus" in queries.columns else F.lit("").alias("corpus")
    asked = queries.select("q_id", corpus, words(F.col("query")).alias("ws")).where("corpus is not null").groupBy("q_id", "corpus").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ws")))).alias("ws"))
    # queries of equal terms are one set
    asked = materialize(asked.where(F.size("ws") > 0).withColumn("said", F.sha2(F.concat_ws(" ", "corpus", "ws"), 256)), "asked")
    sets = asked.groupBy("said").agg(F.first(F.struct("corpus", "ws")).alias("a")).select("said", "a.corpus", "a.ws").withColumn("set", F.monotonically_increasing_id())
    sets = materialize(sets, "sets")
    found = materialize(match_blocks(tokens, sets.select("set", "corpus", "ws"), k), "found")
    # a set's hits are numbered once for all its queries
    ranked = found.withColumn("hit_pos", F.row_number().over(Window.partitionBy("set").orderBy(F.desc("score"), F.desc("paper_id"))))
    kept = (ranked.where(F.col("hit_pos") <= k) if k else ranked).join(sets.select("set", "said"), "set")
    return asked.select("q_id", "said").join(kept, "said").select("q_id", "paper_id", "score", "hit_pos")


def match_blocks(tokens: DataFrame, sets: DataFrame, k: int | None) -> DataFrame:
    """(set, paper_id, score): papers that hold all words of a set (set, corpus, ws); of a block of papers at most the k best.

    Papers are hashed into blocks of bounded size. A block is a task: it lists its papers by term, and the sets stream past
    it. So words are exchanged once with their paper, the sets once for each block, and neither a pair of a set and a
    paper nor a list of a term is ever exchanged. Terms are met by 64-bit hashes.
    """
    spark = tokens.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    again = tokens.groupBy("paper_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("paper_id").alias("again"))
    if not again.isEmpty():  # rows of a paper that are as long are one
        same = tokens["paper_id"] == F.col("again")
        whole = tokens.join(again, same, "left_semi").groupBy("paper_id", "corpus", "length").agg(F.flatten(F.collect_list("w")).alias("w"))
        tokens = tokens.join(again, same, "left_anti").select("paper_id", "corpus", "length", "w").unionByName(whole)
    hashed = lambda c: F.transform(c, lambda t: F.xxhash64("corpus", t))
    size = materialize(tokens.groupBy("corpus").agg(F.count("*").alias("n"), F.avg("length").alias("mean")), "size")
    rows = size.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, min(MATCH_SHARES, -(-rows // MATCH_LEAST)), -(-rows // MATCH_BLOCK))
    papers = tokens.select("paper_id", "corpus", "length", F.sort_array(hashed("w")).alias("terms")).join(F.broadcast(size), "corpus")
    papers = papers.select(F.pmod(F.xxhash64("paper_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), F.col("paper_id").cast("long").alias("id"), (K1 * (1 - B + B * F.col("length") / F.col("mean"))).alias("x"), "terms", F.array().cast("array<long>").alias("dfs"))
    df = tokens.select(F.explode(F.array_distinct(hashed("w"))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    of = sets.join(F.broadcast(size), "corpus").select("set", "n", F.size("ws").alias("size"), F.explode(hashed("ws")).alias("t")).join(df, "t")
    # a set with a word that no paper has is left out
    asked = of.groupBy("set", "n", "size").agg(F.collect_list(F.struct("t", "df")).alias("l")).where(F.size("l") == F.col("size"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), F.col("set").alias("id"), F.col("n").cast("double").alias("x"), F.col("l.t").alias("terms"), F.col("l.df").alias("dfs"))
    dealt = papers.unionByName(asked).repartitionById(blocks, "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(lambda batches: matches(batches, k), "set long, paper_id long, score double")


class Posted:
    """The papers of a block by term: for each term (at first) its rows in order, as keys of term and row, with their tfs."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        self.id, self.x, self.n = rows["id"].to_numpy(), rows["x"].to_numpy(), len(rows)
        lists = rows["terms"].combine_chunks()
        row = np.repeat(np.arange(self.n, dtype=np.int32), pc.list_value_length(lists).to_numpy())
        term = lists.flatten().to_numpy()
        order = np.argsort(term, kind="stable")
        self.terms, number = np.unique(term[order], return_inverse=True)
        key = number * self.n + row[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.keys, self.tf = key[at], np.diff(np.append(at, len(key)))
        self.first = np.searchsorted(self.keys, np.arange(len(self.terms) + 1) * self.n)
        self.paper, count = np.unique(self.id, return_inverse=True, return_counts=True)[1:]
        self.several = count[self.paper] > 1

    def place(self, term: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where rows are in their terms' lists, and whether they are there."""
        key = term * self.n + row
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.keys[at] == key

    def expand(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places on the lists of terms, and of which of the terms each is."""
        n = self.first[term + 1] - self.first[term]
        return np.repeat(self.first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(np.arange(len(term)), n)

    def weight(self, idf: np.ndarray, at: np.ndarray) -> np.ndarray:
        tf = self.tf[at]
        return idf * tf * (K1 + 1) / (tf + self.x[self.keys[at] % self.n])

    def found(self, sets: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(set's number in the batch, row, score) of all rows that hold a set's terms, all of a set's at once."""
        if not len(self.keys):
            return
        size = pc.list_value_length(sets["terms"]).to_numpy().astype(np.int64)
        q = np.repeat(np.arange(len(size)), size)
        term, df, n = sets["terms"].flatten().to_numpy(), sets["dfs"].flatten().to_numpy(), sets["x"].to_numpy()[q]
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        there = self.terms[at] == term
        if self.several.any():  # papers of several rows: terms count in each of them
            whole = np.ones(len(size), bool)
        else:
            whole = np.bincount(q[there], minlength=len(size)) == size
        use = there & whole[q]
        q, at, idf = q[use], at[use], idf[use]
        count = self.first[at + 1] - self.first[at]
        order = np.lexsort((count, q))  # the rarest here first
        q, at, idf, count = q[order], at[order], idf[order], count[order]
        some, start, here = np.unique(q, return_index=True, return_counts=True)
        load = np.cumsum(np.add.reduceat(count, start) if self.several.any() else count[start]) if len(some) else np.zeros(0)
        begin = 0
        while begin < len(some):
            stop = max(begin + 1, int(np.searchsorted(load, (load[begin - 1] if begin else 0) + AT_ONCE, "right")))
            s, first = slice(begin, stop), start[begin:stop]
            of, row = self.holders(at, first, here[s], here[s] == size[some[s]])
            score = np.zeros(len(of))
            ends, lo = np.cumsum(here[s][of]), 0
            while lo < len(of):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
                m = here[s][of[lo:hi]]
                e = np.repeat(np.arange(hi - lo), m)
                t = np.repeat(first[of[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                place, _ = self.place(at[t], row[lo:hi][e])
                score[lo:hi] = np.bincount(e, self.weight(idf[t], place), hi - lo)
                lo = hi
            parts = [(some[s][of], row, score)]
            if self.several.any():
                t = np.arange(first[0], first[-1] + here[s][-1])
                parts.append(self.in_several(q[t], at[t], idf[t], size))
            yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))
            begin = stop

    def holders(self, at: np.ndarray, first: np.ndarray, here: np.ndarray, able: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, row) of rows that hold all terms of a set: those on its rarest term's list that are on each other one."""
        able = np.flatnonzero(able)
        place, of = self.expand(at[first[able]])
        of, row = able[of], self.keys[place] % self.n
        alone = ~self.several[row]
        of, row, j = of[alone], row[alone], 1
        while (more := here[of] > j).any():
            keep = np.ones(len(of), bool)
            keep[more] = self.place(at[first[of[more]] + j], row[more])[1]
            of, row, j = of[keep], row[keep], j + 1
        return of, row

    def in_several(self, q: np.ndarray, at: np.ndarray, idf: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As found, for papers of several rows, which have as many places on the lists of a set's terms as it has terms."""
        place, of = self.expand(at)
        keep = self.several[self.keys[place] % self.n]
        place, of = place[keep], of[keep]
        row = self.keys[place] % self.n
        pair, one, back, c = np.unique(q[of] * self.n + self.paper[row], return_index=True, return_inverse=True, return_counts=True)
        score = np.bincount(back, self.weight(idf[of], place), len(pair))
        s, fits = pair // self.n, c == size[pair // self.n]
        return s[fits], row[one][fits], score[fits]


def matches(batches: Iterator[pa.RecordBatch], k: int | None) -> Iterator[pa.RecordBatch]:
    """The hits of rows (block, kind, id, x, terms, dfs) in order of block and kind: papers (0), then sets of words (1)."""
    block, papers, posted = None, [], None
    for batch in batches:
        of = batch["block"].to_numpy() * 2 + batch["kind"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            now, kind = divmod(int(of[a]), 2)
            if now != block:
                block, papers, posted = now, [], None
            if not kind:
                papers.append(batch.slice(a, b - a))
                continue
            if posted is None and papers:
                posted, papers = Posted(papers), []
            for s, row, score in posted.found(batch.slice(a, b - a)) if posted else ():
                ids, score = posted.id[row], np.round(score, 6)
                if k:
                    order = np.lexsort((-ids, -score, s))
                    s, ids, score = s[order], ids[order], score[order]
                    best = np.arange(len(s)) - np.searchsorted(s, s) < k
                    s, ids, score = s[best], ids[best], score[best]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a).take(pa.array(s)), pa.array(ids), pa.array(score)], ["set", "paper_id", "score"])


def search_like(library: DataFrame, keyword: str) -> DataFrame:
    """Papers with the pattern in a field, ASCII case ignored, newest first; % and _ are wildcards."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pattern = "%" + keyword.translate({i: i + 32 for i in range(65, 91)}) + "%"
    test = None
    for f in FIELDS:
        one = low(F.coalesce(F.col(f), F.lit(""))).like(pattern)
        test = one if test is None else test | one
    return library.where(test).orderBy(F.desc("added_epoch"), F.desc("paper_id"))


def update_paths(library: DataFrame, updates: DataFrame) -> DataFrame:
    """The library with pdf_path set, made portable, for the ids in updates (paper_id, new_path); last by pos wins."""
    last = updates.groupBy("paper_id").agg(F.max_by(portable_path(F.col("new_path")), "pos").alias("new_path"), F.lit(True).alias("hit"))
    return library.join(last, "paper_id", "left").withColumn("pdf_path", F.when(F.col("hit"), F.col("new_path")).otherwise(F.col("pdf_path"))).drop("new_path", "hit")


def normalize_paths(library: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The library with portable paths, and a row (checked, changed, filled).

    A paper without a path gets a file of the inventory (column path, below the library folder) named after its arXiv
    id, else after the id without its version.
    """
    files = inventory.select("path").distinct()
    named = lambda name: F.concat(F.lit("pdfs/"), name, F.lit(".pdf"))
    arxiv = F.when(F.col("arxiv_id") != "", F.col("arxiv_id"))
    lib = library.withColumn("norm", portable_path(F.col("pdf_path"))).withColumn("p1", named(arxiv)).withColumn("p2", named(F.split(arxiv, "v")[0]))
    joined = lib.join(files.select(F.col("path").alias("f1")), F.col("p1") == F.col("f1"), "left").join(files.select(F.col("path").alias("f2")), F.col("p2") == F.col("f2"), "left")
    new = F.coalesce("norm", "f1", "f2")
    out = joined.withColumn("new", new).withColumn("filled", F.col("norm").isNull() & F.col("new").isNotNull()).withColumn("changed", ~F.col("new").eqNullSafe(F.col("pdf_path")))
    counts = out.agg(F.count("*").alias("checked"), F.count_if("changed").alias("changed"), F.count_if("filled").alias("filled"))
    return out.withColumn("pdf_path", F.col("new")).drop("norm", "p1", "p2", "f1", "f2", "new", "filled", "changed"), counts
