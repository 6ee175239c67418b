"""Operator 13, source divergence audit on run-length columns.

Each language keeps the terms of enough documents, and each source of it has a smoothed share for each of them. The
vocabulary is put in an order that brings equal counts together and is cut into blocks; a source's shares over a block are
a column of runs. Two sources are compared run by run: the boundaries of both columns are intersected, and the distance
of the shares is taken once a run and multiplied by its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.library import dense_number
from .common import bounded_batches, materialize, small, table

#: Documents that a term needs in its language, ranks of the terms of a source, the smoothing, and the unit of a share.
DOCUMENTS, TOP_TERMS, SMOOTH, UNIT = 30, 50, 5, 1_000_000_000
#: Terms of a block of the vocabulary; sources whose counts lead its order; sources in a slice of the pairs; counted
#: terms that a task holds before it sends them on.
BLOCK, LEADS, SLICE, HELD = 1 << 16, 3, 128, 300_000
#: In lower-cased UTF-8: letters, and all bytes of other characters.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed within a task as far as it can hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in of.items():
                one = lambda x, k=len(n): pa.repeat(pa.scalar(x, pa.string()), k)
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([one(lang), one(source), terms, pa.array(n.values(), pa.int64()), pa.array(map(in_docs.__getitem__, n), pa.int64())], names=["lang", "source", "term", "n", "docs"])
            of.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                words = _TERM.findall((text.as_py() or "").encode().lower())
                n, in_docs = of.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(words)
                in_docs.update(set(words))
                held += len(n)
            if held > HELD:
                yield from flush()
                held = 0
        yield from flush()

    bounded_batches(docs.sparkSession)
    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)), by long division in steps of a thousand, so that
    64 bits are enough for any total below 9 * 10^15."""
    whole = np.int64(total + SMOOTH * terms)
    out, rest = np.divmod(counts + SMOOTH, whole)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + step
    return out + 1


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the runs of equal values, and the value of each."""
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)) if len(values) else np.zeros(0, np.int64)
    return ends, values[ends - 1]


def distance(ends_a: np.ndarray, a: np.ndarray, ends_b: np.ndarray, b: np.ndarray) -> int:
    """The sum of abs(a - b) over two run-length columns of one length."""
    ends = np.union1d(ends_a, ends_b)
    gap = np.abs(a[np.searchsorted(ends_a, ends)] - b[np.searchsorted(ends_b, ends)])
    return int(gap @ np.diff(ends, prepend=0))


def _share(n: Column, total: Column, terms: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(n + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + SMOOTH * terms)) + 1


def columns(cells: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """(lang, block, source, ends, p): each source's runs in each block of its language's vocabulary, in the blocks where
    it has no term too. A language without terms has one empty block. cells has lang, source, pos, n; groups has lang,
    source, total, terms."""
    ordered = F.array_sort(F.collect_list(F.struct(F.pmod("pos", F.lit(block)).cast("int").alias("at"), "n")))
    full = cells.groupBy("lang", "source", F.floor(F.col("pos") / block).alias("block")).agg(ordered.alias("cells"))
    last = F.greatest(F.ceil(F.col("terms") / block) - 1, F.lit(0))
    every = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    rows = every.join(full, ["lang", "source", "block"], "left").select("lang", "source", "block", "total", "terms", F.col("cells.at").alias("at"), F.col("cells.n").alias("n"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, p = [], []
            for no, total, terms, at, n in zip(*(batch.column(c) for c in ("block", "total", "terms", "at", "n")), strict=True):
                counts = np.zeros(min(block, terms.as_py() - no.as_py() * block), np.int64)
                if at.is_valid:
                    counts[at.values.to_numpy()] = n.values.to_numpy()
                e, c = runs(counts)
                ends.append(e)
                p.append(shares(c, total.as_py(), terms.as_py()) if len(c) else c)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "source", "block")), pa.array(ends, pa.list_(pa.int32())), pa.array(p, pa.list_(pa.int64()))], names=["lang", "source", "block", "ends", "p"])

    return rows.mapInArrow(encode, "lang string, source string, block long, ends array<int>, p array<long>")


def distances(cols: DataFrame, slices: int) -> DataFrame:
    """(lang, source, other, value) of every two sources of a language, each pair twice.

    The columns of a block meet in slices by slices of its sources, so a language of many sources is many keys. A pair
    is worked out once, where its slices meet in order of the names.
    """
    own = cols.withColumn("s", F.pmod(F.xxhash64("source"), F.lit(slices)))
    cell = lambda row, col: F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: row(i) * slices + col(i)))
    a = own.select("lang", "block", cell(lambda i: F.col("s"), lambda i: i).alias("cell"), "source", F.col("ends").alias("ends_a"), F.col("p").alias("a"))
    b = own.select("lang", "block", cell(lambda i: i, lambda i: F.col("s")).alias("cell"), F.col("source").alias("other"), F.col("ends").alias("ends_b"), F.col("p").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.column(c) for c in ("ends_a", "a", "ends_b", "b")]
            values = [distance(*(x.values.to_numpy() for x in row)) if len(row[0]) else 0 for row in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "source", "other")), pa.array(values, pa.int64())], names=["lang", "source", "other", "value"])

    met = a.join(b, ["lang", "block", "cell"]).where("source < other").drop("block", "cell")
    once = met.mapInArrow(run, "lang string, source string, other string, value long").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    swap = F.array(F.struct("source", "other"), F.struct(F.col("other").alias("source"), F.col("source").alias("other")))
    return once.select("lang", F.explode(swap).alias("x"), "value").select("lang", "x.source", "x.other", "value")


def audit(docs: DataFrame, documents: int = DOCUMENTS, top: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: the distance of each source's term shares to every other source of its
    language (part pair), and the terms that it has above its language's share (part term, the first top of them).

    Null lang, source and text count as empty, and each row is a document, repeated or not. Equal values are ranked by
    item. A source without a kept term, or a language without any, has its pairs nevertheless; an only source has none.
    An empty table gives no rows. Counts are exact.
    """
    filled = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # the rows of a term in a language meet once, for its sources, its documents and its place in the order alike
    met = counted(filled).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    rows = met.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("in_docs"), F.sum("n").over(of_term).alias("whole"), F.sum(F.xxhash64("source", "n").cast("decimal(20,0)")).over(of_term).alias("alike"))
    kept = materialize(rows.where(F.col("in_docs") >= documents).drop("in_docs"), "kept")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = materialize(filled.select("lang", "source").groupBy("lang", "source").count().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "sources")
    terms = kept.groupBy("lang", "term").agg(F.first("whole").alias("whole")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("whole").alias("all"))
    langs = sources.select("lang").distinct().join(terms, "lang", "left").select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("all", F.lit(0)).alias("all"))
    groups = materialize(sources.join(langs, "lang"), "groups")

    # equal counts come together: by the counts of the leading sources, then by all of them
    lead = groups.where("total > 0").withColumn("lead", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("total"), "source"))).where(F.col("lead") <= LEADS).select("lang", "source", "lead")
    led = kept.join(small(lead), ["lang", "source"], "left")
    vocabulary = led.groupBy("lang", "term").agg(*[F.coalesce(F.sum(F.when(F.col("lead") == i + 1, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(LEADS)], F.first("whole").alias("whole"), F.first("alike").alias("alike"))
    numbered = dense_number(vocabulary.select("lang", "term", F.struct("lang", *[f"n{i}" for i in range(LEADS)], "whole", "alike", "term").alias("key")), "key", "no").drop("key")
    first = numbered.groupBy("lang").agg(F.min("no").alias("first"))
    placed = numbered.join(small(first), "lang").select("lang", "term", (F.col("no") - F.col("first")).alias("pos"))

    cols = materialize(columns(kept.join(placed, ["lang", "term"]).select("lang", "source", "pos", "n"), groups, block), "columns")
    most = groups.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    pair = distances(cols, max(1, -(-most // SLICE))).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")

    both = kept.join(small(groups), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("whole"), F.col("all"), F.col("terms")).alias("q"))
    above = both.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pair).unionByName(ranked(above).where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL HAVING count(*) >= {DOCUMENTS}),
cell AS (SELECT n.lang, source, term, sum(n.n) AS n FROM n JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS whole FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
g AS (SELECT lang, source, v, whole, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cell GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {UNIT}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH})::HUGEINT // (total + {SMOOTH} * v)::HUGEINT AS p, 1 + {UNIT}::HUGEINT * (k.n + {SMOOTH})::HUGEINT // (whole + {SMOOTH} * v)::HUGEINT AS q
  FROM g JOIN kept k USING (lang) LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f ON f.lang = a.lang AND f.s = a.source AND f.t = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)) WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
