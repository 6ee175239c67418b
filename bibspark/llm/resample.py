"""Operator 11, importance resampling towards a target distribution.

Hashed word n-grams of the corpus and of the target texts are counted in an array of buckets; the log ratio of their
shares is each bucket's gain, and a document's weight is the mean gain of its features. A Gumbel draw is added, and the
highest scores are the sample. The k-th score is found by a distributed quickselect: random pivot keys, an exact count of
the keys below, at and above each, on to the part that holds the k-th. Only the winners are sorted and ranked.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.library import dense_number
from .common import bounded_batches, materialize, table

#: Buckets, the n-grams' length, the sample's share in percent, the words that a document needs, and the draw's seed.
BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, "7"
#: Random pivots of a round of the quickselect: each round leaves about one part in so many.
PIVOTS = 16
#: In lower-cased UTF-8: digits, letters, and all bytes of other characters.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Sixteen hexadecimal digits of a long, in its order.
_DIGITS = "lpad(hex({0} ^ -9223372036854775808L), 16, '0')"
#: The composite key of a row: best score first, then the smaller doc_id, rows without one last, then the text's hash.
KEY = "concat(" + _DIGITS.format("-score") + ", if(doc_id is null, 1, 0), " + _DIGITS.format("coalesce(doc_id, 0L)") + ", " + _DIGITS.format("tie") + ")"


def buckets(text: str | None, size: int = BUCKETS) -> tuple[np.ndarray, int]:
    """The bucket of every word and every pair of neighbouring words of a text, repeats included; and the words' number.
    A null or empty text has none."""
    words = _WORD.findall(text.encode().lower()) if text else []
    first = list(map(crc32, words))
    pairs = map(crc32, map(b" ".__add__, words[1:]), first)  # the second word goes on from the first one's sum
    return np.array([*first, *pairs], np.int64) % size, len(words)


def bucket_counts(texts: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket. A task sends one row a bucket at most, and so does the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("text"):
                total += np.bincount(buckets(x.as_py(), size)[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    bounded_batches(texts.sparkSession)
    out = np.zeros(size, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    size, whole, wanted = len(corpus), int(corpus.sum()), int(target.sum())
    one = lambda s, t: math.floor(1000 * math.log(float(t + 1) * float(whole + size) / (float(s + 1) * float(wanted + size))))
    return np.array([one(int(s), int(t)) for s, t in zip(corpus, target, strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, n_words and the key of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [buckets(x.as_py(), len(gain)) for x in batch.column("text")]
            cols = [[len(at) for at, _ in found], [int(gain[at].sum()) // max(1, len(at)) for at, _ in found], [n for _, n in found]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "tie", "n_features", "weight", "n_words"])

    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text").mapInArrow(run, "doc_id long, tie long, n_features long, weight long, n_words long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    score = F.col("weight") + F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", score).withColumn("key", F.expr(KEY))


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> str:
    """The k-th smallest key (from 1) of rows, which must have k at least.

    A round takes some of the keys that are left at random, those with the smallest hashes of key and round. One aggregate
    counts the keys below, at and above each pivot. Either a pivot is the k-th key, or the search goes on between two.
    Equal keys are at one pivot, so ties of any number end it.
    """
    turn, low, high = 0, None, None
    while True:
        turn += 1
        inside = rows.select("key")
        for bound in ([] if low is None else [F.col("key") > low]) + ([] if high is None else [F.col("key") < high]):
            inside = inside.where(bound)
        drawn = sorted({r.key for r in inside.orderBy(F.xxhash64("key", F.lit(turn)), "key").limit(pivots).collect()})
        # 2i: below pivot i and above the ones before; 2i + 1: at it
        part = reduce(lambda c, i: F.when(F.col("key") < drawn[i], 2 * i).when(F.col("key") == drawn[i], 2 * i + 1).otherwise(c), reversed(range(len(drawn))), F.lit(2 * len(drawn)))
        counts = {r.part: r["count"] for r in inside.groupBy(part.alias("part")).count().collect()}
        for i in range(2 * len(drawn) + 1):
            if k <= counts.get(i, 0):
                break
            k -= counts.get(i, 0)
        if i % 2:
            return drawn[i // 2]
        low, high = drawn[i // 2 - 1] if i else low, drawn[i // 2] if i // 2 < len(drawn) else high


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, size: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score of each row of docs, and the rank of those drawn.

    Of the rows with least_words words or more, percent of a hundred are drawn (rounded down), by score, then doc_id; a null
    doc_id comes last and is drawn by the seed alone. Of rows alike in score, doc_id and text as many are drawn as there
    is room for. Null and empty texts have no feature and weight 0. An empty table gives no rows.
    """
    gain = gains(bucket_counts(docs, size), bucket_counts(target, size))
    scored = materialize(weighted(docs, gain, seed), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    k = able.count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    last = kth_key(able, k)
    won = (F.col("n_words") >= least_words) & (F.col("key") <= last)
    ranked = dense_number(scored.where(won), "key", "rank")
    rank = F.when(F.col("rank") <= k, F.col("rank")).cast("long").alias("rank")
    return ranked.select(*out, rank).unionByName(scored.where(~won).select(*out, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The remainder table of CRC-32 for four bits at a time, from its polynomial.
_NIBBLES = [reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(4), i) for i in range(16)]
_FEATURES = r"""(SELECT *, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM
  (SELECT {0} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {1}))"""
OP11_SQL = f"""
WITH d AS {_FEATURES.format("doc_id", "documents")}, b AS {_FEATURES.format("item_id", "benchmark")},
counted AS (SELECT id, feature, count(*) AS n FROM (SELECT id, unnest(f) AS feature FROM d) GROUP BY ALL),
aimed AS (SELECT feature, count(*) AS n FROM (SELECT unnest(f) AS feature FROM b) GROUP BY ALL),
hexes AS (SELECT feature, hex(feature) AS h FROM (SELECT feature FROM counted UNION SELECT feature FROM aimed)),
nibbles AS (SELECT feature, list_transform(range(0, len(h)), lambda i: strpos('0123456789ABCDEF', h[i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END]) - 1) AS l FROM hexes),
hashed AS (SELECT feature, xor(4294967295, list_reduce(list_prepend(4294967295, l), lambda c, x: xor(c >> 4, {_NIBBLES}[1 + (xor(c, x) & 15)]))) % {BUCKETS} AS bucket FROM nibbles),
s AS (SELECT bucket, sum(n) AS s FROM counted JOIN hashed USING (feature) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM aimed JOIN hashed USING (feature) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM counted) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM aimed) + {BUCKETS})::DOUBLE))) AS gain FROM s LEFT JOIN t USING (bucket)),
weight AS (SELECT id, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight FROM counted JOIN hashed USING (feature) JOIN gain USING (bucket) GROUP BY id),
score AS (SELECT d.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.id), 1, 8))::BIGINT + 0.5) / 4294967296))) AS score FROM d LEFT JOIN weight USING (id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM score WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, r AS rank
FROM score LEFT JOIN (SELECT * FROM ranked WHERE r <= (SELECT count(*) FROM ranked) * {PERCENT} // 100) USING (doc_id)
"""
