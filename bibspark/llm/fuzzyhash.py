"""Operator 3, document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last bytes triggers a chunk boundary wherever it hits a residue that depends on the block size;
each chunk gives one character. A fingerprint is "block:signature:signature at twice the block", and two fingerprints
are compared by the edit distance of the signatures whose block sizes agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: Bytes that the rolling hash sees, the smallest block, the chunks aimed at, and the run of characters that two
#: signatures must share before their distance counts.
WINDOW, SMALLEST, CHUNKS, RUN = 7, 3, 64, 7
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_RNG = np.random.Generator(np.random.PCG64(20240607))
_ROLL = _RNG.integers(0, 2**32, 256, dtype=np.uint32)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64)
_STEP, _ROLL_STEP = np.uint64(0x5851F42D4C957F2D), np.uint32(0x01000193)
_BACK = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))


class _Powers:
    """Powers of the chunk hash's factor and of its inverse, as far as any text so far needs them."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16, 2 * len(cls.up))
            with np.errstate(over="ignore"):
                cls.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _STEP)]))
                cls.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _BACK)]))
        return cls.up, cls.down


def signature(rolled: np.ndarray, summed: np.ndarray, block: int) -> str:
    """One character for each chunk; a chunk ends after each byte where the rolling hash hits block - 1."""
    n = len(rolled)
    ends = np.flatnonzero(rolled % np.uint32(block) == block - 1) + 1
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    _, down = _Powers.upto(n)
    with np.errstate(over="ignore"):
        h = (summed[ends] - summed[starts]) * down[starts]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ALPHABET[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """The fingerprint of the bytes of a text; "3::" for none. The block size depends on the length alone."""
    n = len(data)
    if not n:
        return f"{SMALLEST}::"
    b = np.frombuffer(data, np.uint8)
    rolled, with_factor = np.zeros(n, np.uint32), _ROLL[b]
    up, _ = _Powers.upto(n)
    with np.errstate(over="ignore"):
        for back in range(min(WINDOW, n)):
            rolled[back:] += with_factor[: n - back]
            with_factor = with_factor * _ROLL_STEP
        rolled ^= rolled >> np.uint32(15)
        summed = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[b] * up[:n], dtype=np.uint64)])
    block = SMALLEST
    while block * CHUNKS < n:
        block *= 2
    return f"{block}:{signature(rolled, summed, block)}:{signature(rolled, summed, 2 * block)}"


def distance(a: str, b: str) -> int:
    """Insertions and deletions that turn a into b, by the bit-parallel longest common subsequence."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) + len(b) - 2 * (len(a) - v.bit_count())


def likeness_of_signatures(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    if not run:
        return 0.0
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    return 1 - distance(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1: 1 for equal fingerprints, 0 if no block sizes agree or no run of characters is shared."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    bx, by = int(bx), int(by)
    pairs = [(x1, y1), (x2, y2)] if bx == by else [(x1, y2)] if bx == 2 * by else [(x2, y1)] if by == 2 * bx else []
    return max((likeness_of_signatures(a, b) for a, b in pairs), default=0.0)


def edited(text: str, following: str) -> str:
    """The last half of text, rounded down, replaced by as many code points (or all) from the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, rows_per_range: int = 5_000) -> DataFrame:
    """Rows in ranges of ascending doc_id, sorted within: (rng, key, tail, doc_id, text).

    Ranges are cut at document ids that are there (near quantiles of the narrow id column, which are doubles: the smallest
    id from each on), and the first row of each range is also sent, as its tail, to the range before it; the first of all
    goes to the last. So every row's successor is in its own range, and nothing is sorted as a whole. A row finds its range
    by binary search among the cuts, of which there is one for rows_per_range rows. Rows with a null doc_id come first;
    ties go by text.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    n = base.count()
    parts = max(1, -(-n // rows_per_range))
    cuts = base.stat.approxQuantile("key", [i / parts for i in range(parts)], 0.1 / parts) if n else []
    rough = place_among(docs.sparkSession, sorted({-(2**63), *(min(int(c), 2**63 - 1) for c in cuts)}))
    cuts = sorted(r.k for r in base.select("key", rough("key")["rng"].alias("rng")).groupBy("rng").agg(F.min("key").alias("k")).collect()) if n else [0]
    at = F.col("at")
    own = F.struct(at["rng"].alias("rng"), F.lit(False).alias("tail"))
    before = F.struct(F.pmod(at["rng"] - 1, F.lit(len(cuts))).alias("rng"), F.lit(True).alias("tail"))
    placed = base.withColumn("at", place_among(docs.sparkSession, cuts)("key")).withColumn("p", F.explode(F.when(at["first"], F.array(own, before)).otherwise(F.array(own))))
    return placed.select("p.rng", "key", "p.tail", "doc_id", "text").repartition(4 * parts, "rng").sortWithinPartitions("rng", "tail", "key", "text")


def place_among(spark: SparkSession, cuts: list[int]):
    """A function of a long column: (rng, first), the place of the last cut that isn't above it, and whether it is that cut."""
    shared = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("rng int, first boolean")
    def place(key: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(shared.value, key.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"rng": at.astype(np.int32), "first": shared.value[at] == key.to_numpy(np.int64)})

    return place


def fingerprints(docs: DataFrame, rows_per_range: int = 5_000) -> DataFrame:
    """Fingerprints and likenesses of each row (null text: empty), its edited text and the next row.

    The next of the last row is the first one; of a single row, itself. Repeated rows are neighbours of each other.
    A range that ends without a successor for its last row is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a row that waits for its successor

        def done(row: tuple, following: tuple) -> tuple:
            doc_id, text, own = row[2], row[3], row[4]
            new = edited(text, following[3])
            data = new.encode("utf-8", "surrogatepass")
            print_of_new = fingerprint(data)
            return doc_id, len(text), hashlib.sha256(data).hexdigest(), own, print_of_new, likeness(own, print_of_new), likeness(own, following[4])

        def ended(row: tuple | None) -> None:
            if row is not None:
                raise ValueError(f"no row follows doc_id {row[2]} in range {row[0]}")

        for batch in batches:
            out = []
            for rng, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (rng, tail, doc_id, text, fingerprint(text.encode("utf-8", "surrogatepass")))
                if held is not None and held[0] == rng:
                    out.append(done(held, row))
                    held = None if tail else row
                else:
                    ended(held)
                    held = None if tail else row
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=NAMES)
        ended(held)

    bounded_batches(docs.sparkSession)
    return with_next(docs, rows_per_range).select("rng", "tail", "doc_id", "text").mapInArrow(run, SCHEMA)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op3_fuzzy_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
