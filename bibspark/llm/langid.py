"""Operator 1, language ID: bit-sliced Bloom filters over byte n-grams.

One array of slots serves all languages: slot i holds a bit mask with a bit for each language, so AND-ing the k slots
of an n-gram returns every language that contains it at once. A text's language is the one with most n-grams after
each language's count is corrected for the share of foreign n-grams that its slice lets through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, small, table

#: The bound of the learning sample, the hashes, the slots for each n-gram of the largest language, and the documents that
#: an n-gram needs; parameters of `learn`.
SAMPLE_PER_LANG, HASHES, SLOTS_PER_GRAM, MIN_DF = 1500, 3, 32, 2
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
BLOCK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that aren't letters become spaces.
_PLAIN = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Model:
    langs: list[str]
    slots: np.ndarray  # uint64 [mask words, 2 ** bits]
    false_positive: np.ndarray  # float64 [langs]
    bits: int
    hashes: int


def grams(data: bytes) -> np.ndarray:
    """The 4-byte n-grams of a normalised text, in order, as uint32."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def normal(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" "


def positions(g: np.ndarray, bits: int, hashes: int) -> Iterator[np.ndarray]:
    wide = g.astype(np.uint64)
    for m in MULTIPLIERS[:hashes]:
        yield (((wide + np.uint64(1)) * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64)


def build(by_lang: dict[str, Sequence[int]], bits: int | None = None, hashes: int = HASHES) -> Model:
    """The filters of languages and their n-grams; without bits they are sized by the largest language."""
    langs = list(by_lang)
    if bits is None:
        bits = max(16, (SLOTS_PER_GRAM * max(map(len, by_lang.values()), default=1)).bit_length())
    slots = np.zeros((max(1, -(-len(langs) // 64)), 1 << bits), np.uint64)
    fp = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        word, bit = divmod(i, 64)
        for at in positions(np.array(by_lang[lang], np.uint32), bits, hashes):
            slots[word, at] |= np.uint64(1 << bit)
        fp[i] = np.mean((slots[word] >> np.uint64(bit)) & np.uint64(1)) ** hashes
    return Model(langs, slots, fp, bits, hashes)


def predict(text: str | None, model: Model) -> tuple[str, float]:
    """(language, score); ("und", 0.0) for null, for a text without a letter, or if no language was learned."""
    if not text or not model.langs or not _LETTER.search(text):
        return "und", 0.0
    counts, total, data = np.zeros(len(model.langs)), 0, normal(text)
    for start in range(0, len(data), BLOCK):
        g = grams(data[start : start + BLOCK + 3])
        total += len(g)
        at = list(positions(g, model.bits, model.hashes))
        for word in range(len(model.slots)):
            mask = model.slots[word][at[0]]
            for more in at[1:]:
                mask = mask & model.slots[word][more]
            for i in range(64 * word, min(64 * word + 64, len(model.langs))):
                counts[i] += np.count_nonzero(mask & np.uint64(1 << (i % 64)))
    counts = np.maximum(0, (counts - total * model.false_positive) / (1 - model.false_positive + 1e-12))
    best = int(np.argmax(counts))
    whole = float(counts.sum())
    return model.langs[best], float(counts[best] / whole) if whole > 0 else 0.0


def learn(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, bits: int | None = None, hashes: int = HASHES) -> Model:
    """Fit on at most per_lang labelled documents of each language, chosen by a hash of doc_id.

    Rows with a null lang, text or doc_id teach nothing. Every n-gram of two documents of the sample is in the filters; the
    driver receives them as numbers, and the sample bounds how many.
    Languages are ordered by learned documents, then name; ties of a prediction go to the earlier.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # by the language's count, hashes that can't be among the first are left out before rows meet
    share = labelled.groupBy("lang").agg((2.0 * per_lang / F.count("*")).alias("share"))
    labelled = labelled.join(small(share), "lang").where((F.xxhash64("doc_id") / 2.0**64 + 0.5 < F.col("share")) | (F.col("share") > 0.5))
    sample = labelled.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang).select("doc_id", "lang").distinct()
    texts = docs.where("text is not null").select("doc_id", "lang", "text").join(small(sample), ["doc_id", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, []).append(np.unique(grams(normal(text))))
                docs_of[lang] = docs_of.get(lang, 0) + 1
        for lang, parts in found.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * (len(g) + 1)), "gram": pa.array([-1, *g.astype(np.int64)], pa.int64()), "df": pa.array([docs_of[lang], *n.astype(np.int64)], pa.int64())})

    df = texts.mapInArrow(count, "lang string, gram long, df long").groupBy("lang", "gram").agg(F.sum("df").alias("df"))
    kept = df.where(f"gram < 0 or df >= {MIN_DF}").groupBy("lang").agg(F.max(F.when(F.col("gram") < 0, F.col("df"))).alias("n"), F.collect_list(F.when(F.col("gram") >= 0, F.col("gram"))).alias("grams"))
    learned = {r["lang"]: (r["n"], r["grams"]) for r in kept.toArrow().to_pylist()}
    by_lang = {lang: learned[lang][1] for lang in sorted(learned, key=lambda x: (-learned[x][0], x))}
    return build(by_lang, bits, hashes)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep plus lang_pred and score, a row for each row of docs, from the whole text alone. Repeated rows
    give repeated rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [predict(t.as_py(), shared.value) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def held_out() -> F.Column:
    """The fixed fold: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return identify(docs, learn(docs.where("not held_out")), ("doc_id", "held_out"))
