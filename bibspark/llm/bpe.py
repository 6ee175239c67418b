"""Operator 2, byte-level BPE: overlapping chunks are pre-tokenised apart, stitched where their boundaries agree, then encoded.

Every text goes this way. A text within a task's fair share has its chunks cut, stitched and encoded where it is read;
the chunks of a longer one are dealt out over the cluster, and its pieces come together as ids and bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Code points of a chunk and of the overlap with the next one; and those of a chunk that is sent to another task, which
#: is also what a text may have at most to stay in one task.
CHUNK, OVERLAP = 2_048, 128
SENT_CHUNK, SENT_OVERLAP = 65_536, 512


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def decimals(path: str) -> list[str]:
    return [str(i) for i in range(encoding(path).n_vocab)]


_PATTERN = regex.compile(public_tokenizers.PATTERN)
#: A letter, a number and a sign that are of the same class for every library.
_PLAIN = {r"\p{L}": "é", r"\p{N}": "²", "": "§"}


@lru_cache(maxsize=1)
def unlike() -> dict[int, str]:
    """The characters whose class differs between tiktoken and the library that looks for boundaries here, since their
    Unicode tables are of different years, and for each a character of the class it has for tiktoken."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    of, bytewise = {}, {bytes([b]): b for b in range(256)}
    differ: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        only = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=bytewise, special_tokens={})
        theirs = set(only.decode_bytes(only.encode_ordinary(every)).decode())  # it passes over all but the class
        of |= dict.fromkeys(theirs, kind)
        differ |= theirs ^ set(regex.findall(kind, every))
    return {ord(c): " " if of.get(c) == r"\s" else _PLAIN[of.get(c, "")] for c in differ}


@lru_cache(maxsize=1)
def _classed() -> np.ndarray:
    table = np.arange(0x110000, dtype="<u4")
    for c, plain in unlike().items():
        table[c] = ord(plain)
    return table


def as_tiktoken(text: str) -> str:
    """text, with the same length, as one in which both libraries see tiktoken's boundaries."""
    if text.isascii():
        return text
    return _classed()[np.frombuffer(text.encode("utf-32-le"), "<u4")].tobytes().decode("utf-32-le")


def boundaries(text: str, low: int, high: int) -> list[int]:
    """Ends of pre-tokens of text that lie in [low, high), as tiktoken takes them."""
    out = []
    for m in _PATTERN.finditer(as_tiktoken(text)):
        if m.end() >= high:
            break
        if m.end() >= low:
            out.append(m.end())
    return out


def common_ends(part: str, start: int, n: int, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Ends of pre-tokens, as places in a text of n code points, that a chunk sees in the overlap with the chunk before
    it and with the one after it. part starts at start. What lies at a chunk's own end is left out, and so are ends of
    blanks, which the pattern, looking ahead, would take in another way at the end of a piece."""
    last = start + len(part) >= n
    found = boundaries(part, 0, len(part) + 1)
    sure = len(part) if last else len(part) - 2  # the end of a cut chunk may split a match
    if not last and found and found[-1] >= len(part):
        found.pop()
    found = [p for p in found if 0 < p < sure and not part[p - 1].isspace()]
    return [start + p for p in found if p < overlap] if start else [], [start + p for p in found if p > chunk]


def stitched(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """text as pieces that can be encoded apart: cut at the last pre-token end that two neighbouring chunks both see.
    After chunks without a common one nothing vouches for later boundaries, so what is left is one piece."""
    n, tail, at, out = len(text), None, 0, []
    for start in range(0, n if n > chunk else 0, chunk):
        head, following = common_ends(text[start : start + chunk + overlap], start, n, chunk, overlap)
        if tail is not None:
            common = set(tail).intersection(head)
            if not common:
                break
            out.append(text[at : max(common)])
            at = max(common)
        tail = following
    return [*out, text[at:]]


def encode_rows(path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = encoding(path), decimals(path)
        for batch in batches:
            n, ids_sha, raw_sha = [], [], []
            for x in batch.column("text"):
                ids, raw = [], hashlib.sha256()
                for piece in stitched(x.as_py() or "", chunk, overlap):
                    got = enc.encode_ordinary(piece)
                    ids += got
                    raw.update(enc.decode_bytes(got))
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([dec[i] for i in ids]).encode()).hexdigest())
                raw_sha.append(raw.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def pieces(long_docs: DataFrame, chunk: int = SENT_CHUNK, overlap: int = SENT_OVERLAP) -> DataFrame:
    """(row, no, piece): whole texts as stretches that can be encoded apart.

    Chunk i covers [i * chunk, (i + 1) * chunk + overlap). Both it and chunk i + 1 give the boundaries they see in the
    overlap; where one is common, the pattern, which never looks back, runs on alike, so the text is cut there. What
    lies at a chunk's own end is left out of the comparison. If two neighbours have no boundary in common (an endless
    word), nothing vouches for the later chunks, and the whole text is one piece. Null and empty texts give one empty
    piece.
    """
    rows = long_docs.withColumn("n", F.length("text")).withColumn("no", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / chunk))))
    cut = rows.select("row", "no", "n", F.expr(f"substring(text, cast(no * {chunk} + 1 as int), {chunk + overlap})").alias("part"))

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for no, n, part in zip(batch.column("no").to_pylist(), batch.column("n").to_pylist(), batch.column("part").to_pylist(), strict=True):
                head, tail = common_ends(part, no * chunk, n, chunk, overlap)
                heads.append(head)
                tails.append(tail)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=[*batch.schema.names, "head", "tail"])

    seen = cut.mapInArrow(see, "row string, no long, n int, part string, head array<long>, tail array<long>")
    by_doc = Window.partitionBy("row").orderBy("no")
    common = F.array_max(F.array_intersect("tail", F.lead("head").over(by_doc)))
    joint = seen.withColumn("cut_at", common).withColumn("last", F.lead("no").over(by_doc).isNull())
    apart = F.max((F.col("cut_at").isNull() & ~F.col("last")).cast("int")).over(Window.partitionBy("row"))
    joint = joint.withColumn("cut_at", F.when(apart == 0, F.col("cut_at")))
    grouped = joint.withColumn("g", F.coalesce(F.sum(F.col("cut_at").isNotNull().cast("int")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", F.when(F.col("cut_next"), F.col("part")).otherwise(F.expr(f"substring(part, 1, {chunk})")).alias("part")))), lambda x: x["part"]), "")
    return (
        grouped.withColumn("cut_next", F.col("cut_at").isNotNull() | F.col("last"))
        .withColumn("from_at", F.coalesce(F.last("cut_at", ignorenulls=True).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .groupBy("row", "g")
        .agg(text.alias("text"), F.min("no").alias("no"), F.max("from_at").alias("from_at"), F.max("cut_at").alias("to_at"))
        .select("row", F.col("g").alias("no"), F.expr(f"substring(text, cast(from_at - no * {chunk} + 1 as int), cast(coalesce(to_at, 2000000000) - from_at as int))").alias("piece"))
    )


def encode_pieces(parts: DataFrame, path: str) -> DataFrame:
    """(row, no, n, ids, raw): decimal ids and decoded text of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = encoding(path), decimals(path)
        for batch in batches:
            ids = [enc.encode_ordinary(x or "") for x in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("no"), pa.array([len(x) for x in ids], pa.int64()), pa.array([" ".join([dec[i] for i in x]) for x in ids], pa.string()), pa.array([enc.decode_bytes(x) for x in ids], pa.binary())],
                names=["row", "no", "n", "ids", "raw"],
            )

    return parts.mapInArrow(run, "row string, no long, n long, ids string, raw binary")


def encode(docs: DataFrame, path: str, sent_chunk: int = SENT_CHUNK, sent_overlap: int = SENT_OVERLAP, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs (null text: empty). Repeated rows stay apart.

    Texts of at most sent_chunk code points stay in the task that reads them, in chunks of chunk; of longer ones chunks
    of sent_chunk are dealt out, and only they and their pieces are shuffled.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select("doc_id", "text")
    short = base.where(F.coalesce(F.length("text"), F.lit(0)) <= sent_chunk).mapInArrow(encode_rows(path, chunk, overlap), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    tall = base.where(F.length("text") > sent_chunk).withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256)))
    copies = tall.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    done = encode_pieces(pieces(tall.dropDuplicates(["row"]), sent_chunk, sent_overlap), path)
    ordered = F.array_sort(F.collect_list(F.struct("no", "ids", "raw")))
    whole = done.groupBy("row").agg(F.sum("n").alias("n_tokens"), ordered.alias("p")).select(
        "row",
        "n_tokens",
        F.sha2(F.array_join(F.transform("p", lambda x: x["ids"]), " "), 256).alias("ids_sha256"),
        F.sha2(F.aggregate("p", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["raw"])), 256).alias("decoded_sha256"),
    )
    tall_out = whole.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    return short.unionByName(tall_out)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path(VOCABULARY))
