"""Operator 8, secret scans: fixed patterns, and a token-efficiency test for random strings.

A string that a tokenizer's vocabulary can't compress, so that it spends few characters a token, is likely random.
Runs of key characters and their parts between separators are tested. UUIDs, digests (hex of a usual length), numbers,
words and camel-case names under 20 letters, runs of mostly such parts, and runs of many short parts of different
lengths (paths, dotted and numbered names, time stamps) are excluded before the test.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import VOCABULARY, encoding
from .common import bounded_batches, table

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24}")
_KEYWORD = re.compile(r"(?ai)password|passwd|secret|token|api_?key")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_PART = re.compile(r"[A-Za-z0-9]+")
#: Possessive, so that a run is read once: an upper-case run of two or more is taken whole before the lower-case one.
_WORD = re.compile(r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)++|[A-Za-z]?")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Hex lengths of common digests: CRC-64, MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = frozenset((16, 32, 40, 56, 64, 96, 128))
#: A candidate with fewer characters a token than this is random.
CHARS_PER_TOKEN = 2.2
#: Characters from which the ratio tells random strings (at 12, 99 in 100 stay at 2.0 or less) and word-like ones.
LEAST, LEAST_WORD = 12, 20
#: A run of at least so many parts, of so many characters on average at most and not all of one length, is a name.
NAME_PARTS, NAME_PART = 4, 6


def known(part: str) -> bool:
    """A number or a digest."""
    return part.isdigit() or len(part) in DIGEST_LENGTHS and _DIGEST.fullmatch(part) is not None


def is_random(s: str, enc, ratio: float = CHARS_PER_TOKEN) -> bool:
    """It is no digest or identifier, and the vocabulary barely compresses it."""
    if len(s) < LEAST:
        return False
    parts = _PART.findall(s)
    if _WORD.fullmatch(s):  # a word in capitals compresses as it does in lower case
        if len(s) < LEAST_WORD:
            return False
        s = s.lower()
    elif _UUID.search(s):
        return False
    else:
        size = sum(map(len, parts))
        if len(parts) >= NAME_PARTS and size <= NAME_PART * len(parts) and len(set(map(len, parts))) > 1:
            return False
        odd = size - sum(len(p) for p in parts if known(p))
        if len(parts) > 1 and not (len(s) >= LEAST_WORD and any(c.isdigit() for c in s) and any("a" <= c <= "z" for c in s) and any("A" <= c <= "Z" for c in s)):
            odd -= sum(len(p) for p in parts if _WORD.fullmatch(p))
        if 2 * odd <= size:
            return False
    return len(s) / max(1, len(enc.encode_ordinary(s))) < ratio


def outside(taken: Iterable[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span meets none of the taken ones, found by bisection among their union."""
    starts, ends = [], []
    for s, e in sorted(taken):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end) - 1
        return before < 0 or ends[before] <= start

    return free


def random_spans(text: str, enc, ratio: float, taken: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Random runs, or else the random parts of a run, that don't meet a taken span."""
    free = outside((s, e) for _, s, e in taken)
    for m in _CANDIDATE.finditer(text):
        if free(*m.span()) and is_random(m.group(), enc, ratio):
            yield "random", m.start(), m.end()
            continue
        apart = outside(u.span() for u in _UUID.finditer(m.group()))
        for p in _PART.finditer(m.group()):
            start, end = m.start() + p.start(), m.start() + p.end()
            if p.span() != (0, len(m.group())) and apart(*p.span()) and free(start, end) and is_random(p.group(), enc, ratio):
                yield "random", start, end


def scan(text: str | None, enc, ratio: float = CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: base spans by start and kind, then, among them, the method's own.

    A random string inside a base span adds nothing. Null and empty texts have none.
    """
    if not text:
        return []
    base = []
    if _KEYWORD.search(text):
        base += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _LONG_HEX.search(text):
        base += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    own = list(random_spans(text, enc, ratio, base))
    return sorted(base + own, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame, vocabulary: str, ratio: float = CHARS_PER_TOKEN) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans, for each row of docs. Repeated rows give repeated rows.

    A text is scanned as a whole, however long, in time linear in its length but for the sorting of spans; Arrow batches
    are bounded by bytes, so a very long text comes alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            found = [scan(t.as_py(), enc, ratio) for t in batch.column("text")]
            base = [[x for x in spans if x[0] != "random"] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([sum(x[0] == k for x in spans) for spans in base], pa.int64()) for k in KINDS[:3]),
                    pa.array([hashlib.sha256(written(spans).encode()).hexdigest() for spans in base], pa.string()),
                    pa.array([written(spans) for spans in found], pa.string()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op8_secret_scan(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path(VOCABULARY))
