"""Operator 9, packing: sum-of-squares online packing into windows of a fixed number of tokens.

Each partition of the input is packed on its own, as its documents are read: nothing is shuffled. Whole windows are
cut off a document first. Its rest goes to the fill level that makes the sum of squared counts of partially filled
windows smallest (Csirik et al. 2006), the counts being kept in a level array. At the end of a partition the windows
still open are filled from the emptiest ones, so that at most one window of a partition is padded.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, resident, table

VOCABULARY, WINDOW, END_ID = "word_bpe_49k.json", 4096, 2
_MARK = "\x00"
#: Texts of other characters (controls, far scripts) go through the tokenizer itself.
_PLAIN = "\t\n\r" + "".join(map(chr, (*range(0x20, 0x7F), *range(0xA1, 0x250))))


def _class(kind: str) -> str:
    """The lower-case forms of the plain characters that are of a Unicode category, as a character class's content."""
    return re.escape("".join(sorted({c for c in _PLAIN.lower() if unicodedata.category(c)[0] == kind})))


_OTHER = re.compile(f"[^{re.escape(_PLAIN)}]")
#: The vocabulary's own pre-tokenising pattern (a fixed value), its classes spelled out for plain characters.
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\s{_class('L')}{_class('N')}]+")


class Tokens:
    """Ids of a text by a word vocabulary of the tokenizers library, end id included.

    The words of plain Latin text are merged by tiktoken in one call, each word's end being written as a byte that such
    text doesn't hold; any other text is encoded by the tokenizers library as a whole. Both give the same ids (tests
    compare them). Nothing is remembered from one text to the next.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        byte_of = _byte_characters()
        ranks = {}
        for token, i in self.whole.get_vocab(with_added_tokens=True).items():
            if token not in special:
                end = token.endswith("</w>")
                ranks[bytes(byte_of[c] for c in token.removesuffix("</w>")) + b"\x00" * end] = i
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if _OTHER.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(_MARK.join([*_WORD.findall(text.lower()), ""]))
        ids.append(END_ID)
        return np.array(ids, np.uint32)


def _byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the
    others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokens(path: str) -> Tokens:
    return resident(("words", path), lambda: Tokens(path))


class Levels:
    """counts[h]: open windows filled to h. place() says which level a piece of r tokens should join (0: a new window)."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window, self.counts = window, np.zeros(window + 1, np.int64)

    def place(self, r: int) -> int:
        """Moving a window from h to h + r changes the sum of squares by 2 * (counts[h + r] - counts[h]) + 2, a new one
        by 2 * counts[r] + 1, one that gets full by 1 - 2 * counts[h]; ties go to the fuller window."""
        w, c = self.window, self.counts
        change = 2 * (c[r:] - c[: w + 1 - r]) + 2
        change[w - r] = 1 - 2 * c[w - r]
        change[0] = 2 * c[r] + 1
        change[1:][c[1 : w + 1 - r] == 0] = np.iinfo(np.int64).max
        h = int(len(change) - 1 - np.argmin(change[::-1]))
        if h:
            c[h] -= 1
        if h + r < w:
            c[h + r] += 1
        return h


def pack(docs: Iterator[tuple[int | None, np.ndarray]], window: int = WINDOW) -> Iterator[tuple[int | None, int, np.ndarray, int, int, int]]:
    """(doc_id, start, ids, doc_tokens, sequence, offset) of each piece, for documents in the order they come."""
    levels, open_at, n = Levels(window), [[] for _ in range(window)], 0
    for doc_id, ids in docs:
        total = len(ids)
        whole = total - total % window
        for start in range(0, whole, window):
            yield doc_id, start, ids[start : start + window], total, n, 0
            n += 1
        r = total - whole
        if r:
            h = levels.place(r)
            held = open_at[h].pop() if h else []
            held.append((doc_id, whole, ids[whole:].copy(), total))
            if h + r == window:
                yield from _close(held, n)
                n += 1
            else:
                open_at[h + r].append(held)
    # the fullest windows are topped up from the emptiest, whose pieces are cut as needed
    left = [held for level in open_at for held in level]
    low, high = 0, len(left) - 1
    while low < high:
        room = window - sum(len(p[2]) for p in left[high])
        while room and low < high:
            doc_id, start, ids, total = left[low].pop()
            left[high].append((doc_id, start, ids[:room], total))
            if len(ids) > room:
                left[low].append((doc_id, start + room, ids[room:], total))
            room -= min(room, len(ids))
            if not left[low]:
                low += 1
        yield from _close(left[high], n)
        n += 1
        high -= 1
    if low == high and left[low]:
        yield from _close(left[low], n)


def _close(held: list, n: int) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, ids, total in held:
        yield doc_id, start, ids, total, n, offset
        offset += len(ids)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """The pieces of all documents (null text: empty, so just the end id). Sequence ids count within a partition, whose
    number is above bit 32. Repeated rows and ids are packed as they come. A very long text is cut into whole windows and
    one rest; its ids are held at once in the task that reads it, but with no other text of that size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first = tokens(vocabulary), TaskContext.get().partitionId() << 32

        def rows() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                    yield doc_id.as_py(), coder.ids(text.as_py() or "")

        def flush(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=NAMES)

        out: list[tuple] = []
        for doc_id, start, ids, total, sequence, offset in pack(rows(), window):
            out.append((doc_id, start, len(ids), crc32(ids.astype("<u4").tobytes()), total, first + sequence, offset))
            if len(out) == 10_000:
                yield flush(out)
                out = []
        if out:
            yield flush(out)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op9_pack_sequences(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path(VOCABULARY))
