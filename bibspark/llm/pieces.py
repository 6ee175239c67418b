"""Operator 12, SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the vocabulary spans, so into words with the blanks before them, and each distinct word
is merged once. The words' symbols lie in one flat array. A round finds each word's smallest pair rank, merges all its
leftmost non-overlapping pairs of that rank at once, and compacts the array; words without a pair leave it.

Merging at once equals merging one by one, leftmost first, as long as no merge makes a pair that ranks as well as the
one just merged. Each round checks that; the few words where it doesn't hold (runs of three or more blanks, whose pieces
tie) are merged one pair at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, resident, table

VOCABULARY = "piece_bpe_32k.model"
BLANK = "▁"
NONE = np.iinfo(np.int64).max
#: Characters of texts that are encoded together; distinct words that a task remembers (it forgets all beyond), and the
#: characters of the longest of them; a longer word is cut where it can be.
TOGETHER, REMEMBERED, LONG = 1 << 20, 200_000, 48


class Pieces:
    """A BPE model of the sentencepiece library with byte fallback and no rewriting of characters (else ValueError)."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.begin, self.end = sp.vocab_size(), sp.bos_id(), sp.eos_id()
        odd = " A ﬁ① \t x  "
        if sp.normalize(odd) != (BLANK + odd).replace(" ", BLANK) or min(self.begin, self.end) < 0:
            raise ValueError("the model rewrites characters or has no begin and end ids")
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(self.size)]
        names = [sp.id_to_piece(i) for i in range(self.size)]
        if sum(map(sp.is_byte, range(self.size))) != 256 or any(sp.is_unused(i) for i in range(self.size)):
            raise ValueError("the model has no byte fallback, or unused pieces")
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        # what an id decodes to
        self.raw = [p.replace(BLANK, " ").encode() if not special[i] else b"" for i, p in enumerate(names)]
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes([b])
        # a symbol is a piece's id, or size + code point for a character that is no piece
        self.symbol = self.size + np.arange(0x110000, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        scores = sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        one = lambda s: int(self.symbol[ord(s)]) if len(s) == 1 else self.ids.get(s)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = one(p[:k]), one(p[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank_of[sp.get_score(i)], i
        keys = np.array([(a << 21) | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in self.pairs.values()], np.int64)[order]
        self.merged = np.array([m for _, m in self.pairs.values()], np.int64)[order]
        self.spanned = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        apart = not any(s[1] == BLANK and s[0] != BLANK for s in self.spanned)
        self.word = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+" if apart else r"(?s).+")

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs of symbols; rank NONE where they don't merge."""
        key = (a << 21) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == key
        return np.where(known, self.ranks[at], NONE), self.merged[at]

    def one_by_one(self, symbols: list[int]) -> list[int]:
        """The symbols of a word after all merges, the smallest rank and then the leftmost first."""
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := self.pairs.get((symbols[i], symbols[j]))):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = self.pairs[a, b][1], -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            push(left[i], i)
            push(i, right[i])
        return [s for s in symbols if s >= 0]

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word (not empty), as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(w) for w in words])
        word, sym, out = np.repeat(np.arange(len(words)), sizes), self.symbol[points], []
        end = np.append(word[1:] != word[:-1], True)
        rank, into = self.look(sym, np.append(sym[1:], 0))
        rank[end] = NONE
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            done = best == NONE
            if done.any():
                out.append((word[done], sym[done]))
                word, sym, rank, into, best = (x[~done] for x in (word, sym, rank, into, best))
                if not len(sym):
                    break
            hit = rank == best
            at = np.arange(len(sym))
            since = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), at, 0))
            take = hit & ((at - since) % 2 == 0)  # of a run of hits every second one, from the left
            # a merged symbol beside the next one before that is merged as well
            mid = np.flatnonzero(take[:-2] & take[2:] & (word[:-2] == word[2:])) if len(sym) > 2 else at[:0]
            early = mid[self.look(into[mid], sym[mid + 2])[0] <= best[mid]]
            odd = set(word[early].tolist())
            sym = np.where(take, into, sym)
            keep = ~np.append(False, take[:-1])
            word, sym, rank, into, best, new = (x[keep] for x in (word, sym, rank, into, best, take))
            fresh = np.flatnonzero(new | np.append(new[1:], False))
            r, m = self.look(sym[fresh], np.append(sym[1:], 0)[fresh])
            r[np.append(word[1:] != word[:-1], True)[fresh]] = NONE
            rank[fresh], into[fresh] = r, m
            odd.update(word[fresh[r <= best[fresh]]].tolist())
            if odd:
                stay = ~np.isin(word, list(odd))
                word, sym, rank, into = (x[stay] for x in (word, sym, rank, into))
                for w in sorted(odd):
                    alone = np.array(self.one_by_one([int(self.symbol[ord(c)]) for c in words[w]]), np.int64)
                    out.append((np.full(len(alone), w), alone))
        word, sym = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(word, kind="stable")
        return self._ids(word[order], sym[order], len(words))

    def _ids(self, word: np.ndarray, sym: np.ndarray, n: int) -> list[bytes]:
        """Characters without a piece become the ids of their UTF-8 bytes."""
        point = sym - self.size
        wide = np.where(point < 0, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))
        if (point >= 0).any():
            sym, point, word, size = (np.repeat(x, wide) for x in (sym, point, word, wide))
            nth = np.arange(len(sym)) - np.repeat(np.cumsum(wide) - wide, wide)
            low = (point >> (6 * (size - 1 - nth))) & 0x3F | 0x80
            lead = point >> (6 * (size - 1)) | np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
            sym = np.where(point < 0, sym, self.byte[np.where(point < 0, 0, np.where(nth == 0, lead, low))])
        flat = sym.astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(word, minlength=n)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def cut(self, word: str) -> list[str]:
        """A long word, cut between characters that stand beside each other in no piece."""
        at = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.spanned), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:], strict=False)]

    def words(self, text: str) -> list[str]:
        found = self.word.findall(BLANK + text.replace(" ", BLANK)) if text else []
        if max(map(len, found), default=0) > LONG:
            return [p for w in found for p in (self.cut(w) if len(w) > LONG else (w,))]
        return found

    def encode(self, texts: Iterable[str], known: dict[str, bytes] | None = None) -> list[bytes]:
        """The ids of each text between the begin and the end id, as little-endian unsigned 32-bit integers. known
        remembers words from one call to the next."""
        known = {} if known is None else known
        split = [self.words(t) for t in texts]
        new = [w for w in {w for words in split for w in words} if w not in known]
        known.update(zip(new, self.merge(new), strict=True))
        first, last = (int(i).to_bytes(4, "little") for i in (self.begin, self.end))
        out = [first + b"".join(map(known.__getitem__, words)) + last for words in split]
        if len(known) > REMEMBERED:
            known.clear()
        for w in new:
            if len(w) > LONG:
                known.pop(w, None)
        return out

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids: pieces one after the other, the blank that encoding put first taken off. Bytes that
        are no UTF-8 are decoded by the library."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        raw = b"".join(map(self.raw.__getitem__, numbers))
        if raw.startswith(b" ") and next(i for i in numbers if self.raw[i]) != self.byte[0x20]:
            raw = raw[1:]
        try:
            raw.decode()
        except UnicodeDecodeError:
            return self.library.decode(numbers).encode()
        return raw


def pieces(path: str) -> Pieces:
    return resident(("pieces", path), lambda: Pieces(path))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs (null text: empty, so just begin and end id).

    Nothing is shuffled. Texts are encoded together up to a number of characters, a longer one alone and whole; the work
    grows with its distinct words. Repeated rows give repeated rows, a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, known = pieces(path), {}
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            held, size = [], 0

            def flush(held: list[str]) -> None:
                for ids in coder.encode(held, known):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())

            for x in batch.column("text"):
                held.append(x.as_py() or "")
                size += len(held[-1])
                if size >= TOGETHER:
                    flush(held)
                    held, size = [], 0
            flush(held)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_piece_round_trip(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path(VOCABULARY))
