"""Importance resampling, SentencePiece pieces and the divergence audit against brute-force versions."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from bibspark.llm import divergence, pieces, resample
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path(pieces.VOCABULARY)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, docs long, total long, term string, score double, tie string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, "k", 2, 3, 4, "t", 0.5, "x") for i, t, lang, source in rows], DOCS)


def made(seed, n):
    r = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "δέλτα", "12", "x7", "don't", "中文", "É", "zeta-eta"]
    return [(r.choice([r.randint(0, 2**60), i]), " ".join(r.choices(words, weights=range(len(words), 0, -1), k=r.randint(0, 60))), r.choice(["en", "fr", None]), r.choice(["s1", "s2", "s3", "s4", None])) for i in range(n)]


def odd_rows():
    return [(5, "b a " * 30, "en", "s1"), (5, "b a " * 30, "en", "s1"), (6, None, "en", "s9"), (7, "", None, None), (None, "alpha beta " * 20, "fr", "s2"), (None, "alpha beta " * 20, "fr", "s2"), (8, "x" * 70_000, "en", "s1"), (9, "é " * 40, "de", "only"), (10, " \t\n ", "", "")]


# 11
def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def plain_sample(rows, target, percent=25, least=20):
    """Sorted by (doc_id, n_features, weight, score, rank), all by lists."""
    features = lambda t: (lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])(words_of(t))
    bucket = lambda f: crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, x, *_ in rows for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    whole, aim = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(whole + 10_000) / (float(s[b] + 1) * float(aim + 10_000))))
    out = []
    for i, x, *_ in rows:
        f = features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words_of(x))))
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = [(*x[:4], n + 1) for n, x in enumerate(able[: len(able) * percent // 100])]
    rest = Counter(x[:4] for x in out) - Counter(x[:4] for x in drawn)
    return sorted([*drawn, *((*x, None) for x in rest.elements())], key=repr)


@pytest.mark.parametrize(("seed", "percent"), [(1, 25), (2, 90), (3, 100), (4, 0)])
def test_resampling_equals_sorting(spark, seed, percent):
    rows = [*made(seed, 300), *odd_rows()]
    target = spark.createDataFrame([(1, "alpha δέλτα beta 12"), (2, None), (3, "")], "item_id long, text string")
    got = resample.resample(docs(spark, rows), target, percent).collect()
    assert sorted(map(tuple, got), key=repr) == plain_sample(rows, ["alpha δέλτα beta 12"], percent)


def test_resampling_of_nothing(spark):
    target = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resample.resample(docs(spark, []), target).count() == 0
    assert [r["rank"] for r in resample.resample(docs(spark, odd_rows()[2:4]), target.limit(0)).collect()] == [None, None]


@pytest.mark.parametrize("distinct", [1, 3, 5000])
def test_quickselect_finds_every_place(spark, distinct):
    r = random.Random(distinct)
    keys = [f"{r.randrange(distinct):05d}" for _ in range(6000)]
    rows = spark.createDataFrame([(k,) for k in keys], "key string").repartition(7).cache()
    for k in (1, 2, 2999, 5999, 6000):
        assert resample.kth_key(rows, k, pivots=3 if distinct < 10 else 16) == sorted(keys)[k - 1]


def test_key_order(spark):
    ids = [None, 0, -1, 1, 2**53 + 1, 2**53, -(2**62)]
    rows = [(s, i, t) for s in (5, -7, 0) for i in ids for t in (-3, 9)]
    got = spark.createDataFrame(rows, "score long, doc_id long, tie long").withColumn("key", F.expr(resample.KEY)).orderBy("key").collect()
    assert [tuple(r)[:3] for r in got] == sorted(rows, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))


# 12
@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(seed, n):
    r = random.Random(seed)
    bits = ["a", "the", "ing", " ", "  ", "   ", "\t", "\n", "▁", "é", "中", "\U0001f600", "\x00", "ꙮ", "ion", "<s>", "</s>", "<0x41>", "﻿", "aaaa", "==", "//", "ᲊ"]
    whole = lambda: chr(r.choice([r.randint(0, 0x2FF), r.randint(0, 0xD7FF), r.randint(0xE000, 0x10FFFF)]))
    return [*("".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(n)), *("".join(whole() for _ in range(r.randint(0, 25))) for _ in range(n))]


def test_pieces_equal_the_library(library):
    coder, r = pieces.Pieces(MODEL), random.Random(5)
    names = [library.id_to_piece(i) for i in range(259, 32_000)]
    texts = odd_texts(4, 4000) + ["".join(r.choice(names[: r.choice([100, 2000, 31_000])]) for _ in range(r.randint(0, 30))).replace("▁", r.choice([" ", "", "▁"])) for _ in range(6000)]
    texts += [" " * 30_000, "a" * 30_000, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=30_000)), "".join(r.choice(names[200:3000]).replace("▁", "") for _ in range(9000)), "中文" * 9000, "ꙮ" * 5000]
    for known in (None, {}):
        got = [x for i in range(0, len(texts), 3000) for x in coder.encode(texts[i : i + 3000], known)]
        want = [[1, *x, 2] for x in library.encode(texts)]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
        assert [coder.decode(x).decode() for x in got] == library.decode(want)
    for _ in range(2000):  # ids that no text has
        ids = [r.randrange(32_000) if r.random() < 0.7 else r.randrange(3, 259) for _ in range(r.randint(0, 8))]
        assert coder.decode(np.array([1, *ids], "<u4").tobytes()).decode() == library.decode([1, *ids])


def test_merging_at_once_equals_merging_one_by_one(library):
    coder, r = pieces.Pieces(MODEL), random.Random(6)
    words = ["▁" * r.randint(0, 9) + "".join(r.choices("abeinorst", k=r.randint(1, 12))) for _ in range(3000)]
    alone = [np.array(coder.one_by_one([int(coder.symbol[ord(c)]) for c in w]), "<u4").tobytes() for w in words]
    assert coder.merge(words) == alone and coder.merge([]) == []


def test_piece_round_trip(spark, library):
    rows = [*odd_rows(), *((100 + i, t, "en", "s") for i, t in enumerate(odd_texts(7, 60)) if "\x00" not in t)]
    got = sorted(map(tuple, pieces.round_trip(docs(spark, rows), MODEL).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = [1, *library.encode(t or ""), 2]
        want.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(library.decode(ids).encode())))
    assert got == sorted(want, key=repr)
    assert pieces.round_trip(docs(spark, []), MODEL).count() == 0


# 13
def plain_audit(rows, documents=30, top=50):
    n, df, out = Counter(), Counter(), []
    groups = {(lang or "", source or "") for _, _, lang, source in rows}
    for _, text, lang, source in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = [w for w in re.split(r"[\x00-\x60\x7b-\x7f]+", low) if w]
        n.update((lang or "", source or "", w) for w in terms)
        df.update((lang or "", w) for w in set(terms))
    for lang, source in groups:
        vocabulary = [w for (g, w), k in df.items() if g == lang and k >= documents]
        own = sorted(s for g, s in groups if g == lang)

        def share(sources, lang=lang, vocabulary=vocabulary):
            c = {w: sum(n[lang, s, w] for s in sources) for w in vocabulary}
            return {w: 1 + 10**9 * (k + 5) // (sum(c.values()) + 5 * len(vocabulary)) for w, k in c.items()}

        p, q = share([source]), share(own)
        pair = [(sum(abs(p[w] - x) for w, x in share([s]).items()), s) for s in own if s != source]
        term = [(p[w] - q[w], w) for w in vocabulary if n[lang, source, w] and p[w] > q[w]]
        for part, found in (("pair", pair), ("term", term)):
            best = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(best) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize(("seed", "documents", "block"), [(1, 30, 1 << 16), (2, 2, 3), (3, 10**6, 4), (4, 1, 1)])
def test_audit_equals_brute_force(spark, seed, documents, block, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 2)
    rows = [*made(seed, 250), *odd_rows()]
    got = divergence.audit(docs(spark, rows), documents, 4, block).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == plain_audit(rows, documents, 4)


def test_audit_of_nothing(spark):
    assert divergence.audit(docs(spark, [])).count() == 0


def test_shares_are_exact():
    for total, terms in ((0, 1), (7, 3), (10**12, 10**6), (9 * 10**15 - 10**9, 10)):
        counts = [0, 1, 2, total // 3, total]
        assert divergence.shares(np.array(counts, np.int64), total, terms).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in counts]


def test_distance_of_runs_is_that_of_the_values():
    r = np.random.default_rng(3)
    for n in (1, 2, 50, 1000):
        a, b = r.integers(0, 3, n), r.integers(0, 3, n)
        assert divergence.distance(*divergence.runs(a), *divergence.runs(b)) == np.abs(a - b).sum()
        assert len(divergence.runs(np.sort(a))[0]) <= 3
