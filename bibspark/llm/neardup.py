"""Operator 5, exact n-gram Jaccard join over a token-group matrix.

A document's tokens are 64-bit hashes of its distinct word shingles. Three steps find every link of similarity 0.8:

1. Sharing. A partner of a document with n tokens lacks at most n / 5 of them. So of any m tokens, picked by hash alike
   in all documents, at least m - n / 5 occur in some other document. Documents that fail this, most of a corpus, have
   no partner and drop out. Occurrences are met in hash buckets of packed arrays; each task sends a token once at most.
2. Groups. Documents with a min-hash in common are compared with the smallest of them; those that link, and what
   hangs together by such links, form a group. The matrix holds the union of each group's tokens.
3. Opening. A document can link to one of its size or larger in another group only if the group's union holds n - n / 9
   of its tokens. Its rarest tokens, by number of groups, name the groups to bound; groups within the bound are opened,
   and members that hold one of its n / 9 + 1 rarest tokens there are compared exactly. Pairs inside a group need no
   comparison: they are already connected. Documents around one text, but in different groups, are bounded by their
   overlaps with that text instead.

Nothing is approximate but the equality of tokens by a 64-bit hash, and no group, list or bucket is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, discard, give_back, join_sliced, materialize, small, table, vacate

WORDS, KEYS = 5, 4
#: Documents under SMALL tokens have all tokens met, larger ones the share SAMPLED of the hash range. SMALL_SELF is the
#: size up to which every possible partner is under SMALL.
SMALL, SMALL_SELF, SAMPLED = 128, 100, 0.4
#: Documents for each hash bucket, tokens that a task holds before it sends them, word hashes a worker remembers.
DOCS_PER_BUCKET, HELD, REMEMBERED = 50_000, 200_000, 50_000
#: Rounds in which leaders are looked for; links that these leave are found by the opening.
ROUNDS = 2
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NOBODY = -(2**63)
_LIMIT = np.uint64(int(SAMPLED * 2**64))
_SEEDS = np.array([0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Shingler:
    """Token sets of texts; A-Z are lowered, words are runs without ASCII white space."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.known = words, {}

    def tokens(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the shingles; of the whole sequence if it is shorter; none without words."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            w = np.array([known[x] for x in words], np.uint64)
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            w = np.array([known.get(x) or known.setdefault(x, xxhash.xxh3_64_intdigest(x)) for x in words], np.uint64)
        k = min(self.words, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                h = h * _FACTOR + w[i : len(w) - k + 1 + i]
        return np.unique(mixed(h))


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


MET = "bucket int, doc_id long, n int, m int, digest binary, shared int, tokens binary, ids binary"
_MET_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
_MET_NAMES = [x.split()[0] for x in MET.split(", ")]


def send(buckets: int):
    """Per document a row with its counts, and per bucket a row of packed tokens and of the documents that ask about them."""

    def flush(rows: list[list], found: list[np.ndarray], who: list[np.ndarray]) -> pa.RecordBatch:
        tok, doc = np.concatenate(found), np.concatenate(who)
        order = np.argsort(tok, kind="stable")
        tok, doc = tok[order], doc[order]
        first = np.concatenate([[True], tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        sizes = np.diff(np.append(at, len(tok)))
        twice = np.repeat(sizes > 1, sizes)
        asked = doc[twice & (doc >= 0)]  # positions in rows
        for i, n in zip(*np.unique(asked, return_counts=True), strict=True):
            rows[i][5] += int(n)
        ids = np.array([_NOBODY if r[1] is None else r[1] for r in rows] + [_NOBODY], np.int64)
        tok, who_once = tok[at], np.where(sizes > 1, _NOBODY, ids[doc[at]])
        bucket = bucket_of(tok, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, short, who_once = bucket[order], (tok[order] >> np.uint64(12)).astype(np.uint32), who_once[order]
        ends = np.flatnonzero(np.concatenate([bucket[1:] != bucket[:-1], [True]])) + 1 if len(bucket) else []
        start = 0
        for end in ends:
            rows.append([int(bucket[start]), None, None, None, None, None, short[start:end].tobytes(), who_once[start:end].tobytes()])
            start = end
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _MET_TYPES, strict=True)], names=_MET_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        shingler = Shingler()
        rows, found, who, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                t = shingler.tokens(text.as_py())
                n = len(t)
                low = t < _LIMIT
                m = n if n <= SMALL_SELF else int(low.sum())
                sent = t if n < SMALL else t[low]
                asks = np.full(len(sent), len(rows), np.int64)
                if SMALL_SELF < n < SMALL:
                    asks[~low] = -1
                if doc_id is None:
                    asks[:] = -1
                # a row without an id asks nothing and stays in
                rows.append([len(rows) % buckets, doc_id, n, m, set_digest(t), m if doc_id is None else 0, None, None])
                found.append(sent)
                who.append(asks)
                held += len(sent)
                if held >= HELD or len(rows) >= 20_000:
                    yield flush(rows, found, who)
                    rows, found, who, held = [], [], [], 0
        if rows:
            yield flush(rows, found, who)
        rows = found = who = shingler = None
        give_back()

    return run


def bucket_of(tok: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((tok * _FACTOR) >> np.uint64(33)).astype(np.int64) % buckets


ANSWER = "doc_id long, n int, m int, digest binary, shared int"


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: documents pass; each document gets the count of its tokens that another task or row has too."""
    names = [x.split()[0] for x in ANSWER.split(", ")]

    def answer(tok: list[np.ndarray], who: list[np.ndarray]) -> pa.RecordBatch | None:
        if not tok:
            return None
        t, d = np.concatenate(tok), np.concatenate(who)
        order = np.argsort(t, kind="stable")
        t, d = t[order], d[order]
        same = t[1:] == t[:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        ids, n = np.unique(d[twice & (d != _NOBODY)], return_counts=True)
        none = pa.nulls(len(ids), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), none, none, pa.nulls(len(ids), pa.binary()), pa.array(n.astype(np.int32))], names=names)

    tok, who, bucket = [], [], None
    for batch in batches:
        is_doc = np.array([x is not None for x in batch.column("n").to_pylist()], bool)
        if is_doc.any():
            kept = batch.filter(pa.array(is_doc))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in names], names=names)
        for b, t, w, doc in zip(batch.column("bucket").to_pylist(), batch.column("tokens"), batch.column("ids"), is_doc, strict=True):
            if b != bucket:
                if (out := answer(tok, who)) is not None:
                    yield out
                tok, who, bucket = [], [], b
            if not doc:
                tok.append(np.frombuffer(t.as_py(), np.uint32))
                who.append(np.frombuffer(w.as_py(), np.int64))
    if (out := answer(tok, who)) is not None:
        yield out


def token_sets(docs: DataFrame) -> DataFrame:
    """(id, n, tokens array<long>, keys array<long>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.tokens(t.as_py()) for t in batch.column("text")]
            with np.errstate(over="ignore"):
                keys = [[int(mixed(t * s + s).min().view(np.int64)) for s in _SEEDS[:KEYS]] if len(t) else [] for t in sets]
            # a key belongs to its own min-hash only
            keys = [[k ^ i for i, k in enumerate(x)] for x in keys]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in sets], pa.int32()), pa.array([t.view(np.int64) for t in sets], pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "tokens", "keys"])
        shingler = sets = keys = None
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "id long, n int, tokens array<long>, keys array<long>")


SIMILAR = "100 * common >= 80 * (an + bn - common)"


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, an, bn, common) of the pairs whose sizes allow a link. b may be the same in any share of the pairs."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("tokens").alias("at"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("tokens").alias("bt"))
    common: Column = F.size(F.array_intersect("at", "bt"))
    per_b = pairs.groupBy("b").agg(F.count("*").alias("rows"))
    near = join_sliced(pairs.join(left.select("a", "an"), "a"), right.select("b", "bn"), "b", "a", counts=per_b).where("5 * least(an, bn) >= 4 * greatest(an, bn)").select("a", "b")
    return join_sliced(near.join(left, "a"), right, "b", "a", counts=per_b).select("a", "b", "an", "bn", common.alias("common"))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= 80 * union."""
    return overlaps(pairs, sets).where(SIMILAR).select("a", "b")


def groups_and_links(sets: DataFrame, standing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups (id, g) of similar documents, the links that made them, and the overlaps with leaders that were counted.

    The leader of a key is the document most of whose tokens occur elsewhere, then the one with most copies: where many
    documents are edits of one text, that is the text itself. standing has id, share and copies.

    Documents that link to no leader are dealt leaders of their own in further rounds: many copies of an edit may have all
    their keys in common with the text, so they'd stay apart, and all their pairs would be compared later.
    """
    keyed, links, first = sets.select("id", F.explode("keys").alias("key")), None, None
    for _ in range(ROUNDS):
        leaders = keyed.join(standing, "id").groupBy("key").agg(F.max_by("id", F.struct("share", "copies", -F.col("id"))).alias("b"), F.count("*").alias("rows")).where("rows > 1")
        leaders = materialize(leaders, "leaders")
        pairs = join_sliced(keyed, leaders.select("key", "b"), "key", "id", counts=leaders.select("key", "rows")).where("id <> b").select(F.col("id").alias("a"), "b").distinct()
        pairs = materialize(pairs, "pairs")
        counted = materialize(overlaps(pairs, sets), "counted")
        discard(leaders, pairs, collect=False)
        found = counted.where(SIMILAR).select("a", "b")
        links, first = (found, counted) if links is None else (links.unionByName(found), first)
        if found.isEmpty():
            break
        keyed = keyed.join(small(materialize(found.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "placed")), "id", "left_anti")
    counted = first
    groups = connected_components(links)
    return materialize(sets.select("id").distinct().join(groups, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("g")), "groups"), links, counted


def references(counted: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, ref, rn, common): of the leaders that share half of their union with a document, the one with most followers.

    A leader refers to itself, or to a leader with more followers. An id with several rows has no reference.
    """
    several = small(materialize(sets.groupBy("id").count().where("count > 1").select("id"), "several"))
    near = counted.where("3 * common >= an + bn").join(several, F.col("a") == several["id"], "left_anti").join(several, F.col("b") == several["id"], "left_anti")
    followers = materialize(near.groupBy("b").agg(F.count("*").alias("f"), F.max("bn").alias("bn")), "followers")
    own = followers.select(F.col("b").alias("a"), "b", "bn", F.col("bn").alias("common"), "f")
    ranked = near.select("a", "b", "bn", "common").join(small(followers.select("b", "f")), "b").unionByName(own)
    best = ranked.groupBy("a").agg(F.max_by(F.struct("b", "bn", "common"), F.struct("f", -F.col("b"))).alias("r"))
    return materialize(best.select(F.col("a").alias("id"), F.col("r.b").alias("ref"), F.col("r.bn").alias("rn"), F.col("r.common").alias("common")), "refs")


def pairs_of_one_reference(known: DataFrame, refs: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different groups with the same reference that may link.

    Let d be the number of tokens in which a document and the reference differ. Two documents of n and m tokens differ in
    d + d' - 2 s, if s of those are the same for both; linked ones in a ninth of n + m at most. So s is at least o = (d +
    d' - (n + m) / 9) / 2, which is positive for every pair of which one doesn't link to the reference. Hence, with each
    document's d tokens ordered by the number of documents around the reference that have them, the first common one is
    among the first d - o + 1 of either. What few share comes first, so edits that were made apart hardly ever meet. A
    link also has four ninths of n + m in common, which is no more than either shares with other groups.
    """
    at = groups.select(F.col("id").alias("ref"), F.col("g").alias("rg"))
    placed = known.where("most > 0").join(refs.select("id", "ref"), "id").join(at, "ref").select("ref", "rg", "id", "g", "n", "c")
    of_ref = sets.select(F.col("id").alias("ref"), F.col("tokens").alias("rt"))
    differing = F.array_union(F.array_except("tokens", "rt"), F.array_except("rt", "tokens"))
    met = join_sliced(placed.join(sets.select("id", "tokens"), "id"), of_ref, "ref", "id").select("ref", "rg", "id", "g", "n", "c", differing.alias("t"))
    each = materialize(met.select("ref", "rg", "id", "g", "n", "c", F.size("t").alias("d"), F.explode("t").alias("token")), "differing")
    several = each.groupBy("ref", "token").agg(F.count("*").alias("df")).where("df > 1")
    by_doc = Window.partitionBy("ref", "id")
    shared = each.join(several, ["ref", "token"])
    # tokens that no other document has come first of all
    ranked = shared.withColumn("rank", F.row_number().over(by_doc.orderBy("df", "token")) + F.col("d") - F.count("*").over(by_doc)).where("rank <= floor(n / 4) + 1")
    ranked = materialize(ranked.select("ref", "token", "rg", "id", "g", "n", "c", "d", "rank"), "ranked")
    # of two groups, one isn't the reference's
    x = ranked.where("g <> rg").select(F.col("ref").alias("xref"), F.col("token").alias("xtoken"), *(F.col(k).alias(f"x{k}") for k in ("id", "g", "n", "c", "d", "rank")))
    least = "9 * (xd + d) - (xn + n)"
    may = f"xg <> g and (g = rg or xid < id) and 5 * least(xn, n) >= 4 * greatest(xn, n) and 9 * least(xc, c) >= 4 * (xn + n) and 18 * (xd - xrank + 1) >= {least} and 18 * (d - rank + 1) >= {least}"
    met = x.join(ranked, (F.col("xref") == F.col("ref")) & (F.col("xtoken") == F.col("token")) & F.expr(may))
    return met.select(F.greatest("xid", "id").alias("a"), F.least("xid", "id").alias("b"))


def links_between(sets: DataFrame, groups: DataFrame, refs: DataFrame) -> DataFrame:
    """Links (a, b) between documents of different groups, by the token-group matrix.

    Every pair is looked for from its smaller document (n tokens), at most n / 9 of whose tokens a partner of n tokens
    or more can lack. So of its rarest n / 9 + e tokens, by number of groups, a group to open holds e at least. A
    partner of m tokens, c of them in other groups, can only be that of a document with 4 n <= 9 c - 4 m; the matrix
    keeps, with each group, the largest n that any of its documents allows.

    Where many documents are edits of one text, too far from it to be of its group, each shares nearly all tokens with
    each other. What they don't share with that text, their reference, is little, and tells them apart. So a document
    doesn't ask about groups all of whose documents have its own reference: such pairs come from those differences.

    A partner lacks at most n / 9 of the document's tokens, so it holds one of any n / 9 + 1 of them. In an opened group
    these are the rarest there, tokens that the group hasn't first: members of a large group that have only what all of
    them have in common with the document aren't met, whatever references the group's other documents have.
    """
    tokens = sets.select("id", "n", F.explode("tokens").alias("token")).join(groups, "id")
    spread = tokens.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("token")
    seen = materialize(tokens.join(spread, "token").select("id", "n", "g", "token"), "seen")
    known = materialize(seen.groupBy("id", "n", "g").agg(F.count("*").alias("c")).withColumn("most", F.floor((9 * F.col("c") - 4 * F.col("n")) / 4)).withColumn("most", F.least("most", F.col("n").cast("long"))), "known")
    one_ref = F.when((F.count("*") == F.count("ref")) & (F.min("ref") == F.max("ref")), F.min("ref"))
    of_group = groups.join(refs.select("id", "ref"), "id", "left").groupBy("g").agg(one_ref.alias("only"), F.count("*").alias("members"))
    reach = known.groupBy("g").agg(F.max("most").alias("most")).where("most > 0").join(of_group.select("g", "only"), "g")
    matrix = materialize(seen.groupBy("token", "g").agg(F.count("*").alias("df")).join(reach.select("g", "most", "only"), "g"), "matrix")
    able = known.where("c >= n - floor(n / 9)").withColumn("e", F.floor(F.col("n") / 18) + 1).select("id", "e", (F.floor(F.col("n") / 9) - (F.col("n") - F.col("c")) + F.col("e")).alias("take"))
    spread_of = matrix.groupBy("token").agg(F.count("*").alias("gdf"))
    asking = materialize(seen.join(small(materialize(able, "able")), "id").join(spread_of, "token", "left").withColumn("gdf", F.coalesce("gdf", F.lit(0))), "asking")
    rare = asking.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("gdf", "token"))).where("r <= take")
    rare = rare.select("id", F.col("n").alias("qn"), "e", "token", F.col("g").alias("own")).join(small(refs.select("id", "ref")), "id", "left")
    met = rare.join(matrix, "token").where("g <> own and most >= qn and not coalesce(ref = only, false)")
    members = of_group.select("g", "members")
    named = materialize(met.groupBy("id", "g", "qn", "e").agg(F.count("*").alias("c")).where("c >= e").join(members, "g").select("id", "g", "qn", "members"), "named")
    # the union of a single document is the document: comparing it is the bound
    held = Window.partitionBy("id", "g", "qn")
    bound = (
        named.where("members > 1")
        .join(asking.select("id", "token"), "id")
        .join(matrix.select("token", "g", "df"), ["token", "g"])
        .withColumn("c", F.count("*").over(held))
        .where("c >= qn - floor(qn / 9)")
        .withColumn("r", F.row_number().over(held.orderBy("df", "token")))
        .where("r <= floor(qn / 9) + 1 - (qn - c)")
    )
    bound = materialize(bound.select("id", "g", "qn", "token"), "opened")
    ref_of = refs.select("id", "ref")
    partners = known.select(F.col("id").alias("other"), "g", "n", "most").where("most > 0").join(ref_of.select(F.col("id").alias("other"), F.col("ref").alias("other_ref")), "other", "left")
    listed = seen.select(F.col("id").alias("other"), "g", "token").join(partners, ["other", "g"])
    asked = lambda x: x.join(ref_of, "id", "left")
    may = "n >= qn and most >= qn and not coalesce(ref = other_ref, false)"
    alone = asked(named.where("members = 1").select("id", "g", "qn")).join(partners, "g").where(may)
    within = asked(bound).join(listed, ["token", "g"]).where(may)
    pairs = alone.select("id", "other").unionByName(within.select("id", "other")).select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b"))
    pairs = materialize(pairs.unionByName(pairs_of_one_reference(known, refs, groups, sets)).distinct(), "open_pairs")
    found = materialize(linked(pairs, sets), "between")
    discard(seen, matrix, asking, known, named, bound, pairs)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs.

    A null, empty or blank text has no shingles and no links; a text of fewer than five words is one shingle. Equal sets
    are one node until the end, so copies cost a row each. Rows that share a doc_id are one node. A row without a
    doc_id links with equal sets only, and its component_id is null if none of them has an id.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select("doc_id", "text")
    rows, sharing, _ = sharing_rows(base)
    reps = materialize(sharing.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "reps")
    # once more among one document of each equal set: what only copies share doesn't count
    ids = reps.where("id is not null").select(F.col("id").alias("doc_id")).distinct()
    once = base.join(small(materialize(ids, "ids")), "doc_id", "left_semi")
    _, still, met = sharing_rows(once)
    again = materialize(still.groupBy("doc_id").agg(F.max(F.round(F.col("met") / F.col("m"), 3)).alias("share")), "again")
    discard(met)
    sets = materialize(token_sets(once.join(small(again.select("doc_id")), "doc_id", "left_semi")), "sets")
    standing = again.withColumnRenamed("doc_id", "id").join(reps.groupBy("id").agg(F.max("copies").alias("copies")), "id")
    groups, inside, counted = groups_and_links(sets, standing)
    between = links_between(sets, groups, references(counted, sets))
    discard(sets)
    of = connected_components(inside.unionByName(between))
    of_digest = reps.join(of, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("component"))
    return rows.join(materialize(of_digest, "of_digest"), "digest", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def sharing_rows(base: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, m, digest) of all rows, and of those that share enough tokens, with met, how many of m they share; and
    the scratch table that both read."""
    buckets = 64 + -(-base.count() // DOCS_PER_BUCKET)
    met = base.mapInArrow(send(buckets), MET).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, ANSWER)
    met = materialize(met, "met")
    rows = met.where("n is not null")
    counts = met.where("n is null").groupBy("doc_id").agg(F.sum("shared").alias("more"))
    known = rows.where("n > 0").join(counts, "doc_id", "left").withColumn("met", F.col("shared") + F.coalesce("more", F.lit(0)))
    return rows, known.where("met >= m - floor(n / 5)"), met


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
