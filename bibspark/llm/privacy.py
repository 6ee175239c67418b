"""Operator 7, personal data (native): fixed patterns, and information-theoretic sanitisation around them.

The values that the patterns find, and the classes they belong to (a mail domain, a network, a card issuer, an area
code), are protected entities. A term that keeps company with an entity and hardly occurs elsewhere discloses it: its
pointwise mutual information with the entity, over the documents of the corpus, comes near the entity's own information
content (Sánchez and Batet 2016). Terms above a first threshold are generalised to a class word, terms above a second
one are removed, wherever they occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .common import join_sliced, materialize, small, table

#: kind: (a sign that must be there, pattern, test of a match). Possessive forms give the plain ones' matches without
#: the regular-expression engine's recursion; \G and the look-behinds keep it from starting inside a run again.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
BASE_KINDS, TERM_KINDS = ("email", "ip", "card", "phone"), ("generalise", "remove")
KINDS = (*BASE_KINDS, *TERM_KINDS)
SPAN = "struct<kind:int,start:int,end:int,value:string>"
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}
#: Terms each side of an entity that may disclose it, and the characters read for them: what stands farther off isn't
#: considered.
NEAR_TERMS, NEAR_CHARS = 5, 120
#: Documents that a pair needs (one is no co-occurrence), and the chance, over all pairs of a corpus, that any passes
#: without a tie between term and entity.
DOCUMENTS, CHANCE = 2, 0.05
#: Shares of the entity's information content from which a term is generalised and removed. A share s leaves 1 - s of the
#: entity's bits open: of 17 bits (a document in 10^5) a reader of the term guesses right one time in two at 0.95, nine
#: times in ten at 0.99.
GENERALISE, REMOVE = 0.95, 0.99
TERM = r"\p{L}{3,}+"
#: Copies are told by bands of min-hashes of five-word shingles: two texts of similarity s share one of BANDS bands with
#: probability 1 - (1 - s^BAND)^BANDS: 0.997 at 0.8, 0.05 at 0.19.
BANDS, BAND, SHINGLE = 8, 3, 5
#: Rows of a pair that one task meets, if the pairs aren't few.
DEALT_ROWS = 100_000


def matches(text: Column, pattern: str, kind: int | Callable[[Column], Column]) -> Column:
    """array<SPAN> of all matches, leftmost and not overlapping; offsets in code points. The pieces between matches
    give the offsets. A function gives each match its kind, null for none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    none = F.lit([]).cast(f"array<{SPAN}>")
    of = kind if callable(kind) else lambda _: F.lit(kind)
    start = lambda a, p: (a["at"] + F.length(p["between"])).cast("int")
    span = lambda a, p: F.struct(of(p["found"]).alias("kind"), start(a, p).alias("start"), (start(a, p) + F.length(p["found"])).alias("end"), p["found"].alias("value"))
    return F.aggregate(
        F.slice(F.arrays_zip(between.alias("between"), found.alias("found")), 1, F.size(found)),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, p: F.struct((start(a, p) + F.length(p["found"])).alias("at"), F.when(of(p["found"]).isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(span(a, p)))).alias("out")),
        lambda a: a["out"],
    )


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<SPAN> of email, ip, card and phone, by kind and start; failing matches are dropped."""
    none = F.lit([]).cast(f"array<{SPAN}>")
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    email = F.when(F.contains(text, F.lit("@")), matches(text, EMAIL, 0)).otherwise(none)
    ip = F.when(text.rlike(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), F.filter(matches(text, IP, 1), lambda s: s["value"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))).otherwise(none)
    card = F.when(
        text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        F.filter(F.filter(matches(text, CARD, 2), lambda s: F.length(digits(s)).between(13, 19)), lambda s: luhn(digits(s))),
    ).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE, 3), lambda s: F.length(digits(s)).between(9, 15))).otherwise(none)
    return F.concat(email, ip, card, phone)


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and base spans of every row (null text: empty)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text")).withColumn("base", base_spans(F.col("text")))


def entities(span: Column) -> Column:
    """array<string>: digests of a span's value and of its class: an e-mail address's domain, an IP address's first three
    numbers, a card's first six digits, a phone number's first six."""
    value, kind = span["value"], span["kind"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    group = F.when(kind == 0, F.lower(F.substring_index(value, "@", -1))).when(kind == 1, F.substring_index(value, ".", 3)).otherwise(F.substring(digits, 1, 6))
    name = lambda what, x: F.xxhash64(F.lit(what), kind, x)
    return F.array(name("value", value), name("class", group))


def neighbours(docs: DataFrame) -> DataFrame:
    """(entity, row, text_key, term): terms beside an entity, once for each document; and a row with a null term for the
    entity itself. Rows that repeat an id and a text are one document."""
    spans = found_in(docs).where(F.size("base") > 0).select("doc_id", "text_key", "text", F.explode("base").alias("s"))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))
    left = words(F.expr(f"substring(text, greatest(s.start - {NEAR_CHARS}, 0) + 1, least(s.start, {NEAR_CHARS}))"))
    right = words(F.expr(f"substring(text, s.end + 1, {NEAR_CHARS})"))
    near = spans.select("doc_id", "text_key", F.explode(entities(F.col("s"))).alias("entity"), F.slice(left, F.greatest(F.size(left) - NEAR_TERMS + 1, F.lit(1)), NEAR_TERMS).alias("l"), F.slice(right, 1, NEAR_TERMS).alias("r"))
    terms = F.concat(F.array(F.lit(None).cast("string")), "l", "r")
    return near.select("entity", F.xxhash64("doc_id", "text_key").alias("row"), "text_key", F.explode(terms).alias("term")).distinct()


def bands(text: Column) -> Column:
    """array<long> of BANDS keys: texts that are near copies share one, others don't. The least of the shingles' hashes
    after an exclusive or with a constant is a min-hash; BAND of them make a key. A text of fewer words is one shingle."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    last = lambda w: F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))
    hashes = lambda w: F.transform(F.sequence(F.lit(1), last(w)), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))
    least = lambda h, i: F.array_min(F.transform(h, lambda x: x.bitwiseXOR(F.xxhash64(F.lit(i)))))
    key = lambda h, b: F.xxhash64(*[least(h, b * BAND + j) for j in range(BAND)])
    return let(words, lambda w: let(hashes(w), lambda h: F.array(*[key(h, b) for b in range(BANDS)])))


def independent(docs: DataFrame, near: DataFrame, held: DataFrame) -> DataFrame:
    """(entity, term, alone): for pairs of held (entity, term, both), the documents that hold the pair, near copies of one
    another counted once: the least number of different keys in any band.

    Bands are made of texts that hold such a pair only; a text with any share of the rows is a row a task.
    """
    pair = F.xxhash64("entity", "term").alias("pair")
    rows, asked = near.where("term is not null").select("entity", "term", "text_key", pair), held.select(pair, F.col("both").alias("rows"))
    pairs = asked.select("pair")
    few = small(pairs)
    hits = rows.join(few, "pair") if few is not pairs else join_sliced(rows, pairs, "pair", "text_key", DEALT_ROWS, asked)
    hits = materialize(hits.select("entity", "term", "text_key"), "hits")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    keys = materialize(hits.select("text_key").distinct(), "keys")
    some = small(keys)
    drawn = texts if some is keys else texts.join(some, "text_key")
    drawn = materialize(drawn.select("text_key", bands(F.col("text")).alias("b")).dropDuplicates(["text_key"]), "bands")
    counts = [F.count_distinct(F.col("b")[i]) for i in range(BANDS)]
    return hits.join(drawn, "text_key").groupBy("entity", "term").agg(F.least(*counts).alias("alone"))


def disclosing_terms(docs: DataFrame, documents: int = DOCUMENTS, generalise: float = GENERALISE, remove: float = REMOVE, chance: float = CHANCE) -> DataFrame:
    """(term, kind): terms to generalise or remove.

    A pair of an entity and a term beside it is scored over all documents: PMI(entity, term) against IC(entity), from the
    documents that hold the entity, the term, and the one beside the other. Two rules keep chance out: the pair stands in
    two documents at least, and the count of joint documents, k where x are expected, has a Poisson tail (by its Chernoff
    bound, exp(k - x) (x / k)^k) below the chance that is allowed, shared out over all pairs. The best share of a term
    decides its kind. Both rules take documents as independent, so near copies that hold a pair count once, and the rest
    of them is taken from all counts of the pair.

    Pairs are counted by groups with map-side partial sums, so an entity with a third of all rows costs a row a task; term
    frequencies are counted for the terms of pairs in enough documents only. A null or empty corpus has none.
    """
    near = materialize(neighbours(docs), "neighbours")
    beside = near.where("term is not null").groupBy("entity", "term").agg(F.count("*").alias("both"))
    beside = materialize(beside, "beside")
    n, pairs = max(docs.count(), 1), max(beside.count(), 1)
    held = materialize(beside.where(F.col("both") >= documents), "held")
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    by_word = text.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    asked = held.select("term").distinct()
    few = small(asked)
    # where the terms aren't few, words are counted before they meet them: a stop word is a row a task
    df = (by_word if few is asked else by_word.join(few, "term")).groupBy("term").agg(F.count("*").alias("df"))
    entity_df = near.where("term is null").groupBy("entity").agg(F.count("*").alias("entity_df"))
    alone = independent(docs, near, held)
    scored = held.join(alone, ["entity", "term"]).where(F.col("alone") >= documents).join(df, "term").join(entity_df, "entity")
    copies = F.col("both") - F.col("alone")
    k, with_term, with_entity, whole = F.col("alone"), F.greatest("df", "both") - copies, F.col("entity_df") - copies, F.lit(n) - copies
    expected = with_entity * with_term / whole
    sure = k * F.ln(k / expected) - k + expected >= F.ln(F.lit(pairs / chance))
    share = F.log2(k / expected) / F.log2(whole / with_entity)
    best = scored.where(sure & (F.col("entity_df") < n)).groupBy("term").agg(F.max(share).alias("share"))
    return best.where(F.col("share") >= generalise).select("term", F.when(F.col("share") >= remove, 5).otherwise(4).alias("kind"))


def with_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, text_key, base, spans: base spans, and spans of disclosing terms, by kind and start.

    Rows that hold a term are found with the term table broadcast if it is small; their term spans, narrow, are then
    joined to the base spans. Rows that repeat an id and a text are alike.
    """
    rows = found_in(docs)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    words = text.select("doc_id", "text_key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    hits = words.join(small(terms), "term").groupBy("doc_id", "text_key").agg(F.map_from_entries(F.collect_set(F.struct("term", "kind"))).alias("kinds"))
    hits = materialize(hits.select(F.col("doc_id").alias("x_id"), F.col("text_key").alias("x_key"), "kinds"), "hits")
    same = (F.col("text_key") == F.col("x_key")) & F.col("doc_id").eqNullSafe(F.col("x_id"))
    holding = text.join(small(hits), same)
    placed = matches(F.col("text"), TERM, lambda v: F.try_element_at("kinds", F.lower(v)))
    extra = holding.select("x_id", "x_key", F.array_sort(placed).alias("extra")).dropDuplicates(["x_id", "x_key"])
    joined = rows.join(extra, same, "left")
    return joined.select("doc_id", "text_key", "base", F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.concat("base", "extra")).alias("spans"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, materialize(disclosing_terms(docs), "terms"))
    # a second parameter of the lambda would be the element's index, whatever its default
    of_kind = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with its spans replaced by placeholders; of overlapping spans the earlier, then the longer, then the kind
    listed first, is replaced whole and the later one only beyond it."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(PLACEHOLDERS[k]) for k in KINDS])
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], -s["minus_end"]).alias("at"),
            F.when(-s["minus_end"] <= a["at"], a["out"])
            .otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.element_at(names, s["kind"] + 1)))
            .alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(done)
