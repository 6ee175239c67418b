"""Nested paper records: parsing replies, integrity rules, grouping into directions, comparison slots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_inline, let, pretty_term, term_key, truncate
from ..scratch import materialize

LISTS = ("included", "borderline", "representative")
SLOTS = ("inputs", "methods", "outputs")
#: Items of a paper's lists that are tried before the whole list is.
AHEAD = 16
#: What is written for a slot that doesn't differ, for a cut list's rest, and for an unnamed paper.
SAME, REST, PAPER = "同主线", "其余 {} 项见结构化结果", "文献"


# F1
#: Brackets, quotes, and what a backslash takes with it.
_MARK = r"(?s)\\.|[\"{}\[\]]"


def first_value(text: Column) -> Column:
    """struct(end, bad) of a text that starts with a bracket: the length of its first JSON value, null if that is never
    closed, and whether brackets of different kinds meet. A fold over the brackets outside strings."""
    found, between = F.regexp_extract_all(text, F.lit(_MARK), F.lit(0)), F.split(text, _MARK, -1)
    steps = F.slice(F.arrays_zip(between.alias("b"), found.alias("f")), 1, F.size(found))
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("quoted"), F.lit("").alias("open"), F.lit(None).cast("int").alias("end"), F.lit(False).alias("bad"))

    def step(a: Column, p: Column) -> Column:
        mark = F.right(p["f"], F.lit(1))
        at = (a["at"] + F.length(p["b"]) + F.length(p["f"])).cast("int")
        closes, fits = mark.isin("}", "]"), F.right(a["open"], F.lit(1)) == F.translate(mark, "}]", "{[")
        left = F.left(a["open"], F.length(a["open"]) - 1)
        inside = F.struct(at.alias("at"), (p["f"] != '"').alias("quoted"), a["open"].alias("open"), a["end"].alias("end"), a["bad"].alias("bad"))
        outside = F.struct(
            at.alias("at"),
            (mark == '"').alias("quoted"),
            F.when(mark.isin("{", "["), F.concat(a["open"], mark)).when(closes, left).otherwise(a["open"]).alias("open"),
            F.when(closes & fits & (F.length(a["open"]) == 1), at).cast("int").alias("end"),
            (closes & ~fits).alias("bad"),
        )
        return F.when(a["end"].isNotNull() | a["bad"], a).when(a["quoted"], inside).otherwise(outside)

    return F.aggregate(steps, start, step, lambda a: F.struct(a["end"].alias("end"), a["bad"].alias("bad")))


def parse_replies(df: DataFrame, schema: str, reply: str = "reply") -> DataFrame:
    """df with record (a struct of the schema, of a reply that is an object), records (an array of them, of one that is a
    list; null for members that aren't objects) and status.

    The JSON part is a fenced block, else it starts at the first bracket, which also says whether it is an object or a
    list, and ends where that is closed. Status: ok, repaired (control characters inside strings), no_json (no bracket),
    unclosed, mismatched (a bracket closes one of the other kind), invalid (no JSON between balanced brackets). Text after
    the first value is ignored, in a fenced block after an object only. Lists of lists aren't repaired. A null reply has
    no JSON.
    """
    names = [f.name for f in T.StructType.fromDDL(schema)]
    t = F.trim(F.col(reply))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*\}|\[.*\])\s*```", 1)
    rest = F.regexp_extract(t, r"(?s)([{\[].*)", 1)
    out = df.withColumn("__fenced", fenced != "").withColumn("__body", F.when(fenced != "", fenced).when(rest != "", rest)).withColumn("__list", F.startswith("__body", F.lit("[")))
    bad = {"columnNameOfCorruptRecord": "_bad"}
    parsed = lambda text, fields, **more: F.from_json(text, f"{fields}, _bad string", bad | more)
    an_object = F.when(~F.col("__list"), F.col("__body"))
    out = out.withColumn("__s", parsed(an_object, schema)).withColumn("__l", parsed(an_object, schema, allowUnquotedControlChars="true"))
    good = lambda c: F.coalesce(F.col(f"{c}._bad").isNull() & F.col(c).isNotNull(), F.lit(False))
    single = ~F.col("__list") & (good("__s") | good("__l"))
    out = out.withColumn("__v", F.when(F.col("__body").isNotNull() & ~F.col("__fenced") & ~single, first_value(F.col("__body"))))
    whole = F.when(F.col("__list"), F.when(F.col("__fenced"), F.col("__body")).otherwise(F.expr("left(__body, __v.end)")))
    out = out.withColumn("__m", F.try_parse_json(whole)).withColumn("__r", parsed(F.when(F.col("__m").isNull(), F.concat(F.lit('{"items":'), whole, F.lit("}"))), f"items array<struct<{schema}>>", allowUnquotedControlChars="true"))
    members = F.transform(F.try_variant_get("__m", "$", "array<variant>"), lambda v: F.try_variant_get(v, "$", f"struct<{schema}>"))
    status = (
        F.when(F.col("__body").isNull(), "no_json").when(good("__s") | F.col("__m").isNotNull(), "ok").when(good("__l") | good("__r"), "repaired")
        .when(F.col("__v.bad"), "mismatched").when(~F.col("__fenced") & F.col("__v.end").isNull(), "unclosed").otherwise("invalid")
    )
    pick = lambda c: F.struct(*[F.col(c)[n].alias(n) for n in names])
    out = out.withColumn("status", status).withColumn("record", F.when(good("__s"), pick("__s")).when(good("__l"), pick("__l")))
    out = out.withColumn("records", F.when(F.col("__m").isNotNull(), members).when(good("__r"), F.col("__r.items")))
    return out.drop("__fenced", "__body", "__list", "__s", "__l", "__v", "__m", "__r")


# F2
BLOCKS = ("paper_position", "problem_context", "task_object", "inputs", "methods", "outputs", "evaluation", "direction_hint")


def compact(structures: DataFrame) -> DataFrame:
    """paper_id, title, year and eight blocks; a block that the table lacks is null."""
    there = lambda c: F.col(c) if c in structures.columns else F.lit(None).alias(c)
    return structures.select("paper_id", F.col("bibliography.title").alias("title"), F.col("bibliography.year").alias("year"), *[there(b) for b in BLOCKS])


# F3
def trimmed(c: Column, kind: T.DataType, items: int = 6, chars: int = 260) -> Column:
    """c with every array cut to items and every string shortened, however deep; the schema is walked when the plan is made."""
    if isinstance(kind, T.StringType):
        return F.when(c.isNotNull(), truncate(c, chars, "ellipsis"))
    if isinstance(kind, T.ArrayType):
        return F.transform(F.slice(c, 1, items), lambda x: trimmed(x, kind.elementType, items, chars))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[trimmed(c[f.name], f.dataType, items, chars).alias(f.name) for f in kind]))
    return c


def trim_nested(df: DataFrame, items: int = 6, chars: int = 260) -> DataFrame:
    return df.select(*[trimmed(F.col(f.name), f.dataType, items, chars).alias(f.name) for f in df.schema])


# F4
def explode_mapping(mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flat tables (directions, memberships, assignments) of nested rows with directions and paper_assignments arrays."""
    d = mapping.select(F.posexplode("directions").alias("direction_pos", "d"))
    directions = d.select("direction_pos", "d.direction_id", "d.direction_name", "d.direction_definition")
    kinds = F.array(*[F.struct(F.lit(k).alias("list_kind"), F.col(f"d.{k}_paper_ids").alias("ids")) for k in LISTS])
    lists = d.select(F.col("d.direction_id").alias("direction_id"), F.inline(kinds))
    memberships = lists.select("direction_id", "list_kind", F.posexplode("ids").alias("pos", "paper_id"))
    assignments = mapping.select(F.posexplode("paper_assignments").alias("pos", "a")).select("pos", "a.paper_id", "a.direction_id")
    return directions, memberships, assignments


# F5
def mapping_facts(structures: DataFrame, directions: DataFrame, memberships: DataFrame, assignments: DataFrame, schemas: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """(kind, list_kind, direction_id, paper_id): a row for each row of the inputs. Ids are trimmed; blank means missing."""
    inputs = {"structure": structures, "direction": directions, "list": memberships, "assignment": assignments, "schema": schemas, "record": records}
    there = {"structure": ("paper_id",), "list": ("list_kind", "direction_id", "paper_id"), "assignment": ("direction_id", "paper_id")}
    clean = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    of = lambda kind, c: (F.col(c) if c == "list_kind" else clean(c)) if c in there.get(kind, ("direction_id",)) else F.lit(None).cast("string")
    made = [t.select(F.lit(k).alias("kind"), *[of(k, c).alias(c) for c in ("list_kind", "direction_id", "paper_id")]) for k, t in inputs.items() if t is not None]
    return reduce(DataFrame.unionByName, made)


def validate_mapping(structures: DataFrame, directions: DataFrame, memberships: DataFrame, assignments: DataFrame, schemas: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """(rule, direction_id, paper_id, detail): a row for each violation. A valid mapping gives none.

    structures has paper_id; directions direction_id; memberships direction_id, list_kind, paper_id; assignments
    paper_id, direction_id; schemas and records direction_id. detail tells what the ids don't: how often an id is there,
    which list or table a row is of, in which directions' lists a paper stands; else it is null.

    All inputs are read once, as facts, which are written. Then missing ids are told row by row, ids that nothing defines
    by one anti join of all references, and the rest by one aggregate by paper and direction, in which a key with any
    share of the rows is a row a task. A paper's set of directions is the only list that is gathered.
    """
    facts = materialize(mapping_facts(structures, directions, memberships, assignments, schemas, records), "facts")
    kind, d, p, no = F.col("kind"), F.col("direction_id"), F.col("paper_id"), F.lit(None).cast("string")
    tables = [name for name, t in (("schema", schemas), ("record", records)) if t is not None]

    def violation(rule: str, when: Column, direction: Column = no, paper: Column = no, detail: Column = no) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), direction.alias("direction_id"), paper.alias("paper_id"), detail.alias("detail")))

    def told(df: DataFrame, *rules: Column) -> DataFrame:
        return df.select(F.inline(F.array_compact(F.array(*rules))))

    by_row = told(
        facts,
        violation("structure id missing", (kind == "structure") & p.isNull()),
        violation("direction id missing", (kind == "direction") & d.isNull()),
        violation("assignment without paper", (kind == "assignment") & p.isNull(), d),
        violation("assignment without direction", (kind == "assignment") & p.isNotNull() & d.isNull(), paper=p),
        *[violation(f"{name} without direction", (kind == name) & d.isNull()) for name in tables],
    )

    whole = (kind != "list") | (p.isNotNull() & d.isNotNull())
    key = F.explode(F.array(F.struct(F.lit("paper").alias("by"), p.alias("key")), F.struct(F.lit("direction").alias("by"), d.alias("key"))))
    keyed = facts.where(whole).select("*", key.alias("k")).select("*", "k.by", "k.key").drop("k").where("key is not null")
    defines = ((F.col("by") == "paper") & (kind == "structure")) | ((F.col("by") == "direction") & (kind == "direction"))
    refers = ((F.col("by") == "paper") & kind.isin("list", "assignment")) | ((F.col("by") == "direction") & p.isNotNull() & (kind == "assignment")) | ((F.col("by") == "direction") & kind.isin(*tables))
    unknown = keyed.where(refers).join(keyed.where(defines).select("by", "key"), ["by", "key"], "left_anti")
    paper = F.col("by") == "paper"
    by_reference = told(
        unknown,
        violation("list holds unknown paper", paper & (kind == "list"), d, p, F.concat(F.lit("list="), "list_kind")),
        violation("assignment of unknown paper", paper & (kind == "assignment"), d, p),
        violation("assignment to unknown direction", ~paper & (kind == "assignment"), d, p),
        *[violation(f"{name} of unknown direction", ~paper & (kind == name), d) for name in tables],
    )

    count = lambda when: F.count(F.when(when, 1))
    n = {k: count(kind == k).alias(k) for k in ("structure", "direction", "list", "assignment", "schema", "record")}
    held = count((kind == "list") & F.col("list_kind").isin("included", "borderline")).alias("held")
    in_lists = F.array_sort(F.collect_set(F.when(paper & (kind == "list"), d))).alias("ds")
    assigned = F.max(F.when(kind == "assignment", d)).alias("assigned")
    states = keyed.groupBy("by", "key").agg(*n.values(), held, in_lists, assigned)
    k = F.col("key")
    n = {name: F.col(name) for name in n}
    times = lambda name: F.concat(F.lit("times="), n[name].cast("string"))
    listed = F.concat(F.lit("lists="), F.array_join("ds", ","))
    by_key = told(
        states,
        violation("structure id repeated", paper & (n["structure"] > 1), paper=k, detail=times("structure")),
        violation("assignment repeated", paper & (n["assignment"] > 1), paper=k, detail=times("assignment")),
        violation("structure without assignment", paper & (n["structure"] > 0) & (n["assignment"] == 0), paper=k),
        violation("paper in several directions", paper & (F.size("ds") > 1), paper=k, detail=listed),
        violation("assignment not in its lists", paper & (n["assignment"] > 0) & (F.size("ds") > 0) & ~F.array_contains("ds", F.coalesce("assigned", F.lit(""))), F.col("assigned"), k, listed),
        violation("direction id repeated", ~paper & (n["direction"] > 1), k, detail=times("direction")),
        violation("direction is empty", ~paper & (n["direction"] > 0) & (F.col("held") == 0), k),
        violation("direction has no papers", ~paper & (n["direction"] > 0) & (n["list"] == 0), k),
        *[violation(f"{name} repeated", ~paper & (n[name] > 1), k, detail=times(name)) for name in tables],
        *[violation(f"direction without {name}", ~paper & (n["direction"] > 0) & (n[name] == 0), k) for name in tables],
    )
    return by_row.unionByName(by_reference).unionByName(by_key)


#: (rule, path, kind) of a whole synthesis reply: kinds as schema_of_variant names them.
SYNTHESIS_TYPES = [("direction_mapping must be an object", "$.direction_mapping", "OBJECT"), ("direction_schemas must be an array", "$.direction_schemas", "ARRAY"), ("direction_records must be an array", "$.direction_records", "ARRAY"), ("cross_direction_comparison must be an object", "$.cross_direction_comparison", "OBJECT"), ("cross_direction_differences must be an array", "$.cross_direction_comparison.cross_direction_differences", "ARRAY"), ("directions must be an array", "$.direction_mapping.directions", "ARRAY"), ("paper_assignments must be an array", "$.direction_mapping.paper_assignments", "ARRAY")]


def type_violations(df: DataFrame, key: str, variant: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(key, rule): values of a VARIANT column that are missing or of the wrong JSON kind at a path."""
    at = lambda path: F.schema_of_variant(F.try_variant_get(F.col(variant), path, "variant"))
    found = F.array(*[F.when(~F.coalesce(F.startswith(at(path), F.lit(kind)), F.lit(False)), F.lit(rule)) for rule, path, kind in rules])
    return df.select(key, F.explode(F.array_compact(found)).alias("rule"))


# F6
def direction_papers(memberships: DataFrame, assignments: DataFrame, structures: DataFrame, titles: DataFrame) -> DataFrame:
    """(direction_id, pos, paper_id, how): a direction's papers in the order of its lists, then assignments, each once.

    A direction none of whose ids has a structure takes structures whose title equals an assigned title. memberships has
    pos within a list; assignments pos; structures paper_id, title; titles paper_id, direction_id, title as assigned.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(LISTS) for x in (k, i)]), F.col("list_kind"))
    wanted = memberships.select("direction_id", "paper_id", F.struct(rank.alias("l"), F.col("pos")).alias("o")).unionByName(assignments.select("direction_id", "paper_id", F.struct(F.lit(len(LISTS)).alias("l"), F.col("pos")).alias("o")))
    first = wanted.where("paper_id is not null and paper_id <> ''").groupBy("direction_id", "paper_id").agg(F.min("o").alias("o"))
    direct = first.join(structures.select("paper_id").distinct(), "paper_id").select("direction_id", "paper_id", "o", F.lit("id").alias("how"))
    rest = titles.join(direct.select("direction_id").distinct(), "direction_id", "left_anti").select("direction_id", "title").distinct()
    named = rest.join(structures.select("paper_id", "title"), "title").select("direction_id", "paper_id", F.struct(F.lit(9).alias("l"), F.lit(0).cast("long").alias("pos")).alias("o"), F.lit("title").alias("how"))
    both = direct.unionByName(named)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("direction_id").orderBy("o", "paper_id")) - 1).select("direction_id", "pos", "paper_id", "how")


# F7
def record_identity(records: DataFrame, variant: str = "record") -> DataFrame:
    """records with paper_id, title, year, from the record's paper object, else its meta object, else its top."""
    v = F.col(variant)
    where = lambda name: F.startswith(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("OBJECT"))
    get = lambda field, kind: F.when(where("paper"), F.try_variant_get(v, f"$.paper.{field}", kind)).when(where("meta"), F.try_variant_get(v, f"$.meta.{field}", kind)).otherwise(F.try_variant_get(v, f"$.{field}", kind))
    return records.withColumn("paper_id", F.trim(F.coalesce(get("paper_id", "string"), F.lit("")))).withColumn("title", F.trim(F.coalesce(get("title", "string"), F.lit("")))).withColumn("year", get("year", "int"))


# F8, F9
def citations(assignments: DataFrame, structures: DataFrame, known: DataFrame) -> DataFrame:
    """(paper_id, title, year, citation): the known citation of the title, else the title, shortened, with its year.
    The last structure (by paper_id) of a title gives the year."""
    years = structures.where("title <> ''").groupBy(F.trim("title").alias("title")).agg(F.max_by(F.coalesce(F.col("year").cast("string"), F.lit("")), "paper_id").alias("year"))
    a = assignments.select(F.trim("paper_id").alias("paper_id"), F.trim(F.coalesce("title", F.lit(""))).alias("title"))
    j = a.join(years, "title", "left").join(known.select("title", F.col("citation").alias("k")), "title", "left").withColumn("year", F.coalesce("year", F.lit("")))
    short = F.when(F.length("title") <= 20, F.col("title")).otherwise(F.concat(F.substring("title", 1, 18), F.lit("…")))
    return j.select("paper_id", "title", "year", F.coalesce("k", F.when(F.col("year") != "", F.concat(short, F.lit("（"), "year", F.lit("）"))).otherwise(short)).alias("citation"))


def format_citations(lists: DataFrame, cited: DataFrame) -> DataFrame:
    """(list_id, citations): for each list's paper_ids the citation, else the title, else the id, in order."""
    each = lists.select("list_id", F.posexplode("paper_ids").alias("pos", "paper_id"))
    text = F.coalesce(F.nullif("citation", F.lit("")), F.nullif("title", F.lit("")), "paper_id")
    return each.join(cited.select("paper_id", "title", "citation"), "paper_id", "left").groupBy("list_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("c")))), lambda x: x["c"]).alias("citations"))


# F10
def unique_terms(items: Column, n: int = 3, chars: int = 78, ahead: int | None = None) -> Column:
    """The first n items, prettified and shortened, without blanks and without repeats by term key.

    Exact repeats go first, and an item is cleaned only while fewer than n are found. With ahead, for long lists, so many
    items are tried alone, and the whole list only if they give fewer than n.
    """
    none = F.array().cast("array<struct<v:string,k:string>>")

    def take(a: Column, v: Column) -> Column:
        fits = lambda k: (v != "") & (k != "") & ~F.exists(a, lambda x: x["k"] == k)
        return let(term_key(v), lambda k: F.when(fits(k), F.concat(a, F.array(F.struct(v.alias("v"), k.alias("k"))))).otherwise(a))

    step = lambda a, x: F.when(F.size(a) >= n, a).otherwise(let(truncate(pretty_term(x), chars, "ellipsis"), lambda v: take(a, v)))
    found = lambda some: F.aggregate(F.array_distinct(some), none, step)
    if ahead is None:
        return F.transform(found(items), lambda x: x["v"])
    return F.transform(let(found(F.slice(items, 1, ahead)), lambda a: F.when((F.size(a) >= n) | (F.size(items) <= ahead), a).otherwise(found(items))), lambda x: x["v"])


def join_terms(items: Column, n: int = 3, chars: int = 30, sep: str = "、", ahead: int | None = None) -> Column:
    return F.array_join(unique_terms(items, n, chars, ahead), sep)


# F11
def problem_text(problem: Column, task: Column, fallback: Column, chars: int = 180) -> Column:
    blank = lambda c: F.nullif(clean_inline(c), F.lit(""))
    return truncate(F.coalesce(blank(problem), blank(task), fallback), chars, "ellipsis")


# F12
def generic_slots(input_variables: Column, data_sources: Column, method_family: Column, mechanisms: Column, model_outputs: Column, key_results: Column) -> dict[str, Column]:
    """The three lists of a paper without a direction-specific record."""
    full = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    line = lambda c, made: F.when(full(c), made)
    first = lambda c: truncate(pretty_term(F.get(c, F.lit(0))), 72, "ellipsis")
    return {
        "inputs": F.array_compact(F.array(line(input_variables, F.concat(F.lit("变量："), join_terms(input_variables, 3, 22, ahead=AHEAD))), line(data_sources, F.concat(F.lit("来源："), join_terms(data_sources, 2, 26, ahead=AHEAD))))),
        "methods": F.array_compact(F.array(line(method_family, F.concat(F.lit("方法："), join_terms(method_family, 2, 24, ahead=AHEAD))), line(mechanisms, first(mechanisms)))),
        "outputs": F.array_compact(F.array(line(model_outputs, F.concat(F.lit("输出："), join_terms(model_outputs, 2, 26, ahead=AHEAD))), line(key_results, F.concat(F.lit("结果："), first(key_results))))),
    }


class Record:
    """Reads fields of a VARIANT record by path; what isn't there is null."""

    def __init__(self, variant: Column) -> None:
        self.v = variant

    def get(self, path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(self.v, f"$.{path}", kind)

    def has(self, path: str) -> Column:
        return self.get(path).isNotNull()

    def is_object(self, path: str) -> Column:
        return F.coalesce(F.startswith(F.schema_of_variant(self.get(path)), F.lit("OBJECT")), F.lit(False))

    def number(self, path: str) -> Column:
        """A JSON number as double; strings that look like one don't count."""
        return F.when(F.schema_of_variant(self.get(path)).rlike("^(BIGINT|DOUBLE|DECIMAL)"), self.get(path, "double"))

    def whole(self, path: str) -> Column:
        return F.when(F.schema_of_variant(self.get(path)) == "BIGINT", self.get(path, "bigint"))

    def each(self, path: str) -> Column:
        return F.coalesce(self.get(path, "array<variant>"), F.array().cast("array<variant>"))


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def general(x: Column) -> Column:
    """A number with six significant digits at most and no zeros at its end."""
    digits = F.regexp_replace(F.format_string("%.6g", x), r"(\.\d*?)0+(?=e|$)", "$1")
    return F.when(x.isNotNull(), F.regexp_replace(digits, r"\.(?=e|$)", ""))


# Readers of a part's value: each makes a function of the record and the part's path.
def terms(n: int, chars: int, sep: str = "、"):
    return lambda r, path: join_terms(r.get(path, "array<string>"), n, chars, sep)


def term(chars: int | None = None):
    return lambda r, path: pretty_term(r.get(path, "string")) if chars is None else truncate(pretty_term(r.get(path, "string")), chars, "ellipsis")


def text(chars: int):
    return lambda r, path: truncate(clean_inline(r.get(path, "string")), chars, "ellipsis")


def plain(r: Record, path: str) -> Column:
    return r.get(path, "string")


def number(r: Record, path: str) -> Column:
    return general(r.number(path))


def split_terms(mark: str, n: int, chars: int, sep: str):
    return lambda r, path: join_terms(F.split(r.get(path, "string"), mark), n, chars, sep)


def names(field: str, sep: str):
    """A field of each object of a list, prettified."""
    made = lambda x: F.try_variant_get(x, f"$.{field}", "string")
    return lambda r, path: F.array_join(F.transform(F.filter(r.each(path), lambda x: filled(made(x))), lambda x: pretty_term(made(x))), sep)


def keys(n: int, chars: int, sep: str):
    """Keys of an object, in alphabetical order (a VARIANT keeps no other)."""
    return lambda r, path: join_terms(F.array_sort(F.map_keys(r.get(path, "map<string,variant>"))), n, chars, sep)


def span(r: Record, path: str) -> Column:
    """The least and the greatest of a list of numbers."""
    values = r.get(path, "array<double>")
    return F.concat(general(F.array_min(values)), F.lit("–"), general(F.array_max(values)))


def in_list(field: str, only: tuple[str, str] | None = None):
    """Numbers of a field of a list's objects, of those whose other field has a value."""

    def read(r: Record, path: str) -> Column:
        value = lambda x: Record(x).number(field)
        fits = lambda x: value(x).isNotNull() & (F.lit(True) if only is None else F.try_variant_get(x, f"$.{only[0]}", "string").eqNullSafe(F.lit(only[1])))
        return F.transform(F.filter(r.each(path), fits), value)

    return read


def yes(r: Record, path: str) -> Column:
    """A field that is neither missing nor false, zero or empty."""
    return ~F.coalesce(r.get(path, "string"), F.lit("")).isin("", "false", "0", "0.0", "[]", "{}")


def part(label: str, path: str, how, end: str = "", own: bool = False, default: str | None = None):
    """A part of a line: its value (blank if missing), and what is written for one. With own, the label goes if the value
    is missing; default stands in for it."""

    def shown(value: Column) -> Column:
        whole = F.concat(F.lit(label), value if default is None else F.when(value == "", default).otherwise(value), F.lit(end))
        return F.when(value == "", "").otherwise(whole) if own else whole

    return lambda r: (F.coalesce(how(r, path), F.lit("")), shown)


def _line(parts, wanted):
    def make(r: Record) -> Column:
        values, shown = zip(*[p(r) for p in parts], strict=True)
        return let(F.array(*values), lambda vs: F.when(wanted(vs), F.concat(*[show(vs[i]) for i, show in enumerate(shown)])))

    return make


def any_of(*parts):
    """A line that is there if a part has a value; it then has the labels of all."""
    return _line(parts, lambda vs: F.exists(vs, lambda v: v != ""))


def always(*parts):
    return _line(parts, lambda vs: F.lit(True))


def either(*lines):
    return lambda r: F.coalesce(*[line(r) for line in lines])


def fixed(words: str):
    return lambda r: F.lit(words)


def state_size(r: Record, path: str) -> Column:
    """Observables of a state; those of 20 dimensions or more with their number."""
    size = r.whole(f"{path}.dimension")
    large = F.concat(size.cast("string"), F.lit("维状态："), terms(3, 18)(r, f"{path}.observables"))
    return F.when(size >= 20, large).otherwise(terms(3, 22)(r, f"{path}.observables"))


def aggregated_state(r: Record, path: str) -> Column:
    return F.concat(r.whole(f"{path}.num_waypoints").cast("string"), F.lit(" 航点聚合的 "), r.whole(f"{path}.state_dim").cast("string"), F.lit(" 维向量"))


def no_wind_measured(r: Record, path: str) -> Column:
    return F.when(r.get(path, "boolean").eqNullSafe(F.lit(False)), "reel-out + 预定义 figure-8 + 无显式风测量")


def over_stationary(r: Record, path: str) -> Column:
    return F.concat(F.lit("相对 stationary 净功率提升 "), general(F.get(in_list("improvement_percent.over_stationary")(r, path), F.lit(0))), F.lit("%"))


def losses(r: Record, path: str) -> Column:
    found = in_list("percent_reduction_vs_optimal", only=("algorithm", "A2C"))(r, path)
    return F.when(F.size(found) > 0, F.format_string("A2C 相对穷举最优损失 %.2f%%–%.2f%%", F.array_min(found), F.array_max(found)))


def supervision(r: Record, path: str) -> Column:
    adapted = F.concat(F.lit("风向自适应 "), term()(r, f"{path}.update_target.updated_variable"))
    return F.when(yes(r, f"{path}.enabled"), adapted).otherwise("混合状态机协同绞盘/俯仰")


#: Shapes of a record, told apart in this order by the keys that are there.
SHAPES = [
    ("bank", lambda r: r.has("meta") & r.has("offline_bank")),
    ("learning", lambda r: r.has("task") & r.has("rl") & r.has("mdp")),
    ("iterative", lambda r: r.is_object("paper") & r.has("paper.directional_summary")),
    ("control", lambda r: r.has("paper") & (r.has("inputs") | r.has("methods") | r.has("outputs"))),
    ("batch", lambda r: r.is_object("paper")),
]
#: The lines of each shape's lists, their labels, the paths of their values and how long these may be.
SPECS = [
    ("iterative", "inputs", any_of(part("条件：", "paper.directional_summary.iteration_unit", term()))),
    ("iterative", "inputs", any_of(part("反馈：", "paper.inputs_directional.iteration_level_measurements", terms(2, 18)), part("；圈内信号：", "paper.inputs_directional.within_iteration_signals_for_J", terms(3, 18)))),
    ("iterative", "inputs", either(any_of(part("待调参数：", "paper.path_parameterization.basis_parameters", terms(2, 16))), any_of(part("待调参数：", "paper.inputs_directional.path_parameter_history", terms(2, 22))))),
    ("iterative", "methods", any_of(part("响应面：", "paper.learning_model.estimator.type", term()), part("+", "paper.learning_model.response_surface.form", text(34)))),
    ("iterative", "methods", always(part("更新：", "paper.update_law.update_type", term(36)))),
    ("iterative", "methods", any_of(part("下层控制：", "paper.lower_level_control.path_following.method", term()), part(" + ", "paper.lower_level_control.actuation_and_inner_loops", terms(2, 18), own=True))),
    ("iterative", "outputs", any_of(part("输出参数：", "paper.outputs_directional.updated_path_parameters", terms(2, 18)))),
    ("iterative", "outputs", any_of(part("学习产物：", "paper.outputs_directional.learned_model_artifacts", terms(2, 18)))),
    ("iterative", "outputs", any_of(part("结果：", "paper.evaluation.key_results_text", text(72)))),
    ("bank", "inputs", always(part("测量：", "inputs.wind_measurement.measured_variable", term()), part("，偏差约 ", "inputs.wind_measurement.bias_model.value", number, " m/s", own=True))),
    ("bank", "inputs", any_of(part("反馈：", "inputs.performance_feedback_signal.signal_name", term()))),
    ("bank", "inputs", any_of(part("轨迹库索引：", "offline_bank.index_variable_and_grid.index_variable", term()))),
    ("bank", "methods", fixed("离线生成 Fourier 轨迹库与周期 T")),
    ("bank", "methods", fixed("在线 ES 修正有效风速 w_eff 并插值选轨")),
    ("bank", "methods", fixed("饱和约束 + stationary/adaptive/nonadaptive 模式切换")),
    ("bank", "outputs", always(part("输出设定：", "outputs.selected_setpoint_trajectory.representation", split_terms("_plus_", 2, 20, "+"), default="roll 轨迹 + 周期 T"))),
    ("bank", "outputs", fixed("在线量：w_eff / w_corr / 当前模式")),
    ("bank", "outputs", any_of(part("结果：", "evaluation.key_results", over_stationary))),
    ("learning", "inputs", any_of(part("状态：", "mdp.state.definition", state_size))),
    ("learning", "inputs", any_of(part("环境：", "environment.wind_model.type", term()), part("；层级：", "task.control_level", term()))),
    ("learning", "inputs", any_of(part("目标：", "mdp.reward.definition.primary_signal", term()))),
    ("learning", "methods", any_of(part("算法：", "rl.algorithm.instance", term()))),
    ("learning", "methods", any_of(part("动作：", "mdp.action.definition.control_targets", terms(2, 20)), part("（", "outputs.action_semantics", term(50), "）", own=True))),
    ("learning", "methods", any_of(part("训练：", "training.regime", term()))),
    ("learning", "outputs", any_of(part("策略产物：", "outputs.policy_representation", term()))),
    ("learning", "outputs", any_of(part("控制输出：", "outputs.action_semantics", term(50)))),
    ("learning", "outputs", any_of(part("结果：", "evaluation.key_results[0]", term(64)))),
    ("control", "inputs", any_of(part("传感：", "inputs.required_sensors_minimal_set", terms(3, 16)), part("；地面/系绳信号：", "inputs.tether_and_ground_signals", terms(2, 16), own=True))),
    ("control", "inputs", any_of(part("任务：", "paper.core_setting.system_scope", term()))),
    ("control", "inputs", any_of(part("条件：", "inputs.wind_data_usage", term()))),
    ("control", "methods", fixed("导航/引导：极坐标航迹量 + waypoint/heading 参考")),
    ("control", "methods", any_of(part("控制：", "control.inner_loop_type_and_controlled_variable.controller_form", term()), part(" ", "control.inner_loop_type_and_controlled_variable.controlled_variable", term()))),
    ("control", "methods", always(part("监督：", "wind_adaptation", supervision))),
    ("control", "outputs", any_of(part("输出命令：", "outputs.primary_commands", terms(3, 20)))),
    ("control", "outputs", either(any_of(part("系统输出：", "outputs.supervisory_and_winch_commands", terms(2, 18))), any_of(part("风向对齐输出：", "wind_adaptation.update_target.updated_variable", term())))),
    ("control", "outputs", any_of(part("结果：", "evaluation.metrics_direction_specific", terms(2, 28)))),
    ("batch", "inputs", any_of(part("状态：", "paper.mdp.state_definition", aggregated_state))),
    ("batch", "inputs", any_of(part("动作：离散张力 ", "paper.mdp.action_definition.action_levels_N", span, " N"))),
    ("batch", "inputs", any_of(part("条件：", "paper.wind_handling.wind_measurement_in_state", no_wind_measured))),
    ("batch", "methods", fixed("离线 replay buffer + 全动作/多风速采样")),
    ("batch", "methods", any_of(part("批量强化学习：", "paper.method.algorithms", names("name", " / ")))),
    ("batch", "methods", any_of(part("训练：", "paper.data.offline_buffer.collection_policy", plain))),
    ("batch", "outputs", any_of(part("策略产物：", "paper.output.policy_artifacts", keys(2, 12, " / ")))),
    ("batch", "outputs", fixed("控制输出：期望系绳张力序列")),
    ("batch", "outputs", any_of(part("结果：", "paper.evaluation.results_by_wind", losses))),
]


def slots(records: DataFrame, generic: dict[str, Column], specs: list = SPECS, shapes: list = SHAPES, variant: str = "record") -> DataFrame:
    """records with shape and three lists of at most three lines: by the specs of the record's shape, chosen by the keys
    present; an empty list falls back to the generic one. The specs are (shape, slot, line)."""
    r = Record(F.col(variant))
    shape = reduce(lambda c, s: c.when(s[1](r), s[0]), shapes[1:], F.when(shapes[0][1](r), shapes[0][0])).otherwise("none")
    out = records.withColumn("shape", shape)
    for slot in SLOTS:
        made = F.lit(None).cast("array<string>")
        for name, _ in reversed(shapes):
            lines = [line(r) for s, which, line in specs if s == name and which == slot]
            if lines:
                made = F.when(F.col("shape") == name, unique_terms(F.array_compact(F.array(*lines)), 3, 78)).otherwise(made)
        out = out.withColumn(slot, let(made, lambda m: F.when(F.coalesce(F.size(m), F.lit(0)) > 0, m).otherwise(F.slice(generic[slot], 1, 3))))  # noqa: B023
    return out


# F13
def baseline(memberships: DataFrame, recorded: DataFrame) -> DataFrame:
    """(direction_id, paper_id, pos): the baseline first (the first representative with a record, else the first included
    one), then the other included papers with a record, in order. memberships has pos; recorded has paper_id."""
    have = memberships.join(recorded.select("paper_id").distinct(), "paper_id", "left_semi")
    inc = have.where("list_kind = 'included'").groupBy("direction_id", "paper_id").agg(F.min("pos").alias("o"))
    rep = have.where("list_kind = 'representative'").groupBy("direction_id").agg(F.min_by("paper_id", "pos").alias("base"))
    first = inc.groupBy("direction_id").agg(F.min_by("paper_id", "o").alias("base"))
    base = rep.unionByName(first.join(rep, "direction_id", "left_anti"))
    rows = base.select("direction_id", F.col("base").alias("paper_id"), F.lit(-1).cast("long").alias("o")).unionByName(inc.join(base, "direction_id").where("paper_id <> base").select("direction_id", "paper_id", F.col("o").cast("long").alias("o")))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("direction_id").orderBy("o")) - 1).select("direction_id", "paper_id", "pos")


#: Papers of a direction that share a copy of its baseline, about.
SHARE = 1_000


def with_base(order: DataFrame, papers: DataFrame, base: DataFrame, share: int = SHARE) -> DataFrame:
    """order's papers (direction_id, pos, ...) with their own columns of papers (by paper_id) and base's of their direction.

    A direction may hold any share of the papers: its base is copied so often that each copy goes to share papers, and
    each papers' row moves once, by direction and copy.
    """
    copies = order.groupBy("direction_id").agg((F.max(F.floor(F.col("pos") / share)) + 1).alias("copies"))
    copied = base.join(copies, "direction_id").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    return order.join(papers, "paper_id").withColumn("copy", F.floor(F.col("pos") / share)).join(copied, ["direction_id", "copy"]).drop("copy")


# F14
def relative_slots(current: Column, base: Column, n: int = 3) -> Column:
    """Lines whose key the baseline lacks, at most n; if none is left, the mark for sameness."""
    keys = F.transform(F.filter(base, lambda y: y != ""), term_key)
    new = let(keys, lambda ks: F.filter(current, lambda x: (x != "") & ~F.array_contains(ks, term_key(x))))
    return let(new, lambda lines: F.when(F.size(lines) > 0, F.slice(lines, 1, n)).otherwise(F.array(F.lit(SAME))))


# F15
def flatten_differences(df: DataFrame, cited: DataFrame, variant: str = "differences") -> DataFrame:
    """(direction_id, items): strings of a mixed list stay; an object gives "citation：difference" for each of its
    differences, its paper named by citation, else id."""
    each = df.select("direction_id", F.posexplode(F.try_variant_get(F.col(variant), "$", "array<variant>")).alias("pos", "x"))
    is_text = F.schema_of_variant("x") == "STRING"
    rows = each.select("direction_id", "pos", F.when(is_text, F.try_variant_get("x", "$", "string")).alias("text"), F.trim(F.coalesce(F.try_variant_get("x", "$.paper_id", "string"), F.lit(""))).alias("paper_id"), F.when(~is_text, F.try_variant_get("x", "$.differences", "array<string>")).alias("ds"))
    named = rows.join(cited.select("paper_id", "citation"), "paper_id", "left")
    prefix = F.coalesce(F.nullif("citation", F.lit("")), F.nullif("paper_id", F.lit("")), F.lit(PAPER))
    items = F.when(F.col("text").isNotNull(), F.array("text")).otherwise(F.transform(F.coalesce("ds", F.array().cast("array<string>")), lambda d: F.concat(prefix, F.lit("："), d)))
    return named.groupBy("direction_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", items.alias("i")))), lambda s: s["i"])).alias("items"))


# F16
def clamp_items(items: Column, n: int) -> Column:
    return F.when(F.size(items) <= n, items).otherwise(F.concat(F.slice(items, 1, n), F.array(F.format_string(REST.format("%d"), F.size(items) - n))))


#: Items that each list of a comparison may have.
CROSS_ITEMS = {"commons": 2, "differences": 2, "common_items": 5, "structure": 4, "visual_ideas": 4}


def cross_summary(directions: DataFrame, differences: DataFrame) -> DataFrame:
    """Each direction with what it shares and how it differs, and the lists of the comparison as a whole (common items,
    structure, visual ideas) if there are any: all clamped, null as empty."""
    none = F.array().cast("array<string>")
    j = directions.join(differences, "direction_id", "left")
    lists = [c for c in CROSS_ITEMS if c in differences.columns]
    return j.select(*directions.columns, *[clamp_items(F.coalesce(c, none), CROSS_ITEMS[c]).alias(c) for c in lists])


# F17
def direction_papers_in_context(order: DataFrame, papers: DataFrame, directions: DataFrame, only: list[str] | None = None) -> DataFrame:
    """A row per direction and paper, in order: the direction's name and definition, its baseline, and the paper with its
    reason cut, and its structure and record trimmed. order is baseline()'s; papers has paper_id, citation, role, reason,
    problem, inputs, methods, outputs, and may have structure and record; directions direction_id, direction_name,
    definition. No row is nested, so a direction may have any number of papers."""
    if only is not None:
        directions = directions.where(F.col("direction_id").isin(only))
        if not directions.take(1):
            raise ValueError(f"no such direction: {only}")
    whole = {f.name: trimmed(F.col(f.name), f.dataType).alias(f.name) for f in papers.schema if f.name in ("structure", "record")}
    shown = papers.select("paper_id", "citation", "role", truncate(F.col("reason"), 220, "ellipsis").alias("reason"), "problem", *SLOTS, *whole.values())
    rows = order.join(shown, "paper_id")
    first = rows.where("pos = 0").select("direction_id", F.col("paper_id").alias("baseline_paper_id"), F.col("citation").alias("baseline_citation"))
    named = directions.select("direction_id", "direction_name", truncate(F.col("definition"), 320, "ellipsis").alias("definition"))
    return named.join(rows, "direction_id").join(first, "direction_id", "left")


def direction_context(order: DataFrame, papers: DataFrame, directions: DataFrame, only: list[str] | None = None) -> DataFrame:
    """The same as a nested row per direction, for directions with few papers: they are gathered in one row."""
    flat = direction_papers_in_context(order, papers, directions, only)
    head = ["direction_id", "direction_name", "definition", "baseline_paper_id", "baseline_citation"]
    paper = F.struct("pos", *[c for c in flat.columns if c not in (*head, "pos")])
    return flat.groupBy(*head).agg(F.array_sort(F.collect_list(paper)).alias("papers"))


# F18
PAYLOAD_FIELDS = ("direction_id", "direction_name", "core_problem_cn", "baseline_paper", "comparison_rows", "symbol_glossary_cn")
BASELINE_FIELDS = ("paper_id", "citation_cn", "input_box_cn", "method_box_cn", "output_box_cn")
ROW_FIELDS = ("paper_id", "citation_cn", "input_diff_cn", "method_diff_cn", "output_diff_cn")


def validate_payloads(df: DataFrame, key: str = "id", variant: str = "payload") -> DataFrame:
    """(key, rule): fields that a payload lacks, wrong JSON kinds, and self-check lists that aren't empty."""
    v = F.col(variant)
    at = lambda path, c=v: F.schema_of_variant(F.try_variant_get(c, path, "variant"))
    lacks = lambda path, rule, c=v: F.when(F.try_variant_get(c, path, "variant").isNull(), F.lit(rule))
    kind = lambda path, rule, what: F.when(~F.coalesce(F.startswith(at(path), F.lit(what)), F.lit(False)), F.lit(rule))
    top = [lacks(f"$.{f}", f"missing {f}") for f in PAYLOAD_FIELDS] + [lacks(f"$.baseline_paper.{f}", f"baseline lacks {f}") for f in BASELINE_FIELDS]
    top += [kind(f"$.baseline_paper.{f}", f"baseline {f} must be an array", "ARRAY") for f in BASELINE_FIELDS[2:]] + [kind("$.symbol_glossary_cn", "glossary must be an array", "ARRAY"), kind("$.comparison_rows", "comparison_rows must be an array", "ARRAY")]
    checks = F.try_variant_get(v, "$.self_check", "map<string,array<string>>")
    flagged = F.transform(F.map_keys(F.map_filter(F.coalesce(checks, F.create_map().cast("map<string,array<string>>")), lambda _, x: F.size(x) > 0)), lambda k: F.concat(F.lit("self_check "), k))
    rows = F.coalesce(F.try_variant_get(v, "$.comparison_rows", "array<variant>"), F.array().cast("array<variant>"))
    by_row = F.flatten(F.transform(rows, lambda r, i: F.when(~F.startswith(F.schema_of_variant(r), F.lit("OBJECT")), F.array(F.format_string("row %d must be an object", i))).otherwise(F.array_compact(F.array(*[F.when(F.try_variant_get(r, f"$.{f}", "variant").isNull(), F.format_string(f"row %d lacks {f}", i)) for f in ROW_FIELDS])))))
    return df.select(key, F.explode(F.concat(F.array_compact(F.array(*top)), by_row, flagged)).alias("rule"))


# F19
def coverage(papers: DataFrame, violations: DataFrame) -> DataFrame:
    """(direction_id, papers, by_title, violations), and a total row with a null direction. papers is direction_papers()'s."""
    p = papers.groupBy("direction_id").agg(F.count("*").alias("papers"), F.count_if(F.col("how") == "title").alias("by_title"))
    v = violations.where("direction_id is not null").groupBy("direction_id").agg(F.count("*").alias("violations"))
    both = p.join(v, "direction_id", "full").fillna(0, ["papers", "by_title", "violations"])
    return both.rollup("direction_id").agg(F.sum("papers").alias("papers"), F.sum("by_title").alias("by_title"), F.sum("violations").alias("violations"))


# F20
def formula_list(formulas: DataFrame) -> DataFrame:
    """Formulas (doc_id, number, page, y0, ...) once per number, the first by page and height; ordered by number, suffix."""
    first = formulas.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("page", "y0"))).where("r = 1").drop("r")
    return first.withColumn("n", F.regexp_extract("number", r"^(\d+)", 1).try_cast("int")).withColumn("suffix", F.regexp_extract("number", r"^\d+(.*)$", 1)).orderBy("doc_id", F.asc_nulls_last("n"), "suffix").drop("n", "suffix")
