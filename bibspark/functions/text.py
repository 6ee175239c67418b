"""Text rules as native Column expressions, and the job that applies any set of them to a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Display names of record terms, by the code that records use.
TERM_NAMES = {
    "lap_to_lap_closed_path": "按圈闭合航迹",
    "iteration_to_iteration": "跨循环迭代",
    "low_level_attitude_or_actuation": "低层姿态/操纵",
    "high_level_trajectory_parameter": "高层航迹参数",
    "pumping_cycle": "抽水循环",
    "towing": "牵引工况",
    "uniform_constant": "恒定均匀风",
    "turbulent": "湍流风场",
    "online_interaction": "在线交互训练",
    "offline_from_simulator_dataset": "仿真数据离线训练",
    "value_based": "值函数",
    "discrete_choice": "离散动作",
    "discrete_increment_pair": "离散增量动作",
    "reactive_partial_observation": "部分可观测反应式状态",
    "continuous_vector": "连续状态向量",
    "discretized_bins": "离散分箱状态",
    "full_system_pumping_cycle": "完整抽水循环系统",
    "crosswind_control_subsystem_with_optional_planner": "crosswind 子系统",
    "reel-out": "放缆发电阶段",
    "predefined_figure_8": "预定义 figure-8 航迹",
    "wind_lidar_for_ground_truth_only": "风激光仅作真值对照",
    "autonomous_duration_61_minutes": "连续自主运行 61 min",
    "net_positive_energy": "实现正净能量输出",
    "trajectory_smoothness_qualitative": "航迹更平滑",
    "azimuth_tracking_hesitation_reduction": "方位跟踪犹豫减弱",
    "wind_alignment_vs_lidar_qualitative": "航迹方位可随风向对齐",
    "action_match_rate_vs_oracle": "与 oracle 的动作匹配率",
    "MSE_vs_oracle": "相对 oracle 的 MSE",
    "training_loss_curve": "训练损失收敛",
    "episode_return_proxy_energy": "回报/能量代理提升",
}
#: Fixed value: what stands for the cut middle of an over-long text.
CUT_MARK = "\n\n[... 文本过长，已截断中间部分，仅保留前后文用于抽取 ...]\n\n"
SPACE = r"[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c worked out once a row: inside a lambda, an expression is otherwise repeated for every element."""
    return F.transform(F.array(c), f)[0]


def runs(c: Column, f: Callable[[Column, Column, Column], Column], key: Callable[[Column], Column] = lambda x: x) -> Column:
    """f(sorted, first, end) of each run of elements with equal keys of an array, which is sorted: a grouping within a row."""
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | ~key(F.get(s, i)).eqNullSafe(key(F.get(s, i - 1))))
    each = lambda s: let(starts(s), lambda b: F.zip_with(b, F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(s))), lambda i, j: f(s, i, j)))
    return let(F.array_sort(c), lambda s: F.when(F.size(s) > 0, each(s)))


def run_lengths(c: Column, value: str, n: str) -> Column:
    """The different elements of an array, each with how often it is there."""
    return runs(c, lambda s, i, j: F.struct(F.get(s, i).alias(value), (j - i).cast("long").alias(n)))


def positions(c: Column, value: str, at: str) -> Column:
    """The different elements of an array, each with the places where it is, from 0."""
    placed = F.transform(c, lambda x, i: F.struct(x.alias(value), i.alias(at)))
    return runs(placed, lambda s, i, j: F.struct(F.get(s, i)[value].alias(value), F.transform(F.slice(s, i + 1, j - i), lambda e: e[at]).alias(at)), lambda e: e[value])


def clean_text(c: Column) -> Column:
    """NUL dropped, line ends made LF, runs of blanks one blank, three or more LF two, trimmed."""
    c = F.regexp_replace(F.regexp_replace(c, r"\x00", ""), r"\r\n?", "\n")
    return _strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean_inline(c: Column) -> Column:
    """Null is empty; NUL dropped; all white space one blank; trimmed."""
    return _strip(F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\x00", ""), r"\s+", " "))


def normalize_inline(c: Column) -> Column:
    """As clean_inline, a NUL parting words."""
    return _strip(F.regexp_replace(F.regexp_replace(c, r"\x00", " "), r"\s+", " "))


def safe_stem(c: Column, n: int = 64) -> Column:
    """A file stem that keeps names apart: forbidden characters replaced, cut to n, ten hex digits of the name's SHA-1."""
    s = F.regexp_replace(_strip(c), r"\s+", "_")
    s = F.regexp_replace(F.regexp_replace(s, r'[<>:"/\\|?*\x00-\x1f]', "_"), "_+", "_")
    base = F.regexp_replace(F.substring(F.regexp_replace(s, r"^[._]+|[._]+$", ""), 1, n), r"[._]+$", "")
    return F.concat(F.when(base == "", "item").otherwise(base), F.lit("_"), F.substring(F.sha1(c), 1, 10))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_-]+", "_"), "_+", "_"), "^_+|_+$", "")
    return F.when(s == "", "figure").otherwise(s)


def file_stem(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(_strip(c), r"[^\p{L}\p{N}_-]", "_"), "_+", "_"), "^_+|_+$", "")
    return F.when(s == "", "pdf").otherwise(s)


def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def ws_lower(c: Column) -> Column:
    return F.regexp_replace(F.lower(_strip(F.coalesce(c, F.lit("")))), r"\s+", " ")


def term_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(clean_inline(c)), r"[^\p{L}\p{N}]+", "")


def strip_doi(c: Column) -> Column:
    return F.regexp_replace(_strip(F.coalesce(c, F.lit(""))), r"^(https://doi\.org/)?(doi:)?", "")


def truncate(c: Column, n: int, style: str = "dots") -> Column:
    """dots: n characters and three dots; fit: white space collapsed, dots within n; ellipsis: as fit, with one
    ellipsis character after trimmed text; label: dots within n, text as it is."""
    if style == "dots":
        t = _strip(F.coalesce(c, F.lit("")))
        return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit("...")))
    t = c if style == "label" else clean_inline(c)
    if style == "ellipsis":
        return let(t, lambda t: F.when(F.length(t) <= n, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, n - 1), r"\s+$", ""), F.lit("…"))))
    return let(t, lambda t: F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 3), F.lit("..."))))


def head_tail(c: Column, n: int = 120_000) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n // 2), F.lit(CUT_MARK), F.right(c, F.lit(n - n // 2))))


def first_of_each(words: Column, keep: int) -> Column:
    """The first words, at most keep, without those that repeat an earlier one in another case."""
    first = lambda ws, low: F.transform(F.slice(F.array_distinct(low), 1, keep), lambda k: F.element_at(ws, F.array_position(low, k).cast("int")))
    return let(words, lambda ws: let(F.transform(ws, F.lower), lambda low: first(ws, low)))


def clean_query(c: Column, keep: int = 22) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\b(title|venue|abstract|document title|publication title)\s*:\s*", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\b(AND|OR|NOT)\b", " "), r"[()\"']", " ")
    return F.array_join(first_of_each(F.filter(F.split(t, r"\s+"), lambda w: w != ""), keep), " ")


def portable_path(c: Column) -> Column:
    """A path below the library folder, whatever machine it came from."""
    raw = _strip(c)
    parts = F.filter(F.split(F.replace(raw, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    after = lambda name: F.size(parts) - F.array_position(F.reverse(parts), F.lit(name)) + 1
    tail = lambda at: F.array_join(F.slice(parts, at.cast("int"), F.size(parts) + 1), "/")
    below = tail(after("library") + 1)
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(None))
        .when(F.array_contains(parts, "library"), F.when(below != "", below))
        .when(F.array_contains(parts, "pdfs"), tail(after("pdfs")))
        .when((F.size(parts) == 1) & F.lower(parts[0]).endswith(".pdf"), F.concat(F.lit("pdfs/"), parts[0]))
        .otherwise(raw)
    )


def pretty_term(c: Column, names: Mapping[str, str] = TERM_NAMES) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    figure = lambda t: F.replace(F.replace(t, F.lit("figure_8"), F.lit("figure-8")), F.lit("figure8"), F.lit("figure-8"))
    plain = lambda t: clean_inline(F.replace(figure(t), F.lit("_"), F.lit(" ")))
    return let(clean_inline(c), lambda t: F.when(F.lower(t).isin("", "unknown", "not_applicable", "not applicable"), "").otherwise(F.coalesce(F.try_element_at(table, t), plain(t))))


def parse_score(c: Column, default: float = 5.0) -> Column:
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"\d+(?:\.\d+)?", 0)
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(found.try_cast("double"), F.lit(default))))


def roman(c: Column) -> Column:
    """The value of Roman digits, read from the right; a smaller digit before a larger one is taken away."""
    values = F.create_map(*[F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv])
    digits = F.transform(F.split(F.reverse(F.upper(c)), ""), lambda d: F.try_element_at(values, d))
    return F.aggregate(
        digits,
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("before")),
        lambda a, v: F.struct((a["total"] + F.when(v < a["before"], -v).otherwise(v)).alias("total"), v.alias("before")),
        lambda a: a["total"],
    )


def parse_figure_number(c: Column) -> Column:
    """Arabic numbers without leading zeros, Roman ones as arabic, a suffix letter in lower case; else text as it is."""
    t = _strip(c)
    arabic = F.regexp_replace(F.regexp_extract(t, r"^(\d+)([A-Za-z]?)$", 1), "^0+(?=.)", "")
    letters = F.regexp_extract(t, r"^([IVXLCDMivxlcdm]+)([A-Za-z]?)$", 1)
    return (
        F.when(t.isNull() | (t == ""), F.lit(None))
        .when(arabic != "", F.concat(arabic, F.lower(F.regexp_extract(t, r"^(\d+)([A-Za-z]?)$", 2))))
        .when(letters != "", F.concat(roman(letters).cast("string"), F.lower(F.regexp_extract(t, r"^([IVXLCDMivxlcdm]+)([A-Za-z]?)$", 2))))
        .otherwise(F.lower(F.regexp_replace(t, r"\s+", "")))
    )


TOKEN = r"[A-Za-zΔΘΦΨγψϕθκβ_]+(?:\([A-Za-z]+\))?"


def contains_tokens(*fields: Column) -> Column:
    """Latin and Greek symbol tokens of the given texts, each once, in order of first sight."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.coalesce(f, F.lit("")), F.lit(TOKEN), F.lit(0)) for f in fields]))


RULES: dict[str, Callable[[Column], Column]] = {
    "clean_text": clean_text, "clean_inline": clean_inline, "safe_stem": safe_stem, "slug": slug, "file_stem": file_stem, "title_key": title_key, "ws_lower": ws_lower,
    "term_key": term_key, "strip_doi": strip_doi, "head_tail": head_tail, "clean_query": clean_query, "portable_path": portable_path, "pretty_term": pretty_term, "parse_score": parse_score,
    "parse_figure_number": parse_figure_number,
}


def clean_corpus(df: DataFrame, rules: Mapping[str, str | tuple[str, Callable[[Column], Column]]]) -> tuple[DataFrame, DataFrame]:
    """Apply rules, output column: (input column, rule) or output column: rule name for a column of that name.

    Returns the cleaned table and a row per rule with the number of rows it changed, both lazy and without Python UDFs.
    """
    made = {}
    for out, rule in rules.items():
        source, f = (out, RULES[rule]) if isinstance(rule, str) else rule
        made[out] = (source, f)
    cleaned = df.withColumns({out: f(F.col(source)) for out, (source, f) in made.items()})
    sums = [F.struct(F.lit(out).alias("rule"), F.sum((~f(F.col(source)).cast("string").eqNullSafe(F.col(source).cast("string"))).cast("long")).alias("changed")) for out, (source, f) in made.items()]
    return cleaned, df.agg(F.array(*sums).alias("c")).select(F.inline("c"))
