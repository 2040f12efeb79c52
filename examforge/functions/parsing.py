"""Parsing of extracted exam and law text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE_DIGITS = ("１２３４５６７８９０", "1234567890")
NUMBERED = r"[（(〔\[]\s*([1-9１-９])\s*[)）〕\]]"
LETTERED = r"[（(]\s*([A-HＡ-Ｈ])\s*[)）]"
CIRCLED = "([①-⑧])"
#: Options that name other options, so that their order must stay (fixed values).
CROSS_REFERENCES = r"選項\([A-D]\)|選項[一二三四1234]|以上皆|皆是|皆非|皆正確|皆錯誤"
#: A letter of an option that stands by itself (fixed value).
LONE_LETTER = r"(?:^|[（(,，、\s])[A-D](?:[）),，、\s]|$)"
#: Terms of penalties that an explanation must keep, and its money ranges (fixed values).
PENALTIES = {"科或併科": "科或併科", "有期徒刑": "有期徒刑", "拘役": "拘役", "罰金": "(?<!裁)罰金(?!額)", "罰鍰": "罰鍰"}
MONEY_RANGE = r"新臺幣[^，。；、\s]+以上[^，。；、\s]+以下"


def tf_answer(text: Column) -> Column:
    """0 for a bracketed circle, 1 for a cross, else null."""
    sign = F.regexp_extract(text, r"[（(]\s*([○OＯ╳X×])\s*[)）]", 1)
    return F.when(sign.isin("○", "O", "Ｏ"), 0).when(sign.isin("╳", "X", "×"), 1)


def digit_answers(text: Column) -> Column:
    """Sorted distinct places (from 0) of bracketed digits 1 to 4, as in `（1.3）`; null if there are none or others."""
    digits = F.regexp_extract(F.translate(text, *WIDE_DIGITS), r"[（(]\s*([1-9][\s.、,1-9]*)[)）]", 1)
    places = F.transform(F.regexp_extract_all(digits, F.lit(r"(\d)"), 1), lambda d: d.cast("int") - 1)
    return F.when((F.size(places) > 0) & F.forall(places, lambda p: p < 4), F.array_sort(F.array_distinct(places)))


def bracketed_answer(text: Column) -> Column:
    """Struct of place and free: an answer that isn't 1 to 4 counts as 0 with a free score."""
    ok = F.coalesce(F.trim(text).rlike("^[1-4]$"), F.lit(False))
    return F.struct(F.when(ok, F.trim(text).try_cast("int") - 1).otherwise(0).alias("place"), (~ok).alias("free"))


def marked(text: Column, marker: str, sequence: str | None = None) -> Column:
    """Struct of stem and options: text before the first marker, then what follows each one.

    With a sequence, only markers that continue it count, and others stay part of the text.
    """
    marks = F.regexp_extract_all(text, F.lit(marker), 0)
    signs = F.translate(F.array_join(F.regexp_extract_all(text, F.lit(marker), 1), "\x1f"), "１２３４５６７８９ＡＢＣＤＥＦＧＨ", "123456789ABCDEFGH")
    signs = F.filter(F.split(signs, "\x1f"), lambda s: s != "")
    pieces = F.split(text, marker)
    rest = F.zip_with(F.zip_with(marks, signs, lambda m, s: F.struct(m.alias("m"), s.alias("s"))), F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), lambda x, t: F.struct(x["m"].alias("m"), x["s"].alias("s"), t.alias("t")))
    start = F.array(F.element_at(pieces, 1))

    def step(acc: Column, x: Column) -> Column:
        new = F.array_append(acc, x["t"])
        if sequence is None:
            return new
        same = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), x["m"], x["t"])))
        return F.when(x["s"] == F.substring(F.lit(sequence), F.size(acc), F.lit(1)), new).otherwise(same)

    parts = F.aggregate(rest, start, step)
    tidy = lambda t: F.rtrim(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit("。.，,；"))
    return F.when(text.isNotNull(), F.struct(F.trim(F.element_at(parts, 1)).alias("stem"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), tidy).alias("options")))


def numbered_options(text: Column) -> Column:
    return marked(text, NUMBERED, "123456789")


def lettered_options(text: Column) -> Column:
    return marked(text, LETTERED, "ABCDEFGH")


def circled_options(text: Column) -> Column:
    return marked(text, CIRCLED, "①②③④⑤⑥⑦⑧")


def locked(options: Column, letters: bool = True) -> Column:
    """Whether the order of the options matters: they refer to each other, or, with letters, are the bare letters A to D or
    digits 1 to 4 in order or name such a letter by itself."""
    cross = F.exists(options, lambda o: o.rlike(CROSS_REFERENCES))
    if not letters:
        return F.coalesce(cross, F.lit(False))
    bare = F.transform(options, lambda o: F.upper(F.regexp_replace(o, r"\s+", "")))
    in_order = (bare == F.array(*map(F.lit, "ABCD"))) | (bare == F.array(*map(F.lit, "1234")))
    return F.coalesce(cross | in_order | F.exists(options, lambda o: F.upper(o).rlike(LONE_LETTER)), F.lit(False))


def units_rebalanced(options: Column) -> Column:
    """Where the last option ends with one `/unit` for every option, each gets its own."""
    last = F.element_at(options, -1)
    unit = F.regexp_extract(last, r"(\s*/[^\s/]+)\1+$", 1)
    head = F.regexp_replace(last, r"(\s*/[^\s/]+)\1+$", "")
    repeated = (F.length(last) - F.length(head)) == F.length(unit) * F.size(options)
    given = F.transform(F.concat(F.slice(options, 1, F.size(options) - 1), F.array(head)), lambda o: F.concat(F.rtrim(o), F.ltrim(unit)))
    return F.when((F.size(options) > 1) & (unit != "") & repeated, given).otherwise(options)


def field_clean(text: Column) -> Column:
    """Continuation marks away, no blanks around brackets and slashes or between ideographs, colons and blanks trimmed."""
    t = F.regexp_replace(text, "【?請接續背面】?", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r" +/", "/"), r"\( +", "("), r" +\)", ")")
    t = F.regexp_replace(t, r"(?<=[一-鿿])\s+(?=[一-鿿（(])", "")
    t = F.regexp_replace(t, r"(?<=[、，。；：）])\s+(?=[一-鿿A-Za-z0-9])", "")
    return F.btrim(t, F.lit(" \t\n:"))


#: Names with an index, as the text layer gives them and as they are meant (fixed values).
_INDEXED = (
    (r"\bI\s+0\b", "I₀"), (r"\bG\s+0\b", "G₀"), (r"\bT\s+0\b", "T₀"), (r"\b([XY])\s+(\d)\s+年", "$1$2 年"), (r"\bY\s+d\b", "Yd"), (r"\bQ\s+d\b", "Qd"), (r"\bQ\s+s\b", "Qs"),
    (r"(?<![A-Za-z0-9_])(MU|MP|P)\s+([ABXY])(?=$|[\s，、,。)）＝=]|[\u4e00-\u9fff])", "$1_$2"),
)


def indexes_joined(text: Column) -> Column:
    """Names of quantities with their index, which the text layer gives as a word of its own."""
    for pattern, becomes in _INDEXED:
        text = F.regexp_replace(text, "(?U)" + pattern if pattern.startswith(r"\b") else pattern, becomes)
    return text


def money_ranges(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(MONEY_RANGE), 0))


def missing_terms(source: Column, explanation: Column) -> Column:
    """Penalty terms and money ranges of a source that its explanation doesn't name."""
    terms = F.array_compact(F.array(*[F.when(source.rlike(p) & ~explanation.rlike(p), F.lit(t)) for t, p in PENALTIES.items()]))
    return F.concat(terms, F.filter(money_ranges(source), lambda m: ~F.contains(explanation, m)))


#: Errors of an explanation that names the other kind of fine (fixed values).
_CONFUSED = {"罰金": "罰鍰", "罰鍰": "罰金"}


def has_penalty(text: Column, term: str) -> Column:
    return F.coalesce(text.rlike(PENALTIES[term]), F.lit(False))


def missing_ranges(source: Column, explanation: Column) -> Column:
    return F.filter(money_ranges(source), lambda m: ~F.contains(explanation, m))


def explanation_errors(source: Column, explanation: Column) -> Column:
    """Kinds of fine that an explanation confuses: those its source names, and not the other one, while the explanation
    names only the other one."""
    wrong = lambda a, b: has_penalty(source, a) & ~has_penalty(source, b) & has_penalty(explanation, b) & ~has_penalty(explanation, a)
    return F.array_compact(F.array(*[F.when(wrong(a, b), F.lit(a)) for a, b in _CONFUSED.items()]))


def explanation_repaired(source: Column, explanation: Column) -> Column:
    """The explanation with a sentence for each protected term or money range of its source that it lacks."""
    said = F.trim(explanation)
    lacks = lambda term: has_penalty(source, term) & ~has_penalty(said, term)
    ranges = missing_ranges(source, said)
    more = F.array_compact(F.array(
        F.when(lacks("科或併科"), F.lit("原文用語是「科或併科」，表示可以單獨科罰金，也可以和其他刑罰一起併科。")),
        F.when(lacks("罰金"), F.lit("原文的處罰種類是罰金。")), F.when(lacks("罰鍰"), F.lit("原文的處罰種類是罰鍰。")),
        F.when(F.size(ranges) > 0, F.concat(F.lit("原文金額區間為："), F.array_join(ranges, "、"), F.lit("。"))),
    ))
    return F.trim(F.concat_ws(" ", said, F.array_join(more, " ")))


#: Articles whose explanation is always the same, without white space (fixed values).
DELETED = ("（刪除）", "(刪除)", "刪除", "（删除）", "(删除)", "删除")
BY_AUTHORITY = "^本法施行細則[，,]?由中央主管機關定之。?$"
IN_FORCE = "^本法自公布日施行。?$"


def deleted(text: Column) -> Column:
    """An article whose text says nothing but that it was deleted."""
    return F.coalesce(F.regexp_replace(text, r"[\s　]", "").isin(*DELETED), F.lit(False))


def article_kind(text: Column) -> Column:
    """`deleted`, `by_authority`, `in_force` for articles whose explanation is always the same, null for others."""
    bare = F.regexp_replace(text, r"[\s　]", "")
    return F.when(deleted(text), "deleted").when(bare.rlike(BY_AUTHORITY), "by_authority").when(bare.rlike(IN_FORCE), "in_force")


#: Heading of a reading passage, what it covers (fixed value).
PASSAGE = r"▲\s*閱讀下文\s*[，,]\s*回答第\s*(\d+)\s*[-－–~～]\s*(\d+)\s*題\s*"


def passage_range(text: Column) -> Column:
    """Struct of first, last and content of the reading passage that a text opens; null without one. The content ends
    where a numbered question begins on a new line."""
    whole = r"(?s)" + PASSAGE + r"(.*?)(?=\n\s*\d+\.|\z)"
    first, last, content = (F.regexp_extract(text, whole, i) for i in (1, 2, 3))
    return F.when(first != "", F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), F.trim(content).alias("content")))


#: Words that show that a question needs its picture or its table (fixed values).
IMAGE_HINTS = (r"如\s*[圖表]", r"[圖表]\s*[（(]\s*[一二三四五六七八九十\d]+\s*[)）]", "曲線圖", "附圖", "下[圖表]", "上[圖表]")
TABLE_HINTS = ("【表", "下表", "如下表", "統計表", "表格", "資料如下", "情形如下")


def needs_image(text: Column) -> Column:
    return F.coalesce(text.rlike("|".join(IMAGE_HINTS)), F.lit(False))


def needs_table(text: Column, materials: Column | None = None) -> Column:
    """A question that speaks of a table and has no material yet."""
    hint = F.coalesce(text.rlike("|".join(TABLE_HINTS)), F.lit(False))
    return hint if materials is None else hint & (F.coalesce(F.size(materials), F.lit(0)) <= 0)


def source_line(question: Column, options: Column) -> Column:
    """A question as its paper has it: the options, numbered, in the place of the first blank line, else behind the stem."""
    inline = F.array_join(F.transform(options, lambda o, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(")"), o)), "")
    at = F.instr(question, "______")
    filled = F.concat(F.substr(question, F.lit(1), at - 1), inline, F.substr(question, at + 6))
    return F.when(at > 0, filled).otherwise(F.concat(question, inline))


#: Kinds of sections by the words of their headings, subjects, and what is kept (fixed values).
SECTIONS = {
    "是非題": "truefalse", "單選題": "single", "單擇題": "single", "複選題": "multi", "多選題": "multi", "選擇題(單選)": "single", "選擇題": "single", "填充題": "fill",
    "英翻中": "en2zh", "中譯英": "zh2en", "論文": "essay", "公文": "essay", "作文": "essay", "翻譯": "translation",
}
SECTION_HEADING = r"[一二三四五六七八九十]+\s*[、．.]\s*(是非題|單選題|單擇題|複選題|多選題|選擇題\(單選\)|選擇題|填充題|英翻中|中譯英|論文|公文|作文|翻譯)"
SUBJECT_HEADING = r"(汽車英文專業術語|汽車構造原理概論|汽車構造原理|汽車駕駛理論|道路交通法規|國\s*文)"
KEPT_SECTIONS = ("truefalse", "single", "multi")
SKIPPED_SUBJECTS = ("汽車英文專業術語", "國文")


def section_kind(line: Column) -> Column:
    """Kind of the section that a heading line opens; null for other lines."""
    word = F.regexp_extract(line, SECTION_HEADING, 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair]), word)


def subject_named(line: Column) -> Column:
    """Subject that a heading names, without white space; null without one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(line, SUBJECT_HEADING, 1), r"\s+", ""), F.lit(""))


def kept_section(kind: Column, subject: Column) -> Column:
    """Whether a section's questions are imported: of a kind that is kept, of a subject that isn't skipped."""
    return F.coalesce(kind.isin(*KEPT_SECTIONS), F.lit(False)) & ~F.coalesce(subject.isin(*SKIPPED_SUBJECTS), F.lit(False))


def exam_info(name: Column) -> Column:
    """Struct of year and session from an exam's file name: `115-1…`, `110年…` or `110全科…`; empty ones if it says none."""
    session = F.regexp_extract(name, r"^\d{3}-(\d+)", 1)
    return F.struct(F.regexp_extract(name, r"^(\d{3})(?:-\d+|年|全科)", 1).alias("year"), session.alias("session"))


#: A value with its unit, and the greatest surplus of a last option by the mean length of the others (fixed values).
_NUMBER = r"\d+(?:\.\d+)?\s*[~-]?\s*(?:\d+(?:\.\d+)?)?\s*%?"
_VALUE = rf"^\s*{_NUMBER}\s*[\u4e00-\u9fff]{{0,3}}\s*$"
_SURPLUS = ((2, 2), (5, 3), (None, 5))
BLANK = "______"


def _bare(o: Column) -> Column:
    return F.regexp_replace(o, "[^\u4e00-\u9fff\u3400-\u4dbfA-Za-z0-9]", "")


def _ends(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def trailing_stem(stem: Column, options: Column) -> Column:
    """Struct of stem and options with what the last of four options holds of the stem moved back to it.

    Every place at which the last option may be cut is a candidate: behind the ending that the other three share (if it
    isn't a number), and at white space. Both parts must hold something. A candidate costs how far the option it leaves
    is from the others' mean length; endings go before white space, then the cheapest and the first wins. Candidates
    count only where the last option is longer than the mean by more than a surplus and the stem isn't a question
    already. Then, if the others are values, the last one is cut behind its value and their common unit.
    """
    q = F.struct(stem.alias("stem"), options.alias("options"), F.slice(options, 1, 3).alias("others"), F.element_at(options, 4).alias("last"))
    done = _let(_let(_let(q, _with_ending), _cut_by_length), _cut_by_value)
    return F.when(F.size(options) == 4, done).otherwise(F.struct(stem.alias("stem"), options.alias("options")))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_ending(q: Column) -> Column:
    """Adds the mean length of the first three options, the ending they share, and their bare forms' first."""
    bare = F.transform(q["others"], _bare)

    def ending(b: Column) -> Column:
        tail = lambda o, k: F.substr(o, F.length(o) - k + 1, k)
        first = F.element_at(b, 1)
        shared = F.filter(F.sequence(F.lit(0), F.array_min(F.transform(b, lambda o: F.length(o)))), lambda k: F.forall(b, lambda o: tail(o, k) == tail(first, k)))
        return _let(tail(first, F.array_max(shared)), lambda e: F.when(e.rlike(r"^\d*$"), "").otherwise(e))

    mean = F.aggregate(q["others"], F.lit(0.0), lambda a, o: a + F.length(o)) / 3
    return F.struct(q["stem"].alias("stem"), q["options"].alias("options"), q["others"].alias("others"), q["last"].alias("last"), mean.alias("mean"), _let(bare, ending).alias("ending"))


def _cut_by_length(q: Column) -> Column:
    last, mean, ending = q["last"], q["mean"], q["ending"]
    surplus = F.lit(_SURPLUS[-1][1])
    for most, by in reversed(_SURPLUS[:-1]):
        surplus = F.when(mean <= most, by).otherwise(surplus)

    def candidate(i: Column) -> Column:
        """A cut behind character i: kind (0 ending, 1 white space), cost, place, the two parts; null if it isn't one."""
        by_ending = (ending != "") & (i >= F.length(ending)) & (F.substr(last, i - F.length(ending) + 1, F.length(ending)) == ending)
        by_space = F.substr(last, i + 1, F.lit(1)).rlike(r"(?U)\s") & ~F.substr(last, i, F.lit(1)).rlike(r"(?U)\s")
        parts = F.struct(F.when(by_ending, 0).when(by_space, 1).alias("kind"), _ends(F.substr(last, F.lit(1), i)).alias("left"), _ends(F.substr(last, i + 1, F.length(last))).alias("right"))
        cost = lambda x: F.struct(x["kind"].alias("kind"), F.abs(F.length(x["left"]) - mean).alias("cost"), i.alias("at"), x["left"].alias("left"), x["right"].alias("right"))
        return _let(parts, lambda x: F.when(x["kind"].isNotNull() & (x["left"] != "") & (x["right"] != ""), cost(x)))

    inside = F.when(F.length(last) > 1, F.sequence(F.lit(1), F.length(last) - 1)).otherwise(F.array().cast("array<int>"))
    start = F.coalesce(_ends(q["stem"]), F.lit(""))
    long = (F.length(last) > mean + surplus) & ~start.rlike("[？?]$")
    best = F.when(long, F.array_min(F.array_compact(F.transform(inside, candidate))))

    def made(x: Column) -> Column:
        stem = F.when(x["best"].isNull(), q["stem"]).when(x["start"] == "", x["best"]["right"]).otherwise(F.concat_ws(f" {BLANK} ", x["start"], x["best"]["right"]))
        return F.struct(stem.alias("stem"), q["others"].alias("others"), F.coalesce(x["best"]["left"], last).alias("last"))

    return _let(F.struct(best.alias("best"), start.alias("start")), made)


def _cut_by_value(q: Column) -> Column:
    others, last = q["others"], q["last"]
    unit_of = lambda k: _ends(F.regexp_extract(F.element_at(others, k), r"([\u4e00-\u9fff\s]+)$", 1))
    after = F.regexp_replace(F.substr(last, F.length(F.regexp_extract(last, rf"^\s*{_NUMBER}", 0)) + 1, F.length(last)), r"(?U)^\s+", "")
    seen = F.struct(
        F.when(unit_of(2) == unit_of(3), unit_of(2)).otherwise("").alias("unit"), last.rlike(rf"^\s*{_NUMBER}").alias("number"), after.alias("after"), last.endswith("為限").alias("limited"),
        _ends(F.regexp_replace(last, "為限$", "")).alias("bounded"),
    )

    def told(x: Column) -> Column:
        rest = _ends(F.substr(x["after"], F.length(x["unit"]) + 1, F.length(x["after"])))
        value = _ends(F.concat(F.substr(last, F.lit(1), F.length(last) - F.length(x["after"])), x["unit"]))
        tail = F.struct(rest.alias("rest"), value.alias("value"))

        def moved(y: Column) -> Column:
            words = (F.length(y["rest"]) >= 2) | (x["unit"] == "")
            tailed = x["number"] & F.startswith(x["after"], x["unit"]) & y["rest"].rlike(r"^[\p{L}\p{N}_\s]+$") & y["rest"].rlike(r"[\u4e00-\u9fffA-Za-z]") & words
            by_limit = F.when(x["bounded"].rlike(_VALUE), F.struct(x["bounded"].alias("last"), F.lit("為限").alias("tail")))
            return F.when(x["limited"], by_limit).when(tailed, F.struct(y["value"].alias("last"), y["rest"].alias("tail")))

        return _let(tail, moved)

    def made(m: Column) -> Column:
        blank = F.when(F.contains(q["stem"], F.lit(BLANK)), q["stem"]).otherwise(F.concat_ws(" ", q["stem"], F.lit(BLANK)))
        stem = F.when(m.isNull(), q["stem"]).otherwise(F.trim(F.concat_ws(" ", blank, m["tail"])))
        return F.struct(stem.alias("stem"), F.concat(others, F.array(F.coalesce(m["last"], last))).alias("options"))

    values = F.forall(others, lambda o: o.rlike(_VALUE))
    return _let(F.when(values, _let(seen, told)), made)


def content_key(*parts: Column) -> Column:
    """Stable hash of what a cached result depends on."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def layout_blocks(text: Column) -> Column:
    """Blocks of a layout answer, malformed ones dropped; null if none is left. Fences around the JSON are ignored."""
    from examforge.functions.text import fences_stripped

    schema = "blocks array<struct<type:string,text:string,items:array<string>>>"
    blocks = F.from_json(fences_stripped(text), schema)["blocks"]
    good = F.filter(blocks, lambda b: (b["type"] == "paragraph") & (F.trim(b["text"]) != "") | b["type"].isin("bulletList", "steps") & (F.size(b["items"]) > 0))
    return F.when(F.size(good) > 0, good)
