"""Exam papers as text: sections of a subject, blocks of questions with embedded answers, and banks compared with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examforge.functions import parsing
from examforge.functions import text as T
from examforge.operators import segment

#: Heading of a subject's paper, of a section, sections without choices, and lines that aren't part of it (fixed values).
PAPER = r"筆\s*試\s*試\s*題"
SECTION = r"^[一二三四五]\s*、\s*(\S{0,6}題)"
OPEN_SECTIONS = "填充|問答|申論|簡答|計算"
#: A question with its answer in brackets at the start of a line, anywhere, and with the bracket cut off (fixed values).
_NUMBER, _STOP = r"(\d\s?\d|\d{1,2})", r"\s*[.、](?!\d)"
STRICT = rf"(?m)^\s*[（(]\s*([^（）()]{{1,14}}?)\s*[）)]\s*{_NUMBER}{_STOP}"
LOOSE = rf"[（(]\s*([^（）()]{{1,14}}?)\s*[）)]\s*{_NUMBER}{_STOP}"
CUT_OFF = rf"[（(]\s*[\d、，,]{{1,10}}\s+{_NUMBER}{_STOP}"
#: The embedded form `【2】1.`, the heading of the part behind the choices, and the largest number (fixed values).
EMBEDDED = r"【([^】]+)】\s*(\d{1,2})\s*[.．]"
PART_TWO = "\n貳、"
MOST = 50


def paper(text: Column, subject: str) -> Column:
    """What a text has between the heading of a subject's paper and the next paper's; null without it."""
    heading = r"\s*".join(subject) + r"\s*" + PAPER
    found = F.regexp_extract(text, rf"(?s){heading}(.*?)(?:(?=(?m:^[^\n]{{0,30}}{PAPER}))|\z)", 1)
    return F.when(text.rlike(heading), found)


def sections(papers: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, name, content): sections in order from 0, without noise; a paper without headings is one without a
    name, else what stands before the first heading is left out. Sections from the first one without choices on are left
    out as well."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~T.noise_line(x, "traffic"))
    marked = F.transform(lines, lambda x: F.when(x.rlike(SECTION), F.concat(F.lit("\x1e"), F.regexp_extract(x, SECTION, 1), F.lit("\x1f"))).otherwise(x))
    # an answer cut over two lines leaves its end at the start of the second
    whole = F.regexp_replace(F.array_join(marked, "\n"), r"(?m)^[\d、，,\s]{1,8}[）)]\s*", "")
    parts = papers.select(key, F.posexplode(F.split(whole, "\x1e")).alias("section", "part"), F.contains(whole, F.lit("\x1e")).alias("_many"))
    parts = parts.where(~F.col("_many") | (F.col("section") > 0))
    parts = parts.select(key, F.when(F.col("_many"), F.col("section") - 1).otherwise(F.lit(0)).alias("section"), F.when(F.col("_many"), F.substring_index("part", "\x1f", 1)).alias("name"), F.substring_index("part", "\x1f", -1).alias("content"))
    w = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    over = F.max(F.coalesce(F.col("name").rlike(OPEN_SECTIONS), F.lit(False))).over(w)
    return parts.withColumn("_over", over).where(~F.col("_over")).drop("_over")


def _run(text: Column, pattern: str, answer: int | None, no: int) -> Column:
    """Questions that count 1, 2, 3, ... among the matches of a pattern: structs of raw answer (null where it was cut off),
    number and body. A match out of turn is part of the body before it."""
    marks = F.regexp_extract_all(text, F.lit(pattern), 0)
    raw = F.transform(marks, lambda m: F.when(m.rlike(LOOSE), F.regexp_extract(m, LOOSE, 1))) if answer is None else F.transform(marks, lambda m: F.regexp_extract(m, pattern, answer))
    number = F.transform(marks, lambda m: F.regexp_replace(F.regexp_extract(m, rf"{_NUMBER}{_STOP}$", 1) if answer is None else F.regexp_extract(m, pattern, no), r"\s", "").cast("int"))
    pieces = F.split(text, pattern, -1)
    each = F.arrays_zip(marks.alias("mark"), raw.alias("raw"), number.alias("number"), F.slice(pieces, 2, F.size(marks)).alias("body"))
    none = F.array().cast("array<struct<raw:string,number:int,body:string>>")

    def step(acc: Column, x: Column) -> Column:
        new = F.array_append(acc, F.struct(x["raw"].alias("raw"), x["number"].alias("number"), x["body"].alias("body")))
        last = F.element_at(acc, -1)
        longer = F.struct(last["raw"].alias("raw"), last["number"].alias("number"), F.concat(last["body"], x["mark"], x["body"]).alias("body"))
        return F.when(x["number"] == F.size(acc) + 1, new).when(F.size(acc) > 0, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(acc)

    return F.aggregate(each, none, step)


def answer_of(raw: Column) -> Column:
    """Places from 0 of an embedded answer: its digits, else 0 for a circle and 1 for a cross; null where it allows several
    answers, is a free score or says nothing."""
    digits = F.transform(F.regexp_extract_all(raw, F.lit(r"(\d)"), 1), lambda d: d.cast("int") - 1)
    said = F.when(F.size(digits) > 0, digits).when(raw.rlike("[○〇Ｏ]"), F.array(F.lit(0))).when(raw.rlike("[╳×Ｘ✕X]"), F.array(F.lit(1)))
    return F.when(~raw.rlike("或|送分"), said)


def blocks(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, number, answer, body): questions of all sections, numbered through the paper. In each section the longest of
    three runs counts: questions at the start of lines, anywhere, and also those whose bracket was cut off."""
    c = F.col("content")
    runs = [_run(c, STRICT, 1, 2), _run(c, LOOSE, 1, 2), _run(c, f"{LOOSE}|{CUT_OFF}", None, 0)]
    best = runs[0]
    for r in runs[1:]:
        best = F.when(F.size(r) > F.size(best), r).otherwise(best)
    rows = found.withColumn("q", best).withColumn("n", F.size("q"))
    w = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).select(key, "before", F.explode("q").alias("q"))
    return rows.select(key, (F.col("before") + F.col("q.number")).cast("int").alias("number"), answer_of(F.col("q.raw")).alias("answer"), F.col("q.body").alias("body"))


def compared(bank: DataFrame, parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, id, issue) of a bank against its paper: `count` (id null), `missing`, `text`, `answer`.

    bank: key, id, question, options, answers (array of places); parsed: blocks(). Texts are compared by compare_key;
    the options O and X of a question that its paper has without options are no difference, nor is an answer that the
    paper leaves open.
    """
    b = bank.select(key, "id", T.compare_key(parsing.source_line(F.col("question"), F.col("options"))).alias("full"), T.compare_key(F.col("question")).alias("stem"), "options", F.array_sort("answers").alias("answers"))
    p = parsed.select(key, F.col("number").alias("id"), T.compare_key(F.col("body")).alias("body"), F.array_sort("answer").alias("answer"), F.lit(True).alias("here"))
    rows = b.join(p, [key, "id"], "left")
    ox = F.transform("options", lambda o: F.upper(F.trim(o)))
    added = ((ox == F.array(F.lit("O"), F.lit("X"))) | (ox == F.array(F.lit("○"), F.lit("×"))) | (ox == F.array(F.lit("是"), F.lit("非")))) & (F.col("body") == F.col("stem"))
    found = F.array_compact(F.array(
        F.when(F.col("here").isNull(), F.lit("missing")), F.when((F.col("body") != F.col("full")) & ~F.coalesce(added, F.lit(False)), F.lit("text")),
        F.when(F.col("answer").isNotNull() & ~F.col("answer").eqNullSafe(F.col("answers")), F.lit("answer")),
    ))
    issues = rows.select(key, "id", F.explode(found).alias("issue"))
    n = bank.groupBy(key).agg(F.count("*").alias("a")).join(parsed.groupBy(key).agg(F.count_distinct("number").alias("b")), key, "left")
    counts = n.where(F.col("a") != F.coalesce("b", F.lit(0))).select(key, F.lit(None).cast("int").alias("id"), F.lit("count").alias("issue"))
    return issues.unionByName(counts)


def embedded(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, id, question, options, answer, free, locked) of banks written as `【2】1. stem (1) … (4) …`: up to the second
    part, numbers 1 to MOST, only questions with a stem and four options. Without a digit the answer is 0 and free."""
    choices = F.substring_index(text, PART_TWO, 1)
    marks, pieces = F.regexp_extract_all(choices, F.lit(EMBEDDED), 0), F.split(choices, EMBEDDED, -1)
    rows = texts.select(key, F.posexplode(F.arrays_zip(marks.alias("mark"), F.slice(pieces, 2, F.size(marks)).alias("body"))).alias("place", "q"))
    split = parsing.marked(F.translate("q.body", "\x81\x82\x83\x84", "①②③④①②③④"), "([①-④])", "①②③④")
    rows = rows.select(key, "place", F.regexp_extract("q.mark", EMBEDDED, 2).cast("int").alias("id"), F.regexp_extract(F.regexp_extract("q.mark", EMBEDDED, 1), "[1-4]", 0).alias("a"), split.alias("s"))
    rows = rows.where(F.col("id").between(1, MOST) & (F.coalesce(F.col("s.stem"), F.lit("")) != "") & (F.size("s.options") == 4))
    answer = F.coalesce(F.nullif("a", F.lit("")).cast("int") - 1, F.lit(0))
    return rows.select(key, "id", F.col("s.stem").alias("question"), F.col("s.options").alias("options"), answer.alias("answer"), (F.col("a") == "").alias("free"), parsing.locked(F.col("s.options"), letters=False).alias("locked"))


def active_lines(rows: DataFrame, key: str, order: str = "no", line: str = "line") -> DataFrame:
    """Lines of a column that belong to the choices: from the line behind the heading of part one, or from the first line
    with an answer mark, up to the heading of the next part. The heading itself isn't one."""
    t = F.col(line)
    heading = F.contains(t, F.lit("壹、")) | F.contains(t, F.lit("壹."))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    stopped = F.max(t.rlike("[貳贰]、")).over(w)
    started = F.max(heading | t.rlike(r"【[^】]*】")).over(w)
    return rows.withColumn("_on", started & ~stopped & ~heading).where("_on").drop("_on")


def first_places(marks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first of the marks of each id, by the order given (page, then height, then place in the line)."""
    cols = [c for c in marks.columns if c not in by]
    return marks.groupBy(*by).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("m")).select(*by, "m.*")


def with_crops(questions: DataFrame, materials: DataFrame, keys: list[str]) -> DataFrame:
    """Crops of questions with those of their materials (clip, warnings), null where a question has none; of several the
    first by clip."""
    m = materials.groupBy(*keys).agg(F.min(F.struct("clip", "warnings")).alias("m")).select(*keys, F.col("m.clip").alias("material_clip"), F.col("m.warnings").alias("material_warnings"))
    return questions.join(m, keys, "left")


def without_excluded(questions: DataFrame, excluded: DataFrame, keys: list[str], answers: DataFrame | None = None) -> DataFrame:
    """Questions that no list excludes and, given the answers, whose answer isn't null (free scores)."""
    out = questions.join(excluded.select(*keys).distinct(), keys, "left_anti")
    return out if answers is None else out.join(answers.where(F.col("answer").isNull()).select(*keys), keys, "left_anti")


def bank_of(crops: DataFrame, answers: DataFrame, overrides: DataFrame, materials: DataFrame, passages: DataFrame, key: str = "year") -> DataFrame:
    """A joint examination's bank from its parts: stems and options of the crops' texts, answers (0 where there is none;
    null ones are free scores and left out), overriding fields, materials, passages over ranges of numbers, and groups
    of more than one member.

    crops: key, id, text; answers: key, id, answer; overrides: key, id, question, options; materials: key, id, materials;
    passages: key, first, last, content.
    """
    keys = [key, "id"]
    split = parsing.lettered_options(F.regexp_replace("text", r"^\s*\d{1,2}\s*[.．]\s*", ""))
    q = crops.select(*keys, split.alias("s")).select(*keys, F.col("s.stem").alias("question"), F.col("s.options").alias("options"))
    q = without_excluded(q, q.limit(0), keys, answers).join(answers, keys, "left").withColumn("answer", F.coalesce("answer", F.lit(0)))
    o = overrides.select(*keys, F.col("question").alias("o_question"), F.col("options").alias("o_options"))
    q = q.join(o, keys, "left").withColumn("question", F.coalesce("o_question", "question")).withColumn("options", F.coalesce("o_options", "options")).drop("o_question", "o_options")
    q = q.join(materials, keys, "left")
    p = passages.withColumn("id", F.explode(F.sequence("first", "last"))).groupBy(*keys).agg(F.min(F.struct("first", "last", "content")).alias("p"))
    q = q.join(p, keys, "left").withColumn("groupid", F.concat_ws("-", F.col("p.first"), F.col("p.last"))).withColumn("passage", F.col("p.content")).drop("p")
    n = q.where(F.col("groupid") != "").groupBy(key, "groupid").agg(F.count("*").alias("n"))
    q = q.join(n, [key, "groupid"], "left").withColumn("groupid", F.when(F.col("n") > 1, F.col("groupid"))).drop("n")
    return q.select(*keys, "question", "options", "answer", "materials", "passage", "groupid")


def accumulated(rows: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, id, answer, free, question, options) from lines of positioned text: an answer mark `【2】1.` opens a record,
    text before an option goes to the stem, later text to the last option; options are padded to their mark's place, and
    a repeated mark goes on with its option."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col(line).rlike(EMBEDDED)
    rows = rows.withColumn("_q", F.sum(opens.cast("int")).over(w)).where(F.col("_q") > 0)
    whole = rows.groupBy(key, "_q").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))).alias("l"))
    text = T.layout_normalized(F.array_join(F.transform("l", lambda x: x["l"]), " "))
    whole = whole.select(key, "_q", text.alias("t")).withColumn("m", F.regexp_extract("t", EMBEDDED, 0))
    body = F.trim(F.substr("t", F.instr("t", F.col("m")) + F.length("m"), F.length("t")))
    pieces = F.split(body, "[①-④]", -1)
    marks = F.regexp_extract_all(body, F.lit("[①-④]"), 0)
    each = F.zip_with(marks, F.slice(pieces, 2, F.size(marks)), lambda m, t: F.struct((F.instr(F.lit("①②③④"), m)).alias("at"), F.trim(t).alias("t")))
    most = F.coalesce(F.array_max(F.transform(each, lambda x: x["at"])), F.lit(0))
    slots = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    options = F.transform(slots, lambda i: F.array_join(F.transform(F.filter(each, lambda x: (x["at"] == i) & (x["t"] != "")), lambda x: x["t"]), " "))
    raw = F.trim(F.regexp_extract("m", EMBEDDED, 1))
    place = parsing.bracketed_answer(raw)
    return whole.select(key, F.regexp_extract("m", EMBEDDED, 2).cast("int").alias("id"), place["place"].alias("answer"), place["free"].alias("free"), F.trim(F.get(pieces, F.lit(0))).alias("question"), options.alias("options"))


def kept_sections(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, no, line, subject, kind) of the lines of sections that are imported; subject and kind are those of the last
    heading before, a subject's heading closes the section before."""
    subject, kind = parsing.subject_named(F.col("line")), parsing.section_kind(F.col("line"))
    rows = segment.carried(lines, key, {"subject": subject, "kind": F.coalesce(kind, F.when(subject.isNotNull(), ""))})
    body = kind.isNull() & subject.isNull()
    return rows.where(body & parsing.kept_section(F.col("kind"), F.col("subject"))).select(key, "no", "line", "subject", "kind")
