"""Operators over a few literal rows, with the rows that must come out as SQL VALUES.

Most of these operators have no equivalent in SQL, or their rules meet no row of the tables; what must come out was
written down from their definitions by hand, never from a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examforge.functions import parsing as P
from examforge.functions import rendering as R
from examforge.functions import text as T
from examforge.operators import audit, imports, laws, papers, quality, quiz, ranges, reviews, segment
from examforge.plans.base import Plans
from examforge.sources import writers

plans = Plans()


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value) if isinstance(value, int) else f"CAST({value!r} AS DOUBLE)"
    return "'" + value.replace("'", "''") + "'"


def expected(columns: str, rows: list[tuple], **casts: str) -> str:
    """SQL that gives the rows; casts: type by column."""
    names = columns.split()
    picked = ", ".join(f"CAST({n} AS {casts[n]}) AS {n}" if n in casts else n for n in names)
    return f"SELECT {picked} FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({', '.join(names)})"


def shown(c: Column) -> Column:
    """A list as text."""
    return F.array_join(c.cast("array<string>"), "|", "null")


def _struct(c: Column, *fields: str) -> Column:
    return F.concat_ws(";", *[F.coalesce(c[f].cast("string"), F.lit("null")) for f in fields])


_TEXTS = {
    "gaps_removed": (T.gaps_removed, [("甲 ， 乙 ab 丙", "甲，乙 ab 丙"), ("（ 甲 ） 㐀", "（甲）㐀")]),
    "gaps_joined": (T.gaps_joined, [("臺 灣 水 利", "臺灣 水 利"), ("下列 何者 正確 的 是", "下列何者 正確的 是"), ("大 幅 甲 乙", "大幅 甲 乙"), ("伴 手禮", "伴手禮")]),
    "gaps_joined_keeping_tables": (lambda c: T.gaps_joined(c, keep_tables=True), [("甲 的 乙 丙 丁", "甲 的 乙 丙 丁"), ("甲 的", "甲的")]),
    "spaced": (T.spaced, [("共12組ab型（甲）％", "共 12 組 ab 型(甲)%"), ("何者？！　甲", "何者？！ 甲"), ("1〜2－3", "1~2-3")]),
    "compare_key": (T.compare_key, [("Ａ１ ，㎡(cid:12)。b(cid:711)", "A1,m2bˇ")]),
    "marks_mapped": (T.marks_mapped, [("Å甲Ç乙丙", "①甲②乙③丙")]),
    "compatibility_fixed": (T.compatibility_fixed, [("理利不", "理利不")]),
    "layout_normalized": (T.layout_normalized, [("甲 乙 ,丙 .", "甲→ 乙,丙."), ("2 x 10 元、6 甲", "2×10^6 元、 甲")]),
    "powers_joined": (T.powers_joined, [("3 x 10 元，6 與", "3×10^6 元， 與"), ("5 × 10 元，效益分別為6，", "5×10^6 元，效益分別為，"), ("5X10元。", "5×10 元。")]),
    "chinese_number": (lambda c: T.chinese_number(c).cast("string"), [("一百零五", "105"), ("兩百", "200"), ("十", "10"), ("42", "42"), ("甲", None)]),
    "explanation_cleaned": (T.explanation_cleaned, [('```json\n{"explanation": " 白話 "}\n```', "白話"), ("想\n改寫後：解釋：甲\n乙", "甲 乙")]),
    "fences_stripped": (T.fences_stripped, [("<think>x</think>\n```json\n{}\n```", "{}")]),
    "slug": (lambda c: T.slug(c, "law"), [("Water Act.txt", "water-act"), ("!.txt", "law")]),
    "article_slug": (T.article_slug, [("第 12－1 條（刪除）", "article-第12-1條-刪除"), ("", "article-unknown")]),
    "roc_year": (lambda c: T.roc_year(c).cast("string"), [("99/12/31", "2010"), ("x", None)]),
    "token_estimate": (lambda c: T.token_estimate(c).cast("string"), [("abcde", "2"), ("", "1")]),
    "html_escaped": (R.html_escaped, [("<a href=\"x\">'&", "&lt;a href=&quot;x&quot;&gt;&#39;&amp;")]),
    "field_clean": (P.field_clean, [("甲 乙( a )【請接續背面】: ", "甲乙(a)")]),
    "indexes_joined": (P.indexes_joined, [("I 0 與 X 1 年，Q d 及 MU A。", "I₀ 與 X1 年，Qd 及 MU_A。")]),
    "row_values": (lambda c: shown(R.row_values(c)), [('["a", 1]', "a|1"), ('{"x": "b", "y": "c"}', "b|c"), ("oops", None)]),
    "tf_answer": (lambda c: P.tf_answer(c).cast("string"), [("（○）", "0"), ("( X )", "1"), ("（3）", None)]),
    "digit_answers": (lambda c: shown(P.digit_answers(c)), [("（3.1 3）", "0|2"), ("（２）", "1"), ("（9）", None)]),
    "bracketed_answer": (lambda c: _struct(P.bracketed_answer(c), "place", "free"), [("3", "2;false"), ("送分", "0;true")]),
    "numbered_options": (lambda c: F.concat_ws("//", P.numbered_options(c)["stem"], shown(P.numbered_options(c)["options"])), [("下列 (1) 甲 (３) 乙。（2）丙； (3) 丁", "下列//甲 (３) 乙|丙|丁")]),
    "lettered_options": (lambda c: F.concat_ws("//", P.lettered_options(c)["stem"], shown(P.lettered_options(c)["options"])), [("何者？(A)甲(B)乙(D)丙", "何者？//甲|乙(D)丙")]),
    "circled_options": (lambda c: F.concat_ws("//", P.circled_options(c)["stem"], shown(P.circled_options(c)["options"])), [("題 ①一②二", "題//一|二")]),
    "passage_range": (lambda c: _struct(P.passage_range(c), "first", "last", "content"), [("▲閱讀下文，回答第 11 - 15 題 水庫。\n11. 問", "11;15;水庫。")]),
    "article_kind": (P.article_kind, [("（刪 除）", "deleted"), ("本法施行細則，由中央主管機關定之。", "by_authority"), ("本法自公布日施行", "in_force"), ("第三條", None)]),
    "has_penalty": (lambda c: P.has_penalty(c, "罰金").cast("string"), [("處罰金", "true"), ("裁罰金額", "false")]),
    "section_kind": (P.section_kind, [("一、是非題（每題 2 分）", "truefalse"), ("貳、作文", None), ("三．選擇題(單選)", "single"), ("四、中譯英", "zh2en")]),
    "subject_named": (P.subject_named, [("道路交通法規筆試試題", "道路交通法規"), ("國　文", None), ("國 文", "國文")]),
    "exam_info": (lambda c: _struct(P.exam_info(c), "year", "session"), [("115-1全科.pdf", "115;1"), ("110年檢定", "110;"), ("109全科", "109;"), ("x", ";")]),
    "money_ranges": (lambda c: shown(P.money_ranges(c)), [("處新臺幣一萬元以上五萬元以下，新臺幣一萬元以上五萬元以下", "新臺幣一萬元以上五萬元以下")]),
    "bank_year": (lambda c: audit.bank_year(c).cast("string"), [("112水利", "112"), ("水利", "110")]),
    "stem": (T.stem, [("甲、乙？ A_b ①½é", "甲乙a_b①½é")]),
}


@plans.add(expected("fn input output", [(n, i, o) for n, (_, cases) in _TEXTS.items() for i, o in cases]))
def literal_texts(spark, d):
    rows = spark.createDataFrame([(n, i) for n, (_, cases) in _TEXTS.items() for i, _ in cases], "fn string, input string")
    out = F.lit(None).cast("string")
    return _by_function(rows, out)


def _by_function(rows: DataFrame, out: Column) -> DataFrame:
    parts = [rows.where(F.col("fn") == n).withColumn("output", f(F.col("input")).cast("string")) for n, (f, _) in _TEXTS.items()]
    while len(parts) > 1:
        parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    return parts[0]


@plans.add(expected("stem options", [
    ("申報應於 ______ 向主管機關提出", "三日內|五日內|七日內|十日內"), ("由 ______ 任命之官員辦理", "縣長|市長|部長|總統"), ("期限 ______ 為限", "1 年|2 年|3 年|6 個月"), ("相距 ______ 以上", "10公尺|20公尺|30公尺|40公尺"),
    ("何者？", "a|b|c|a very long last option"), ("期限", "1年|2年|3年|4年內"), ("a", "x|y"),
]))
def literal_trailing_stems(spark, d):
    rows = [
        ("申報應於", "三日內|五日內|七日內|十日內向主管機關提出"), ("由", "縣長|市長|部長|總統 任命之官員辦理"), ("期限", "1 年|2 年|3 年|6 個月為限"), ("相距", "10公尺|20公尺|30公尺|40公尺以上"),
        ("何者？", "a|b|c|a very long last option"), ("期限", "1年|2年|3年|4年內"), ("a", "x|y"),
    ]
    q = spark.createDataFrame(rows, "s string, o string").select(P.trailing_stem(F.col("s"), F.split("o", r"\|")).alias("r"))
    return q.select("r.stem", shown(F.col("r.options")).alias("options"))


@plans.add(expected("source repaired errors missing", [
    ("科或併科罰金新臺幣一萬元以上五萬元以下", "要罰錢 原文用語是「科或併科」，表示可以單獨科罰金，也可以和其他刑罰一起併科。 原文的處罰種類是罰金。 原文金額區間為：新臺幣一萬元以上五萬元以下。", "", "科或併科|罰金|新臺幣一萬元以上五萬元以下"),
    ("處罰鍰", "處罰金 原文的處罰種類是罰鍰。", "罰鍰", "罰鍰"), ("無", "無", "", ""),
]))
def literal_explanations(spark, d):
    q = spark.createDataFrame([("科或併科罰金新臺幣一萬元以上五萬元以下", "要罰錢"), ("處罰鍰", "處罰金"), ("無", " 無 ")], "source string, e string")
    s, e = F.col("source"), F.col("e")
    return q.select("source", P.explanation_repaired(s, e).alias("repaired"), shown(P.explanation_errors(s, e)).alias("errors"), shown(P.missing_terms(s, e)).alias("missing"))


@plans.add(expected("question line", [("甲______乙______", "甲(1)一(2)二乙______"), ("甲", "甲(1)一(2)二")]))
def literal_source_lines(spark, d):
    q = spark.createDataFrame([("甲______乙______",), ("甲",)], "question string")
    return q.select("question", P.source_line(F.col("question"), F.array(F.lit("一"), F.lit("二"))).alias("line"))


@plans.add(expected("options out", [("1 m3|2 m3|3 m3|4 m3 /ha /ha /ha /ha", "1 m3/ha|2 m3/ha|3 m3/ha|4 m3/ha"), ("1|2 /ha", "1|2 /ha")]))
def literal_units(spark, d):
    q = spark.createDataFrame([("1 m3|2 m3|3 m3|4 m3 /ha /ha /ha /ha",), ("1|2 /ha",)], "options string")
    return q.select("options", shown(P.units_rebalanced(F.split("options", r"\|"))).alias("out"))


@plans.add(expected("r block size", [("a", 1, 1), ("a", 2, 3), ("b", 0, 3), ("c", 0, 2), ("c", 2, 1), ("c", 4, 4), ("d", 0, 2), ("d", 2, 4)], block="INTEGER", size="INTEGER"))
def literal_exact_blocks(spark, d):
    given = {"a": ([2, 1, 3], 4), "b": ([3, 3], 4), "c": ([2, 2, 1, 1, 4], 7), "d": ([2, 3, 4], 6)}
    out = None
    for r, (sizes, wanted) in given.items():
        one = quiz.exact_selection(spark.createDataFrame([(r, i, n) for i, n in enumerate(sizes)], "r string, block int, size int"), ["r"], ["block"], "size", wanted)
        out = one if out is None else out.unionByName(one)
    return out


_PAPER = "汽車構造筆試試題\n一、是非題\n（○）1. 甲\n第 2 頁\n（X）2. 乙\n二、選擇題\n（2）1. 丙(1)子(2)丑(3)寅(4)卯（1.5）公升\n續（3或4）2. 丁\n三、問答題\n（1）1. 戊\n國文筆試試題\n（1）1. 己"


def _paper(spark):
    df = spark.createDataFrame([(1, _PAPER)], "doc_id bigint, text string").withColumn("text", papers.paper(F.col("text"), "汽車構造"))
    return papers.blocks(papers.sections(df))


@plans.add(expected("number answer body", [(1, "0", "甲"), (2, "1", "乙"), (3, "1", "丙(1)子(2)丑(3)寅(4)卯（1.5）公升\n續"), (4, None, "丁")], number="INTEGER"))
def literal_paper_blocks(spark, d):
    return _paper(spark).select("number", shown(F.col("answer")).alias("answer"), F.trim(F.regexp_replace("body", r"^\s+|\s+$", "")).alias("body"))


@plans.add(expected("id issue", [(None, "count"), (2, "answer"), (4, "text"), (5, "missing")], id="INTEGER"))
def literal_paper_issues(spark, d):
    bank = [(1, 1, "甲", ["O", "X"], [0]), (1, 2, "乙", ["O", "X"], [0]), (1, 3, "丙______（1.5）公升續", ["子", "丑", "寅", "卯"], [1]), (1, 4, "丁丁", [], [0]), (1, 5, "無", [], [0])]
    return papers.compared(spark.createDataFrame(bank, "doc_id bigint, id int, question string, options array<string>, answers array<int>"), _paper(spark)).select("id", "issue")


@plans.add(expected("id question options answer free locked", [(1, "甲", "一|二|三|以上皆是", 1, False, True), (2, "乙", "a|b|c|d", 0, True, False)], id="INTEGER", answer="INTEGER"))
def literal_embedded_bank(spark, d):
    text = "【2】1. 甲 ①一 ②二 ③三 ④以上皆是\n【送分】2. 乙 ①a②b③c④d\n【1】3. 丙 ①a ②b\n【3】51. 丁 ①a②b③c④d\n貳、\n【1】4. 戊 ①a②b③c④d"
    found = papers.embedded(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    return found.select("id", "question", shown(F.col("options")).alias("options"), "answer", "free", "locked")


@plans.add(expected("id question options answer free", [(1, "甲 續", "一|二 又||四", 1, False), (2, "乙", "", 0, True)], id="INTEGER", answer="INTEGER"))
def literal_accumulated(spark, d):
    lines = ["頁首", "【2】1. 甲", "續", "①一 ②二", "②又", "④四", "【送分】2. 乙"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id bigint, no int, line string")
    found = papers.accumulated(rows, "doc_id", "no", "line")
    return found.select("id", "question", shown(F.col("options")).alias("options"), "answer", "free")


@plans.add(expected("no line", [(2, "甲"), (3, "乙")], no="INTEGER"))
def literal_active_lines(spark, d):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["頁首", "壹、選擇題", "甲", "乙", "貳、非選擇題", "丙"])], "doc_id bigint, no int, line string")
    return papers.active_lines(rows, "doc_id").select("no", "line")


@plans.add(expected("no line subject kind", [(2, "甲", "道路交通法規", "truefalse"), (6, "丁", "道路交通法規", "single")], no="INTEGER"))
def literal_kept_sections(spark, d):
    lines = ["道路交通法規筆試試題", "一、是非題", "甲", "二、填充題", "乙", "三、選擇題", "丁", "國 文", "一、選擇題", "戊"]
    return papers.kept_sections(spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id bigint, no int, line string")).select("no", "line", "subject", "kind")


@plans.add(expected("id page y", [(1, 1, 2.0), (2, 1, 5.0)], id="INTEGER", page="INTEGER"))
def literal_first_places(spark, d):
    marks = spark.createDataFrame([(1, 2, 1.0, 0.0), (1, 1, 9.0, 0.0), (1, 1, 2.0, 3.0), (2, 1, 5.0, 1.0)], "id int, page int, y double, x double")
    return papers.first_places(marks, ["id"], ["page", "y", "x"]).select("id", "page", "y")


@plans.add(expected("id question options answer passage groupid", [(1, "甲", "a|b|c|d", 0, "文", "1-3"), (3, "丙改", "a|b|c|d", 2, "文", "1-3"), (4, "丁", "a|b", 0, "獨", None)], id="INTEGER", answer="INTEGER"))
def literal_joint_bank(spark, d):
    make = spark.createDataFrame
    crops = make([(1, 1, "1. 甲 (A) a (B) b (C) c (D) d"), (1, 2, "2. 乙 (A) a"), (1, 3, "3. 丙 (A) a (B) b (C) c (D) d"), (1, 4, "4. 丁(A)a(B)b")], "year int, id int, text string")
    answers = make([(1, 1, 0), (1, 2, None), (1, 3, 2)], "year int, id int, answer int")
    found = papers.bank_of(
        crops, answers, make([(1, 3, "丙改", None)], "year int, id int, question string, options array<string>"), make([], "year int, id int, materials array<string>"),
        make([(1, 1, 3, "文"), (1, 4, 4, "獨")], "year int, first int, last int, content string"),
    )
    return found.select("id", "question", shown(F.col("options")).alias("options"), "answer", "passage", "groupid")


@plans.add(expected("id material_clip", [(1, "5|6"), (2, None)], id="INTEGER"))
def literal_crops(spark, d):
    q = spark.createDataFrame([(1,), (2,)], "id int")
    m = spark.createDataFrame([(1, [7, 8], []), (1, [5, 6], ["small"])], "id int, clip array<int>, warnings array<string>")
    return papers.with_crops(q, m, ["id"]).select("id", shown(F.col("material_clip")).alias("material_clip"))


_LAWS = [
    (1, "第 1 條　甲。\n第 2 條　前條及第 1 條之規定，依農田水利法第 3 條、第 2 條。\n第 3 條　乙。"),
    (2, "第 1 條　依水利法辦理；第 2 條亦同。\n第 2 條　丙。\n第 3 條　丁。"),
    (3, "第一章 總則\n第 1 條　本法第 3 條所稱，指第九條。\n第 2 條　包括水利法。其第 3 條另定，本條第 2 條不計。"),
]
_TITLES = [(1, "水利法"), (2, "農田水利法"), (3, "農田水利法施行細則")]
_LINKS = [
    (1, 2, "前條", 1, "1", "previous-article", 1.0), (1, 2, "第 1 條", 1, "1", "same-law", 0.9), (1, 2, "第 3 條", 2, "3", "sentence-law-context", 1.0), (1, 2, "第 2 條", 2, "2", "sentence-law-context", 1.0),
    (2, 1, "第 2 條", 2, "2", "same-law", 0.9), (3, 1, "第 3 條", 2, "3", "this-law", 1.0), (3, 2, "第 3 條", 1, "3", "nearby-law-context", 1.0), (3, 2, "第 2 條", 1, "2", "nearby-law-context", 1.0),
]


def _links(spark):
    found = laws.articles(spark.createDataFrame(_LAWS, "doc_id bigint, text string"))
    return found, laws.links(found, spark.createDataFrame(_TITLES, "doc_id bigint, title string"))


@plans.add(expected("source seq text target target_no method confidence", _LINKS, source="BIGINT", seq="INTEGER", target="BIGINT"))
def literal_law_links(spark, d):
    return laws.valid_links(_links(spark)[1]).select("source", "seq", "text", "target", "target_no", "method", "confidence")


@plans.add(expected("source seq field texts", [(1, 2, "text", "前條|第 1 條|第 2 條|第 3 條"), (2, 1, "text", "第 2 條"), (3, 1, "text", "第 3 條"), (3, 2, "text", "第 2 條|第 3 條")], source="BIGINT", seq="INTEGER"))
def literal_links_by_article(spark, d):
    return laws.links_by_article(_links(spark)[1]).select("source", "seq", "field", shown(F.transform("refs", lambda r: r["text"])).alias("texts"))


@plans.add(expected("doc_id seq blocks texts", [(1, 1, None, None), (1, 2, "steps", "前條|第 1 條|第 2 條|第 3 條"), (1, 3, None, None)], doc_id="BIGINT", seq="INTEGER"))
def literal_article_extras(spark, d):
    found, refs = _links(spark)
    layouts = spark.createDataFrame([(1, 2, ["steps"])], "doc_id bigint, seq int, blocks array<string>")
    out = laws.with_extras(found.where("doc_id = 1"), layouts, laws.links_by_article(refs))
    return out.select("doc_id", "seq", shown(F.col("blocks")).alias("blocks"), shown(F.transform(F.col("refs")["text"], lambda r: r["text"])).alias("texts"))


@plans.add(expected("place kind label", [(0, "summary", "某法重點整理"), (1, "article", "第 二 章 罰則 / 第 3 條")], place="INTEGER"))
def literal_law_deck(spark, d):
    text = "第一章 總則\n第 1 條　甲\n第 2 條　乙\n第二章 罰則\n不屬於任何條\n第 3 條　丙"
    found = laws.articles(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    return laws.deck(found, spark.createDataFrame([(1, "某法")], "doc_id bigint, title string"), chapter="第 二 章 罰則").select("place", "kind", "label")


@plans.add(expected("text", [("某法\n\n第 一 章 總則\n\n第 1 條　甲\n解釋：說明\n\n第 2 條　乙\n\n第 二 章 罰則\n\n第 3 條　丙",)]))
def literal_law_text(spark, d):
    text = "第一章 總則\n第 1 條　甲\n解釋：說明\n第 2 條　乙\n第二章 罰則\n第 3 條　丙"
    found = laws.articles(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    return writers.law_text(found, spark.createDataFrame([(1, "某法")], "doc_id bigint, title string")).select("text")


@plans.add(expected("query_id item_id signals", [(1, 10, "article_mention|penalty=3,600元→art45"), (1, 11, "deprecated_term=電動自行車")], query_id="BIGINT", item_id="BIGINT"))
def literal_rule_signals(spark, d):
    q = spark.createDataFrame([(1, 110, "依處罰條例第 45 條處 3,600元，電動自行車")], "query_id bigint, year int, text string")
    a = spark.createDataFrame([(10, 111, "道路交通管理處罰條例", "45", "甲"), (11, 112, "安全規則", "7", "微型電動二輪車"), (12, 109, "處罰條例", "45", "乙"), (13, 113, "安全規則", "8", "丙")], "item_id bigint, year int, law string, article_no string, text string")
    return audit.rule_signals(q, a).select("query_id", "item_id", shown(F.col("signals")).alias("signals"))


@plans.add(expected("query_id items", [(1, "11 article_mention embed=0.900|10 embed=0.500|12 article_mention")], query_id="BIGINT"))
def literal_candidates(spark, d):
    similar = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.9)], "query_id bigint, item_id bigint, similarity double")
    signalled = spark.createDataFrame([(1, 11, ["article_mention"]), (1, 12, ["article_mention"])], "query_id bigint, item_id bigint, signals array<string>")
    c = audit.candidates(similar, signalled).withColumn("score", F.col("similarity")).withColumn("strong", F.exists("signals", lambda s: s == "article_mention"))
    return audit.matches(c).select("query_id", shown(F.transform("matches", lambda m: F.concat_ws(" ", m["item_id"].cast("string"), F.array_join(m["signals"], " ")))).alias("items"))


def _audited(spark):
    amendments = [("某條例", "7", "112/01/02", ["embed=0.500"], "甲" * 500, "乙" * 400), ("某規則", "8", "113/01/02", ["deprecated_term=x"], "丙", "")]
    rows = [(1, "某題", ["子", "丑"], "[0, 1]", amendments)]
    return spark.createDataFrame(rows, "query_id bigint, question string, options array<string>, answer string, amendments array<struct<law:string,article_no:string,latest:string,signals:array<string>,text:string,reason:string>>")


@plans.add(expected("options correct amendments", [(
    "  (A) 子\n  (B) 丑", "(A), (B)", "\n  [某條例] 第 7 條（修正日期：112/01/02）\n  信號：embed=0.500\n  條文：" + "甲" * 400 + "\n  理由：" + "乙" * 200 + "\n\n  [某規則] 第 8 條（修正日期：113/01/02）\n  信號：deprecated_term=x\n  條文：丙\n",
)]))
def literal_review_items(spark, d):
    return reviews.items(_audited(spark)).select("options", "correct", "amendments")


@plans.add(expected("prompt", [("某題\n  (A) 子\n  (B) 丑\n\n  [某規則] 第 8 條（修正日期：113/01/02）\n  信號：deprecated_term=x\n  條文：丙\n\n  [某條例] 第 7 條（修正日期：112/01/02）\n  信號：embed=0.500\n  條文：" + "甲" * 300 + "\n  理由：" + "乙" * 150 + "\n",)]))
def literal_prompts(spark, d):
    return reviews.prompts(_audited(spark)).select("prompt")


@plans.add(expected("reasons", [("300|0",)]))
def literal_audit_entries(spark, d):
    return reviews.entries(_audited(spark)).select(shown(F.transform("amendments", lambda a: F.length(a["reason"]))).alias("reasons"))


@plans.add(expected("i route affected confidence reason article", [(1, "final", True, 5, "r1", "a1"), (2, "second", True, 40, "r1", "a1"), (3, "second", False, 30, "r1", "a1")], i="INTEGER", confidence="INTEGER"))
def literal_decisions(spark, d):
    rows = [(1, True, None, 5, None, 0.0, False, "r1", None, "a1", None), (2, False, True, 10, 40, 0.6, False, "r1", None, "a1", None), (3, False, False, 30, 10, 0.0, False, "r1", "r2", "a1", "a2")]
    df = spark.createDataFrame(rows, "i int, p1 boolean, p2 boolean, c1 int, c2 int, similarity double, strong boolean, reason1 string, reason2 string, article1 string, article2 string")
    return reviews.agreed(df).select("i", "route", "affected", "confidence", "reason", "article")


@plans.add(expected("bank_name id entry", [("乙庫", 2, "[乙庫] #2 affected 40\n題\n  (A) 子\n* (B) 丑\n因")], id="INTEGER"))
def literal_audit_log(spark, d):
    df = spark.createDataFrame([("乙庫", "2", True, 40, "題", ["子", "丑"], "1", "因")], "bank_name string, id string, affected boolean, confidence int, question string, options array<string>, answer string, reason string")
    return reviews.ordered(reviews.log(df))


@plans.add(expected("id attempt", [(1, "b"), (2, "d")], id="INTEGER"))
def literal_best_attempts(spark, d):
    df = spark.createDataFrame([(1, 1, 5, "a"), (1, 2, 9, "b"), (1, 3, 9, "c"), (2, 1, None, "d")], "id int, no int, confidence int, attempt string")
    return reviews.best(df, ["id"], "confidence", "no").select("id", "attempt")


@plans.add(expected("bank qid answer warning repeats", [("b", "1", "2", "w", None), ("b", "2", None, None, "x|y"), ("b", "3", "0", None, "z")]))
def literal_patches(spark, d):
    results = spark.createDataFrame([("b", "1", "2", "w"), ("b", "3", "0", None)], "bank string, qid string, answer string, warning string")
    repeats = spark.createDataFrame([("b", "2", ["x", "y"]), ("b", "3", ["z"])], "bank string, qid string, repeats array<string>")
    return reviews.patches(results, repeats).select("bank", "qid", "answer", "warning", shown(F.col("repeats")).alias("repeats"))


@plans.add(expected("bank qid answer warning", [("b", "1", "2", "old"), ("b", "2", "0", None), ("c", "1", None, "w")]))
def literal_merged_patches(spark, d):
    s = "bank string, qid string, answer string, warning string"
    merged = reviews.merged_maps(spark.createDataFrame([("b", "1", "1", "old"), ("c", "1", None, "w")], s), spark.createDataFrame([("b", "1", "2", None), ("b", "2", "0", None)], s), ["answer", "warning"])
    maps = reviews.as_maps(merged, ["answer", "warning"])  # and back again
    return maps.select("bank", F.explode("questions").alias("qid", "p")).select("bank", "qid", "p.answer", "p.warning")


@plans.add(expected("files ok review questions", [(3, 2, 1, 35)], files="BIGINT", ok="BIGINT", review="BIGINT", questions="BIGINT"))
def literal_review_summary(spark, d):
    return reviews.summary(spark.createDataFrame([("ok", 15), ("review", 5), ("ok", 15)], "status string, n int"))


@plans.add(expected("bank", [("b",)]))
def literal_still_there(spark, d):
    make = lambda *names: spark.createDataFrame([(n,) for n in names], "bank string")
    return reviews.still_there(make("a", "b", "b"), make("b", "c"))


@plans.add(expected("id tag", [(1, "new"), (3, "c"), (4, "last")], id="INTEGER"))
def literal_upsert(spark, d):
    old = spark.createDataFrame([(1, "old"), (2, "b"), (3, "c")], "id int, tag string")
    new = spark.createDataFrame([(1, "new", 1), (2, "", 1), (4, "zero", 1), (4, "last", 2)], "id int, tag string, _order int")
    return writers.upserted(old, new, ["id"], ["tag"], F.col("tag") == "")


@plans.add(expected("law article_no note", [("a", "1", "新"), ("a", "3", "三")]))
def literal_notes(spark, d):
    s = "law string, article_no string, note string"
    return writers.noted(spark.createDataFrame([("a", "1", "舊"), ("a", "2", "二"), ("a", "3", "三")], s), spark.createDataFrame([("a", "1", "新"), ("a", "2", " ")], s))


@plans.add(expected("key value", [("quiz_x", "new"), ("theme", "dark"), ("other", "kept")]))
def literal_restore(spark, d):
    s = "key string, value string"
    return writers.restored(spark.createDataFrame([("quiz_x", "old"), ("other", "kept")], s), spark.createDataFrame([("quiz_x", "new"), ("theme", "dark"), ("secret", "no")], s), ("theme",), ("quiz_",))


@plans.add(expected("session_id", [(1,), (None,)], session_id="INTEGER"))
def literal_without(spark, d):
    return writers.without(spark.createDataFrame([(1,), (2,), (None,)], "session_id int"), "session_id", [2])


@plans.add(expected("bank text", [("b", "一\nA. x\nB. y\nAnswer: A\n" + "-" * 50 + "\n二\nA. z\nAnswer: ")]))
def literal_export(spark, d):
    q = spark.createDataFrame([("b", 2, 9, "二", ["z"], None), ("b", 1, 8, "一", ["x", "y"], "0")], "bank string, id int, row_id bigint, question string, options array<string>, answer string")
    return writers.exported(q, "bank")


@plans.add(expected("text", [("表\n| a | b |\n| --- | --- |\n| 1 | 2 |\n註",)]))
def literal_tables(spark, d):
    m = spark.createDataFrame([("表", ["a", "b"], [["1", "2"]], "註")], "title string, headers array<string>, rows array<array<string>>, notes string")
    return m.select(R.table_text(F.col("title"), F.col("headers"), F.col("rows"), F.col("notes")).alias("text"))


@plans.add(expected("id titles", [(1, "閱讀|舊"), (2, "閱讀"), (3, "")], id="INTEGER"))
def literal_passages(spark, d):
    m = "array<struct<type:string,title:string,content:string,notes:string>>"
    q = spark.createDataFrame([(1, [("text", "舊", "x", None)]), (2, [("text", "閱讀", "文", None)]), (3, [])], f"id int, materials {m}")
    p = spark.createDataFrame([(1, 2, "文"), (5, 4, "無")], "first int, last int, content string")
    met = q.join(ranges.attach_by_range(q.select("id"), "id", p, "first", "last").select("id", "content"), "id", "left")
    new = F.when(F.col("content").isNotNull(), F.struct(F.lit("text").alias("type"), F.lit("閱讀").alias("title"), F.col("content").alias("content"), F.lit(None).cast("string").alias("notes")))
    return met.select("id", shown(F.transform(imports.with_material(F.col("materials"), new, first=True), lambda x: x["title"])).alias("titles"))


@plans.add(expected("id type", [(1, "text"), (2, "table")], id="INTEGER"))
def literal_merged_materials(spark, d):
    m = "array<struct<type:string,title:string,content:string,notes:string>>"
    q = spark.createDataFrame([(1, [("text", "a", "b", None)]), (2, None)], f"id int, materials {m}")
    r = spark.createDataFrame([(2, True, [("table", "t", "c", None)]), (1, True, []), (1, False, [("x", "y", "z", None)])], f"id int, found boolean, materials {m}")
    return imports.merged_materials(q, r, "id").select("id", F.get("materials", F.lit(0))["type"].alias("type"))


@plans.add(expected("g x0 y0 x1 y1 largest", [("a", 0.0, 0.0, 9.0, 5.0, 2)], largest="INTEGER"))
def literal_boxes(spark, d):
    return ranges.union_boxes(spark.createDataFrame([("a", 1, 0.0, 0.0, 2.0, 2.0), ("a", 2, 3.0, 1.0, 9.0, 5.0)], "g string, id int, x0 double, y0 double, x1 double, y1 double"), "g")


@plans.add(expected("doc_id row_id page", [(1, 1, 2), (1, 1, 3), (1, 2, 1), (1, 2, 2), (1, 2, 3)], doc_id="INTEGER", row_id="INTEGER", page="INTEGER"))
def literal_pages(spark, d):
    q = spark.createDataFrame([(1, 1, "甲 乙丙"), (1, 2, "無此")], "doc_id int, row_id int, question string")
    return imports.candidate_pages(q, spark.createDataFrame([(1, 1, "x"), (1, 2, "有甲乙 丙"), (1, 3, "y")], "doc_id int, page int, text string"))


@plans.add(expected("no line", [(0, "前"), (1, "（2）1. 甲（未完）乙 續"), (2, "2. 丙")], no="INTEGER"))
def literal_merged_lines(spark, d):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["前", "（2）", "1. 甲（未", "完）乙", "續", "2. 丙"])], "doc_id int, no int, line string")
    return imports.merged_lines(rows, "doc_id").select("no", "line")


@plans.add(expected("row_no text", [(0, "a b d"), (1, "c")], row_no="INTEGER"))
def literal_rows_by_height(spark, d):
    items = spark.createDataFrame([(1, "b", 5.0, 11.0), (1, "a", 1.0, 10.0), (1, "c", 1.0, 20.0), (1, "d", 9.0, 14.0)], "page int, text string, x double, y double")
    return segment.rows_by_height(items, ["page"]).select("row_no", "text")


@plans.add(expected("kept", [("0-5|5-6",)]))
def literal_overlaps(spark, d):
    m = spark.createDataFrame([([(4, 9), (0, 3), (0, 5), (5, 6)],)], "m array<struct<start:int,end:int>>")
    return m.select(shown(F.transform(segment.without_overlaps(F.col("m")), lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))).alias("kept"))


@plans.add(expected("e s k l", [("0.0;0.0;10.0;11.5", "ab;cd", 2, "2|3")], k="INTEGER"))
def literal_layout(spark, d):
    return spark.range(1).select(
        _struct(imports.expanded(F.lit(1.0), F.lit(2.0), F.lit(9.0), F.lit(9.5), 2.0, F.lit(10.0), F.lit(20.0)), "x0", "y0", "x1", "y1").alias("e"),
        _struct(imports.split_at(F.lit("abcd"), F.lit(0.0), F.lit(8.0), F.lit(4.0)), "left", "right").alias("s"),
        imports.ranked(F.lit("x"), ["y", "x"]).alias("k"), shown(imports.largest(F.array(F.lit(1)), F.array(F.lit(2), F.lit(3)))).alias("l"),
    )


@plans.add(expected("id answer found free", [(1, "2", True, False), (2, "0", True, True), (3, "0", False, False)], id="INTEGER"))
def literal_answer_keys(spark, d):
    q = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "id int, answer string")
    k = spark.createDataFrame([(1, 1, "3"), (1, 2, "2"), (2, 1, None)], "id int, order int, answer string")
    return imports.keyed_answers(q, k, ["id"], last_wins=True).select("id", "answer", "found", "free")


@plans.add(expected("id blocks", [(1, "steps"), (2, None)], id="INTEGER"))
def literal_layout_blocks(spark, d):
    df = spark.createDataFrame([(1, '```json\n{"blocks":[{"type":"paragraph","text":" "},{"type":"steps","items":["a"]}]}\n```'), (2, "oops")], "id int, t string")
    return df.select("id", shown(F.transform(P.layout_blocks(F.col("t")), lambda b: b["type"])).alias("blocks"))


@plans.add(expected("k place a b", [(1, 3, "def", "xef"), (3, 2, "", "c")], k="INTEGER", place="INTEGER"))
def literal_first_differences(spark, d):
    df = spark.createDataFrame([(1, "abcdef", "abcxef"), (2, "ab", "ab"), (3, "ab", "abc")], "k int, a string, b string")
    return quality.first_difference(df, "k", "a", "b").select("k", "place", F.col("left").alias("a"), F.col("right").alias("b"))


@plans.add(expected("bank status n_issues", [("a", "ok", 0), ("b", "review", 1), ("c", "review", 0)], n_issues="BIGINT"))
def literal_report_status(spark, d):
    issues = spark.createDataFrame([("a", "question"), ("b", "answer")], "bank string, issue string")
    qa = spark.createDataFrame([("a", "ok"), ("b", "ok"), ("c", "review")], "bank string, status string")
    return quality.report_status(issues, qa, "bank")


@plans.add(expected("signals strong", [("dep=1|dep=2|embed|rerank", True), ("embed", False)]))
def literal_strong_first(spark, d):
    df = spark.createDataFrame([(["embed", "dep=1", "rerank", "dep=2"],), (["embed"],)], "s array<string>")
    return df.select(shown(audit.strong_first(F.col("s"), "dep")).alias("signals"), F.exists("s", lambda x: x.startswith("dep")).alias("strong"))


@plans.add(expected("same other", [(True, False)]))
def literal_content_keys(spark, d):
    key = lambda *v: P.content_key(*[F.lit(x) for x in v])
    return spark.range(1).select((key("a", "b") == key("a", "b")).alias("same"), (key("a", "b") == key("ab", "")).alias("other"))


@plans.add(expected("id", [(1,), (4,)], id="INTEGER"))
def literal_not_excluded(spark, d):
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    return papers.without_excluded(q, spark.createDataFrame([(2,)], "id int"), ["id"], spark.createDataFrame([(3, None), (4, 1)], "id int, answer int"))
