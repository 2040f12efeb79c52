import numpy as np
import pytest
from pyspark.sql import functions as F

from examforge.functions import text as T
from examforge.operators import audit, catalog, laws, papers, quality, ranges, segment
from examforge.plans import registry


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize("numeral, n", [("十", 10), ("十二", 12), ("二十", 20), ("一百零五", 105), ("一百", 100), ("九百九十九", 999), ("7", 7), ("三", 3), ("", None), ("甲", None), (None, None), ("〇", None), ("兩百", 200), ("十百", 110)])
def test_chinese_numbers(spark, numeral, n):
    got = one(spark, T.chinese_number, numeral)
    assert got == n or (numeral == "〇" and got == 0)


@pytest.mark.parametrize("f, before, after", [
    (T.gaps_joined, "臺 灣 水 利", "臺灣 水 利"), (T.gaps_joined, "下列 何者 正確 的 是", "下列何者 正確的 是"), (T.gaps_joined, "甲 乙", "甲 乙"), (T.gaps_removed, "甲 ， 乙 ab 丙", "甲，乙 ab 丙"),
    (T.spaced, "共12組ab型（甲）％", "共 12 組 ab 型(甲)%"), (T.spaced, "何者？！  甲", "何者？！ 甲"), (T.stem, "甲、乙？ A_b ①½é", "甲乙a_b①½é"), (T.marks_mapped, "Å甲Ç乙", "①甲②乙"),
    (T.fences_stripped, "<think>x</think>\n```json\n{}\n```", "{}"), (T.powers_joined, "3 x 10 元，6 與 5×10 元", "3×10^6 元， 與 5×10 元"), (T.compare_key, "Ａ１ ，㎡(cid:12)。b(cid:711)", "A1,m2bˇ"),
    (T.layout_normalized, "甲\uf0e0 乙 ,丙 .", "甲→ 乙,丙."), (T.explanation_cleaned, "```json\n{\"explanation\": \" 白話 \"}\n```", "白話"), (T.explanation_cleaned, "想\n改寫後：解釋：甲\n乙", "甲 乙"),
])
def test_normalization(spark, f, before, after):
    assert one(spark, f, before) == after
    assert one(spark, f, None) is None


def test_years(spark):
    assert one(spark, T.roc_year, "99/12/31") == 2010 and one(spark, T.roc_year, "110/01/01") == 2021 and one(spark, T.roc_year, "x") is None
    assert one(spark, audit.bank_year, "水利") == 110 and one(spark, audit.bank_year, "112水利") == 112


@pytest.mark.parametrize("options, want", [
    (["1 個月", "3 個月", "6 個月", "1 年以上者，同時吊扣其牌照，至檢驗合格後發還"], 3), (["2 公尺", "10 公尺以上者應於夜間亮燈警示之", "3 公尺"], 1),
    (["1 個月", "3 個月", "6 個月", "1 年"], None), (["10 公分，小型車不得超過 15 公分", "15 公分，小型車不得超過 10 公分", "均不得超過 10 公分"], None),
    (["1 年", "2 年", "3 年", "患有某種疾病者不得申請駕駛執照考驗"], None), (["1 年", "2 年", "3 英吋，因為水位在夜間應該上升"], None), (["1 年", "2 年，同時吊扣其牌照"], None), (["1 年", None, "2 年", "1 年以上者，同時吊扣其牌照，至檢驗"], None), (None, None), ([], None),
])
def test_leaks(spark, options, want):
    df = spark.createDataFrame([(options,)], "o array<string>")
    assert df.select(quality.leak(F.col("o")).alias("r")).first().r == (None if want is None else options[want])


def test_completeness_and_missing_ids(spark, rows):
    four = ["a", "b", "c", "d"]
    q = spark.createDataFrame([(i, "b", k, "q", four, "0", None) for i, k in enumerate((1, 2, 2, 4))] + [(9, "c", 1, "", None, "[5]", None), (10, "d", 1, "q", four, None, True), (11, "d", 2, "q 請接續", four, "[0, 3]", None)], "row_id bigint, bank string, id int, question string, options array<string>, answer string, freescore boolean")
    assert rows(quality.issues(q)) == [("b", "missing", 3), ("b", "repeated", 2), ("c", "bad_options", 1), ("c", "empty", 1), ("c", "odd_answers", 1), ("d", "suspicious", 2)]
    r = {x.bank: x for x in quality.completeness(q).collect()}
    assert (r["b"].missing, r["b"].repeated, r["b"].status, r["d"].suspicious) == (1, 1, "review", 1)
    assert quality.completeness(q.where("row_id = 10")).first().status == "ok" and quality.completeness(q.where("row_id = 10"), expected=2).first().status == "review"
    assert rows(quality.issues(q.where("row_id = 3"), expected=3).where("issue in ('missing', 'extra')")) == [("b", "extra", 4), ("b", "missing", 1), ("b", "missing", 2), ("b", "missing", 3)]
    assert rows(quality.missing_ids(q, step=2)) == [("b", 3)]


def test_reconcile(spark, rows):
    mk = lambda r: spark.createDataFrame(r, "id int, question string, answer string")
    got = quality.reconcile(mk([(1, "a", "0"), (2, "b", None)]), mk([(2, "x", None), (3, "c", "1")]), ["id"], ["question", "answer"])
    assert rows(got) == [(1, "extra"), (2, "question"), (3, "missing")]


def test_first_difference(spark, rows):
    df = spark.createDataFrame([(1, "abcdef", "abcxef"), (2, "ab", "ab"), (3, "ab", "abc"), (4, None, "a")], "k int, a string, b string")
    assert rows(quality.first_difference(df, "k", "a", "b").where("k < 4")) == [(1, 3, "def", "xef"), (3, 2, "", "c")]


def test_law_articles_headings_are_anchored(spark):
    text = "某法\n第一條　甲。\n第 12 條之 1　乙。\n依第 3 條辦理。\n解釋：丙。\n續行\n- 4 -\n第三條之規定照辦"
    got = laws.previous(laws.articles(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string"))).orderBy("seq").collect()
    assert [(r.article_no, r.text, r.explanation, r.previous_no) for r in got[:2]] == [("1", "甲。", "", None), ("12-1", "乙。\n依第 3 條辦理。", "丙。\n續行", "1")]


def test_question_records(spark):
    text = "前言\n1. 下列何者\n正確？\n(A) 甲\n續\n(B) 乙\n2、次題\n（A）丙"
    got = segment.question_records(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("q_no").collect()
    assert [(r.number, r.stem, r.options) for r in got] == [(1, "下列何者 正確？", ["甲 續", "乙"]), (2, "次題", ["丙"])]


def test_folds(spark):
    df = spark.createDataFrame([([2, 1, 3, 2, 5, 3, 4],)], "n array<int>")
    assert df.select(segment.accepted(F.col("n")).alias("r")).first().r == [1, 2, 3, 4]
    m = spark.createDataFrame([([(4, 9), (0, 3), (0, 5), (5, 6), (9, 10)],)], "m array<struct<start:int,end:int>>")
    assert [tuple(x) for x in m.select(segment.without_overlaps(F.col("m")).alias("r")).first().r] == [(0, 5), (5, 6), (9, 10)]
    s = spark.createDataFrame([(["a" * 50, "b" * 50, "c；", "d"],)], "s array<string>")
    assert [len(x) for x in s.select(segment.buffered(F.col("s")).alias("r")).first().r] == [100, 2, 1]
    s = spark.createDataFrame([("甲。乙。丙。 " + "丁" * 95 + "。戊；己",)], "s string")
    assert s.select(segment.buffered(segment.sentences(F.col("s"))).alias("r")).first().r == ["甲。乙。", "丙。" + "丁" * 95 + "。", "戊；", "己"]


def test_rows_by_height(spark):
    items = spark.createDataFrame([(1, "b", 5.0, 11.0), (1, "a", 1.0, 10.0), (1, "c", 1.0, 20.0), (1, "d", 9.0, 14.0)], "page int, text string, x double, y double")
    assert [r.text for r in segment.rows_by_height(items, ["page"]).orderBy("row_no").collect()] == ["a b d", "c"]


def test_vector_top_k_against_numpy(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = v.astype(np.float32)
    year = r.integers(0, 5, 60)
    rows = [(int(i), int(year[i]), [float(x) for x in v[i]]) for i in range(60)]
    df = spark.createDataFrame(rows + [(99, 9, None)], "i bigint, year int, vector array<float>").repartition(3)
    got = audit.newer_top_k(df.where("i % 7 = 0").withColumnRenamed("i", "query_id"), df.withColumnRenamed("i", "item_id"), 5, block=4).collect()
    for q in range(0, 60, 7):
        s = (v.astype(float) @ v[q].astype(float)).round(9)
        best = sorted((i for i in range(60) if year[i] > year[q]), key=lambda i: (-s[i], i))[:5]
        assert [g.item_id for g in sorted((g for g in got if g.query_id == q), key=lambda g: g.place)] == best


def test_rectangles_against_brute_force(spark, rows):
    r = np.random.default_rng(2)
    make = lambda n: [(i, *map(float, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(zip(r.integers(-20, 20, n), r.integers(-20, 20, n), r.integers(0, 9, n), r.integers(1, 9, n)))]
    a, b = make(60), make(60)
    s = "id bigint, x0 double, y0 double, x1 double, y1 double"
    want = sorted((i, j) for i, x0, y0, x1, y1 in a for j, u0, v0, u1, v1 in b if x0 < x1 and u0 < u1 and x0 < u1 and u0 < x1 and y0 < v1 and v0 < y1)
    assert rows(ranges.intersecting(spark.createDataFrame(a, s), spark.createDataFrame(b, s), 5.0)) == want


def test_rate_windows_across_days(spark, rows):
    import datetime as dt

    from examforge.operators import history

    day = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, 7, day + dt.timedelta(hours=23, minutes=50), 1.0), (2, 7, day + dt.timedelta(hours=24, minutes=5), 2.0), (3, 7, day + dt.timedelta(hours=26), 4.0), (4, 8, day, 1.0), (5, 7, None, 1.0)], "id int, u int, at timestamp, v double")
    got = history.rate_windows(e, "u", "at", F.col("v"), 3600, 1, 100.0)
    assert rows(got.select("id", "n_requests", "sum_weight", "held")) == [(1, 1, 1.0, False), (2, 2, 3.0, True), (3, 1, 4.0, False), (4, 1, 1.0, False)]


def test_routing(spark):
    df = spark.createDataFrame([(1, True, None, 5, None, 0.0, False), (2, False, True, 10, 40, 0.6, False), (3, False, None, 5, None, 0.1, False), (4, False, False, 30, 10, 0.0, False)], "i int, p1 boolean, p2 boolean, c1 int, c2 int, similarity double, strong boolean")
    got = {r.i: (r.route, r.affected, r.confidence, r.disagreed, r.batch) for r in audit.routed(df).collect()}
    assert got == {1: ("final", True, 5, False, "A"), 2: ("second", True, 40, True, "A"), 3: ("done", False, 5, False, "B"), 4: ("second", False, 30, False, "A")}


def test_catalogue(spark):
    df = spark.createDataFrame([(f"questions/{n}.json",) for n in ("110統測專二-農業概要", "交通部115-2-汽車構造", "交通部110-道路交通法規", "113農田水利署-法學緒論", "112 甲 - 乙_丙(2)", "questions")], "file string")
    got = df.select(*[c.alias(n) for n, c in catalog.bank_parts(F.col("file")).items()], catalog.bank_name(F.col("file")).alias("name")).collect()
    assert [(r.year, r.source, r.category, r.subject, r.original) for r in got] == [
        ("110", "統測專二", "商業與管理群", "農業概論", "農業概要"), ("115", "交通部", "第2梯次", "汽車構造", "汽車構造"), ("110", "交通部", "年度檢定", "道路交通法規", "道路交通法規"),
        ("113", "農田水利署", "共同科目", "公文與法學緒論", "法學緒論"), ("112", "農田水利", "甲", "乙 丙", "乙 丙"), ("", "農田水利", "", "questions", "questions"),
    ]
    assert [r.shown for r in got][:3] == ["110 農業概論", "115 汽車構造（第2梯次）", "110 道路交通法規（年度檢定）"] and [r.name for r in got][3:] == ["113 法學緒論（農田水利署）", "112 乙 丙（甲）", "questions"]


def test_references_in_context(spark, rows):
    laws_ = spark.createDataFrame([(1, "水利法"), (2, "農田水利法"), (3, "農田水利法施行細則"), (4, None)], "doc_id bigint, title string")
    texts = [
        (1, "第 1 條　甲。\n第 2 條　前條及第 1 條之規定，依農田水利法第 3 條、第 2 條。\n第 3 條　乙。"),
        (2, "第 1 條　依水利法辦理；第 2 條亦同。\n第 2 條　丙。\n第 3 條　丁。"),
        (3, "第一章 總則\n第 1 條　本法第 3 條所稱，指第九條。\n第 2 條　包括水利法。其第 3 條另定，本條第 2 條不計。"),
    ]
    found = laws.articles(spark.createDataFrame([*texts, (4, None)], "doc_id bigint, text string"))
    got = rows(laws.links(found, laws_).select("source", "seq", "text", "target", "target_no", "method"))
    assert got == sorted([
        (1, 2, "前條", 1, "1", "previous-article"), (1, 2, "第 1 條", 1, "1", "same-law"), (1, 2, "第 3 條", 2, "3", "sentence-law-context"), (1, 2, "第 2 條", 2, "2", "sentence-law-context"),
        (2, 1, "第 2 條", 2, "2", "same-law"), (3, 1, "第 3 條", 2, "3", "this-law"), (3, 2, "第 3 條", 1, "3", "nearby-law-context"), (3, 2, "第 2 條", 1, "2", "nearby-law-context"),
    ])
    assert {r.chapter for r in found.collect()} == {"未分章", "第 一 章 總則"}
    assert rows(laws.sizes(found)) == [(1, 1, 3), (2, 1, 3), (3, 1, 2)]


def test_papers(spark, rows):
    text = "汽車構造筆試試題\n一、是非題\n（○）1. 甲\n第 2 頁\n（X）2. 乙\n二、選擇題\n（2）1. 丙(1)子(2)丑(3)寅(4)卯（1.5）公升\n續（3或4）2. 丁\n三、問答題\n（1）1. 戊\n國文筆試試題\n（1）1. 己"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string").withColumn("text", papers.paper(F.col("text"), "汽車構造"))
    got = papers.blocks(papers.sections(df))
    assert rows(got.select("number", "answer")) == [(1, [0]), (2, [1]), (3, [1]), (4, None)]
    bank = spark.createDataFrame([(1, 1, "甲", ["O", "X"], [0]), (1, 2, "乙", ["O", "X"], [0]), (1, 3, "丙______（1.5）公升續", ["子", "丑", "寅", "卯"], [1]), (1, 4, "丁丁", [], [0]), (1, 5, "無", [], [0])], "doc_id bigint, id int, question string, options array<string>, answers array<int>")
    assert rows(papers.compared(bank, got)) == [(1, None, "count"), (1, 2, "answer"), (1, 4, "text"), (1, 5, "missing")]


def test_general_text_queries_read_every_source(spark, tmp_path):
    text = "1. 甲何者？\n(A) 子\n(B) 丑\n解析：因為（A）不合。\n2. 乙？\n(A) 寅\n(B) 卯"
    sources = ["exam_archive", "bank_explanations", "forum_posts", "glossary"]
    docs = [(i, s, text) for i, s in enumerate(sources)] + [(9, "forum_posts", None)]
    spark.createDataFrame(docs, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.accepted) for r in run("accepted_numbers")} == {(i, "1,2") for i in range(4)}
    want = {(1, "甲何者？", "子\x1f丑"), (2, "乙？", "寅\x1f卯")}
    got = {(r.doc_id, r.group_no, r.stem.split(". ")[-1].strip(), r.options) for r in run("lettered_records")}
    assert got == {(i, *w) for i in range(4) for w in want}
    for name in ("merged_exam_lines", "paragraph_buffers"):
        assert {r.doc_id for r in run(name)} == set(range(4)), name


def test_first_difference_of_long_texts(spark, rows):
    same = "ab" * 40_000
    df = spark.createDataFrame([(1, same + "c", same + "d"), (2, same, same + "x")], "k int, a string, b string")
    assert rows(quality.first_difference(df, "k", "a", "b")) == [(1, 80_000, "c", "d"), (2, 80_000, "", "x")]
