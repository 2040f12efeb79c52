import pytest
from pyspark.sql import functions as F

from examforge.functions import parsing as P
from examforge.operators import imports


@pytest.fixture
def one(spark):
    def run(column, value, kind="string"):
        return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r

    return run


@pytest.mark.parametrize("f, text, want", [
    (P.tf_answer, "（○）", 0), (P.tf_answer, "( X )", 1), (P.tf_answer, "（3）", None), (P.tf_answer, None, None),
    (P.digit_answers, "（3.1 3）", [0, 2]), (P.digit_answers, "（２）", [1]), (P.digit_answers, "（9）", None), (P.digit_answers, "x", None),
    (P.field_clean, "甲 乙( a )【請接續背面】: ", "甲乙(a)"), (P.indexes_joined, "當 I 0 與 X 1 年，Q d 及 MU A。", "當 I₀ 與 X1 年，Qd 及 MU_A。"),
    (P.deleted, "（刪　除）", True), (P.deleted, "第三條", False), (P.needs_image, "如下圖所示", True), (P.needs_table, "依下表", True), (P.needs_image, None, False), (P.needs_image, "如 圖", True), (P.needs_image, "圖（三）", True), (P.needs_image, "圖 3", False), (P.deleted, "（删除）", True),
    (P.layout_blocks, '```json\n{"blocks":[{"type":"paragraph","text":" "},{"type":"steps","items":["a"]}]}\n```', [("steps", None, ["a"])]), (P.layout_blocks, "oops", None),
])
def test_columns(one, f, text, want):
    got = one(f, text)
    assert ([tuple(x) for x in got] if f is P.layout_blocks and got else got) == want


def test_options_follow_their_sequence(one):
    got = one(P.numbered_options, "下列 (1) 甲 (３) 乙。（2）丙； (3) 丁")
    assert (got.stem, got.options) == ("下列", ["甲 (３) 乙", "丙", "丁"])
    assert one(P.lettered_options, "無選項").options == [] and one(P.lettered_options, None) is None
    assert one(P.circled_options, "題 ①一②二").options == ["一", "二"]
    assert tuple(one(P.passage_range, "▲閱讀下文，回答第 11 - 15 題 水 庫\n很大。\n11. 問")) == (11, 15, "水 庫\n很大。") and one(P.passage_range, "第 11-15 題為題組") is None
    assert tuple(one(P.bracketed_answer, "3")) == (2, False) and tuple(one(P.bracketed_answer, "送分")) == (0, True)


@pytest.mark.parametrize("options, named, locked", [
    (["以上皆是", "丙"], True, True), (["皆非"], True, True), (["選項一"], True, True), (["選項(B)與(C)"], True, True), (list("ABCD"), False, True), (["1", "2", "3", " 4"], False, True),
    (["甲、B", "C"], False, True), (["甲乙", "丙"], False, False), (["AB", "CD"], False, False), (["ABC", "BD"], False, False), (["檢查", "更換"], False, False), (None, False, False),
])
def test_locks(one, options, named, locked):
    assert one(lambda c: P.locked(c, letters=False), options, "array<string>") is named and one(P.locked, options, "array<string>") is locked


def test_units_and_many_options(one):
    assert one(P.units_rebalanced, ["1 m3", "2 m3", "3 m3", "4 m3 /ha /ha /ha /ha"], "array<string>") == ["1 m3/ha", "2 m3/ha", "3 m3/ha", "4 m3/ha"]
    assert one(P.units_rebalanced, ["1", "2 /ha"], "array<string>") == ["1", "2 /ha"]


def test_terms_an_explanation_must_keep(spark):
    df = spark.createDataFrame([("處新臺幣一萬元以上五萬元以下罰鍰，科或併科罰金", "要罰錢，裁罰金額另定"), ("無", "無")], "s string, e string")
    got = df.select(P.missing_terms(F.col("s"), F.col("e")).alias("r")).collect()
    assert got[0].r == ["科或併科", "罰金", "罰鍰", "新臺幣一萬元以上五萬元以下"] and got[1].r == []


def test_answer_keys(spark, rows):
    q = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "id int, answer string")
    k = spark.createDataFrame([(1, 1, "2"), (1, 2, "3"), (2, 1, None)], "id int, order int, answer string")
    assert rows(imports.keyed_answers(q, k, ["id"]).select("id", "answer", "found", "free")) == [(1, "2", True, False), (2, "0", True, True), (3, "0", False, False)]
    assert imports.keyed_answers(q, k, ["id"], last_wins=True).where("id = 1").first().answer == "3"


def test_materials(spark):
    m = "array<struct<type:string,title:string,content:string,notes:string>>"
    q = spark.createDataFrame([(1, [("text", "a", "b", None)]), (2, None)], f"id int, materials {m}")
    r = spark.createDataFrame([(2, True, [("table", "t", "c", None)]), (1, True, []), (1, False, [("x", "y", "z", None)])], f"id int, found boolean, materials {m}")
    got = {x.id: x.materials[0].type for x in imports.merged_materials(q, r, "id").collect()}
    assert got == {1: "text", 2: "table"}
    new = F.struct(F.lit("text").alias("type"), F.lit("a").alias("title"), F.lit("b").alias("content"), F.lit(None).cast("string").alias("notes"))
    assert [len(x.r) for x in q.orderBy("id").select(imports.with_material(F.col("materials"), new).alias("r")).collect()] == [1, 1]


def test_pages(spark, rows):
    q = spark.createDataFrame([(1, 1, "甲 乙丙"), (1, 2, "無此")], "doc_id int, row_id int, question string")
    p = spark.createDataFrame([(1, 1, "x"), (1, 2, "有甲乙 丙"), (1, 3, "y")], "doc_id int, page int, text string")
    assert rows(imports.candidate_pages(q, p)) == [(1, 1, 2), (1, 1, 3), (1, 2, 1), (1, 2, 2), (1, 2, 3)]


def test_lines_and_stems(spark, rows):
    assert imports.merge_lines(["前", "（2）", "1. 甲（未", "完）乙", "續", "2. 丙"]) == ["前", "（2）1. 甲（未完）乙 續", "2. 丙"]
    assert imports.merge_lines([]) == [] and imports.merge_lines(["（○）"]) == ["（○）"]
    df = spark.createDataFrame([(1, 2, "續"), (1, 1, "1. 甲")], "doc_id int, no int, line string")
    assert rows(imports.merged_lines(df, "doc_id")) == [(1, 0, "1. 甲 續")]


@pytest.mark.parametrize("stem, options, new_stem, last", [
    ("申報應於", ["三日內", "五日內", "七日內", "十日內向主管機關提出"], "申報應於 ______ 向主管機關提出", "十日內"),
    ("", ["三日內", "五日內", "七日內", "十日內向主管機關提出"], "向主管機關提出", "十日內"),
    ("何者正確？", ["a", "b", "c", "a very long last option"], "何者正確？", "a very long last option"),
    ("應於", ["三日內", "五日內", "七日內", "十日內"], "應於", "十日內"),
    ("由", ["縣長", "市長", "部長", "總統 任命之官員辦理"], "由 ______ 任命之官員辦理", "總統"),
    ("期限", ["1年", "2年", "3年", "4年為限"], "期限 ______ 為限", "4年"),
    ("期限", ["1 年", "2 年", "3 年", "6 個月為限"], "期限 ______ 為限", "6 個月"),
    ("相距", ["10公尺", "20公尺", "30公尺", "40公尺以上"], "相距 ______ 以上", "40公尺"),
    ("罰 ______ 元", ["1", "2", "3", "4萬元"], "罰 ______ 元 萬元", "4"), ("罰", ["1", "2", "3", "4 萬元"], "罰 ______ 萬元", "4"),
    ("期限", ["1年", "2年", "3年", "4年內"], "期限", "4年內"),
    ("a", ["x", "y", "z"], "a", None),
])
def test_trailing_stems(spark, stem, options, new_stem, last):
    df = spark.createDataFrame([(stem, options)], "s string, o array<string>")
    got = df.select(P.trailing_stem(F.col("s"), F.col("o")).alias("r")).first().r
    assert got.stem == new_stem and got.options == (options if last is None else [*options[:3], last])


def test_trailing_stems_of_nulls(spark):
    df = spark.createDataFrame([(None, None), (None, ["a", "b", "c", None])], "s string, o array<string>")
    assert [(r.r.stem, r.r.options) for r in df.select(P.trailing_stem(F.col("s"), F.col("o")).alias("r")).collect()] == [(None, None), (None, ["a", "b", "c", None])]


def test_layout(spark):
    r = spark.range(1).select(imports.expanded(F.lit(1.0), F.lit(2.0), F.lit(9.0), F.lit(9.5), 2.0, F.lit(10.0), F.lit(20.0)).alias("e"), imports.split_at(F.lit("abcd"), F.lit(0.0), F.lit(8.0), F.lit(4.0)).alias("s"), imports.ranked(F.lit("x"), ["y", "x"]).alias("k"), imports.largest(F.array(F.lit(1)), F.array(F.lit(2), F.lit(3))).alias("l")).first()
    assert tuple(r.e) == (0.0, 0.0, 10.0, 11.5) and tuple(r.s) == ("ab", "cd") and r.k == 2 and r.l == [2, 3]
