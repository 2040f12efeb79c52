import itertools
import random

import pytest
from pyspark.sql import functions as F

from examforge.functions import grading
from examforge.operators import quiz
from examforge.plans import quizzes

Q = "row_id bigint, bank string, id int, question string, options array<string>, answer string, noshuffle boolean, freescore boolean, groupid string, materials array<struct<type:string,title:string,content:string,notes:string>>"


@pytest.fixture
def questions(spark):
    def make(rows):
        full = [(i, "b", i, "q", o, a, ns, fs, g, m) for i, o, a, ns, fs, g, m in rows]
        return spark.createDataFrame(full, Q)

    return make


def test_grading(spark):
    cases = [("2", "2", None, "ok"), ("1", "2", None, "wrong"), (None, "2", None, "skipped"), ("[2, 0]", "[0, 2]", None, "ok"), ("[0]", "[0, 2]", None, "wrong"), ("[]", "[0, 2]", None, "skipped"), ("3", "1", True, "ok"), (None, "1", True, "skipped"), ("1", None, None, "wrong")]
    df = spark.createDataFrame(cases, "u string, a string, f boolean, want string")
    assert df.where(grading.outcome(F.col("u"), F.col("a"), F.col("f")) != F.col("want")).count() == 0


def test_types(questions):
    q = questions([(1, ["a", "b"], "0", None, None, None, None), (2, list("abcd"), "0", None, None, None, None), (3, list("ab"), "[0, 1]", None, None, None, None), (4, None, "0", None, None, None, None), (5, ["a"], None, None, None, None, None)])
    assert [r.qtype for r in quiz.with_type(q).orderBy("row_id").collect()] == ["tf", "sc", "mc", None, None]


def test_patches_apply_when_defined_or_not_empty(questions, spark):
    q = questions([(1, ["a"], "0", None, True, None, None), (2, ["a"], "0", None, None, None, None)])
    o = spark.createDataFrame([("b", "1", None, "", "u", [], False), ("b", "2", "3", "w", None, ["x"], None)], "bank string, qid string, answer string, warning string, amendmenturl string, repeats array<string>, freescore boolean")
    a, b = quiz.patched(q, o).orderBy("row_id").collect()
    assert (a.freescore, a.warning, a.amendmenturl, a.repeats, a.answer) == (False, None, "u", None, "0")
    assert (b.freescore, b.warning, b.repeats, b.answer) == (None, "w", ["x"], "3")


def test_permutation_keeps_the_answer_and_locked_questions(questions):
    q = questions([(1, list("abcd"), "[0, 3]", None, None, None, None), (2, list("abcd"), "1", True, None, None, None), (3, list("ab"), "1", None, None, None, None), (4, None, "1", None, None, None, None), (5, list("wxyz"), None, None, None, None, None)])
    p = {r.row_id: r for r in quiz.permuted(q, "s").collect()}
    assert sorted(p[1].new_options) == list("abcd") and {p[1].new_options[i] for i in p[1].new_answers} == {"a", "d"}
    assert p[2].new_options == list("abcd") and p[3].new_options == list("ab") and p[4].new_options is None and p[5].new_answers is None


def test_blocks_by_group_and_reading_text(questions):
    m = [("image", "閱讀資料（第 2-4 題）", "no", None), ("text", "閱讀資料（第 2-4 題）", "passage", None)]
    other = [("text", "t", "passage", None)]  # a text without the title of a reading text groups nothing
    q = questions([(1, [], "0", None, None, "g", None), (2, [], "0", None, None, None, m), (3, [], "0", None, None, "g", m), (4, [], "0", None, None, None, m), (5, [], "0", None, None, "", other), (6, [], "0", None, None, None, other)])
    assert [(r.block, r.block_size) for r in quiz.blocks(q).orderBy("row_id").collect()] == [(1, 2), (2, 2), (1, 2), (2, 2), (5, 1), (6, 1)]


@pytest.mark.parametrize("sizes, wanted, taken", [
    ([2, 1, 3], 4, [1, 2]), ([3, 3], 4, [0]), ([], 4, []), ([5], 0, []), ([1, 1, 1, 3], 4, [0, 3]), ([2, 2, 1, 1, 4], 7, [0, 2, 4]), ([3, 1], 4, [0, 1]),
    ([2, 3, 4], 6, [0, 2]), ([0, 9, 2], 2, [2]), ([3, 2, 3, 2], 7, [0, 1, 3]),
])
def test_taking_blocks(sizes, wanted, taken):
    assert quiz.take_exactly(sizes, wanted) == taken


def test_exact_taking_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        sizes = [r.randint(1, 4) for _ in range(r.randint(1, 8))]
        n = r.randint(1, 12)
        taken = quiz.take_exactly(sizes, n)
        total = sum(sizes[i] for i in taken)
        assert total <= n and len(set(taken)) == len(taken) and taken == sorted(taken)
        possible = {sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k)}
        if total < n:  # then no block could complete the quiz with some of those kept before it
            assert n not in possible or all(sum(sizes[i] for i in taken if i < k) + sizes[k] != n for k in range(len(sizes)))


def test_requests_that_the_first_blocks_leave_open_are_read_on(spark, rows):
    sizes = [3] * 60 + [1] + [3] * 5
    b = spark.createDataFrame([(r, i, n) for r in (None, "x") for i, n in enumerate(sizes)] + [("y", 0, 4)], "r string, block int, size int")
    found = quiz.exact_selection(b, ["r"], ["block"], "size", 4, ahead=1)
    assert rows(found) == rows(spark.createDataFrame([(r, i, n) for r in (None, "x") for i, n in ((0, 3), (60, 1))] + [("y", 0, 4)], "r string, block int, size int"))


def test_overshooting_take(spark, rows):
    b = spark.createDataFrame([(0, 1, 1), (0, 2, 3), (0, 3, 1)], "r int, block int, size int")
    assert rows(quiz.take_blocks(b, ["r"], ["block"], "size", 2).select("block", "taken_before")) == [(1, 0), (2, 1)]


def test_weights_prefer_what_was_tried_less(spark):
    df = spark.range(20000).select("id", F.when(F.col("id") < 10000, 0).otherwise(3).alias("times"))
    first = df.orderBy(quiz.sampling_key("s", F.col("times"), F.col("id"))).limit(4000)
    assert first.where("times = 0").count() > 3400


@pytest.fixture
def asked(spark):
    """Questions 1 to 6 of two banks, and what user 1 and user 2 did with them."""
    q = spark.createDataFrame([(i, "questions/交通部.json" if i > 4 else "b", i, "q", list("abcd"), "0", None, None, None, None) for i in range(1, 7)], Q)
    log = [(1, 0, 1, "b", 1, True, True), (1, 1, 1, "b", 2, False, True), (1, 2, 1, "b", 3, False, False), (2, 0, 1, "b", 2, True, True), (2, 1, 1, "questions/交通部.json", 5, False, True), (3, 0, 2, "b", 4, False, True)]
    rows = [(s, p, u, b, i, "0" if a else None, c, a, None, None) for s, p, u, b, i, c, a in log]
    log = spark.createDataFrame(rows, "session_id bigint, pos int, user_id bigint, bank string, qid int, user_answer string, correct boolean, answered boolean, session_at timestamp, day date")
    tags = spark.createDataFrame([("b", "1", "key"), ("b", "4", "exclude"), ("questions/交通部.json", "6", "key")], "bank string, qid string, tag string")
    none = spark.createDataFrame([], "bank string, qid string, answer string, warning string, amendmenturl string, repeats array<string>, freescore boolean")

    def ids(**kw):
        return sorted(r.row_id for r in quiz.select(quiz.QuizSpec(**{"num": 0, "user_id": 1} | kw), q, log, none, tags).collect())

    return ids


@pytest.mark.parametrize("request_, want", [
    ({"mode": "all"}, [1, 2, 3, 5, 6]), ({"mode": "wrong"}, [2, 3, 5]), ({"mode": "still-wrong"}, [3, 5]), ({"mode": "unseen"}, [3, 6]), ({"mode": "key"}, [1, 6]),
    ({"mode": "stat"}, [2, 5]), ({"mode": "stat", "max_accuracy": 50}, [5]), ({"mode": "stat", "min_wrong": 2}, []), ({"mode": "retry", "session_id": 1, "user_id": None}, [2, 3]),
    ({"mode": "wrong", "track": "traffic"}, [5]), ({"mode": "wrong", "track": "irrigation"}, [2, 3]), ({"mode": "key", "src_banks": ("b",)}, [1]), ({"mode": "all", "banks": ("b",)}, [1, 2, 3]),
    ({"mode": "unseen", "user_id": 2}, [1, 2, 3, 5, 6]), ({"mode": "all", "types": ("tf",)}, []), ({"mode": "all", "num": 2}, [1, 2]),
])
def test_modes(asked, request_, want):
    assert asked(**request_) == want


@pytest.mark.parametrize("mode", ["random", "wrong", "unseen"])
def test_all_modes_but_one_take_exactly_what_was_asked_for(asked, mode):
    assert len(asked(mode=mode, num=2)) == 2


def test_bad_requests():
    for kw in ({"mode": "x"}, {"num": -1}, {"num": "ten"}, {"mode": "retry"}):
        with pytest.raises(ValueError):
            quiz.QuizSpec(**kw)


def test_exact_quiz_reads_on_behind_the_first_blocks(spark, tmp_path, rows):
    groups = [("a", f"g{k:03}", 3) for k in range(210)] + [("a", "last", 1)] + [("b", f"h{k:03}", 7) for k in range(230)] + [("b", "end", 5)]
    questions = [(bank, g) for bank, g, n in groups for _ in range(n)]
    frame = spark.createDataFrame([(i, bank, g, None) for i, (bank, g) in enumerate(questions)], "row_id bigint, bank string, groupid string, materials array<struct<type:string,title:string,content:string,notes:string>>")
    frame.write.parquet(f"{tmp_path}/questions.parquet")
    firsts = {}
    for i, q in enumerate(questions):
        firsts.setdefault(q, i)
    want = [("a", firsts["a", f"g{k:03}"]) for k in range(13)] + [("a", firsts["a", "last"])] + [("b", firsts["b", f"h{k:03}"]) for k in range(5)] + [("b", firsts["b", "end"])]
    assert rows(quizzes.block_take_exact(spark, str(tmp_path))) == want
