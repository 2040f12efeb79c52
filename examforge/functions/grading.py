"""Answers: parsing, grading, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def answers(answer: Column) -> Column:
    """ARRAY<INT> of an answer written as `2`, `[0, 2]` or null (null stays null)."""
    bare = F.regexp_replace(answer, r"[\[\]\s]", "")
    return F.when(answer.isNull() | (bare == ""), F.when(answer.isNotNull(), F.array().cast("array<int>"))).otherwise(F.split(bare, ",").cast("array<int>"))


def is_multi(answer: Column) -> Column:
    return F.coalesce(answer.startswith("["), F.lit(False))


def answered(user: Column) -> Column:
    """Null and an empty list count as not answered."""
    return F.coalesce(F.size(answers(user)) > 0, F.lit(False))


def same_answers(a: Column, b: Column) -> Column:
    """Equal as multisets."""
    return F.coalesce(F.array_sort(answers(a)) == F.array_sort(answers(b)), F.lit(False))


def outcome(user: Column, answer: Column, free_score: Column) -> Column:
    """`skipped`, `ok` or `wrong`; free scores are ok if answered at all."""
    free = F.coalesce(free_score, F.lit(False))
    return F.when(~answered(user), "skipped").when(free | same_answers(user, answer), "ok").otherwise("wrong")


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 for nothing."""
    return F.when(whole > 0, F.floor(part * F.lit(100.0) / whole + F.lit(0.5))).otherwise(F.lit(0)).cast("int")


def band(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "pass").otherwise("retry")


def letters(answer: Column) -> Column:
    """`A`, `A,C`; empty for null."""
    return F.coalesce(F.array_join(F.transform(answers(answer), lambda i: F.char(i + 65)), ","), F.lit(""))


def question_type(options: Column, answer: Column) -> Column:
    """`mc` for several answers, `tf` for two options, `sc` for more; null without an answer or options."""
    n = F.size(options)
    return F.when(answer.isNull(), F.lit(None)).when(is_multi(answer), "mc").when(n == 2, "tf").when(n > 2, "sc")
