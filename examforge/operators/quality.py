"""Data quality: completeness, reconciliation, structural leaks, comparison with a second source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examforge.functions import grading
from examforge.functions.text import SPACE

#: Units of answers that are values, words that end a rule, and the least length of an option that leaks (fixed values).
UNITS = "個月|年|公尺|公分|公里|公噸|分鐘|小時|秒|歲|點|次|毫克|元|日|張|人|倍|度|%"
TAIL_MARKERS = ("以上者", "註銷", "吊扣", "吊銷", "扣繳", "至檢驗合格", "發還", "禁止其行駛", "沒入", "處汽車所有人")
LONG = 14
NUMERIC = rf"^\d[\d,.]*\s*(?:{UNITS})?$"
NUMERIC_PREFIX = rf"^\d[\d,.]*\s*(?:{UNITS})"
#: What shows that a record was extracted badly (fixed value).
SUSPICIOUS = "\ufffd|[ÅÇÉÑ]|[\uf081-\uf084]|×10 元|/ha /ha|題目[一二三四五六]|請接續"


_FLAGS = ("repeated", "bad_options", "empty", "odd_answers", "suspicious")


def issues(questions: DataFrame, by: str = "bank", expected: int | None = None, options: int = 4) -> DataFrame:
    """(source, issue, id): the ids behind a completeness report, a row each, so that no list grows with a source.

    missing and extra: of 1 to expected (or to the largest id); repeated; bad_options: another number of options; empty:
    no question, or an option missing or empty; odd_answers: not one of the options' places, free scores aside;
    suspicious: characters of a bad extraction. Rows are combined by (source, id) first, map-side.
    """
    one = _by_id(questions, by, options)
    flagged = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in _FLAGS]))
    found = one.select(by, "id", F.explode(flagged).alias("issue"))
    if expected is not None:
        found = found.unionByName(one.where((F.col("id") < 1) | (F.col("id") > expected)).select(by, "id", F.lit("extra").alias("issue")))
    else:
        found = found.unionByName(one.where(F.col("id") < 1).select(by, "id", F.lit("extra").alias("issue")))
    return found.unionByName(missing_ids(one, by, expected).select(by, "id", F.lit("missing").alias("issue"))).select(by, "issue", "id")


def completeness(questions: DataFrame, by: str = "bank", expected: int | None = None, options: int = 4) -> DataFrame:
    """By source: n, how many ids each issue has, and the status: `ok` without issues and with the expected number."""
    one = _by_id(questions, by, options)
    last = F.lit(expected) if expected is not None else F.greatest(F.max("id"), F.lit(0))
    out = one.groupBy(by).agg(
        F.sum("n").alias("n"), last.cast("bigint").alias("_last"), F.count_if((F.col("id") >= 1) & ((F.col("id") <= expected) if expected is not None else F.lit(True))).alias("_in"),
        F.count("id").alias("_ids"), *[F.count_if(k).alias(k) for k in _FLAGS],
    )
    out = out.withColumn("missing", F.col("_last") - F.col("_in")).withColumn("extra", F.col("_ids") - F.col("_in"))
    ok = F.col("n") == F.col("_last")
    for k in ("missing", "extra", *_FLAGS):
        ok = ok & (F.col(k) == 0)
    return out.select(by, "n", "missing", "extra", *_FLAGS, F.when(ok, "ok").otherwise("review").alias("status"))


def _by_id(questions: DataFrame, by: str, options: int) -> DataFrame:
    n = F.greatest(F.size("options"), F.lit(0))
    answers = grading.answers(F.col("answer"))
    right = F.coalesce((F.size(answers) > 0) & F.forall(answers, lambda a: (a >= 0) & (a < options)), F.lit(False))
    text = F.concat_ws(" ", "question", F.array_join("options", " "))
    empty = (F.coalesce("question", F.lit("")) == "") | (n != options) | F.coalesce(F.exists("options", lambda o: F.coalesce(o, F.lit("")) == ""), F.lit(True))
    flags = {"bad_options": n != options, "empty": empty, "odd_answers": ~F.coalesce("freescore", F.lit(False)) & ~right, "suspicious": text.rlike(SUSPICIOUS)}
    one = questions.groupBy(by, "id").agg(F.count("*").alias("n"), *[F.max(c).alias(k) for k, c in flags.items()])
    return one.withColumn("repeated", F.col("n") > 1)


def missing_ids(questions: DataFrame, by: str = "bank", expected: int | None = None, step: int = 10_000) -> DataFrame:
    """(source, id): ids from 1 to expected, or to a source's largest, that no row has. The ranges are expanded in steps,
    spread over tasks."""
    last = questions.groupBy(by).agg((F.lit(expected) if expected is not None else F.max("id")).alias("last")).where(F.col("last") >= 1)
    ranges = last.withColumn("a", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(step)))).repartition(by, "a")
    ids = ranges.select(by, F.explode(F.sequence("a", F.least(F.col("a") + step - 1, F.col("last")))).alias("id"))
    return ids.join(questions.select(by, "id"), [by, "id"], "left_anti")


def reconcile(candidate: DataFrame, reference: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full outer comparison by key: `missing`, `extra`, or which fields differ (null-safe); equal rows are left out."""
    c = candidate.select(*keys, F.struct(*fields).alias("c"))
    r = reference.select(*keys, F.struct(*fields).alias("r"))
    both = c.join(r, keys, "full")
    differs = F.concat_ws(",", *[F.when(~F.col(f"c.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields])
    issue = F.when(F.col("c").isNull(), "missing").when(F.col("r").isNull(), "extra").otherwise(differs)
    return both.select(*keys, issue.alias("issue")).where(F.col("issue") != "")


def report_status(issues: DataFrame, qa: DataFrame, by: str, harmless: tuple[str, ...] = ("question",)) -> DataFrame:
    """`review` where the completeness check isn't ok or any issue but a text difference exists."""
    bad = issues.where(~F.col("issue").isin(*harmless)).groupBy(by).agg(F.count("*").alias("n_issues"))
    out = qa.select(by, "status").join(bad, by, "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0)))
    return out.withColumn("status", F.when((F.col("status") == "ok") & (F.col("n_issues") == 0), "ok").otherwise("review"))


def leak(options: Column) -> Column:
    """The first option that holds the end of the stem, null without one: of three options or more all but one at most are
    values, and it is no value itself, is LONG or longer, begins with a value and its unit, and holds a comma or words
    that end a rule. Options with a null give none."""
    stripped = F.transform(options, lambda o: F.regexp_replace(o, f"^{SPACE}+|{SPACE}+$", ""))
    is_value = lambda o: o.rlike(NUMERIC)
    tail = lambda o: o.contains("，") | o.rlike("|".join(TAIL_MARKERS))
    odd = F.filter(stripped, lambda o: ~is_value(o) & (F.length(o) >= LONG) & o.rlike(NUMERIC_PREFIX) & tail(o))
    gap = (F.size(options) >= 3) & (F.size(F.filter(stripped, is_value)) >= F.size(options) - 1) & F.forall(options, lambda o: o.isNotNull())
    return F.when(gap, F.get(odd, F.lit(0)))


def changes(rows: DataFrame, key: str, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Change log of a normalization: (key, field, before, after) where a field changes."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), a.alias("before"), b.alias("after")) for n, (a, b) in fields.items()])
    return rows.select(key, F.inline(pairs)).where(~F.col("before").eqNullSafe(F.col("after")))


def first_difference(rows: DataFrame, key: str, a: str, b: str, context: int = 25) -> DataFrame:
    """(key, place, left, right): the first place where two texts differ, with what follows. Binary search on prefix
    equality: comparisons of substrings in the JVM, no loop over characters."""
    n = F.least(F.length(a), F.length(b))
    low, high = F.lit(0), n
    q = rows.withColumn("_lo", low).withColumn("_hi", high)
    for _ in range(31):  # enough for any length of a string
        mid = F.floor((F.col("_lo") + F.col("_hi") + 1) / 2).cast("int")
        same = F.substr(a, F.lit(1), mid) == F.substr(b, F.lit(1), mid)
        q = q.withColumn("_mid", mid).withColumn("_same", same)
        q = q.withColumn("_lo", F.when(F.col("_same"), F.col("_mid")).otherwise(F.col("_lo"))).withColumn("_hi", F.when(F.col("_same"), F.col("_hi")).otherwise(F.col("_mid") - 1))
    q = q.where(~F.col(a).eqNullSafe(F.col(b)))
    cut = lambda c: F.substr(c, F.col("_lo") + 1, F.lit(context))
    return q.select(key, F.col("_lo").alias("place"), cut(F.col(a)).alias("left"), cut(F.col(b)).alias("right"))
