"""Attempt analytics over the flattened log: latest outcomes, wrong pools, counts, coverage.

Every aggregate is by user and question with map-side combining; the log is joined with its sessions once, on
session_id, and repeated rows are dropped under the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examforge.functions import grading

DEFAULT_BANK = "questions/questions.json"


def or_empty(c: str | Column) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def resolved(attempts: DataFrame, sessions: DataFrame, default_bank: str = DEFAULT_BANK) -> DataFrame:
    """Attempts once each, with the bank of the item, else of the session, else the default; `answered`, `day` (UTC)."""
    s = sessions.select("session_id", F.col("bank").alias("s_bank"), F.col("date_iso").alias("session_at"))
    a = attempts.select("session_id", "pos", "user_id", "bank", "qid", "user_answer", "correct")
    joined = a.join(s, "session_id", "left").dropDuplicates(["session_id", "pos"])
    return joined.select(
        "session_id", "pos", "user_id", F.coalesce(or_empty("bank"), or_empty("s_bank"), F.lit(default_bank)).alias("bank"), "qid", "user_answer",
        F.coalesce("correct", F.lit(False)).alias("correct"), grading.answered(F.col("user_answer")).alias("answered"), "session_at", F.to_date("session_at").alias("day"),
    )


def wrong_pools(log: DataFrame, as_of: str) -> DataFrame:
    """By user and question: last outcome in log order, ever/still/today/past wrong. Skips count as wrong here."""
    wrong = ~F.col("correct")
    pools = log.groupBy("user_id", "bank", "qid").agg(
        F.max_by("correct", F.struct("session_id", "pos")).alias("last_correct"),
        F.max(wrong).alias("ever"),
        F.max(wrong & F.coalesce(F.col("day") == F.lit(as_of).cast("date"), F.lit(False))).alias("today"),
    )
    return pools.withColumn("still", ~F.col("last_correct")).withColumn("past", F.col("ever") & ~F.col("today"))


def attempt_counts(log: DataFrame) -> DataFrame:
    """By user and question, without skips: total, n_correct, n_wrong, accuracy in percent, often wrong."""
    counts = log.where("answered").groupBy("user_id", "bank", "qid").agg(F.count("*").alias("total"), F.count_if("correct").alias("n_correct"))
    counts = counts.withColumn("n_wrong", F.col("total") - F.col("n_correct"))
    return counts.withColumn("accuracy", grading.percent(F.col("n_correct"), F.col("total"))).withColumn("often_wrong", (F.col("total") >= 2) & (2 * F.col("n_correct") < F.col("total")))


def practice_stats(log: DataFrame) -> DataFrame:
    """By user and bank: distinct questions answered, answered attempts, last time (skips count for the time only).

    Two steps, so that the distinct count needs no expansion of the rows: first by question, then by bank.
    """
    by_question = log.groupBy("user_id", "bank", "qid").agg(F.count_if("answered").alias("n"), F.max("session_at").alias("at"))
    return by_question.groupBy("user_id", "bank").agg(F.count_if(F.col("n") > 0).alias("questions"), F.sum("n").alias("attempts"), F.max("at").alias("last_at"))


def stat_filter(counts: DataFrame, min_wrong: int | None = None, max_accuracy: float | None = None) -> DataFrame:
    """Questions wrong at least min_wrong (1 at least) times and with an accuracy strictly below max_accuracy."""
    least, most = thresholds(min_wrong, max_accuracy)
    kept = counts.where(F.col("n_wrong") >= max(1, least))
    return kept if most is None else kept.where((F.col("total") == 0) | (F.col("n_correct") * 100 < F.col("total") * most))


def thresholds(min_wrong, max_accuracy) -> tuple[int, float | None]:
    """min_wrong that isn't a positive number becomes 0; max_accuracy is kept within 1 to 100, or None."""

    def number(x):
        try:
            x = float(x)
        except (TypeError, ValueError):
            return None
        return x if abs(x) < float("inf") else None

    least, most = number(min_wrong), number(max_accuracy)
    return int(least) if least and least > 0 else 0, None if most is None else min(100.0, max(1.0, most))


def unseen(questions: DataFrame, log: DataFrame, user_id: int | None = None) -> DataFrame:
    """Questions never answered (a skip doesn't count), by anyone or by one user."""
    seen = log.where("answered")
    if user_id is not None:
        seen = seen.where(F.col("user_id") == user_id)
    return questions.join(seen.select(F.col("bank"), F.col("qid").alias("id")), ["bank", "id"], "left_anti")


def session_scores(log: DataFrame) -> DataFrame:
    """By session: counts and the score, rounded half up, and its band."""
    s = log.groupBy("session_id").agg(
        F.count("*").alias("total"), F.count_if("correct").alias("n_correct"), F.count_if(F.col("answered") & ~F.col("correct")).alias("n_wrong"),
        F.count_if(~F.col("answered")).alias("n_skip"),
    )
    s = s.withColumn("score", grading.percent(F.col("n_correct"), F.col("total")))
    return s.withColumn("band", grading.band(F.col("score")))


def latest_snapshots(questions: DataFrame) -> DataFrame:
    """The last imported row of each (bank, id)."""
    return questions.groupBy("bank", "id").agg(F.max_by(F.struct("row_id", "question", "options", "answer"), F.struct("imported_at", "row_id")).alias("q")).select("bank", "id", "q.*")


def bank_facets(pools: DataFrame) -> DataFrame:
    """Wrong questions by bank with their rank (most first, ties by name)."""
    counts = pools.where("ever").groupBy("bank").agg(F.count("*").alias("n_wrong"), F.count_if("still").alias("n_still"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_wrong"), "bank")))  # a row a bank


def rate_windows(events: DataFrame, by: str, at: str, weight: Column, seconds: int, most_requests: int, most_weight: float) -> DataFrame:
    """Requests and weight of the last `seconds` seconds up to each event, and whether a limiter would hold it back.

    A user's events are cut into days (or four spans, if that is longer); those of the last span of a day also go to the
    next one as context, so that a user with a third of all events is spread over as many tasks as there are days. Events without a time are left out.
    """
    span, day = seconds * 1_000_000, max(86_400, 4 * seconds) * 1_000_000
    e = events.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_w", weight)
    e = e.withColumn("_day", F.floor(F.col("_us") / day))
    near = F.col("_us") >= (F.col("_day") + 1) * day - span
    e = e.withColumn("_in", F.explode(F.when(near, F.array("_day", F.col("_day") + 1)).otherwise(F.array("_day"))))
    w = Window.partitionBy(by, "_in").orderBy("_us").rangeBetween(1 - span, 0)
    out = e.withColumn("n_requests", F.count("*").over(w)).withColumn("sum_weight", F.sum("_w").over(w)).where(F.col("_in") == F.col("_day"))
    return out.withColumn("held", (F.col("n_requests") > most_requests) | (F.col("sum_weight") > most_weight)).drop("_us", "_w", "_day", "_in")
