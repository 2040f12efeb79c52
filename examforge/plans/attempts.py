"""Attempt analytics, grading and review over sessions, attempts and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from examforge.functions import grading
from examforge.operators import history
from examforge.plans.base import Plans, table

plans = Plans()
AS_OF = "2024-06-14"

LOG = """
    SELECT DISTINCT a.session_id, a.pos, a.user_id, coalesce(nullif(a.bank, ''), nullif(s.bank, ''), 'questions/questions.json') AS bank, a.qid,
           a.user_answer, coalesce(a.correct, false) AS correct, a.user_answer IS NOT NULL AND a.user_answer <> '[]' AS answered,
           s.date_iso AS session_at, CAST(s.date_iso AS DATE) AS day
    FROM attempts a LEFT JOIN sessions s ON a.session_id = s.session_id
"""
POOLS = f"""
    SELECT user_id, bank, qid, arg_max(correct, session_id * 100000 + pos) AS last_correct, bool_or(NOT correct) AS ever,
           bool_or(NOT correct AND coalesce(day = DATE '{AS_OF}', false)) AS today
    FROM ({LOG}) GROUP BY user_id, bank, qid
"""
COUNTS = f"""
    SELECT user_id, bank, qid, count(*) AS total, count(*) FILTER (WHERE correct) AS n_correct, count(*) FILTER (WHERE NOT correct) AS n_wrong
    FROM ({LOG}) WHERE answered GROUP BY user_id, bank, qid
"""


def log(spark, d):
    return history.resolved(table(spark, d, "attempts"), table(spark, d, "sessions"))


@plans.add(f"SELECT session_id, pos, user_id, bank, qid, correct, answered FROM ({LOG})")
def attempts_resolved(spark, d):
    return log(spark, d).select("session_id", "pos", "user_id", "bank", "qid", "correct", "answered")


@plans.add(f"SELECT *, NOT last_correct AS still, ever AND NOT today AS past FROM ({POOLS})")
def wrong_pools(spark, d):
    return history.wrong_pools(log(spark, d), AS_OF)


@plans.add(f"SELECT user_id, bank, qid FROM ({POOLS}) WHERE NOT last_correct")
def still_wrong_items(spark, d):
    return history.wrong_pools(log(spark, d), AS_OF).where("still").select("user_id", "bank", "qid")


@plans.add(f"""
    SELECT *, CAST(floor(n_correct * 100.0 / total + 0.5) AS INTEGER) AS accuracy, total >= 2 AND 2 * n_correct < total AS often_wrong FROM ({COUNTS})""")
def attempt_counts(spark, d):
    return history.attempt_counts(log(spark, d))


@plans.add(f"""
    SELECT user_id, bank, count(DISTINCT qid) FILTER (WHERE answered) AS questions, count(*) FILTER (WHERE answered) AS attempts,
           epoch_us(max(session_at)) AS last_us
    FROM ({LOG}) GROUP BY user_id, bank""")
def practice_stats_per_bank(spark, d):
    s = history.practice_stats(log(spark, d))
    return s.select("user_id", "bank", "questions", "attempts", F.unix_micros("last_at").alias("last_us"))


@plans.add(f"SELECT user_id, bank, qid, total, n_wrong FROM ({COUNTS}) WHERE n_wrong >= 1 AND n_correct * 100 < total * 60")
def stat_filter_items(spark, d):
    return history.stat_filter(history.attempt_counts(log(spark, d)), 1, 60).select("user_id", "bank", "qid", "total", "n_wrong")


@plans.add(f"""
    SELECT bank, qid, sum(n_wrong) AS n_wrong FROM ({COUNTS}) GROUP BY bank, qid HAVING sum(n_wrong) > 0
    ORDER BY n_wrong DESC, bank, qid LIMIT 100""")
def most_wrong_report(spark, d):
    counts = history.attempt_counts(log(spark, d)).groupBy("bank", "qid").agg(F.sum("n_wrong").alias("n_wrong"))
    return counts.where("n_wrong > 0").orderBy(F.desc("n_wrong"), "bank", "qid").limit(100)


@plans.add(f"""
    SELECT row_id, bank, id FROM questions q
    WHERE NOT EXISTS (SELECT 1 FROM ({LOG}) a WHERE a.answered AND a.user_id = 36 AND a.bank = q.bank AND a.qid = q.id)""")
def unseen_questions(spark, d):
    return history.unseen(table(spark, d, "questions").select("row_id", "bank", "id"), log(spark, d), 36).select("row_id", "bank", "id")


@plans.add(f"""
    SELECT row_id, bank, id FROM questions q WHERE bank LIKE '%農業概論%'
    AND EXISTS (SELECT 1 FROM ({POOLS}) p WHERE p.ever AND p.bank = q.bank AND p.qid = q.id)""")
def scope_semi_join(spark, d):
    pools = history.wrong_pools(log(spark, d), AS_OF).where("ever").select("bank", F.col("qid").alias("id"))
    q = table(spark, d, "questions").select("row_id", "bank", "id").where(F.col("bank").contains("農業概論"))
    return q.join(pools, ["bank", "id"], "left_semi").select("row_id", "bank", "id")


@plans.add(f"""
    SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'pass' ELSE 'retry' END AS band FROM (
      SELECT session_id, count(*) AS total, count(*) FILTER (WHERE correct) AS n_correct, count(*) FILTER (WHERE answered AND NOT correct) AS n_wrong,
             count(*) FILTER (WHERE NOT answered) AS n_skip, CAST(floor(count(*) FILTER (WHERE correct) * 100.0 / count(*) + 0.5) AS INTEGER) AS score
      FROM ({LOG}) GROUP BY session_id)""")
def session_scores(spark, d):
    return history.session_scores(log(spark, d))


@plans.add(f"""
    SELECT s.session_id, s.n_correct AS said, coalesce(l.n, 0) AS found FROM sessions s
    LEFT JOIN (SELECT session_id, count(*) FILTER (WHERE correct) AS n, count(*) AS total FROM ({LOG}) GROUP BY session_id) l ON l.session_id = s.session_id
    WHERE s.n_correct IS DISTINCT FROM l.n OR s.total IS DISTINCT FROM l.total""")
def session_audit(spark, d):
    scores = history.session_scores(log(spark, d)).select("session_id", F.col("n_correct").alias("n"), F.col("total").alias("t"))
    s = table(spark, d, "sessions").join(scores, "session_id", "left")
    odd = ~F.col("n_correct").cast("bigint").eqNullSafe(F.col("n")) | ~F.col("total").cast("bigint").eqNullSafe(F.col("t"))
    return s.where(odd).select("session_id", F.col("n_correct").alias("said"), F.coalesce("n", F.lit(0)).alias("found"))





@plans.add(f"""
    SELECT p.user_id, p.bank, p.qid, l.row_id FROM ({POOLS}) p
    JOIN (SELECT bank, id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY bank, id ORDER BY imported_at DESC, row_id DESC) AS k FROM questions) WHERE k = 1) l
    ON l.bank = p.bank AND l.id = p.qid WHERE p.ever""")
def wrong_latest_snapshot(spark, d):
    pools = history.wrong_pools(log(spark, d), AS_OF).where("ever").select("user_id", "bank", "qid")
    latest = history.latest_snapshots(table(spark, d, "questions").select("bank", "id", "row_id", "question", "options", "answer", "imported_at"))
    return pools.join(latest.select("bank", F.col("id").alias("qid"), "row_id"), ["bank", "qid"]).select("user_id", "bank", "qid", "row_id")


@plans.add(f"""
    SELECT *, row_number() OVER (ORDER BY n_wrong DESC, bank) AS place FROM (
      SELECT bank, count(*) AS n_wrong, count(*) FILTER (WHERE NOT last_correct) AS n_still FROM ({POOLS}) WHERE ever GROUP BY bank)""")
def wrong_by_bank(spark, d):
    facets = history.bank_facets(history.wrong_pools(log(spark, d), AS_OF))
    return facets.withColumn("place", F.col("place").cast("bigint"))


@plans.add(f"SELECT session_id, pos, bank, qid FROM ({LOG}) WHERE NOT correct")
def retry_set(spark, d):
    return log(spark, d).where(~F.col("correct")).select("session_id", "pos", "bank", "qid")


@plans.add(f"""
    SELECT session_id, count(*) FILTER (WHERE answered) AS n_answered, count(*) FILTER (WHERE NOT answered) AS n_open FROM ({LOG}) GROUP BY session_id""")
def answered_counts(spark, d):
    return log(spark, d).groupBy("session_id").agg(F.count_if("answered").alias("n_answered"), F.count_if(~F.col("answered")).alias("n_open"))


@plans.add(f"""
    SELECT a.session_id, a.pos, CASE WHEN NOT a.answered THEN 'skipped'
      WHEN coalesce(q.freescore, false) OR list_sort(string_split(regexp_replace(a.user_answer, '[\\[\\] ]', '', 'g'), ',')) = list_sort(string_split(regexp_replace(q.answer, '[\\[\\] ]', '', 'g'), ',')) THEN 'ok'
      ELSE 'wrong' END AS outcome
    FROM ({LOG}) a JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bank, id ORDER BY imported_at DESC, row_id DESC) AS k FROM questions) WHERE k = 1) q
    ON q.bank = a.bank AND q.id = a.qid""")
def graded_attempts(spark, d):
    q = table(spark, d, "questions").groupBy("bank", "id").agg(F.max_by(F.struct("answer", "freescore"), F.struct("imported_at", "row_id")).alias("q"))
    a = log(spark, d).join(q.select("bank", F.col("id").alias("qid"), "q.answer", "q.freescore"), ["bank", "qid"])
    return a.select("session_id", "pos", grading.outcome(F.col("user_answer"), F.col("answer"), F.col("freescore")).alias("outcome"))


@plans.add("""
    SELECT session_id, strftime(date_iso, '%-m/%-d') AS day_label, strftime(date_iso, '%-m/%-d %H:%M') AS label,
           CASE WHEN elapsed IS NULL THEN '' ELSE lpad(CAST(elapsed // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(elapsed % 60 AS VARCHAR), 2, '0') END AS took
    FROM sessions""")
def session_labels(spark, d):
    took = F.concat(F.lpad(F.floor(F.col("elapsed") / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("elapsed") % 60).cast("string"), 2, "0"))
    return table(spark, d, "sessions").select(
        "session_id", F.date_format("date_iso", "M/d").alias("day_label"), F.date_format("date_iso", "M/d HH:mm").alias("label"), F.coalesce(took, F.lit("")).alias("took")
    )


@plans.add(f"""
    SELECT b.file, b.n_questions AS n_total, count(DISTINCT p.qid) AS n_selected FROM banks b
    LEFT JOIN (SELECT bank, qid FROM ({POOLS}) WHERE ever) p ON p.bank = b.file GROUP BY b.file, b.n_questions""")
def scope_summary(spark, d):
    pools = history.wrong_pools(log(spark, d), AS_OF).where("ever").select("bank", "qid").distinct()
    n = pools.groupBy(F.col("bank").alias("file")).agg(F.count("*").alias("n_selected"))
    b = table(spark, d, "banks").select("file", F.col("n_questions").alias("n_total"))
    return b.join(n, "file", "left").withColumn("n_selected", F.coalesce("n_selected", F.lit(0)))


@plans.add("""
    SELECT event_id, n_requests, round(sum_weight, 4) AS sum_weight, n_requests > 3 OR sum_weight > 100 AS held FROM (
      SELECT event_id, count(*) OVER w AS n_requests, sum(value) OVER w AS sum_weight FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW))""")
def rate_limit_windows(spark, d):
    e = history.rate_windows(table(spark, d, "events"), "user_id", "ts", F.col("value"), 3600, 3, 100.0)
    return e.select("event_id", "n_requests", F.round("sum_weight", 4).alias("sum_weight"), "held")
