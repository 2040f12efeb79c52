"""Review of audited questions: items for the reviewer, decisions of two passes, entries, logs, patches and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examforge.functions import grading
from examforge.operators import audit

#: Characters of an amendment's text and reason that an item, a prompt and an entry show (fixed values).
ITEM, PROMPT, ENTRY = (400, 200), (300, 150), 300
MOST_AMENDMENTS = 8


def bracketed(options: Column) -> Column:
    """`  (A) first` and so on, a line each."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.lit("  ("), F.char(i + 65), F.lit(") "), o)), "\n")


def correct(answer: Column) -> Column:
    """`(A)` or `(A), (C)`."""
    return F.array_join(F.transform(grading.answers(answer), lambda i: F.concat(F.lit("("), F.char(i + 65), F.lit(")"))), ", ")


def amendment_block(amendments: Column, text: int, reason: int) -> Column:
    """Amendments (law, article_no, latest, signals, text, reason) as text, cut to so many characters; blank reasons are
    left out."""

    def one(a: Column) -> Column:
        head = F.concat(F.lit("\n  ["), a["law"], F.lit("] 第 "), a["article_no"], F.lit(" 條（修正日期："), a["latest"], F.lit("）\n  信號："), F.array_join(a["signals"], ", "), F.lit("\n  條文："), F.left(a["text"], F.lit(text)), F.lit("\n"))
        return F.concat(head, F.when(F.coalesce(a["reason"], F.lit("")) != "", F.concat(F.lit("  理由："), F.left(a["reason"], F.lit(reason)), F.lit("\n"))).otherwise(""))

    return F.array_join(F.transform(amendments, one), "")


def items(rows: DataFrame) -> DataFrame:
    """Questions (options, answer, amendments, further columns) as items for the reviewer: options and answers as lettered
    text, amendments as a text of bounded parts."""
    return rows.withColumn("correct", correct(F.col("answer"))).withColumn("options", bracketed(F.col("options"))).withColumn("amendments", amendment_block(F.col("amendments"), *ITEM)).drop("answer")


def prompts(rows: DataFrame, strong: str = "deprecated_term") -> DataFrame:
    """(query_id, prompt): the question, its options and at most eight amendments, those with a strong signal first."""
    has = lambda a: F.exists(a["signals"], lambda s: s.startswith(strong))
    first = F.slice(F.concat(F.filter("amendments", has), F.filter("amendments", lambda a: ~has(a))), 1, MOST_AMENDMENTS)
    return rows.select("query_id", F.concat_ws("\n", "question", bracketed(F.col("options")), amendment_block(first, *PROMPT)).alias("prompt"))


def entries(rows: DataFrame) -> DataFrame:
    """Audit entries: the reasons of the amendments cut to ENTRY characters."""
    cut = F.transform("amendments", lambda a: a.withField("reason", F.left(a["reason"], F.lit(ENTRY))))
    return rows.withColumn("amendments", cut)


def agreed(rows: DataFrame) -> DataFrame:
    """Adds route, affected, confidence, disagreed, batch (see audit.routed), reason and article: the second pass's where
    both passes call the question affected and it gives them, else the first one's.

    rows: p1, p2, c1, c2, similarity, strong, reason1, reason2, article1, article2."""
    out = audit.routed(rows)
    both = (F.col("route") == "second") & F.coalesce("p2", F.lit(False)) & F.col("affected")
    pick = lambda name: F.when(both, F.coalesce(f"{name}2", f"{name}1")).otherwise(F.col(f"{name}1")).alias(name)
    return out.select("*", pick("reason"), pick("article"))


def log(rows: DataFrame) -> DataFrame:
    """(bank_name, id, entry): a plain-text entry of the audit log for each question, options marked, the correct one with
    a star, in the order of (bank name, id) within their key."""
    places = grading.answers(F.col("answer"))
    marked = F.array_join(F.transform("options", lambda o, i: F.concat(F.when(F.array_contains(places, i), "* ").otherwise("  "), F.lit("("), F.char(i + 65), F.lit(") "), o)), "\n")
    head = F.concat(F.lit("["), F.col("bank_name"), F.lit("] #"), F.col("id").cast("string"), F.when(F.col("affected"), " affected").otherwise(" safe"), F.lit(" "), F.col("confidence").cast("string"))
    return rows.select("bank_name", F.col("id").cast("int").alias("id"), F.concat_ws("\n", head, F.col("question"), marked, F.col("reason")).alias("entry"))


def ordered(rows: DataFrame) -> DataFrame:
    """By bank name and number, as results are listed."""
    return rows.orderBy("bank_name", F.col("id").cast("int"))


def best(attempts: DataFrame, by: list[str], confidence: str, order: str) -> DataFrame:
    """The attempt of the highest confidence, the first of equals; null confidences count as 0."""
    cols = [c for c in attempts.columns if c not in by]
    return attempts.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct(F.coalesce(confidence, F.lit(0)), -F.col(order))).alias("a")).select(*by, "a.*")


def patches(results: DataFrame, repeats: DataFrame) -> DataFrame:
    """(bank, qid, answer, warning, repeats): reviewed results (bank, qid, answer, warning) with the names of the banks that
    repeat the question (bank, qid, repeats); either may lack a question."""
    return results.join(repeats, ["bank", "qid"], "full").select("bank", "qid", "answer", "warning", "repeats")


def as_maps(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(bank, questions): patches of each bank as a map of question to patch; of repeated questions the largest patch."""
    one = rows.groupBy("bank", "qid").agg(F.max(F.struct(*fields)).alias("p"))
    return one.groupBy("bank").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("qid", "p")))).alias("questions"))


def merged_maps(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """Patches of two sources merged field by field: a field that the new one has replaces the old one's."""
    o, n = (df.groupBy("bank", "qid").agg(F.max(F.struct(*fields)).alias(name)) for df, name in ((old, "o"), (new, "n")))
    both = o.join(n, ["bank", "qid"], "full")
    return both.select("bank", "qid", *[F.coalesce(f"n.{f}", f"o.{f}").alias(f) for f in fields])


def summary(reports: DataFrame) -> DataFrame:
    """One row: files, those that are ok, those to review, and questions. reports: status, n."""
    return reports.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("review"), F.coalesce(F.sum("n"), F.lit(0)).alias("questions"))


def still_there(picked: DataFrame, banks: DataFrame) -> DataFrame:
    """Picked banks that still exist, once each."""
    return picked.select("bank").intersect(banks.select("bank"))
