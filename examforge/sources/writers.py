"""Writing: appends, keyed upserts, backups, exports. Every write is explicit; without a path a frame is returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examforge.functions import grading, rendering
from examforge.operators.laws import NO_CHAPTER


def append(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = rows.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def without(rows: DataFrame, key: str, values: list) -> DataFrame:
    """Rows whose key isn't among the values; null keys stay."""
    return rows.where(~F.coalesce(F.col(key).isin(values), F.lit(False)))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], blank: Column | None = None) -> DataFrame:
    """Full outer merge: a new row replaces the old one; rows for which `blank` holds are deleted. Of several new rows of a
    key the last one counts: the one of the largest `_order` if there is such a column, else the largest."""
    o = old.select(*keys, F.struct(*fields).alias("o"))
    pick = F.max_by(F.struct(*fields), F.col("_order")) if "_order" in new.columns else F.max(F.struct(*fields))
    n = new.groupBy(*keys).agg(pick.alias("n"))
    merged = o.join(n, keys, "full").select(*keys, F.coalesce("n", "o").alias("v")).select(*keys, "v.*")
    return merged if blank is None else merged.where(~F.coalesce(blank, F.lit(False)))


def backup(entries: DataFrame, names: tuple[str, ...], prefixes: tuple[str, ...]) -> DataFrame:
    """Entries (key, value) that belong into a backup: named keys and keys with a prefix."""
    keep = F.col("key").isin(*names)
    for p in prefixes:
        keep = keep | F.startswith("key", F.lit(p))
    return entries.where(keep)


def restored(current: DataFrame, saved: DataFrame, names: tuple[str, ...], prefixes: tuple[str, ...]) -> DataFrame:
    """Saved entries over the current ones with the same key; keys that don't belong into a backup are ignored."""
    return upserted(current, backup(saved, names, prefixes), ["key"], ["value"])


def json_lines(rows: DataFrame, path: str) -> None:
    public = [c for c in rows.columns if not c.startswith("_")]
    rows.select(*public).write.mode("overwrite").json(path)


def exported(questions: DataFrame, by: str) -> DataFrame:
    """(by, text): the questions of a group as text in order of id, between rules."""
    text = rendering.question_text(F.col("question"), F.col("options"), grading.letters(F.col("answer")))
    g = questions.select(by, "id", "row_id", text.alias("t")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("id", "row_id", "t"))).alias("l"))
    return g.select(by, F.array_join(F.transform("l", lambda x: x["t"]), f"\n{rendering.RULE}\n").alias("text"))


def law_text(articles: DataFrame, titles: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text): laws written out again: the title, a chapter's line before its first article, articles with their
    explanations below. titles: key, title."""
    body = F.concat_ws("\n", F.concat(F.lit("第 "), F.col("article_no"), F.lit(" 條　"), F.col("text")), F.when(F.col("explanation") != "", F.concat(F.lit("解釋："), F.col("explanation"))))
    before = F.lag("chapter").over(Window.partitionBy(key).orderBy("seq"))
    opens = F.when(~F.col("chapter").eqNullSafe(before) & (F.col("chapter") != NO_CHAPTER), F.col("chapter"))
    rows = articles.withColumn("b", F.concat_ws("\n\n", opens, body))
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "b"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["b"]), "\n\n")
    if titles is None:
        return g.select(key, text.alias("text"))
    return g.join(titles, key, "left").select(key, F.concat_ws("\n\n", F.nullif("title", F.lit("")), text).alias("text"))


def noted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Notes on articles (law, article_no, note): new ones over the old, blank ones delete."""
    return upserted(old, new, ["law", "article_no"], ["note"], F.trim(F.coalesce("note", F.lit(""))) == "")


def audit_log(entries: DataFrame, path: str) -> None:
    """Entries (bank_name, id, entry) of reviews.log as text, a blank line between, in their order."""
    entries.orderBy("bank_name", "id").select(F.concat("entry", F.lit("\n"))).write.mode("overwrite").text(path)


def markdown_report(report: DataFrame, most_rows: int = 1000) -> str:
    """A small report as a Markdown table; an error if it has more rows than that."""
    rows = report.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(report.columns), line(["---"] * len(report.columns)), *map(line, rows)])
