"""Segmentation of extracted text: lines with ordinals, state carried forward, sessions of lines, records of questions.

Lines are exploded with their ordinal, and windows run within one document, never over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examforge.functions.text import SPACE, noise_line


def lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, no, line): trimmed lines that aren't blank, counted from 0 as stored."""
    exploded = documents.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("no", "line"))
    return exploded.withColumn("line", F.btrim("line", F.lit(" \t　"))).where(F.col("line") != "")


def without_noise(rows: DataFrame) -> DataFrame:
    return rows.where(~noise_line(F.col("line")))


def carried(rows: DataFrame, key: str, states: dict[str, Column]) -> DataFrame:
    """Carries each state's last non-null value forward within the document."""
    w = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[F.last(c, ignorenulls=True).over(w).alias(n) for n, c in states.items()])


def sessions(rows: DataFrame, key: str, starts: Column) -> DataFrame:
    """(key, group_no, text, n_lines): lines joined with blanks from one start to the next; lines before the first
    start form group 0."""
    w = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    grouped = rows.withColumn("group_no", F.sum(starts.cast("int")).over(w))
    parts = grouped.groupBy(key, "group_no").agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("l"))
    return parts.select(key, F.col("group_no").cast("bigint").alias("group_no"), F.array_join(F.transform("l", lambda x: x["line"]), " ").alias("text"), F.size("l").alias("n_lines"))


def neighbours(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Previous and next value within the key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("following", F.lead(value).over(w))


def accepted(numbers: Column) -> Column:
    """Numbers that continue 1, 2, 3, ... among candidates in order; others are passed over."""
    return F.aggregate(numbers, F.array().cast("array<int>"), lambda acc, n: F.when(n == F.size(acc) + 1, F.array_append(acc, n)).otherwise(acc))


QUESTION = r"^(\d{1,3})\s*[.、．]\s*(.+)$"
OPTION = r"^[(（]([A-H])[)）]\s*(.*)$"


def question_records(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Questions of exam texts: (key, q_no, number, stem, options). A numbered line opens a record, `(A)` lines are its
    options, lines in between continue the stem, lines after an option continue that option."""
    rows = without_noise(lines(documents, key))
    number = F.nullif(F.regexp_extract("line", QUESTION, 1), F.lit(""))
    letter = F.nullif(F.regexp_extract("line", OPTION, 1), F.lit(""))
    rows = rows.withColumn("number", number).withColumn("letter", letter)
    w = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("q_no", F.count("number").over(w)).where("q_no > 0")
    o = Window.partitionBy(key, "q_no").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("slot", F.count("letter").over(o))
    text = F.when(F.col("letter").isNotNull(), F.regexp_extract("line", OPTION, 2)).when(F.col("number").isNotNull(), F.regexp_extract("line", QUESTION, 2)).otherwise(F.col("line"))
    slots = rows.groupBy(key, "q_no", "slot").agg(F.array_sort(F.collect_list(F.struct("no", text.alias("t")))).alias("l"), F.max("number").alias("number"))
    slots = slots.withColumn("t", F.array_join(F.transform("l", lambda x: x["t"]), " "))
    records = slots.groupBy(key, "q_no").agg(F.max("number").cast("int").alias("number"), F.max(F.when(F.col("slot") == 0, F.col("t"))).alias("stem"), F.array_sort(F.collect_list(F.when(F.col("slot") > 0, F.struct("slot", "t")))).alias("o"))
    return records.select(key, "q_no", "number", "stem", F.transform("o", lambda x: x["t"]).alias("options"))


def rows_by_height(items: DataFrame, page: list[str], tolerance: float = 4.0) -> DataFrame:
    """Clusters positioned text items into rows: an item joins the first row whose running mean height is within the
    tolerance. Greedy and order-dependent, so each page (a bounded group) is folded in pandas."""
    import pandas as pd

    schema = ", ".join(f"{n} {t}" for n, t in items.select(*page).dtypes) + ", row_no int, y double, text string"

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        found: list[list] = []
        for r in group.sort_values(["y", "x"], kind="stable").itertuples(index=False):
            row = next((f for f in found if abs(f[0] - r.y) <= tolerance), None)
            if row is None:
                found.append([r.y, [(r.x, r.text)]])
            else:
                row[1].append((r.x, r.text))
                row[0] += (r.y - row[0]) / len(row[1])
        found.sort(key=lambda f: f[0])
        out = pd.DataFrame({"row_no": range(len(found)), "y": [f[0] for f in found], "text": [" ".join(t for _, t in sorted(f[1], key=lambda p: p[0])) for f in found]})
        for c in page:
            out[c] = group[c].iloc[0]
        return out[[*page, "row_no", "y", "text"]]

    return items.groupBy(*page).applyInPandas(fold, schema)


def sentences(text: Column) -> Column:
    """Sentences of a text with their marks; runs of white space count as one blank."""
    whole = F.trim(F.regexp_replace(text, f"{SPACE}+", " "))
    found = F.transform(F.regexp_extract_all(whole, F.lit("[^。！？；;]+[。！？；;]?"), 0), lambda s: F.trim(s))
    return F.filter(F.when(F.size(found) > 0, found).otherwise(F.array(whole)), lambda s: s != "")


def buffered(pieces: Column, least: int = 95) -> Column:
    """Sentences collected into paragraphs: a paragraph ends with a sentence that has a semicolon, with one by which it
    reaches `least` characters, and with its second sentence; what is left open at the end is one more."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        now = F.concat(acc["open"], s)
        full = (acc["open"] != "") | (F.length(now) >= least) | s.rlike("[；;]")
        return F.struct(F.when(full, F.array_append(acc["done"], now)).otherwise(acc["done"]).alias("done"), F.when(full, F.lit("")).otherwise(now).alias("open"))

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))


def without_overlaps(matches: Column) -> Column:
    """Of matches (start, end, ...) those that don't overlap an earlier one: by start, the longest first."""
    ordered = F.array_sort(matches, lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["end"] != b["end"], F.when(a["end"] > b["end"], -1).otherwise(1)).otherwise(0))
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda acc, m: F.when((F.size(acc) == 0) | (m["start"] >= F.try_element_at(acc, F.lit(-1))["end"]), F.array_append(acc, m)).otherwise(acc))
