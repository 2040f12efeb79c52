"""Joins and folds of the import: answer keys, materials, pages, merged lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_answers(questions: DataFrame, key: DataFrame, keys: list[str], last_wins: bool = False) -> DataFrame:
    """Questions with the answer of their key, found (the key has a row) and free (its answer is null).

    Of repeated keys the first counts, or the last; key has keys, order and answer."""
    pick = F.max_by if last_wins else F.min_by
    k = key.groupBy(*keys).agg(pick(F.struct("answer"), F.col("order")).alias("k"))
    q = questions.drop("answer").join(k, keys, "left")
    return q.withColumn("found", F.col("k").isNotNull()).withColumn("free", F.col("k").isNotNull() & F.col("k.answer").isNull()).withColumn("answer", F.coalesce("k.answer", F.lit("0"))).drop("k")


def merged_materials(questions: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Materials of accepted results (found, not empty) over those of the questions."""
    r = results.where(F.col("found") & (F.size("materials") > 0)).select(key, F.col("materials").alias("_new")).dropDuplicates([key])
    return questions.join(r, key, "left").withColumn("materials", F.coalesce("_new", "materials")).drop("_new")


def with_material(materials: Column, material: Column, first: bool = False) -> Column:
    """Adds a material unless one with the same type, title and content is there."""
    same = lambda m: m["type"].eqNullSafe(material["type"]) & m["title"].eqNullSafe(material["title"]) & m["content"].eqNullSafe(material["content"])
    old = F.coalesce(materials, F.array().cast("array<struct<type:string,title:string,content:string,notes:string>>"))
    added = F.concat(F.array(material), old) if first else F.concat(old, F.array(material))
    return F.when(material.isNull() | F.exists(old, same), old).otherwise(added)


def candidate_pages(questions: DataFrame, pages: DataFrame, snippet: int = 24) -> DataFrame:
    """(doc_id, row_id, page): pages that hold the question's first `snippet` characters (blanks ignored), and the page
    behind each; all pages of the document if none does. Within one document, so the join is an equi-join."""
    q = questions.select("doc_id", "row_id", F.substring(F.regexp_replace("question", r"\s+", ""), 1, snippet).alias("s"))
    p = pages.select("doc_id", "page", F.regexp_replace("text", r"\s+", "").alias("t"))
    hits = q.where("s <> ''").join(p, "doc_id").where(F.contains("t", F.col("s"))).select("doc_id", "row_id", "page")
    near = hits.select("doc_id", "row_id", F.explode(F.array(F.col("page"), F.col("page") + 1)).alias("page")).distinct().join(p.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    none = q.join(hits.select("row_id").distinct(), "row_id", "left_anti").join(p, "doc_id").select("doc_id", "row_id", "page")
    return near.select("doc_id", "row_id", "page").unionByName(none)


def merge_lines(lines: list[str], start: str = r"^\d{1,3}\s*[.、．]", answer: str = r"^[（(][○╳×OX1-4]+[)）]$", look: int = 5) -> list[str]:
    """Greedy merging: a line that is only an answer goes in front of the next line, a line with an open bracket takes in
    up to `look` following ones until it is closed, and lines that begin no question go on with the one before."""
    out: list[str] = []
    held = ""
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if re.match(answer, line):
            held += line
            continue
        taken = 0
        while line.count("（") + line.count("(") > line.count("）") + line.count(")") and taken < look and i < len(lines) and not re.match(start, lines[i]):
            line, taken, i = line + lines[i], taken + 1, i + 1
        opens = bool(re.match(start, line)) or bool(held)
        line, held = held + line, ""
        if out and not opens:
            out[-1] += " " + line
        else:
            out.append(line)
    return out + ([held] if held else [])


def merged_lines(rows: DataFrame, key: str) -> DataFrame:
    """merge_lines for every document (a bounded group): (key, no, line)."""
    @F.pandas_udf("array<string>")
    def merged(lists: pd.Series) -> pd.Series:
        return pd.Series([merge_lines(list(l)) for l in lists])

    by = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("l"))
    return by.select(key, F.posexplode(merged(F.transform("l", lambda x: x["line"]))).alias("no", "line"))


def expanded(x0: Column, y0: Column, x1: Column, y1: Column, margin: float, width: Column, height: Column) -> Column:
    """A rectangle grown by a margin and kept within its page."""
    z = F.lit(0.0)
    return F.struct(F.greatest(x0 - margin, z).alias("x0"), F.greatest(y0 - margin, z).alias("y0"), F.least(x1 + margin, width).alias("x1"), F.least(y1 + margin, height).alias("y1"))


def split_at(text: Column, x: Column, width: Column, border: Column) -> Column:
    """A text item cut where a column border crosses it, by interpolation over its characters."""
    n = F.round(F.length(text) * F.least(F.greatest((border - x) / F.nullif(width, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).cast("int")
    return F.struct(F.substring(text, F.lit(1), n).alias("left"), F.substring(text, n + 1, F.length(text)).alias("right"))


def ranked(value: Column, order: list[str]) -> Column:
    """Place of a value in a fixed list, values outside it behind."""
    at = F.array_position(F.array(*[F.lit(v) for v in order]), value)
    return F.when(at == 0, len(order) + 1).otherwise(at).cast("int")


def largest(*arrays: Column) -> Column:
    """The longest of several arrays, the first of equals."""
    best = arrays[0]
    for a in arrays[1:]:
        best = F.when(F.size(a) > F.size(best), a).otherwise(best)
    return best
