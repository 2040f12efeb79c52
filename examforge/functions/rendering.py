"""Rows as text: options, materials, questions for export."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULE = "-" * 50


def option_lines(options: Column) -> Column:
    """`A. first` and so on, a line each."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")


def row_values(raw: Column) -> Column:
    """Values of a table's row written as a JSON array or object, in order; null for anything else."""
    return F.when(F.ltrim(raw).startswith("{"), F.map_values(F.from_json(raw, "map<string,string>"))).when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>"))


def material_text(materials: Column) -> Column:
    """Title and content of texts, tables as Markdown where they have headers and rows, a placeholder for images, notes
    below. Materials without headers and rows of their own are written by title and content."""

    def one(m: Column) -> Column:
        body = F.concat(F.coalesce(m["title"], F.lit("")), F.lit("\n"), F.coalesce(m["content"], F.lit("")))
        text = F.when(F.lower(m["type"]) == "image", F.concat(F.lit("[image] "), F.coalesce(m["title"], F.lit("")))).otherwise(F.btrim(body, F.lit("\n")))
        return F.concat(text, F.coalesce(F.concat(F.lit("\n"), m["notes"]), F.lit("")))

    return F.array_join(F.transform(materials, one), "\n")


def table_text(title: Column, headers: Column, rows: Column, notes: Column) -> Column:
    """A table material: title, Markdown table, notes, a line each, missing ones skipped."""
    return F.concat_ws("\n", F.nullif(title, F.lit("")), markdown_table(headers, rows), F.nullif(notes, F.lit("")))


def markdown_table(headers: Column, rows: Column) -> Column:
    """A table of arrays as Markdown lines."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    rule = line(F.transform(headers, lambda _: F.lit("---")))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")


def question_text(question: Column, options: Column, letters: Column) -> Column:
    return F.concat_ws("\n", question, option_lines(options), F.concat(F.lit("Answer: "), letters))


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
