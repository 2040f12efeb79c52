"""The queries of the text operators, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from examforge.llm import confusables, formatdup, leakage, mixture, mojibake, neardup, scanfix, splitter
from examforge.llm.common import read


def p1_found(spark, d):
    return mojibake.repaired_fields(read(spark, d, "questions")).select("row_id", "field_no")


def p1_repaired(spark, d):
    return mojibake.repaired_fields(read(spark, d, "questions"))


def p2_found(spark, d):
    return confusables.normalized_fields(read(spark, d, "questions")).select("row_id", "field_no")


def p2_normalized(spark, d):
    return confusables.normalized_fields(read(spark, d, "questions"))


#: Fields of problem 2, what becomes of them and what was odd; the words between them make up the vocabulary.
FORMS = (
    ("第５9組 ＫＣ-４８", "第59組 KC-48", "full_width"), ("⽤⽔\ufeff庫", "用水庫", "ideograph,invisible"), ("甲\u00a0乙", "甲 乙", "space"), ("A\u030astro\u0308m", "Åström", "combining"),
    ("the l\u0435ft valve", "the left valve", "lookalike"), ("以919kP\u0430為上限，編\u041a\u0421-78", "以919kPa為上限，編KC-78", "lookalike"), ("7.2k\u0420\u0430", "7.2kPa", "lookalike"),
)
UNTOUCHED = ("left valve left kPa kPa KC-1", "the KC-2", "夾角α與β", "係數χ與κ", "Привет", "q\u0445zzz", "3℃ 5㎡ 7Ω 9μm，（）％　", "")


def p2_literal(spark, d):
    texts = [t for t, _, _ in FORMS] + list(UNTOUCHED)
    fields = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "row_id bigint, field_no bigint, text string")
    return confusables.normalized(fields, fields, None).select("row_id", "normalized", "kinds")


def p3_found(spark, d):
    return formatdup.copy_pairs(read(spark, d, "questions")).select(F.col("first_id").alias("row_id_a"), F.col("row_id").alias("row_id_b"))


def p3_copy_counts(spark, d):
    return formatdup.collapsed(read(spark, d, "questions")).select("row_id", "n_copies")


def p4_found(spark, d):
    return neardup.row_pairs(read(spark, d, "questions")).select("row_id_a", "row_id_b")


def p4_groups(spark, d):
    return neardup.groups(read(spark, d, "questions"))


def p5_found(spark, d):
    return scanfix.repaired_fields(read(spark, d, "questions")).select("row_id", "field_no")


def p5_repaired(spark, d):
    return scanfix.repaired_fields(read(spark, d, "questions"))


def p6_found(spark, d):
    return leakage.exact_leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p6_edited(spark, d):
    return leakage.edited_leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p7_found(spark, d):
    return mixture.plan(mixture.token_counts(read(spark, d, "documents")), read(spark, d, "mix_targets")).where("short").select("source")


def p7_mixture(spark, d):
    return mixture.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))[0]


def p7_report(spark, d):
    return mixture.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))[1]


def p8_found(spark, d):
    cut = splitter.pieces(read(spark, d, "documents"), read(spark, d, "split_limits"), with_text=False)
    return cut.where("piece_no = 0").select("doc_id").distinct()


def p8_pieces(spark, d):
    return splitter.pieces(read(spark, d, "documents"), read(spark, d, "split_limits"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
