"""Explicit schemas of the input files; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B, TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MATERIAL = struct(type=S, title=S, headers=T.ArrayType(S), rows=T.ArrayType(T.ArrayType(S)), notes=S, src=S, alt=S, content=S, markdown=S)
#: `answer` is an integer, a list of integers or null in the files: read as text, normalized by grading.answers().
QUESTION = struct(id=I, question=S, options=T.ArrayType(S), answer=S, noShuffle=B, freeScore=B, group=S, groupId=S, materials=T.ArrayType(MATERIAL))
ANSWER = struct(qid=I, bank=S, userAnswer=S, correct=B)
SESSION = struct(date=S, date_iso=TS, total=I, correct=I, wrong=I, skip=I, score=I, elapsed=I, bank=S, answers=T.ArrayType(ANSWER))
PATCH = struct(answer=S, warning=S, amendmentUrl=S, repeats=T.ArrayType(S), freeScore=B)
OVERRIDES = T.MapType(S, T.MapType(S, PATCH))
BANK = struct(file=S, name=S, displayName=S, year=S, source=S, category=S, subject=S, originalSubject=S, count=I)
ARTICLE = struct(id=S, no=S, title=S, text=S, explanation=S)
CHAPTER = struct(id=S, no=S, title=S, articles=T.ArrayType(ARTICLE))
LAW = struct(id=S, title=S, sourceFile=S, summary=T.ArrayType(S), chapters=T.ArrayType(CHAPTER), chapterCount=I, articleCount=I)
TEXT_ITEM = struct(text=S, x=T.DoubleType(), y=T.DoubleType(), width=T.DoubleType())
PAGES = struct(pages=T.ArrayType(struct(width=T.DoubleType(), text_items=T.ArrayType(TEXT_ITEM))))
AMENDMENT = struct(article_no=S, date_roc=S, text=S, reason=S)
