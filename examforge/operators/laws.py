"""Law texts: chapters, articles, explanations, reading decks, and references between articles in their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examforge.functions import text as T
from examforge.operators import segment
from examforge.session import checkpointed, small

_NUMERAL = "[0-9零〇一二兩三四五六七八九十百]+"
CHAPTER = rf"^第\s*({_NUMERAL})\s*章\s*(.*)$"
HEADING = rf"^第\s*({_NUMERAL}(?:[-－—][0-9]+)?)\s*條(?:之\s*({_NUMERAL}))?[\s　]*(.*)$"
EXPLANATION = r"^解釋[：:]\s*(.*)$"
REFERENCE = r"([\p{IsHan}]{2,20}?(?:規則|辦法|條例|細則|基準|要點|法))第\s*([0-9一二三四五六七八九十百]+)\s*條"
NO_CHAPTER = "未分章"


def number(main: Column, sub: Column) -> Column:
    """Number of an article: `12`, or `12-1` for 之 and for dashes; null where one of its numerals is none."""
    whole = F.translate(main, "－—", "--")
    sub_no = F.coalesce(F.nullif(sub, F.lit("")), F.nullif(F.regexp_extract(whole, "-(.*)$", 1), F.lit("")))
    main_no = T.chinese_number(F.substring_index(whole, "-", 1)).cast("string")
    return F.when(sub_no.isNull(), main_no).otherwise(F.concat(main_no, F.lit("-"), T.chinese_number(sub_no).cast("string")))


def articles(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seq, article_no, chapter, text, explanation): a heading line opens an article, `解釋：` its explanation, other
    lines go on with what is open; a chapter line closes the article, and what stands between it and the next heading is
    left out. Numbers are normalized whether they are written in Chinese or Arabic digits."""
    rows = segment.without_noise(segment.lines(documents, key))
    line = F.col("line")
    part = lambda form, i: F.regexp_extract("line", form, i)
    rows = rows.withColumn("heading", F.when(line.rlike(HEADING), number(part(HEADING, 1), part(HEADING, 2))))
    title = F.trim(F.concat(F.lit("第 "), part(CHAPTER, 1), F.lit(" 章 "), F.trim(part(CHAPTER, 2))))
    rows = rows.withColumn("opens", F.when(line.rlike(CHAPTER), title))
    rows = rows.withColumn("mode", F.when(F.col("heading").isNotNull(), "text").when(F.col("opens").isNotNull(), "none").when(line.rlike(EXPLANATION), "explanation"))
    marked = F.when(F.col("heading").isNotNull() | F.col("opens").isNotNull(), F.struct("no", F.col("heading").isNotNull().alias("article")))
    rows = segment.carried(rows, key, {"mark": marked, "in": F.col("mode"), "chapter": F.col("opens")}).where(F.coalesce(F.col("mark.article"), F.lit(False)))
    body = F.when(F.col("heading").isNotNull(), part(HEADING, 3)).when(F.col("mode") == "explanation", part(EXPLANATION, 1)).otherwise(line)
    rows = rows.withColumn("at", F.col("mark.no")).withColumn("body", body)

    def joined(mode: str):
        parts = F.array_sort(F.collect_list(F.when((F.col("in") == mode) & (F.col("body") != ""), F.struct("no", "body"))))
        return F.array_join(F.transform(parts, lambda x: x["body"]), "\n")

    out = rows.groupBy(key, "at").agg(F.max("heading").alias("article"), F.coalesce(F.max("chapter"), F.lit(NO_CHAPTER)).alias("chapter"), joined("text").alias("text"), joined("explanation").alias("explanation"))
    w = Window.partitionBy(key).orderBy("at")
    return out.select(key, F.row_number().over(w).alias("seq"), F.col("article").alias("article_no"), "chapter", "text", "explanation")


def previous(found: DataFrame, key: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy("seq")
    return found.withColumn("previous_no", F.lag("article_no").over(w))


def indexed(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, article_no, seq): of several articles of one number the last one counts."""
    return found.groupBy(key, "article_no").agg(F.max("seq").alias("seq"))


def sizes(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """By law: chapters (those that articles stand in) and articles."""
    by = found.groupBy(key, "chapter").agg(F.count("*").alias("n"))
    return by.groupBy(key).agg(F.count("*").alias("chapters"), F.sum("n").alias("articles"))


def deck(found: DataFrame, titles: DataFrame, key: str = "doc_id", chapter: str | None = None) -> DataFrame:
    """(key, place, kind, label): for each law a summary card (place 0) and a card an article, of one chapter or of all.

    titles: key, title."""
    cards = found if chapter is None else found.where(F.col("chapter") == chapter)
    w = Window.partitionBy(key).orderBy("seq")
    cards = cards.select(key, F.row_number().over(w).alias("place"), F.lit("article").alias("kind"), F.concat_ws(" / ", "chapter", F.concat(F.lit("第 "), "article_no", F.lit(" 條"))).alias("label"))
    first = titles.join(found.select(key).distinct(), key, "left_semi").select(key, F.lit(0).alias("place"), F.lit("summary").alias("kind"), F.concat(F.coalesce("title", F.lit("")), F.lit("重點整理")).alias("label"))
    return first.unionByName(cards)


def references(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, law, article_no, n): laws with article numbers named in a text, once each with the number of mentions.

    Only texts with an article sign are looked at, and a match is taken apart once."""
    found = rows.where(F.contains(text, F.lit("條"))).select(*key, F.explode(F.regexp_extract_all(text, F.lit(REFERENCE), 0)).alias("m"))
    found = found.groupBy(*key, "m").agg(F.count("*").alias("n"))  # repeated matches are one row before anything is parsed
    split = found.select(*key, F.substring_index("m", "第", -1).alias("no"), F.expr("left(m, length(m) - length(substring_index(m, '第', -1)) - 1)").alias("law"), "n")
    named = split.select(*key, "law", T.chinese_number(F.trim(F.regexp_replace("no", "條$", ""))).cast("string").alias("article_no"), "n")
    return named.groupBy(*key, "law", "article_no").agg(F.sum("n").alias("n"))


#: A mention of an article without a law's name, of the article before, and what the context is read by (fixed values).
MENTION = rf"第\s*({_NUMERAL})\s*條(?:\s*之\s*({_NUMERAL}))?"
BEFORE = "前條"
SENTENCE_ENDS = "。；;：:\n"
THIS_LAW = "本法"
POINTERS = "這些規定|上述規定|前述規定|分別是|包含|包括|依據|根據"
#: Rules and regulations under a law, by title: there 本法 means that law (fixed values).
PARENTS = {
    "水利法施行細則": "水利法", "水污染防治法施行細則": "水污染防治法", "土壤及地下水污染整治法施行細則": "土壤及地下水污染整治法",
    "農田水利法施行細則": "農田水利法", "農田灌溉排水管理辦法": "農田水利法", "灌溉管理組織設置辦法": "農田水利法",
}
NEARBY, PREFIX = 120, 36


def mentions(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seq, field, pos, mark, article_no, sentence, nearby, prefix): every mention of an article in texts and
    explanations with what stands before it: its sentence, the last NEARBY and the last PREFIX characters, all without
    white space. Places are sums of the lengths of the pieces between the mentions."""
    fields = found.select(key, "seq", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("text", "explanation")])).alias("f")).select(key, "seq", "f.*")
    fields = fields.where(F.contains("value", F.lit("條")))
    marks, pieces = F.regexp_extract_all("value", F.lit(MENTION), 0), F.split("value", MENTION, -1)
    state = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<pos:int,mark:string>>").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        pos = acc["end"] + F.length(x["piece"])
        return F.struct((pos + F.length(x["mark"])).alias("end"), F.array_append(acc["at"], F.struct(pos.alias("pos"), x["mark"].alias("mark"))).alias("at"))

    each = F.zip_with(marks, F.slice(pieces, 1, F.size(marks)), lambda m, p: F.struct(p.alias("piece"), m.alias("mark")))
    rows = fields.withColumn("m", F.explode(F.aggregate(each, state, step, lambda acc: acc["at"]))).select(key, "seq", "field", "value", "m.*")
    bare = lambda c: F.regexp_replace(c, f"{T.SPACE}+", "")
    last = lambda n: bare(F.substr("value", F.greatest(F.col("pos") - n + 1, F.lit(1)), F.least(F.col("pos"), F.lit(n))))
    sentence = F.substring_index(F.translate(F.substr("value", F.lit(1), F.col("pos")), SENTENCE_ENDS, "\x1e" * len(SENTENCE_ENDS)), "\x1e", -1)
    no = number(F.regexp_extract("mark", MENTION, 1), F.regexp_extract("mark", MENTION, 2))
    return rows.select(key, "seq", "field", "pos", "mark", no.alias("article_no"), bare(sentence).alias("sentence"), last(NEARBY).alias("nearby"), last(PREFIX).alias("prefix")).where(F.col("article_no").isNotNull())


def titles_within(rows: DataFrame, id_: str, text: str, laws: DataFrame, longest: int = 64) -> DataFrame:
    """(id, law, at_end): the law whose title ends last in the text, the longer of two that end together, and whether it
    ends the text. laws: law, title.

    Titles are met by equality with the parts of the text that may be one: those that end with a title's last character
    and have a title's length. Both sets are bounded, by the alphabet and by `longest`; longer titles are left out.
    """
    named = laws.where(F.length("title").between(1, longest)).groupBy("title").agg(F.max("law").alias("law"))
    shape = named.agg(F.collect_set(F.right("title", F.lit(1))).alias("ends"), F.collect_set(F.length("title")).alias("lengths")).first()
    if not shape["ends"]:
        return rows.select(id_, F.lit(None).cast(dict(laws.dtypes)["law"]).alias("law"), F.lit(False).alias("at_end")).limit(0)
    place = F.sequence(F.lit(1), F.length(text))
    ends = rows.where(F.length(text) > 0).select(id_, text, F.explode(F.filter(place, lambda i: F.substr(text, i, F.lit(1)).isin(*shape["ends"]))).alias("end"))
    parts = ends.withColumn("n", F.explode(F.array(*map(F.lit, sorted(shape["lengths"]))))).where(F.col("n") <= F.col("end"))
    parts = parts.select(id_, "end", "n", (F.col("end") == F.length(text)).alias("at_end"), F.substr(text, F.col("end") - F.col("n") + 1, F.col("n")).alias("title"))
    met = parts.join(small(named), "title")
    return met.groupBy(id_).agg(F.max_by(F.struct("law", "at_end"), F.struct("end", "n")).alias("t")).select(id_, "t.law", "t.at_end")


def links(found: DataFrame, laws: DataFrame, key: str = "doc_id") -> DataFrame:
    """(source, seq, field, text, target, target_seq, target_no, method, confidence): references of articles to articles.

    A mention belongs to the law whose title stands last before it in its sentence (sentence-law-context); else, where
    本法 stands there, to the law that this one is made under or to this one (this-law); else, where a pointing word is
    near, to the law whose title stands last nearby (nearby-law-context); else to this law (same-law, 0.9). 前條 is the
    article before. Mentions of articles that don't exist and of the article itself are left out, and of equal ones
    (field, text, target) in an article the first stays. found: articles(); laws: key, title.
    """
    named = laws.select(F.col(key).alias("law"), "title").where(F.coalesce("title", F.lit("")) != "")
    # a mention's contexts are compared by their text, so that repeated ones are looked up once
    found = checkpointed(found)
    m = checkpointed(mentions(found, key))
    in_sentence = titles_within(m.select("sentence").distinct(), "sentence", "sentence", named).select("sentence", F.col("law").alias("s_law"))
    near = titles_within(m.where(F.col("nearby").rlike(POINTERS)).select("nearby").distinct(), "nearby", "nearby", named).select("nearby", F.col("law").alias("n_law"))
    explicit = titles_within(m.select("prefix").distinct(), "prefix", "prefix", named).where("at_end").select("prefix", F.col("law").alias("p_law"))
    parent = F.try_element_at(F.create_map(*[F.lit(x) for pair in PARENTS.items() for x in pair]), F.col("title"))
    by_title = named.groupBy("title").agg(F.max("law").alias("parent_law")).withColumnRenamed("title", "parent_title")
    own = named.select(F.col("law").alias(key), parent.alias("parent_title")).where(F.col("parent_title").isNotNull()).join(by_title, "parent_title").select(key, "parent_law")
    rows = m.join(in_sentence, "sentence", "left").join(near, "nearby", "left").join(explicit, "prefix", "left").join(own, key, "left")
    this = F.contains("sentence", F.lit(THIS_LAW))
    method = F.when(F.col("s_law").isNotNull(), "sentence-law-context").when(this, "this-law").when(F.col("n_law").isNotNull(), "nearby-law-context").when(F.col("p_law").isNotNull(), "explicit-law").when(F.col("prefix").endswith(THIS_LAW), "this-law").otherwise("same-law")
    target = F.when(F.col("s_law").isNotNull(), F.col("s_law")).when(this, F.coalesce("parent_law", key)).otherwise(F.coalesce("n_law", "p_law", key))
    rows = rows.select(F.col(key).alias("source"), "seq", "field", "pos", F.col("mark").alias("text"), target.alias("target"), F.col("article_no").alias("target_no"), method.alias("method"))
    index = indexed(found, key).select(F.col(key).alias("target"), F.col("article_no").alias("target_no"), F.col("seq").alias("target_seq"))
    rows = rows.join(index, ["target", "target_no"])

    w = Window.partitionBy(key).orderBy("seq")
    prior = found.select(key, "seq", "text", "explanation", F.lag("article_no").over(w).alias("target_no"), F.lag("seq").over(w).alias("target_seq")).where(F.col("target_no").isNotNull())
    says = F.filter(F.array(*[F.struct(F.lit(c).alias("field"), F.instr(c, BEFORE).alias("pos")) for c in ("text", "explanation")]), lambda f: f["pos"] > 0)
    prior = prior.select(key, "seq", "target_no", "target_seq", F.explode(says).alias("f"))
    # 前條 goes before numbered mentions of the same text and target, which it never equals
    prior = prior.select(F.col(key).alias("source"), "seq", "f.field", F.col("f.pos").alias("pos"), F.lit(BEFORE).alias("text"), F.col(key).alias("target"), "target_no", F.lit("previous-article").alias("method"), "target_seq")
    rows = rows.unionByName(prior).where(~((F.col("source") == F.col("target")) & (F.col("seq") == F.col("target_seq"))))
    kept = rows.groupBy("source", "seq", "field", "text", "target", "target_seq").agg(F.min_by(F.struct("target_no", "method"), "pos").alias("k"))
    return kept.select("source", "seq", "field", "text", "target", "target_seq", "k.*", F.when(F.col("k.method") == "same-law", 0.9).otherwise(1.0).alias("confidence"))


def links_by_article(found: DataFrame) -> DataFrame:
    """(source, seq, field, refs): the references of links() of each article and field in one list, by text and target."""
    refs = F.array_sort(F.collect_list(F.struct("text", "target", "target_no", "method")))
    return found.groupBy("source", "seq", "field").agg(refs.alias("refs"))


def with_extras(found: DataFrame, layouts: DataFrame, refs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Articles with their layout blocks and references, null where there are none. layouts: key, seq, blocks; refs: of
    links_by_article, whose fields are put into one map."""
    maps = refs.groupBy(F.col("source").alias(key), "seq").agg(F.map_from_entries(F.collect_list(F.struct("field", "refs"))).alias("refs"))
    return found.join(layouts, [key, "seq"], "left").join(maps, [key, "seq"], "left")


def valid_links(refs: DataFrame) -> DataFrame:
    """References that have a field, a text, and both parts of a target."""
    ok = F.lit(True)
    for c in ("field", "text", "target", "target_no"):
        ok = ok & (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return refs.where(ok)
