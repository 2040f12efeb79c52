"""Reading banks, histories, overrides, law texts and positioned text with explicit schemas.

Malformed files give no rows instead of failing a load; every row keeps the file it came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from examforge import schemas
from examforge.operators.catalog import is_traffic


def _json(spark: SparkSession, schema, paths: str | list[str]) -> DataFrame:
    """Array or object files; unreadable ones give no rows."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    return reader.json(paths)


def banks(spark: SparkSession, paths: str | list[str], picked: DataFrame | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """Questions of bank files with `bank`, the path from `questions/` on. picked (bank, id) is a pushed-down selection;
    skip lists file stems that are left out."""
    q = _json(spark, schemas.QUESTION, paths).withColumn("_path", F.col("_metadata.file_path"))
    stem = F.regexp_extract(F.url_decode("_path"), r"([^/]+)\.json$", 1)
    q = q.withColumn("bank", F.concat(F.lit("questions/"), stem, F.lit(".json"))).where(~stem.isin(*skip, "")).drop("_path")
    return q if picked is None else q.join(picked.select("bank", "id"), ["bank", "id"], "left_semi")


def bank_index(spark: SparkSession, paths: str | list[str], skip: tuple[str, ...] = ("questions",)) -> DataFrame:
    """(file, count) of bank files, the legacy default bank left out, in order of file."""
    return banks(spark, paths, skip=skip).groupBy(F.col("bank").alias("file")).agg(F.count("*").cast("int").alias("count"))


def history(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sessions of the attempt log as stored, nested."""
    return _json(spark, schemas.SESSION, paths)


def flattened(sessions: DataFrame, order: str = "session_id") -> DataFrame:
    """Nested sessions as attempts (session_id, pos, bank, qid, user_answer, correct); positions count from 0."""
    s = sessions.select(order, F.col("bank").alias("s_bank"), "date_iso", F.posexplode_outer("answers").alias("pos", "a"))
    return s.where(F.col("a").isNotNull()).select(
        order, "pos", F.coalesce(F.nullif("a.bank", F.lit("")), F.nullif("s_bank", F.lit(""))).alias("bank"), F.col("a.qid").alias("qid"),
        F.col("a.userAnswer").alias("user_answer"), F.col("a.correct").alias("correct"), "date_iso",
    )


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """A map of bank to map of question to patch, as rows (bank, qid, answer, warning, amendmenturl, repeats, freescore).
    A file that can't be read gives no rows."""
    text = spark.read.option("ignoreMissingFiles", True).text(path, wholetext=True)
    maps = text.select(F.from_json("value", schemas.OVERRIDES).alias("m")).where(F.col("m").isNotNull())
    by_bank = maps.select(F.explode("m").alias("bank", "q"))
    rows = by_bank.select("bank", F.explode("q").alias("qid", "p"))
    return rows.select("bank", "qid", "p.answer", "p.warning", F.col("p.amendmentUrl").alias("amendmenturl"), "p.repeats", F.col("p.freeScore").alias("freescore"))


def law_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(doc_id, title, text) of law text files; the title is the first line that isn't blank."""
    t = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))
    first = F.get(F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != ""), F.lit(0))
    return t.select("doc_id", F.trim(first).alias("title"), "text")


def positioned(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, page, width, text, x, y, item_width) of layout files."""
    p = _json(spark, schemas.PAGES, paths).select(F.col("_metadata.file_name").alias("file"), F.posexplode("pages").alias("page", "p"))
    return p.select("file", "page", F.col("p.width").alias("width"), F.explode("p.text_items").alias("i")).select("file", "page", "width", "i.text", "i.x", "i.y", F.col("i.width").alias("item_width"))


def version_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(day, time, message) of lines `timestamp<TAB>message`; the written offset is kept, other lines are left out."""
    v = spark.read.text(paths).where(F.contains("value", F.lit("\t")))
    at, message = F.split_part("value", F.lit("\t"), F.lit(1)), F.substring_index("value", "\t", -1)
    return v.select(F.substring(at, 1, 10).alias("day"), F.substring(at, 12, 5).alias("time"), message.alias("message"))


def year_map(spark: SparkSession, root: str, suffix: str = "*.pdf") -> DataFrame:
    """(stem, folder) of files below root; of repeated stems the last path counts. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(root).select("path")
    parts = files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"))
    return parts.groupBy("stem").agg(F.max_by("folder", "path").alias("folder"))


def only_file(spark: SparkSession, root: str, suffix: str) -> str:
    """The one file below root whose name ends with suffix; an error that lists what was found otherwise."""
    found = [r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path").limit(20).collect()]
    if len(found) != 1:
        raise ValueError(f"expected one file *{suffix} in {root}, found {sorted(found)}")
    return found[0]


def amendments(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Amendment files of several laws in one frame, each row tagged with its law: law name -> path."""
    out = None
    for law, path in paths.items():
        rows = _json(spark, schemas.AMENDMENT, path).select(F.lit(law).alias("law"), "*")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "law string, article_no string, date_roc string, text string, reason string") if out is None else out


def laws(spark: SparkSession, path: str, layouts: str | None = None, links: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, layout blocks, references) of the law files; the second and the third one are optional and give no rows
    where they are missing. articles: doc_id, title, seq, chapter, article_no, text, explanation."""
    raw = _json(spark, schemas.LAW, path)
    a = raw.select(F.col("id").alias("doc_id"), "title", F.posexplode("chapters").alias("c_no", "c")).select("doc_id", "title", "c_no", F.col("c.title").alias("chapter"), F.posexplode("c.articles").alias("a_no", "a"))
    w = Window.partitionBy("doc_id").orderBy("c_no", "a_no")
    articles = a.select("doc_id", "title", F.row_number().over(w).alias("seq"), "chapter", F.col("a.no").alias("article_no"), "a.text", "a.explanation")
    blocks = _json(spark, "source string, blocks array<struct<type:string,text:string,items:array<string>>>", [layouts] if layouts else []) if layouts else spark.createDataFrame([], "source string, blocks array<struct<type:string,text:string,items:array<string>>>")
    refs = "refs array<struct<field:string,text:string,targetLawId:string,targetArticleId:string,targetLawTitle:string,targetArticleTitle:string,confidence:double,method:string>>"
    found = _json(spark, f"source string, {refs}", links) if links else spark.createDataFrame([], f"source string, {refs}")
    return articles, blocks, found.select("source", F.explode("refs").alias("r")).select("source", "r.*")


def bank_maps(banks_: DataFrame) -> DataFrame:
    """(file, label, traffic) of a bank index: the displayed name, else the name, else the file's stem, and the track."""
    stem = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    label = F.coalesce(F.nullif("displayname", F.lit("")), F.nullif("name", F.lit("")), stem)
    return banks_.select("file", label.alias("label"), is_traffic(F.col("source"), F.col("file")).alias("traffic"))


def changelog(spark: SparkSession, path: str, placeholder: str = "") -> DataFrame:
    """(day, time, message) of a changelog file, an array of days with items; a file that is none or empty gives one row
    with the placeholder."""
    days = _json(spark, "date string, items array<struct<time:string,message:string>>", path).where(F.col("date").isNotNull())
    rows = days.select(F.col("date").alias("day"), F.explode("items").alias("i")).select("day", "i.time", "i.message")
    return rows if not rows.isEmpty() else spark.createDataFrame([(None, None, placeholder)], "day string, time string, message string")


def unreadable(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, problem): files that aren't an array of objects, for reports next to what was read."""
    t = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("v"))
    parsed = F.try_parse_json("v")
    return t.where(parsed.isNull() | ~F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False))).select("file", F.when(F.try_parse_json("v").isNull(), "unreadable").otherwise("no list").alias("problem"))
