"""Bank catalogue: metadata from file names, facets, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examforge.operators.history import or_empty

#: Subjects under other names, categories of joint examinations, sources of the traffic track, and the word by which a
#: traffic bank is known where the index doesn't have it (fixed values).
ALIASES = {
    "公文及法學緒論": "公文與法學緒論",
    "公文與農田水利相關法規": "公文與法學緒論",
    "法學緒論": "公文與法學緒論",
    "灌溉排水概要": "農田灌溉排水概要",
    "農業概要": "農業概論",
}
CATEGORIES = {"統測專二": "商業與管理群", "統測農概": "農業群"}
TRAFFIC_SOURCES = ("交通部",)
TRAFFIC_WORD = "交通部"
#: Forms of a bank file's stem: joint examination, traffic, and a leading year (fixed values).
JOINT = r"^(\d{3})(統測[^-]+)-(.+)$"
TRAFFIC = r"^交通部(\d{3})(?:-(\d+))?-(.+)$"
LEADING_YEAR = r"^(\d{3})\s*(?=\S)(.+)$"


def stem_of(file: Column) -> Column:
    """File name without folder, ending and the number of a copy."""
    return F.regexp_replace(F.trim(F.regexp_extract(file, r"([^/]+)\.json$", 1)), r"\s*\(\d+\)$", "")


def _titled(stem: Column) -> Column:
    """Underscores as blanks, one blank around hyphens, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(stem, F.lit("_"), F.lit(" ")), r"\s*-\s*", " - "), r"\s+", " "))


def _aliased(subject: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, subject), subject)


def bank_parts(file: Column, known_year: Column | None = None) -> dict[str, Column]:
    """year, source, category, subject, original and shown of a bank, by the three families of file names.

    known_year: the year that the folder of the bank's source file gives, which goes before one in the name (but for the
    first two families, which always carry their own).
    """
    stem = stem_of(file)
    given = F.nullif(F.trim(known_year), F.lit("")) if known_year is not None else F.lit(None).cast("string")
    part = lambda form, i: F.regexp_extract(stem, form, i)
    joint, traffic = stem.rlike(JOINT), stem.rlike(TRAFFIC)
    name = _titled(stem)
    year = F.coalesce(given, F.nullif(F.regexp_extract(name, LEADING_YEAR, 1), F.lit("")), F.lit(""))
    rest = F.when((year != "") & F.startswith(name, year), F.trim(F.substring(name, F.length(year) + 1, F.length(name)))).otherwise(name)
    pieces = F.filter(F.transform(F.split(rest, " - "), lambda x: F.trim(x)), lambda x: x != "")
    last = F.coalesce(F.try_element_at(pieces, F.lit(-1)), rest)
    subject = _aliased(last)
    context = F.array_join(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), " / ")
    bureau = F.coalesce(year.try_cast("int") >= 113, F.lit(False))
    common = F.when(subject == "公文與法學緒論", "共同科目").otherwise("專業科目")
    category = F.when(bureau & (context == "農田水利署"), common).otherwise(context)
    round_ = F.when(part(TRAFFIC, 2) != "", F.concat(F.lit("第"), part(TRAFFIC, 2), F.lit("梯次"))).otherwise(F.lit("年度檢定"))
    choose = lambda a, b, c: F.when(joint, a).when(traffic, b).otherwise(c)
    known = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return {
        "stem": stem,
        "year": choose(part(JOINT, 1), part(TRAFFIC, 1), year),
        "source": choose(part(JOINT, 2), F.lit("交通部"), F.when(bureau, "農田水利署").otherwise("農田水利")),
        "category": choose(F.coalesce(F.try_element_at(known, part(JOINT, 2)), F.lit("")), round_, category),
        "subject": choose(_aliased(part(JOINT, 3)), part(TRAFFIC, 3), subject),
        "original": choose(part(JOINT, 3), part(TRAFFIC, 3), last),
        "shown": choose(
            F.concat_ws(" ", part(JOINT, 1), _aliased(part(JOINT, 3))), F.concat(part(TRAFFIC, 1), F.lit(" "), part(TRAFFIC, 3), F.lit("（"), round_, F.lit("）")), F.trim(F.concat_ws(" ", year, subject))
        ),
    }


def bank_name(file: Column, known_year: Column | None = None) -> Column:
    """Name of a bank for lists: year, subject and, in brackets, what stands between them in the file name."""
    name = _titled(stem_of(file))
    if known_year is not None:
        given = F.coalesce(F.trim(known_year), F.lit(""))
        name = F.when((given != "") & ~F.startswith(name, given), F.concat(given, F.lit(" "), name)).otherwise(name)
    name = F.regexp_replace(name, r"^(\d{3})(?=\S)", "$1 ")
    pieces = F.filter(F.transform(F.split(F.regexp_extract(name, r"^\d{3}\s+(.+)$", 1), " - "), lambda x: F.trim(x)), lambda x: x != "")
    context = F.array_join(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), " / ")
    return F.when(F.size(pieces) > 1, F.concat(F.substring(name, 1, 3), F.lit(" "), F.element_at(pieces, -1), F.lit("（"), context, F.lit("）"))).otherwise(name)


def is_traffic(source: Column, file: Column) -> Column:
    """Whether a bank belongs to the traffic track: by its source where the index has it, else by its file name."""
    return F.coalesce(F.when(source.isNotNull(), source.isin(*TRAFFIC_SOURCES)), F.contains(F.coalesce(file, F.lit("")), F.lit(TRAFFIC_WORD)))


def in_track(rows: DataFrame, track: str | None, index: DataFrame | None = None, bank: str = "bank") -> DataFrame:
    """Rows whose bank belongs to the track `traffic`, or to the other one (any other name); all rows without a track.
    index: file, source."""
    if not track:
        return rows
    if index is None:
        return rows.where(is_traffic(F.lit(None).cast("string"), F.col(bank)) == (track == "traffic"))
    known = index.groupBy(F.col("file").alias("_file")).agg(F.max(F.coalesce("source", F.lit(""))).alias("_source"))  # a row a bank
    met = rows.join(known, F.col("_file") == F.col(bank), "left")
    return met.where(is_traffic(F.col("_source"), F.col(bank)) == (track == "traffic")).drop("_file", "_source")


def collection(source: Column, subject: Column, name: Column, track: str | None = None) -> Column:
    """The shelf of a bank. In the traffic track by the first of three words in subject or name; else by its source."""
    if track == "traffic":
        has = lambda word: F.contains(F.coalesce(subject, F.lit("")), F.lit(word)) | F.contains(F.coalesce(name, F.lit("")), F.lit(word))
        return F.when(has("構造"), "traffic-structure").when(has("駕駛"), "traffic-theory").otherwise("traffic-law")
    return F.when(F.coalesce(source, F.lit("")) == "統測專二", "tve-business").otherwise("irrigation")


def label(collection_id: Column, titles: dict[str, str]) -> Column:
    """Title of a shelf, its id where none is known."""
    out = collection_id
    for k, v in titles.items():
        out = F.when(collection_id == k, F.lit(v)).otherwise(out)
    return out


def filled(banks: DataFrame, source: str = "農田水利") -> DataFrame:
    """Missing or empty sources get the default one, missing subjects the bank's name."""
    return banks.withColumn("source", F.coalesce(or_empty("source"), F.lit(source))).withColumn("subject", F.coalesce(or_empty("subject"), F.col("name")))


def meta(source: Column, category: Column, original: Column, subject: Column) -> Column:
    """Source, category and the original subject where it differs, blanks skipped."""
    return F.concat_ws(" / ", F.nullif(source, F.lit("")), F.nullif(category, F.lit("")), F.when(~original.eqNullSafe(subject), F.nullif(original, F.lit(""))))


def facets(banks: DataFrame, track: str | None = None) -> DataFrame:
    """Banks and questions by collection, and a grand total `all`."""
    b = banks.withColumn("collection", collection(F.col("source"), F.col("subject"), F.col("name"), track))
    r = b.rollup("collection").agg(F.count("*").alias("banks"), F.sum("n_questions").alias("questions"), F.grouping("collection").alias("g"))
    return r.select(F.when(F.col("g") == 1, "all").otherwise(F.col("collection")).alias("collection"), "banks", "questions")


def search(banks: DataFrame, words: str, wanted: str | None = None, subject: str | None = None, track: str | None = None, titles: dict[str, str] | None = None) -> DataFrame:
    """Case-insensitive substring of nine fields (year, subject, original subject, source, title of the collection,
    category, name, displayed name, file; empty ones are skipped), within a collection and a subject."""
    shelf = collection(F.col("source"), F.col("subject"), F.col("name"), track)
    fields = [F.col("year_label"), F.col("subject"), F.col("originalsubject"), F.col("source"), label(shelf, titles or {}), F.col("category"), F.col("name"), F.col("displayname"), F.col("file")]
    b = banks.where(F.contains(F.lower(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in fields])), F.lit(words.strip().lower())))
    if wanted:
        b = b.where(shelf == wanted)
    return b.where(F.col("subject") == subject) if subject else b


def subjects(banks: DataFrame, order: str) -> DataFrame:
    """Distinct subjects in first-seen order."""
    s = banks.where(or_empty("subject").isNotNull()).groupBy("subject").agg(F.min(order).alias("first"))
    return s.withColumn("place", F.row_number().over(Window.orderBy("first")))  # a row a subject


def ordered(banks: DataFrame) -> DataFrame:
    """By year (999 where it is missing), then name; place counts from 1."""
    year = F.coalesce(or_empty("year_label").try_cast("int"), F.lit(999))
    return banks.withColumn("year", year).withColumn("place", F.row_number().over(Window.orderBy("year", "displayname", "file")))  # a row a bank
