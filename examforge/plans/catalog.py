"""Catalogue queries over banks and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from examforge.operators import catalog
from examforge.plans.base import Plans, table

plans = Plans()
_STEM = "regexp_replace(trim(regexp_extract(file, '([^/]+)\\.json$', 1)), '\\s*\\(\\d+\\)$', '')"
_ALIAS = "CASE {s} WHEN '公文及法學緒論' THEN '公文與法學緒論' WHEN '公文與農田水利相關法規' THEN '公文與法學緒論' WHEN '法學緒論' THEN '公文與法學緒論' WHEN '灌溉排水概要' THEN '農田灌溉排水概要' WHEN '農業概要' THEN '農業概論' ELSE {s} END"
_PARTS = f"""
    SELECT file, stem, CASE WHEN joint THEN j1 WHEN traffic THEN t1 ELSE year END AS year,
           CASE WHEN joint THEN j2 WHEN traffic THEN '交通部' WHEN TRY_CAST(nullif(year, '') AS INTEGER) >= 113 THEN '農田水利署' ELSE '農田水利' END AS source,
           CASE WHEN joint THEN CASE j2 WHEN '統測專二' THEN '商業與管理群' WHEN '統測農概' THEN '農業群' ELSE '' END
                WHEN traffic THEN CASE WHEN t2 <> '' THEN '第' || t2 || '梯次' ELSE '年度檢定' END
                WHEN TRY_CAST(nullif(year, '') AS INTEGER) >= 113 AND context = '農田水利署' THEN CASE WHEN subject = '公文與法學緒論' THEN '共同科目' ELSE '專業科目' END ELSE context END AS category,
           CASE WHEN joint THEN {_ALIAS.format(s='j3')} WHEN traffic THEN t3 ELSE subject END AS subject,
           CASE WHEN joint THEN j3 WHEN traffic THEN t3 ELSE last END AS original
    FROM (SELECT *, {_ALIAS.format(s='last')} AS subject FROM (
      SELECT *, coalesce(pieces[-1], rest) AS last, array_to_string(pieces[1:len(pieces) - 1], ' / ') AS context FROM (
        SELECT *, list_filter(list_transform(string_split(rest, ' - '), lambda x: trim(x)), lambda x: x <> '') AS pieces FROM (
          SELECT *, CASE WHEN year <> '' THEN trim(substr(name, 4)) ELSE name END AS rest FROM (
            SELECT *, regexp_extract(name, '^(\\d{{3}})\\s*\\S', 1) AS year FROM (
              SELECT file, {_STEM} AS stem, trim(regexp_replace(regexp_replace(replace({_STEM}, '_', ' '), '\\s*-\\s*', ' - ', 'g'), '\\s+', ' ', 'g')) AS name,
                     regexp_matches({_STEM}, '^\\d{{3}}統測[^-]+-.+$') AS joint, regexp_matches({_STEM}, '^交通部\\d{{3}}(-\\d+)?-.+$') AS traffic,
                     regexp_extract({_STEM}, '^(\\d{{3}})(統測[^-]+)-(.+)$', 1) AS j1, regexp_extract({_STEM}, '^(\\d{{3}})(統測[^-]+)-(.+)$', 2) AS j2, regexp_extract({_STEM}, '^(\\d{{3}})(統測[^-]+)-(.+)$', 3) AS j3,
                     regexp_extract({_STEM}, '^交通部(\\d{{3}})(-(\\d+))?-(.+)$', 1) AS t1, regexp_extract({_STEM}, '^交通部(\\d{{3}})(-(\\d+))?-(.+)$', 3) AS t2, regexp_extract({_STEM}, '^交通部(\\d{{3}})(-(\\d+))?-(.+)$', 4) AS t3
              FROM banks))))))"""
_SHELF = "CASE WHEN coalesce(source, '') = '統測專二' THEN 'tve-business' ELSE 'irrigation' END"
_TRAFFIC = "coalesce(source IN ('交通部'), contains(file, '交通部'))"


@plans.add(_PARTS)
def catalog_from_paths(spark, d):
    parts = catalog.bank_parts(F.col("file"))
    return table(spark, d, "banks").select("file", *[parts[n].alias(n) for n in ("stem", "year", "source", "category", "subject", "original")])


@plans.add(f"""
    WITH b AS (SELECT {_SHELF} AS collection, n_questions FROM banks)
    SELECT collection, count(*) AS banks, CAST(sum(n_questions) AS BIGINT) AS questions FROM b GROUP BY collection
    UNION ALL SELECT 'all', count(*), CAST(sum(n_questions) AS BIGINT) FROM b""")
def catalog_facets(spark, d):
    return catalog.facets(table(spark, d, "banks"))


@plans.add("""
    SELECT collection, count(*) AS banks, CAST(sum(n_questions) AS BIGINT) AS questions FROM (
      SELECT CASE WHEN contains(concat(subject, chr(1), name), '構造') THEN 'traffic-structure' WHEN contains(concat(subject, chr(1), name), '駕駛') THEN 'traffic-theory' ELSE 'traffic-law' END AS collection, n_questions FROM banks)
    GROUP BY ROLLUP (collection) HAVING collection IS NOT NULL
    UNION ALL SELECT 'all', count(*), CAST(sum(n_questions) AS BIGINT) FROM banks""")
def catalog_facets_traffic(spark, d):
    return catalog.facets(table(spark, d, "banks"), "traffic")


@plans.add(f"""
    SELECT file, concat_ws(' / ', nullif(source, ''), nullif(category, ''), CASE WHEN originalsubject IS DISTINCT FROM subject THEN nullif(originalsubject, '') END) AS meta FROM banks
    WHERE {_SHELF} = 'irrigation' AND contains(lower(concat_ws(' ', nullif(year_label, ''), nullif(subject, ''), nullif(originalsubject, ''), nullif(source, ''), '農田水利招考', nullif(category, ''), nullif(name, ''), nullif(displayname, ''), nullif(file, ''))), '農業')""")
def catalog_search(spark, d):
    found = catalog.search(table(spark, d, "banks"), " 農業", "irrigation", titles={"irrigation": "農田水利招考"})
    return found.select("file", catalog.meta(F.col("source"), F.col("category"), F.col("originalsubject"), F.col("subject")).alias("meta"))


@plans.add(f"SELECT file, CASE WHEN {_TRAFFIC} THEN 'traffic' ELSE 'irrigation' END AS track FROM banks")
def bank_tracks(spark, d):
    b = table(spark, d, "banks").select(F.col("file").alias("bank"), "source")
    index = b.select(F.col("bank").alias("file"), "source")
    both = [catalog.in_track(b.select("bank"), t, index).withColumn("track", F.lit(t)) for t in ("traffic", "irrigation")]
    return both[0].unionByName(both[1]).select(F.col("bank").alias("file"), "track")


@plans.add("SELECT file, coalesce(nullif(source, ''), '農田水利') AS source, coalesce(nullif(subject, ''), name) AS subject FROM banks")
def catalog_defaults(spark, d):
    return catalog.filled(table(spark, d, "banks")).select("file", "source", "subject")


@plans.add("""
    SELECT subject, first, CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS place FROM (SELECT subject, min(file) AS first FROM banks WHERE subject <> '' GROUP BY subject)""")
def subject_list(spark, d):
    return catalog.subjects(table(spark, d, "banks"), "file")


@plans.add("""
    SELECT file, coalesce(TRY_CAST(nullif(year_label, '') AS INTEGER), 999) AS year,
           CAST(row_number() OVER (ORDER BY coalesce(TRY_CAST(nullif(year_label, '') AS INTEGER), 999), displayname, file) AS INTEGER) AS place FROM banks""")
def bank_order(spark, d):
    return catalog.ordered(table(spark, d, "banks")).select("file", "year", "place")


@plans.add("""
    SELECT coalesce(b.file, q.bank) AS file, b.n_questions AS said, coalesce(q.n, 0) AS found FROM banks b
    FULL JOIN (SELECT bank, count(*) AS n FROM questions GROUP BY bank) q ON q.bank = b.file WHERE b.n_questions IS DISTINCT FROM q.n""")
def bank_count_audit(spark, d):
    q = table(spark, d, "questions").groupBy("bank").agg(F.count("*").alias("n"))
    b = table(spark, d, "banks").join(q, F.col("bank") == F.col("file"), "full").where(~F.col("n_questions").cast("bigint").eqNullSafe(F.col("n")))
    return b.select(F.coalesce("file", "bank").alias("file"), F.col("n_questions").alias("said"), F.coalesce("n", F.lit(0)).alias("found"))


@plans.add("SELECT DISTINCT bank FROM documents WHERE bank IS NOT NULL AND bank NOT IN (SELECT bank FROM overrides WHERE bank IS NOT NULL)")
def incremental_sync(spark, d):
    known = table(spark, d, "overrides").select("bank")
    return table(spark, d, "documents").select("bank").where(F.col("bank").isNotNull()).distinct().join(known, "bank", "left_anti")


@plans.add("""
    SELECT q.row_id, coalesce(nullif(b.displayname, ''), regexp_extract(q.bank, '([^/]+)\\.json$', 1)) AS label FROM questions q LEFT JOIN banks b ON b.file = q.bank""")
def bank_labels(spark, d):
    b = table(spark, d, "banks").select(F.col("file").alias("bank"), "displayname")
    q = table(spark, d, "questions").select("row_id", "bank").join(b, "bank", "left")
    return q.select("row_id", F.coalesce(F.nullif("displayname", F.lit("")), F.regexp_extract("bank", r"([^/]+)\.json$", 1)).alias("label"))
