"""Text queries over documents and questions: normalization, segmentation, laws, changelog."""

from __future__ import annotations

from pyspark.sql import functions as F

from examforge.functions import text as T
from examforge.operators import audit, changelog, laws, quality, segment
from examforge.plans.base import Plans, table

plans = Plans()

LINES = """
    SELECT doc_id, source, published_at, CAST(no AS INTEGER) AS no, line FROM (
      SELECT doc_id, source, published_at, generate_subscripts(l, 1) - 1 AS no, trim(unnest(l), chr(32) || chr(9) || chr(12288)) AS line
      FROM (SELECT doc_id, source, published_at, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM documents)) WHERE line <> ''
"""
_SP = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_EAST = "[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{F900}-\\x{FAFF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEE}]"
_HAN = "[\\x{3400}-\\x{9fff}]"


def _spaced(c: str) -> str:
    t = f"translate(translate({c}, '\uf9e4\uf9dd\uf9ca\uf9ea', '理利流離'), '／～〜－—％（）［］：', '/~~--%()[]:')"
    t = f"regexp_replace(regexp_replace({t}, '({_EAST})([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])({_EAST})', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({t}, '{_SP}+', ' ', 'g'), ' ')"


@plans.add(f"SELECT doc_id, md5({_spaced('text')}) AS digest, CAST(length({_spaced('text')}) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL")
def text_normalize(spark, d):
    t = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", T.spaced(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


def _phrased(c: str) -> str:
    for p in T.PHRASES:
        c = f"regexp_replace({c}, '{p.replace(' ', _SP + '+')}', '{p.replace(' ', '')}', 'g')"
    return c


_PAIRED = ", ".join(f"'{p}'" for p in T.JOIN_PAIRS)
# every gap as one chunk, every other character as its own, as the scan from the left finds them
_JOINED = f"""array_to_string(list_transform(regexp_extract_all({_phrased('question')}, '(?s){_HAN}{_SP}+{_HAN}|.'), lambda c:
    CASE WHEN length(c) > 1 AND (contains('{T.JOIN_LEFT}', c[1]) OR contains('{T.JOIN_RIGHT}', c[-1]) OR c[1] || c[-1] IN ({_PAIRED})) THEN c[1] || c[-1] ELSE c END), '')"""


@plans.add(f"""
    SELECT row_id, {_JOINED} AS joined, CAST(len(regexp_extract_all(question, '{_HAN}{_SP}+{_HAN}')) AS INTEGER) AS gaps FROM questions WHERE regexp_matches(question, '{_HAN}{_SP}+{_HAN}')""")
def gap_repair(spark, d):
    q = table(spark, d, "questions").select("row_id", "question")
    return q.select("row_id", T.gaps_joined(F.col("question")).alias("joined"), T.gap_count(F.col("question")).alias("gaps")).where("gaps > 0")


_TOKENS = f"list_filter(string_split_regex(o, '{_SP}+'), lambda t: t <> '')"


@plans.add(f"""
    SELECT row_id, place, coalesce(len(regexp_extract_all(o, '{_HAN}{_SP}+{_HAN}')) >= 2 AND NOT regexp_matches(o, '[、。，；：？！,.;:!?]')
           AND (len({_TOKENS}) >= 4 OR len(list_filter({_TOKENS}, lambda t: regexp_matches(t, '{_HAN}'))) >= 3), false) AS sheet
    FROM (SELECT row_id, CAST(generate_subscripts(options, 1) - 1 AS INTEGER) AS place, unnest(options) AS o FROM questions)""")
def table_like_options(spark, d):
    o = table(spark, d, "questions").select("row_id", F.posexplode("options").alias("place", "o"))
    return o.select("row_id", "place", F.coalesce(T.looks_like_table(F.col("o")), F.lit(False)).alias("sheet"))


@plans.add(f"""
    SELECT row_id, field, before, after FROM (
      SELECT row_id, 'question' AS field, question AS before, {_spaced('question')} AS after FROM questions
      UNION ALL SELECT row_id, 'options', array_to_string(options, chr(31)), {_spaced("array_to_string(options, chr(31))")} FROM questions)
    WHERE before IS DISTINCT FROM after""")
def normalization_changes(spark, d):
    q = table(spark, d, "questions").select("row_id", "question", F.array_join("options", "\x1f").alias("options"))
    return quality.changes(q, "row_id", {n: (F.col(n), T.spaced(F.col(n))) for n in ("question", "options")})


_STEM_SQL = "lower(regexp_replace(question, '[^\\p{L}\\p{N}_]', '', 'g'))"


@plans.add(f"""
    WITH s AS (SELECT row_id, bank, {_STEM_SQL} AS stem FROM questions), k AS (SELECT * FROM s WHERE length(stem) >= 10),
    g AS (SELECT stem, list_sort(list(DISTINCT bank)) AS names FROM k GROUP BY stem HAVING count(DISTINCT bank) > 1)
    SELECT k.row_id, array_to_string(g.names, ';') AS names FROM k JOIN g ON g.stem = k.stem""")
def repeat_stems(spark, d):
    r = audit.repeated_stems(table(spark, d, "questions"), "row_id", "question", "bank")
    return r.select("row_id", F.array_join("names", ";").alias("names"))


_NOISE = "|".join(f"({p})" for p in T.NOISE.values())
CLEAN = f"SELECT * FROM ({LINES}) WHERE NOT regexp_matches(trim(line), '{_NOISE}')"


@plans.add(f"SELECT source, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(trim(line), '{_NOISE}')) AS n_noise FROM ({LINES}) GROUP BY source")
def noise_lines(spark, d):
    docs = table(spark, d, "documents")
    rows = segment.lines(docs.select(F.struct("doc_id", "source").alias("doc_id"), "text"))
    return rows.groupBy(F.col("doc_id.source").alias("source")).agg(F.count("*").alias("n_lines"), F.count_if(T.noise_line(F.col("line"))).alias("n_noise"))


_TITLE = "^(重點整理：|單元\\s*\\d+|【.+】|小結|\\d+、)"


@plans.add(f"""
    SELECT doc_id, no, last_value(CASE WHEN regexp_matches(line, '{_TITLE}') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading
    FROM ({LINES})""")
def line_state_machine(spark, d):
    rows = segment.lines(table(spark, d, "documents"))
    rows = segment.carried(rows, "doc_id", {"heading": F.when(F.col("line").rlike(_TITLE), F.col("line"))})
    return rows.select("doc_id", "no", "heading")


@plans.add(f"""
    SELECT doc_id, CAST(group_no AS BIGINT) AS group_no, string_agg(line, ' ' ORDER BY no) AS text, CAST(count(*) AS INTEGER) AS n_lines FROM (
      SELECT doc_id, no, line, sum(CASE WHEN regexp_matches(line, '^\\d{{1,3}}\\s*[.、．]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS group_no
      FROM ({LINES})) GROUP BY doc_id, group_no""")
def line_sessions(spark, d):
    rows = segment.lines(table(spark, d, "documents"))
    return segment.sessions(rows, "doc_id", F.col("line").rlike(r"^\d{1,3}\s*[.、．]"))


@plans.add(f"""
    WITH r AS (SELECT doc_id, no, line, nullif(regexp_extract(line, '^(\\d{{1,3}})\\s*[.、．]\\s*(.+)$', 1), '') AS number, nullif(regexp_extract(line, '^[(（]([A-H])[)）]\\s*(.*)$', 1), '') AS letter
               FROM ({CLEAN})),
    q AS (SELECT *, count(number) OVER (PARTITION BY doc_id ORDER BY no) AS q_no FROM r),
    s AS (SELECT *, count(letter) OVER (PARTITION BY doc_id, q_no ORDER BY no) AS slot FROM q WHERE q_no > 0),
    t AS (SELECT doc_id, q_no, slot, max(number) AS number, string_agg(CASE WHEN letter IS NOT NULL THEN regexp_extract(line, '^[(（]([A-H])[)）]\\s*(.*)$', 2)
          WHEN number IS NOT NULL THEN regexp_extract(line, '^(\\d{{1,3}})\\s*[.、．]\\s*(.+)$', 2) ELSE line END, ' ' ORDER BY no) AS t FROM s GROUP BY doc_id, q_no, slot)
    SELECT doc_id, q_no, CAST(max(number) AS INTEGER) AS number, max(CASE WHEN slot = 0 THEN t END) AS stem, coalesce(string_agg(t, chr(31) ORDER BY slot) FILTER (WHERE slot > 0), '') AS options
    FROM t GROUP BY doc_id, q_no""")
def exam_questions(spark, d):
    q = segment.question_records(table(spark, d, "documents"))
    return q.withColumn("options", F.array_join("options", "\x1f"))


@plans.add(f"""
    SELECT doc_id, no, lag(line) OVER (PARTITION BY doc_id ORDER BY no) AS previous, lead(line) OVER (PARTITION BY doc_id ORDER BY no) AS following FROM ({LINES})""")
def prev_next_segment(spark, d):
    rows = segment.lines(table(spark, d, "documents"))
    return segment.neighbours(rows, "doc_id", "no", "line").select("doc_id", "no", "previous", "following")


@plans.add(f"""
    WITH RECURSIVE r AS (SELECT doc_id, no, CAST(nullif(regexp_extract(line, '^(\\d{{1,3}})\\s*[.、．]\\s*(.+)$', 1), '') AS INTEGER) AS number FROM ({CLEAN})),
    l AS (SELECT doc_id, list(number ORDER BY no) AS l FROM r WHERE number IS NOT NULL GROUP BY doc_id),
    f AS (SELECT doc_id, l, 1 AS i, 0 AS top FROM l UNION ALL SELECT doc_id, l, i + 1, CASE WHEN l[i] = top + 1 THEN top + 1 ELSE top END FROM f WHERE i <= len(l))
    SELECT doc_id, array_to_string(range(1, top + 1), ',') AS accepted FROM f WHERE i = len(l) + 1""")
def accepted_numbers(spark, d):
    q = segment.question_records(table(spark, d, "documents"))
    by = q.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("q_no", "number"))).alias("l"))
    return by.select("doc_id", F.array_join(segment.accepted(F.transform("l", lambda x: x["number"])).cast("array<string>"), ",").alias("accepted"))


@plans.add(f"""
    SELECT numeral, CAST(numeral AS INTEGER) AS n FROM (SELECT DISTINCT regexp_extract(line, '^第\\s*([0-9]+)\\s*條', 1) AS numeral FROM ({LINES})) WHERE numeral <> ''""")
def article_numerals(spark, d):
    h = segment.lines(table(spark, d, "documents")).select(F.regexp_extract("line", laws.HEADING, 1).alias("numeral")).where("numeral <> ''").distinct()
    return h.select("numeral", T.chinese_number(F.col("numeral")).alias("n")).where(F.col("n").isNotNull())


_HEAD = "^第\\s*([0-9]+)\\s*條[\\s　]*(.*)$"
_LAW = f"""
    SELECT doc_id, pos, article, coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (WHERE mode = 't' AND body <> ''), '') AS text,
           coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (WHERE mode = 'e' AND body <> ''), '') AS explanation FROM (
      SELECT doc_id, no, body, max(CASE WHEN head THEN no END) OVER w AS pos, last_value(CASE WHEN head THEN 't' WHEN expl THEN 'e' END IGNORE NULLS) OVER w AS mode,
             last_value(CASE WHEN head THEN number END IGNORE NULLS) OVER w AS article FROM (
        SELECT doc_id, no, regexp_matches(line, '{_HEAD}') AS head, regexp_matches(line, '^解釋[：:]') AS expl, CAST(TRY_CAST(regexp_extract(line, '{_HEAD}', 1) AS INTEGER) AS VARCHAR) AS number,
               CASE WHEN regexp_matches(line, '{_HEAD}') THEN regexp_extract(line, '{_HEAD}', 2) WHEN regexp_matches(line, '^解釋[：:]') THEN regexp_extract(line, '^解釋[：:]\\s*(.*)$', 1) ELSE line END AS body
        FROM ({CLEAN}))
      WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE pos IS NOT NULL GROUP BY doc_id, pos, article
"""
_SEQ = f"SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS seq FROM ({_LAW})"


@plans.add(f"""
    SELECT doc_id, seq, article AS article_no, '未分章' AS chapter, text, explanation, lag(article) OVER (PARTITION BY doc_id ORDER BY pos) AS previous_no FROM ({_SEQ})""")
def law_articles(spark, d):
    return laws.previous(laws.articles(table(spark, d, "documents")))


@plans.add(f"SELECT doc_id, CAST(1 AS BIGINT) AS chapters, count(*) AS articles FROM ({_SEQ}) GROUP BY doc_id")
def law_sizes(spark, d):
    return laws.sizes(laws.articles(table(spark, d, "documents")))


@plans.add(f"SELECT doc_id, article AS article_no, max(seq) AS seq FROM ({_SEQ}) GROUP BY ALL")
def law_index(spark, d):
    return laws.indexed(laws.articles(table(spark, d, "documents")))


@plans.add(f"""
    SELECT doc_id, seq AS place, 'article' AS kind, '未分章 / 第 ' || article || ' 條' AS label FROM ({_SEQ})
    UNION ALL SELECT doc_id, 0, 'summary', coalesce(title, '') || '重點整理' FROM documents WHERE doc_id IN (SELECT doc_id FROM ({_SEQ}))""")
def law_deck(spark, d):
    docs = table(spark, d, "documents")
    return laws.deck(laws.articles(docs), docs.select("doc_id", "title"))


_REF = "([\\p{Han}]{2,20}?(?:規則|辦法|條例|細則|基準|要點|法))第\\s*([0-9]+)\\s*條"


@plans.add(f"""
    SELECT law, article_no, CAST(sum(n) AS BIGINT) AS n, count(*) AS documents FROM (
      SELECT doc_id, regexp_extract(m, '{_REF}', 1) AS law, CAST(CAST(regexp_extract(m, '{_REF}', 2) AS INTEGER) AS VARCHAR) AS article_no, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_REF}')) AS m FROM documents) GROUP BY ALL)
    GROUP BY law, article_no""")
def law_references(spark, d):
    refs = laws.references(table(spark, d, "documents"), ["doc_id"], "text")
    return refs.groupBy("law", "article_no").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


# no title of the tables' documents stands before a mention, and neither 本法 nor 前條 occurs in them: the rules that
# read the context are in the queries over literal rows
@plans.add(f"""
    WITH s AS ({_SEQ}), f AS (SELECT doc_id, seq, 'text' AS field, text AS v FROM s UNION ALL SELECT doc_id, seq, 'explanation', explanation FROM s),
    m AS (SELECT doc_id, seq, field, unnest(regexp_extract_all(v, '第\\s*[0-9]+\\s*條')) AS t FROM f),
    i AS (SELECT doc_id, article, max(seq) AS target_seq FROM s GROUP BY ALL)
    SELECT DISTINCT m.doc_id AS source, m.seq, m.field, m.t AS text, m.doc_id AS target, i.target_seq, i.article AS target_no, 'same-law' AS method, CAST(0.9 AS DOUBLE) AS confidence
    FROM m JOIN i ON i.doc_id = m.doc_id AND i.article = CAST(CAST(regexp_extract(m.t, '([0-9]+)', 1) AS INTEGER) AS VARCHAR) WHERE i.target_seq <> m.seq""")
def law_links(spark, d):
    docs = table(spark, d, "documents")
    return laws.links(laws.articles(docs), docs.select("doc_id", "title"))


@plans.add(f"""
    SELECT strftime(published_at, '%Y-%m-%d') AS day, CAST(count(*) AS INTEGER) AS n, string_agg(regexp_replace(line, '^-\\s*', ''), chr(10) ORDER BY doc_id, no) AS items
    FROM ({LINES}) WHERE source = 'changelog_posts' AND published_at IS NOT NULL GROUP BY ALL""")
def changelog_rollup(spark, d):
    docs = table(spark, d, "documents").where((F.col("source") == "changelog_posts") & F.col("published_at").isNotNull())
    docs = docs.select(F.struct(F.date_format("published_at", "yyyy-MM-dd").alias("day"), "doc_id").alias("doc_id"), "text")
    entries = segment.lines(docs).select("doc_id.day", "doc_id.doc_id", "no", F.regexp_replace("line", r"^-\s*", "").alias("message"))
    return changelog.by_day(entries, "day", ["doc_id", "no"], "message")


@plans.add(f"""
    WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(trim(regexp_replace(text, '{_SP}+', ' ', 'g')), '[^。！？；;]+[。！？；;]?'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
    f AS (SELECT doc_id, l, 1 AS i, '' AS open, CAST([] AS VARCHAR[]) AS done FROM s
      UNION ALL SELECT doc_id, l, i + 1, CASE WHEN open <> '' OR length(open || l[i]) >= 95 OR regexp_matches(l[i], '[；;]') THEN '' ELSE open || l[i] END,
             CASE WHEN open <> '' OR length(open || l[i]) >= 95 OR regexp_matches(l[i], '[；;]') THEN list_append(done, open || l[i]) ELSE done END FROM f WHERE i <= len(l))
    SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS no, unnest(p) AS paragraph FROM (SELECT doc_id, CASE WHEN open <> '' THEN list_append(done, open) ELSE done END AS p FROM f WHERE i = len(l) + 1)""")
def paragraph_buffers(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.posexplode(segment.buffered(segment.sentences(F.col("text")))).alias("no", "paragraph"))
