"""Quiz assembly over questions, overrides and the attempt log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from examforge.functions import grading, parsing, rendering
from examforge.operators import imports, quiz, segment
from examforge.plans.attempts import LOG, log
from examforge.plans.base import Plans, table
from examforge.plans.texts import LINES

plans = Plans()
TYPE = "CASE WHEN answer IS NULL THEN NULL WHEN answer LIKE '[%' THEN 'mc' WHEN len(options) = 2 THEN 'tf' WHEN len(options) > 2 THEN 'sc' END"
ANSWERS = "CASE WHEN answer IS NULL THEN NULL ELSE CAST(string_split(regexp_replace(answer, '[\\[\\] ]', '', 'g'), ',') AS INTEGER[]) END"
UNIFORM = "((('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT + 1) / 4294967296.0)"


@plans.add(f"SELECT row_id, {TYPE} AS qtype FROM questions")
def question_types(spark, d):
    return quiz.with_type(table(spark, d, "questions").select("row_id", "options", "answer")).select("row_id", "qtype")


@plans.add("""
    SELECT q.row_id, coalesce(o.answer, q.answer) AS answer, CAST(coalesce(o.freescore, q.freescore) AS VARCHAR) AS freescore, nullif(o.warning, '') AS warning,
           nullif(o.amendmenturl, '') AS amendmenturl, CASE WHEN len(o.repeats) > 0 THEN array_to_string(o.repeats, ';') END AS repeats
    FROM questions q LEFT JOIN overrides o ON o.bank = q.bank AND o.qid = CAST(q.id AS VARCHAR)""")
def override_patch(spark, d):
    q = quiz.patched(table(spark, d, "questions").select("row_id", "bank", "id", "answer", "freescore"), table(spark, d, "overrides"))
    return q.select("row_id", "answer", F.col("freescore").cast("string").alias("freescore"), "warning", "amendmenturl", F.array_join("repeats", ";").alias("repeats"))


@plans.add("SELECT bank, count(*) FILTER (WHERE warning <> '') AS n_warnings FROM overrides GROUP BY bank")
def warning_counts(spark, d):
    return table(spark, d, "overrides").groupBy("bank").agg(F.count_if(F.col("warning") != "").alias("n_warnings"))


@plans.add("""
    SELECT count(*) AS entries, count(*) FILTER (WHERE warning <> '') AS warnings, count(*) FILTER (WHERE freescore) AS free, count(DISTINCT bank) AS banks FROM overrides""")
def override_totals(spark, d):
    return table(spark, d, "overrides").agg(F.count("*").alias("entries"), F.count_if(F.col("warning") != "").alias("warnings"), F.count_if("freescore").alias("free"), F.count_distinct("bank").alias("banks"))


@plans.add("""
    SELECT row_id, min(row_id) OVER (PARTITION BY key) AS block, count(*) OVER (PARTITION BY key) AS block_size FROM (
      SELECT row_id, coalesce(bank || chr(30) || coalesce(nullif(groupid, ''), t.title || chr(31) || coalesce(t.content, '')), 's' || row_id) AS key
      FROM (SELECT row_id, bank, groupid, list_filter(materials, lambda m: m.type = 'text' AND regexp_matches(coalesce(m.title, ''), '^閱讀資料（第\\s*\\d+\\s*[-－~～]\\s*\\d+\\s*題）$'))[1] AS t FROM questions))""")
def question_blocks(spark, d):
    q = quiz.blocks(table(spark, d, "questions").select("row_id", "bank", "groupid", "materials"))
    return q.select("row_id", "block", "block_size")


@plans.add(f"""
    WITH n AS (SELECT bank, qid, count(*) AS times FROM ({LOG}) WHERE answered GROUP BY bank, qid)
    SELECT row_id, CAST(row_number() OVER (PARTITION BY bank ORDER BY k, row_id) AS INTEGER) AS place FROM (
      SELECT q.row_id, q.bank, round(-ln({UNIFORM.format(seed="7", key="q.row_id")}) * (1.0 + coalesce(n.times, 0)) * (1.0 + coalesce(n.times, 0)), 9) AS k
      FROM questions q LEFT JOIN n ON n.bank = q.bank AND n.qid = q.id)
    QUALIFY place <= 20""")
def weighted_order(spark, d):
    n = log(spark, d).where("answered").groupBy("bank", F.col("qid").alias("id")).agg(F.count("*").alias("times"))
    q = table(spark, d, "questions").select("row_id", "bank", "id").join(n, ["bank", "id"], "left")
    q = q.withColumn("k", F.round(quiz.sampling_key("7", F.coalesce("times", F.lit(0)), F.col("row_id")), 9))
    return q.withColumn("place", F.row_number().over(Window.partitionBy("bank").orderBy("k", "row_id"))).where("place <= 20").select("row_id", "place")


@plans.add(f"SELECT row_id, {UNIFORM.format(seed='3', key='row_id')} AS u FROM questions ORDER BY u, row_id LIMIT 50")
def shuffled_sample(spark, d):
    q = table(spark, d, "questions").select("row_id", quiz.uniform("3", F.col("row_id")).alias("u"))
    return q.orderBy("u", "row_id").limit(50)


BLOCKS = plans.sql["question_blocks"]


@plans.add(f"""
    WITH b AS (SELECT block, max(block_size) AS size FROM ({BLOCKS}) GROUP BY block),
    q AS (SELECT b.block, b.size, q.bank FROM b JOIN questions q ON q.row_id = b.block)
    SELECT bank, block, size, taken_before FROM (
      SELECT bank, block, size, CAST(coalesce(sum(size) OVER (PARTITION BY bank ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS taken_before FROM q)
    WHERE taken_before < 25""")
def block_take_overshoot(spark, d):
    b = quiz.blocks(table(spark, d, "questions").select("row_id", "bank", "groupid", "materials")).groupBy("bank", "block").agg(F.count("*").alias("size"))
    return quiz.take_blocks(b, ["bank"], ["block"], "size", 25)


def _exact(sized: str, wanted: int) -> str:
    """SQL of the exact selection from (bank, block, size, place): the fold over the blocks, one step a row. goal: what
    blocks kept so far have to give up for block i, looked for from the latest one (k) on by the bits of their sums."""
    return f"""
    WITH RECURSIVE g AS (SELECT bank, list({{'b': block, 'n': size}} ORDER BY place) AS l FROM ({sized}) WHERE size BETWEEN 1 AND {wanted} GROUP BY bank),
    f AS (SELECT bank, l, 1 AS i, l[1:0] AS kept, {wanted} AS open, CAST(1 AS BIGINT) AS sums, CAST(NULL AS INTEGER) AS goal, 0 AS k, CAST(1 AS BIGINT) AS mask, CAST([] AS INTEGER[]) AS away FROM g
      UNION ALL SELECT bank, l, CASE WHEN goal IS NULL AND NOT done THEN i + 1 ELSE i END,
        CASE WHEN goal IS NULL AND done AND n = open OR goal IS NULL AND NOT done AND n < open THEN list_append(kept, l[i])
             WHEN goal IS NOT NULL AND hit AND goal = m THEN list_append(list_filter(kept, lambda x, j: NOT list_contains(list_append(away, len(kept) - k), j)), l[i]) ELSE kept END,
        CASE WHEN goal IS NULL AND done AND n = open OR goal IS NOT NULL AND hit AND goal = m THEN 0 WHEN goal IS NULL AND NOT done AND n < open THEN open - n ELSE open END,
        CASE WHEN goal IS NULL AND NOT done AND n < open THEN sums | (sums << n) ELSE sums END,
        CASE WHEN goal IS NULL AND done AND n <> open THEN n - open WHEN goal IS NOT NULL AND hit THEN nullif(goal - m, 0) ELSE goal END,
        CASE WHEN goal IS NOT NULL AND NOT hit THEN k + 1 ELSE 0 END, CASE WHEN goal IS NOT NULL AND NOT hit THEN wider ELSE 1 END,
        CASE WHEN goal IS NOT NULL AND hit THEN list_append(away, CAST(len(kept) - k AS INTEGER)) WHEN goal IS NULL THEN [] ELSE away END
      FROM (SELECT *, ((wider >> coalesce(goal, 0)) & 1) = 1 AS hit FROM (
        SELECT *, CASE WHEN goal IS NULL OR m > goal THEN mask ELSE mask | (mask << m) END AS wider FROM (
          SELECT *, CAST(l[i].n AS INTEGER) AS n, CASE WHEN goal IS NOT NULL THEN CAST(kept[len(kept) - k].n AS INTEGER) END AS m, ((sums >> ({wanted} - CAST(l[i].n AS INTEGER))) & 1) = 1 AS done
          FROM f WHERE open > 0 AND i <= len(l)))))
    SELECT bank, unnest(kept).b AS block FROM f WHERE goal IS NULL AND (open = 0 OR i > len(l))"""


@plans.add(_exact(f"SELECT q.bank, x.block, x.size, x.block AS place FROM (SELECT block, max(block_size) AS size FROM ({BLOCKS}) GROUP BY block) x JOIN questions q ON q.row_id = x.block", 40))
def block_take_exact(spark, d):
    b = quiz.blocks(table(spark, d, "questions").select("row_id", "bank", "groupid", "materials")).groupBy("bank", "block").agg(F.count("*").cast("int").alias("size"))
    return quiz.exact_selection(b, ["bank"], ["block"], "size", 40).select("bank", "block")


@plans.add(f"""
    SELECT row_id, locked, array_to_string(CASE WHEN locked THEN options ELSE list_transform(s, lambda x: x.o) END, chr(31)) AS new_options,
           array_to_string(CASE WHEN locked THEN answers ELSE list_sort(list_transform(answers, lambda a: CAST(list_position(list_transform(s, lambda x: x.i), a) - 1 AS INTEGER))) END, ',') AS new_answers
    FROM (SELECT row_id, options, coalesce(noshuffle, false) OR len(options) <= 2 OR options IS NULL AS locked, {ANSWERS} AS answers,
                 list_sort(list_transform(options, lambda o, i: {{'k': md5('11|' || row_id || '|' || (i - 1)), 'i': CAST(i - 1 AS INTEGER), 'o': o}})) AS s
          FROM questions)""")
def permuted_options(spark, d):
    q = quiz.permuted(table(spark, d, "questions").select("row_id", "options", "answer", "noshuffle"), "11")
    return q.select("row_id", "locked", F.array_join("new_options", "\x1f").alias("new_options"), F.array_join(F.col("new_answers").cast("array<string>"), ",").alias("new_answers"))


@plans.add(f"""
    SELECT row_id, CASE WHEN answer IS NULL THEN '' ELSE array_to_string(list_transform({ANSWERS}, lambda a: chr(a + 65)), ',') END AS letters,
           array_to_string(list_transform(options, lambda o, i: chr(CAST(i AS INTEGER) + 64) || '. ' || o), chr(10)) AS lines FROM questions""")
def answer_letters(spark, d):
    q = table(spark, d, "questions")
    return q.select("row_id", grading.letters(F.col("answer")).alias("letters"), rendering.option_lines(F.col("options")).alias("lines"))


@plans.add("""
    SELECT row_id, array_to_string(list_transform(materials, lambda m: CASE WHEN lower(m.type) = 'image' THEN '[image] ' || coalesce(m.title, '')
        ELSE trim(coalesce(m.title, '') || chr(10) || coalesce(m.content, ''), chr(10)) END || coalesce(chr(10) || m.notes, '')), chr(10)) AS text
    FROM questions WHERE len(materials) > 0""")
def material_text(spark, d):
    q = table(spark, d, "questions").where(F.size("materials") > 0)
    return q.select("row_id", rendering.material_text(F.col("materials")).alias("text"))


_READ = BLOCKS.replace("FROM questions)", "FROM pool)")
_KEYED = f"""
    SELECT 0 AS bank, block, size, row_number() OVER (ORDER BY -ln({UNIFORM.format(seed='42', key='block')}) * (1.0 + times) * (1.0 + times), block) AS place
    FROM (SELECT x.block, count(*) AS size, max(coalesce(n.times, 0)) AS times FROM ({_READ}) x JOIN pool p ON p.row_id = x.row_id
      LEFT JOIN (SELECT bank, qid, count(*) AS times FROM ({LOG}) WHERE answered GROUP BY ALL) n ON n.bank = p.bank AND n.qid = p.id GROUP BY x.block)"""


@plans.add(f"""
    WITH pool AS (SELECT * FROM (SELECT *, {TYPE} AS qtype FROM questions) WHERE qtype IN ('sc', 'mc') AND (bank, id) NOT IN (SELECT bank, CAST(qid AS INTEGER) FROM overrides WHERE freescore)),
    chosen AS ({_exact(_KEYED, 50)})
    SELECT p.row_id, p.bank, p.id, x.block, p.qtype FROM pool p JOIN ({_READ}) x ON x.row_id = p.row_id WHERE x.block IN (SELECT block FROM chosen)""")
def quiz_selection(spark, d):
    spec = quiz.QuizSpec(mode="random", num=50, types=("sc", "mc"), seed="42")
    tags = table(spark, d, "overrides").where("freescore").select("bank", "qid", F.lit("exclude").alias("tag"))
    return quiz.select(spec, table(spark, d, "questions"), log(spark, d), table(spark, d, "overrides"), tags).select("row_id", "bank", "id", "block", "qtype")


_TAGS = "SELECT bank, CAST(qid AS INTEGER) AS id, CASE WHEN coalesce(freescore, false) THEN 'exclude' WHEN warning <> '' THEN 'key' ELSE '' END AS tag FROM overrides"
_OWN = f"SELECT * FROM ({LOG}) WHERE user_id = 36"
_COUNTED = f"SELECT bank, qid, count(*) AS total, count(*) FILTER (WHERE correct) AS n_correct FROM ({_OWN}) WHERE answered GROUP BY bank, qid"
_POOL = f"""
    WITH ever AS (SELECT bank, qid, bool_or(NOT correct) AS ever, NOT arg_max(correct, session_id * 100000 + pos) AS still FROM ({_OWN}) GROUP BY bank, qid), counted AS ({_COUNTED}), tags AS ({_TAGS}),
    items AS (SELECT 'wrong' AS mode, bank, qid FROM ever WHERE ever UNION ALL SELECT 'still-wrong', bank, qid FROM ever WHERE still
      UNION ALL SELECT 'stat', bank, qid FROM counted WHERE total - n_correct >= 1 AND n_correct * 100 < total * 80
      UNION ALL SELECT DISTINCT 'key', bank, id FROM tags WHERE tag = 'key' UNION ALL SELECT DISTINCT 'retry', bank, qid FROM ({LOG}) WHERE session_id = 7 AND NOT correct),
    q AS (SELECT row_id, bank, id, {TYPE} AS qtype FROM questions WHERE (bank, id) NOT IN (SELECT bank, id FROM tags WHERE tag = 'exclude'))
    SELECT i.mode, q.row_id FROM q JOIN items i ON i.bank = q.bank AND i.qid = q.id WHERE q.qtype IN ('sc', 'mc')
    UNION ALL SELECT 'unseen', row_id FROM q WHERE qtype IN ('sc', 'mc') AND (bank, id) NOT IN (SELECT bank, qid FROM counted)
    UNION ALL SELECT 'all', row_id FROM q WHERE qtype IN ('sc', 'mc') AND bank = 'questions/questions.json'
"""


@plans.add(_POOL)
def quiz_pools(spark, d):
    o = table(spark, d, "overrides")
    tags = o.select("bank", "qid", F.when(F.coalesce("freescore", F.lit(False)), "exclude").when(F.col("warning") != "", "key").otherwise("").alias("tag"))
    out = None
    for mode in (*quiz.SCOPED, "retry", "unseen", "all"):
        spec = quiz.QuizSpec(mode=mode, types=("sc", "mc"), user_id=None if mode == "retry" else 36, session_id=7, max_accuracy="80", track="irrigation", banks=("questions/questions.json",) if mode == "all" else ())
        p = quiz.pool(spec, table(spark, d, "questions"), log(spark, d), tags, table(spark, d, "banks")).select(F.lit(mode).alias("mode"), "row_id")
        out = p if out is None else out.unionByName(p)
    return out


@plans.add(f"""
    SELECT row_id, block FROM (SELECT row_id, block, sum(CASE WHEN row_id = block THEN block_size ELSE 0 END) OVER (ORDER BY block, row_id ROWS UNBOUNDED PRECEDING) - block_size AS before FROM ({BLOCKS})
      WHERE block IN (SELECT block FROM ({BLOCKS}) WHERE row_id = block ORDER BY block LIMIT 60)) WHERE before < 60""")
def quiz_in_stored_order(spark, d):
    none = table(spark, d, "overrides").limit(0)
    return quiz.select(quiz.QuizSpec(mode="all", num=60), table(spark, d, "questions"), log(spark, d), none).select("row_id", "block")


@plans.add("""
    SELECT q.row_id, coalesce(t.tag, '') AS tag FROM questions q
    LEFT JOIN (SELECT bank, CAST(qid AS INTEGER) AS id, CASE WHEN max(CASE WHEN freescore THEN 1 ELSE 0 END) = 1 THEN 'exclude' WHEN count(*) FILTER (WHERE warning <> '') > 0 THEN 'key' ELSE '' END AS tag
               FROM overrides GROUP BY bank, qid) t ON t.bank = q.bank AND t.id = q.id
    WHERE coalesce(t.tag, '') <> 'exclude'""")
def tagged_questions(spark, d):
    o = table(spark, d, "overrides").groupBy("bank", F.col("qid").cast("int").alias("id")).agg(
        F.when(F.max(F.coalesce("freescore", F.lit(False))), "exclude").when(F.count_if(F.col("warning") != "") > 0, "key").otherwise("").alias("tag")
    )
    q = table(spark, d, "questions").select("row_id", "bank", "id").join(o, ["bank", "id"], "left").withColumn("tag", F.coalesce("tag", F.lit("")))
    return q.where(F.col("tag") != "exclude").select("row_id", "tag")


_XREF = "選項\\([A-D]\\)|選項[一二三四1234]|以上皆|皆是|皆非|皆正確|皆錯誤"
_LONE = "(^|[（(,，、\\s])[A-D]([）),，、\\s]|$)"


@plans.add(f"""
    SELECT row_id, coalesce(len(list_filter(options, lambda o: regexp_matches(o, '{_XREF}'))) > 0, false) AS named,
           coalesce(len(list_filter(options, lambda o: regexp_matches(o, '{_XREF}') OR regexp_matches(upper(o), '{_LONE}'))) > 0
             OR list_transform(options, lambda o: upper(regexp_replace(o, '\\s+', '', 'g'))) IN (['A', 'B', 'C', 'D'], ['1', '2', '3', '4']), false) AS locked FROM questions""")
def locked_options(spark, d):
    o = F.col("options")
    return table(spark, d, "questions").select("row_id", parsing.locked(o, letters=False).alias("named"), parsing.locked(o).alias("locked"))


@plans.add("""
    SELECT row_id, coalesce(regexp_matches(question, '如\\s*[圖表]|[圖表]\\s*[（(]\\s*[一二三四五六七八九十\\d]+\\s*[)）]|曲線圖|附圖|下[圖表]|上[圖表]'), false) AS image,
           coalesce(regexp_matches(question, '【表|下表|如下表|統計表|表格|資料如下|情形如下'), false) AND coalesce(len(materials), 0) = 0 AS sheet FROM questions""")
def media_hints(spark, d):
    q = F.col("question")
    return table(spark, d, "questions").select("row_id", parsing.needs_image(q).alias("image"), parsing.needs_table(q, F.col("materials")).alias("sheet"))


@plans.add("""
    SELECT q.row_id, coalesce(k.answer, '0') AS answer, k.bank IS NOT NULL AS found, k.bank IS NOT NULL AND k.answer IS NULL AS free FROM questions q
    LEFT JOIN (SELECT bank, id, answer FROM (SELECT *, row_number() OVER (PARTITION BY bank, id ORDER BY row_id) AS n FROM questions WHERE freescore IS NOT NULL) WHERE n = 1) k ON k.bank = q.bank AND k.id = q.id""")
def answer_key_join(spark, d):
    q = table(spark, d, "questions").select("row_id", "bank", "id", "answer", "freescore")
    key = q.where(F.col("freescore").isNotNull()).select("bank", "id", F.col("row_id").alias("order"), "answer")
    return imports.keyed_answers(q.drop("freescore"), key, ["bank", "id"]).select("row_id", "answer", "found", "free")


# markers that continue A, B, C, ... open an option; others stay part of the text before them
_MARK = "[（(]\\s*([A-HＡ-Ｈ])\\s*[)）]"
_TIDY = "rtrim(trim(regexp_replace({t}, '\\s+', ' ', 'g'), ' '), '。.，,；')"


@plans.add(f"""
    WITH RECURSIVE l AS (SELECT doc_id, no, line, regexp_matches(line, '^\\d{{1,3}}\\s*[.、．]') AS start FROM ({LINES})),
    e AS (SELECT *, last_value(CASE WHEN start THEN false WHEN regexp_matches(line, '^解析\\s*[：:]') THEN true END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS explained FROM l),
    g AS (SELECT doc_id, no, line, sum(CASE WHEN start THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS group_no FROM e WHERE NOT coalesce(explained, false)),
    t AS (SELECT doc_id, CAST(group_no AS BIGINT) AS group_no, string_agg(line, ' ' ORDER BY no) AS text FROM g WHERE group_no > 0 GROUP BY ALL),
    m AS (SELECT doc_id, group_no, regexp_extract_all(text, '{_MARK}') AS marks, list_transform(regexp_extract_all(text, '{_MARK}', 1), lambda x: translate(x, 'ＡＢＣＤＥＦＧＨ', 'ABCDEFGH')) AS signs, string_split_regex(text, '{_MARK}') AS pieces FROM t),
    f AS (SELECT doc_id, group_no, marks, signs, pieces, 1 AS i, [pieces[1]] AS parts FROM m
      UNION ALL SELECT doc_id, group_no, marks, signs, pieces, i + 1, CASE WHEN signs[i] = substr('ABCDEFGH', len(parts), 1) THEN list_append(parts, pieces[i + 1]) ELSE list_concat(parts[1:len(parts) - 1], [parts[len(parts)] || marks[i] || pieces[i + 1]]) END FROM f WHERE i <= len(marks))
    SELECT doc_id, group_no, trim(parts[1], ' ') AS stem, array_to_string(list_transform(parts[2:], lambda x: {_TIDY.format(t='x')}), chr(31)) AS options FROM f WHERE i = len(marks) + 1""")
def lettered_records(spark, d):
    start = F.col("line").rlike(r"^\d{1,3}\s*[.、．]")
    # an explanation runs to the next question and isn't part of the last option
    explained = F.when(start, False).when(F.col("line").rlike("^解析\\s*[：:]"), True)
    rows = segment.carried(segment.lines(table(spark, d, "documents")), "doc_id", {"explained": explained})
    rows = segment.sessions(rows.where(~F.coalesce("explained", F.lit(False))), "doc_id", start)
    split = rows.where("group_no > 0").select("doc_id", "group_no", parsing.lettered_options(F.col("text")).alias("q"))
    return split.select("doc_id", "group_no", "q.stem", F.array_join("q.options", "\x1f").alias("options"))


# cur: the line that is taken in others until its brackets are closed; held: answers that wait for a line
_OPENS = "regexp_matches({x}, '^\\d{{1,3}}\\s*[.、．]')"
_ANSWER_ONLY = "regexp_matches({x}, '^[（(][○╳×OX1-4]+[)）]$')"
_UNCLOSED = "length(replace(replace({x}, '）', ''), ')', '')) > length(replace(replace({x}, '（', ''), '(', ''))"
_GOES_ON = f"cur IS NOT NULL AND {_UNCLOSED.format(x='cur')} AND taken < 5 AND NOT {_OPENS.format(x='l[i]')}"
_FLUSHED = f"CASE WHEN cur IS NULL THEN done WHEN len(done) > 0 AND NOT ({_OPENS.format(x='cur')} OR held <> '') THEN list_concat(done[1:len(done) - 1], [done[len(done)] || ' ' || cur]) ELSE list_append(done, held || cur) END"


@plans.add(f"""
    WITH RECURSIVE g AS (SELECT doc_id, list(line ORDER BY no) AS l FROM ({LINES}) GROUP BY doc_id),
    f AS (SELECT doc_id, l, 1 AS i, CAST([] AS VARCHAR[]) AS done, '' AS held, CAST(NULL AS VARCHAR) AS cur, 0 AS taken FROM g
      UNION ALL SELECT doc_id, l, i + 1, CASE WHEN {_GOES_ON} THEN done ELSE {_FLUSHED} END,
             CASE WHEN {_GOES_ON} THEN held ELSE CASE WHEN cur IS NULL THEN held ELSE '' END || CASE WHEN {_ANSWER_ONLY.format(x='l[i]')} THEN l[i] ELSE '' END END,
             CASE WHEN {_GOES_ON} THEN cur || l[i] WHEN {_ANSWER_ONLY.format(x='l[i]')} THEN NULL ELSE l[i] END, CASE WHEN {_GOES_ON} THEN taken + 1 ELSE 0 END FROM f WHERE i <= len(l)),
    e AS (SELECT doc_id, CASE WHEN cur IS NULL AND held <> '' THEN list_append(done, held) ELSE {_FLUSHED} END AS o FROM f WHERE i = len(l) + 1)
    SELECT doc_id, CAST(generate_subscripts(o, 1) - 1 AS INTEGER) AS no, unnest(o) AS line FROM e""")
def merged_exam_lines(spark, d):
    return imports.merged_lines(segment.lines(table(spark, d, "documents")), "doc_id")
