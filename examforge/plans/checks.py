"""Data quality, reconciliation, audit and range queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from examforge.functions.text import SPACE
from examforge.operators import audit, quality, ranges
from examforge.plans.base import Plans, table

plans = Plans()
_ANS = "CASE WHEN answer IS NULL THEN NULL ELSE CAST(string_split(regexp_replace(answer, '[\\[\\] ]', '', 'g'), ',') AS INTEGER[]) END"


_BY_ID = f"""
    SELECT bank, id, count(*) AS n, count(*) > 1 AS repeated, bool_or(coalesce(len(options), 0) <> 4) AS bad_options,
           bool_or(coalesce(question, '') = '' OR coalesce(len(options), 0) <> 4 OR len(list_filter(options, lambda o: coalesce(o, '') = '')) > 0) AS empty,
           bool_or(NOT coalesce(freescore, false) AND NOT coalesce(len(a) > 0 AND len(list_filter(a, lambda x: x < 0 OR x > 3)) = 0, false)) AS odd_answers,
           bool_or(regexp_matches(concat_ws(' ', question, array_to_string(options, ' ')), '\ufffd|[ÅÇÉÑ]|[\uf081-\uf084]|×10 元|/ha /ha|題目[一二三四五六]|請接續')) AS suspicious
    FROM (SELECT *, {_ANS} AS a FROM questions) GROUP BY bank, id"""


@plans.add(f"""
    SELECT *, CASE WHEN n = last AND missing + extra + repeated + bad_options + empty + odd_answers + suspicious = 0 THEN 'ok' ELSE 'review' END AS status FROM (
      SELECT bank, CAST(sum(n) AS BIGINT) AS n, CAST(greatest(max(id), 0) AS BIGINT) AS last, greatest(max(id), 0) - count(*) FILTER (WHERE id >= 1) AS missing, count(*) FILTER (WHERE id < 1) AS extra,
             count(*) FILTER (WHERE repeated) AS repeated, count(*) FILTER (WHERE bad_options) AS bad_options, count(*) FILTER (WHERE empty) AS empty,
             count(*) FILTER (WHERE odd_answers) AS odd_answers, count(*) FILTER (WHERE suspicious) AS suspicious FROM ({_BY_ID}) GROUP BY bank)""".replace("SELECT *, CASE WHEN n = last", "SELECT bank, n, missing, extra, repeated, bad_options, empty, odd_answers, suspicious, CASE WHEN n = last"))
def qa_completeness(spark, d):
    return quality.completeness(table(spark, d, "questions"))


@plans.add(f"""
    WITH one AS ({_BY_ID})
    SELECT bank, issue, id FROM (SELECT bank, id, unnest(list_filter([CASE WHEN repeated THEN 'repeated' END, CASE WHEN bad_options THEN 'bad_options' END, CASE WHEN empty THEN 'empty' END,
        CASE WHEN odd_answers THEN 'odd_answers' END, CASE WHEN suspicious THEN 'suspicious' END, CASE WHEN id < 1 OR id > 15 THEN 'extra' END], lambda x: x IS NOT NULL)) AS issue FROM one)
    UNION ALL SELECT bank, 'missing', CAST(i AS INTEGER) FROM (SELECT DISTINCT bank FROM one) b, range(1, 16) r(i) WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.bank = b.bank AND one.id = i)""")
def qa_issues_of_15(spark, d):
    return quality.issues(table(spark, d, "questions"), expected=15)


@plans.add("""
    SELECT bank, CAST(id AS INTEGER) AS id FROM (SELECT bank, unnest(range(1, max(id) + 1)) AS id FROM questions GROUP BY bank)
    EXCEPT SELECT bank, id FROM questions""")
def missing_ids(spark, d):
    return quality.missing_ids(table(spark, d, "questions"))


_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bank, id ORDER BY imported_at {o}, row_id {o}) AS k FROM questions) WHERE k = 1"


@plans.add(f"""
    SELECT a.bank, a.id, concat_ws(',', CASE WHEN a.question IS DISTINCT FROM b.question THEN 'question' END, CASE WHEN a.options IS DISTINCT FROM b.options THEN 'options' END,
           CASE WHEN a.answer IS DISTINCT FROM b.answer THEN 'answer' END) AS issue FROM ({_FIRST.format(o='DESC')}) a JOIN ({_FIRST.format(o='')}) b ON a.bank = b.bank AND a.id = b.id
    WHERE a.question IS DISTINCT FROM b.question OR a.options IS DISTINCT FROM b.options OR a.answer IS DISTINCT FROM b.answer""")
def reconcile_imports(spark, d):
    q = table(spark, d, "questions")
    at = F.struct("imported_at", "row_id")
    pick = lambda f: q.groupBy("bank", "id").agg(f(F.struct("question", "options", "answer"), at).alias("q")).select("bank", "id", "q.*")
    return quality.reconcile(pick(F.max_by), pick(F.min_by), ["bank", "id"], ["question", "options", "answer"])


@plans.add("""
    SELECT coalesce(o.bank, q.bank) AS bank, coalesce(o.id, q.id) AS id, CASE WHEN o.bank IS NULL THEN 'missing' WHEN q.bank IS NULL THEN 'extra' ELSE 'answer' END AS issue
    FROM (SELECT DISTINCT bank, CAST(qid AS INTEGER) AS id, answer FROM overrides WHERE answer IS NOT NULL) o
    FULL JOIN (SELECT bank, id, max(answer) AS answer FROM questions GROUP BY bank, id) q ON o.bank = q.bank AND o.id = q.id
    WHERE o.answer IS DISTINCT FROM q.answer OR o.bank IS NULL OR q.bank IS NULL""")
def reconcile_full_outer(spark, d):
    o = table(spark, d, "overrides").where(F.col("answer").isNotNull()).select("bank", F.col("qid").cast("int").alias("id"), "answer").distinct()
    q = table(spark, d, "questions").groupBy("bank", "id").agg(F.max("answer").alias("answer"))
    return quality.reconcile(o, q, ["bank", "id"], ["answer"])


_UNITS = "(個月|年|公尺|公分|公里|公噸|分鐘|小時|秒|歲|點|次|毫克|元|日|張|人|倍|度|%)"
_SP = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


@plans.add(f"""
    SELECT row_id, n_values, n_options, odd[1] AS leak FROM (
      SELECT row_id, CAST(len(o) AS INTEGER) AS n_options, CAST(len(list_filter(o, lambda x: regexp_matches(x, '^\\d[\\d,.]*\\s*{_UNITS}?$'))) AS INTEGER) AS n_values,
             CASE WHEN len(o) >= 3 AND len(list_filter(o, lambda x: regexp_matches(x, '^\\d[\\d,.]*\\s*{_UNITS}?$'))) >= len(o) - 1 AND len(list_filter(options, lambda x: x IS NULL)) = 0 THEN
               list_filter(o, lambda x: NOT regexp_matches(x, '^\\d[\\d,.]*\\s*{_UNITS}?$') AND length(x) >= 14 AND regexp_matches(x, '^\\d[\\d,.]*\\s*{_UNITS}')
                 AND regexp_matches(x, '，|以上者|註銷|吊扣|吊銷|扣繳|至檢驗合格|發還|禁止其行駛|沒入|處汽車所有人')) END AS odd
      FROM (SELECT row_id, options, list_transform(options, lambda x: regexp_replace(x, '^{_SP}+|{_SP}+$', '', 'g')) AS o FROM questions WHERE options IS NOT NULL))""")
def leak_detector(spark, d):
    q = table(spark, d, "questions").where(F.col("options").isNotNull())
    values = F.filter("options", lambda o: F.regexp_replace(o, f"^{SPACE}+|{SPACE}+$", "").rlike(quality.NUMERIC))
    return q.select("row_id", F.size(values).alias("n_values"), F.size("options").alias("n_options"), quality.leak(F.col("options")).alias("leak"))


@plans.add("""
    SELECT bank, count(*) AS n, count(*) FILTER (WHERE answer LIKE '[%') AS multi, count(*) FILTER (WHERE len(options) = 2 AND answer NOT LIKE '[%') AS tf,
           count(*) FILTER (WHERE answer IS NULL) AS no_answer, count(*) FILTER (WHERE coalesce(freescore, false)) AS free FROM questions GROUP BY bank""")
def import_stats(spark, d):
    multi = F.coalesce(F.col("answer").startswith("["), F.lit(False))
    return table(spark, d, "questions").groupBy("bank").agg(
        F.count("*").alias("n"), F.count_if(multi).alias("multi"), F.count_if((F.size("options") == 2) & F.col("answer").isNotNull() & ~multi).alias("tf"),
        F.count_if(F.col("answer").isNull()).alias("no_answer"), F.count_if(F.coalesce("freescore", F.lit(False))).alias("free"),
    )


@plans.add("""
    SELECT row_id, CASE WHEN n > 1 THEN groupid END AS groupid FROM (SELECT row_id, groupid, count(*) OVER (PARTITION BY bank, groupid) AS n FROM questions WHERE groupid IS NOT NULL)""")
def group_cardinality(spark, d):
    q = table(spark, d, "questions").where(F.col("groupid").isNotNull()).select("row_id", "bank", "groupid")
    n = q.groupBy("bank", "groupid").agg(F.count("*").alias("n"))
    return q.join(n, ["bank", "groupid"]).select("row_id", F.when(F.col("n") > 1, F.col("groupid")).alias("groupid"))


@plans.add("""
    SELECT o_custkey, max(d) AS latest, min(d) AS earliest, arg_max(o_orderstatus, {'a': d, 'b': o_orderkey}) AS latest_text, count(*) AS n_versions, string_agg(d, ',' ORDER BY d, o_orderkey) AS dates,
           coalesce(string_agg('[' || d || '修正] ' || o_orderpriority, chr(10) ORDER BY d, o_orderkey, o_orderpriority) FILTER (WHERE o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')), arg_max(o_orderpriority, {'a': d, 'b': o_orderkey})) AS reasons
    FROM (SELECT *, strftime(o_orderdate, '%Y/%m/%d') AS d FROM orders) GROUP BY o_custkey""")
def version_consolidation(spark, d):
    o = table(spark, d, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy/MM/dd"))
    v = audit.consolidated(o, ["o_custkey"], "d", "o_orderstatus", "o_orderpriority", ("5-LOW", "4-NOT SPECIFIED"), "o_orderkey")
    return v.withColumn("dates", F.array_join("dates", ","))


@plans.add("""
    SELECT q.vec_id AS query_id, i.vec_id AS item_id,
           CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 9) DESC, i.vec_id) AS INTEGER) AS place
    FROM embeddings q JOIN embeddings i ON i.label > q.label WHERE q.vec_id % 20 = 0 QUALIFY place <= 20""")
def newer_vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("year"), F.col("embedding").alias("vector"))
    items = e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("year"), F.col("embedding").alias("vector"))
    return audit.newer_top_k(queries, items, 20).select("query_id", "item_id", "place")


_MENTION = "第\\s*(\\d+([\\-之]\\d+)?)\\s*條"


@plans.add(f"""
    WITH q AS (SELECT row_id AS query_id, CAST(row_id % 50 AS INTEGER) AS asked, unnest(list_distinct(list_transform(regexp_extract_all(concat_ws(' ', question, array_to_string(options, ' ')), '{_MENTION}', 1), lambda x: replace(x, '之', '-')))) AS key FROM questions),
    a AS (SELECT doc_id AS item_id, CAST(doc_id % 100 AS INTEGER) AS year, CAST(doc_id % 97 AS VARCHAR) AS key FROM documents WHERE source IN ('law_articles', 'law_explanations'))
    SELECT query_id, item_id, 'article_mention' AS signals FROM q JOIN a ON a.key = q.key AND a.year > q.asked""")
def rule_signals(spark, d):
    q = table(spark, d, "questions").select(F.col("row_id").alias("query_id"), (F.col("row_id") % 50).cast("int").alias("year"), F.concat_ws(" ", "question", F.array_join("options", " ")).alias("text"))
    a = table(spark, d, "documents").where(F.col("source").isin("law_articles", "law_explanations"))
    a = a.select(F.col("doc_id").alias("item_id"), (F.col("doc_id") % 100).cast("int").alias("year"), F.lit("處罰").alias("law"), (F.col("doc_id") % 97).cast("string").alias("article_no"), F.lit("").alias("text"))
    return audit.rule_signals(q, a).select("query_id", "item_id", F.array_join("signals", ",").alias("signals"))


@plans.add("""
    SELECT event_id, CASE WHEN p1 THEN 'final' WHEN second THEN 'second' ELSE 'done' END AS route, p1 OR (second AND coalesce(p2, false)) AS affected,
           CASE WHEN second THEN greatest(c1, coalesce(c2, 0)) ELSE c1 END AS confidence, coalesce(second AND coalesce(p2, false) <> p1, false) AS disagreed,
           CASE WHEN p1 OR (second AND coalesce(p2, false)) OR (CASE WHEN second THEN greatest(c1, coalesce(c2, 0)) ELSE c1 END) >= 20 THEN 'A' ELSE 'B' END AS batch
    FROM (SELECT *, NOT p1 AND (strong OR similarity > 0.5 OR c1 >= 30) AS second FROM (
      SELECT event_id, event_type = 'error' AS p1, event_type = 'purchase' AS p2, CAST(event_id % 50 AS INTEGER) AS c1, CAST(event_id % 90 AS INTEGER) AS c2, value / 40 AS similarity, event_type = 'signup' AS strong FROM events))""")
def consensus_routing(spark, d):
    e = table(spark, d, "events")
    t = F.col("event_type")
    rows = e.select("event_id", (t == "error").alias("p1"), (t == "purchase").alias("p2"), (F.col("event_id") % 50).cast("int").alias("c1"), (F.col("event_id") % 90).cast("int").alias("c2"), (F.col("value") / 40).alias("similarity"), (t == "signup").alias("strong"))
    return audit.routed(rows).select("event_id", "route", "affected", "confidence", "disagreed", "batch")


@plans.add("""
    SELECT doc_id, round(1 / (1 + exp(-(coalesce(n_chars, 0) - 400) / 200.0)), 6) AS score FROM documents WHERE round(1 / (1 + exp(-(coalesce(n_chars, 0) - 400) / 200.0)), 6) >= 0.3""")
def rerank_threshold(spark, d):
    logit = (F.coalesce("n_chars", F.lit(0)) - 400) / 200.0
    return table(spark, d, "documents").select("doc_id", F.round(audit.sigmoid(logit), 6).alias("score")).where("score >= 0.3")


@plans.add("""
    SELECT p.p_partkey, o.o_orderkey FROM part p JOIN (SELECT o_orderkey, o_custkey AS a, o_custkey + o_orderkey % 4 AS b FROM orders) o ON p.p_partkey BETWEEN o.a AND o.b""")
def range_passage_attach(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_custkey") + F.col("o_orderkey") % 4).alias("b"))
    return ranges.attach_by_range(table(spark, d, "part").select("p_partkey"), "p_partkey", o, "a", "b").select("p_partkey", "o_orderkey")


_RECT = "SELECT {id} AS id, CAST({x} AS DOUBLE) AS x0, CAST({y} AS DOUBLE) AS y0, CAST({x} + 3 AS DOUBLE) AS x1, CAST({y} + 2 AS DOUBLE) AS y1 FROM {t}"


@plans.add(f"""
    SELECT a.id AS a_id, b.id AS b_id FROM ({_RECT.format(id='p_partkey', x='p_partkey % 500', y='p_size * 3', t='part')}) a
    JOIN ({_RECT.format(id='s_suppkey', x='s_suppkey * 5 % 500', y='s_suppkey % 150', t='supplier')}) b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""")
def spatial_intersects(spark, d):
    def rect(t, i, x, y):
        x, y = x.cast("double"), y.cast("double")
        return table(spark, d, t).select(F.col(i).alias("id"), x.alias("x0"), y.alias("y0"), (x + 3).alias("x1"), (y + 2).alias("y1"))

    p, s = F.col("p_partkey"), F.col("s_suppkey")
    return ranges.intersecting(rect("part", "p_partkey", p % 500, F.col("p_size") * 3), rect("supplier", "s_suppkey", s * 5 % 500, s % 150), 8.0)


_PLACE = "('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT"


@plans.add(f"SELECT doc_id FROM documents WHERE {_PLACE} < CAST(floor(4294967296.0 * 0.15) AS BIGINT)")
def qa_sample(spark, d):
    return audit.sample(table(spark, d, "documents").select("doc_id"), "doc_id", 0.15, "42")


@plans.add(f"""
    WITH u AS (SELECT file AS doc_id, md5('42|' || file) AS k FROM banks)
    SELECT doc_id AS file FROM u ORDER BY k, doc_id LIMIT (SELECT greatest(1, CAST(floor(0.15 * count(*)) AS BIGINT)) FROM u)""")
def qa_sample_exact(spark, d):
    return audit.exact_sample(table(spark, d, "banks").select("file"), "file", 0.15, "42")
