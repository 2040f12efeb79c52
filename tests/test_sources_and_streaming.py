import json

from pyspark.sql import functions as F

from examforge.sources import readers, writers
from examforge.streaming import attempts as stream


def test_banks_overrides_and_history(spark, tmp_path, rows):
    d = tmp_path / "questions"
    d.mkdir()
    (d / "110甲.json").write_text(json.dumps([{"id": 1, "question": "q", "options": ["a", "b"], "answer": 0}, {"id": 2, "question": "r", "options": ["a"], "answer": [0, 2]}]))
    (d / "questions.json").write_text(json.dumps([{"id": 1, "question": "s", "answer": None}]))
    (d / "broken.json").write_text("{not json")
    q = readers.banks(spark, str(d / "*.json"))
    assert ("questions/110甲.json", 2, "[0, 2]") in rows(q.select("bank", "id", "answer"))
    assert rows(readers.bank_index(spark, str(d / "*.json")).where("file like '%110%'")) == [("questions/110甲.json", 2)]
    (tmp_path / "o.json").write_text(json.dumps({"b": {"3": {"warning": "w", "freeScore": False}, "4": {"answer": [1]}}}))
    assert rows(readers.overrides(spark, str(tmp_path / "o.json")).select("bank", "qid", "warning", "freescore")) == [("b", "3", "w", False), ("b", "4", None, None)]
    (tmp_path / "bad.json").write_text("oops")
    assert readers.overrides(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "h.json").write_text(json.dumps([{"date_iso": "2024-01-02T03:04:05Z", "bank": "b", "answers": [{"qid": 1, "userAnswer": [0, 2], "correct": True}, {"qid": 2, "bank": "", "userAnswer": None, "correct": False}]}]))
    h = readers.flattened(readers.history(spark, str(tmp_path / "h.json")).withColumn("session_id", F.lit(1)))
    assert rows(h.select("pos", "bank", "qid", "user_answer")) == [(0, "b", 1, "[0, 2]"), (1, "b", 2, None)]


def test_logs_and_files(spark, tmp_path, rows):
    (tmp_path / "log.txt").write_text("2024-01-02T03:04:05+08:00\tfix: a\tb\nnoise\n")
    assert rows(readers.version_log(spark, str(tmp_path / "log.txt")))[0][:2] == ("2024-01-02", "03:04")
    (tmp_path / "112").mkdir()
    (tmp_path / "112" / "x.pdf").write_bytes(b"x")
    assert rows(readers.year_map(spark, str(tmp_path))) == [("x", "112")]
    assert readers.only_file(spark, str(tmp_path), "x.pdf").endswith("112/x.pdf")
    (tmp_path / "law.txt").write_text("\n 某法 \n第 1 條　甲。")
    assert rows(readers.law_texts(spark, str(tmp_path / "law.txt")))[0][:2] == ("law.txt", "某法")


def test_upserts_backups_and_exports(spark, rows):
    kv = lambda r: spark.createDataFrame(r, "key string, value string")
    merged = writers.upserted(kv([("a", "1"), ("b", "2")]), kv([("b", ""), ("c", "3")]), ["key"], ["value"], F.col("value") == "")
    assert rows(merged) == [("a", "1"), ("c", "3")]
    assert rows(writers.restored(kv([("note:1", "x")]), kv([("note:1", "y"), ("other", "z")]), ("k",), ("note:",))) == [("note:1", "y")]
    q = spark.createDataFrame([("b", 1, 1, "q?", ["x", "y"], "1")], "bank string, id int, row_id bigint, question string, options array<string>, answer string")
    assert rows(writers.exported(q, "bank")) == [("b", "q?\nA. x\nB. y\nAnswer: B")]
    assert writers.markdown_report(kv([("a", None)])) == "| key | value |\n| --- | --- |\n| a |  |"


def test_streamed_counts_equal_the_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/attempts.parquet")
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = stream.run_once(stream.windowed_counts(s, late="3000 days"), "counts", str(tmp_path / "cp"))
    want = batch.dropDuplicates(["session_id", "pos"]).where("user_answer is not null")
    assert got.agg(F.sum("n")).first()[0] == want.count()


def test_law_files_amendments_changelog_and_logs(spark, rows, tmp_path):
    import json

    from examforge.operators import reviews
    from examforge.sources import readers, writers

    def put(name, value):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
        return str(tmp_path / name)

    article = {"id": "a1", "no": "1", "title": "第 1 條", "text": "甲", "explanation": ""}
    law = put("laws.json", [{"id": "w", "title": "水利法", "chapters": [{"id": "c", "no": "一", "title": "總則", "articles": [article, article | {"no": "2"}]}]}])
    links = put("links.json", [{"source": "w::a1", "refs": [{"field": "text", "text": "第 2 條", "targetLawId": "w", "targetArticleId": "a2"}]}])
    articles, blocks, refs = readers.laws(spark, law, links=links)
    assert rows(articles.select("doc_id", "seq", "chapter", "article_no")) == [("w", 1, "總則", "1"), ("w", 2, "總則", "2")]
    assert blocks.count() == 0 and rows(refs.select("source", "text", "targetLawId")) == [("w::a1", "第 2 條", "w")]

    one = put("one.json", [{"article_no": "7", "date_roc": "112/01/02", "text": "t", "reason": "r"}])
    two = put("two.json", [{"article_no": "8", "date_roc": "113/01/02", "text": "u", "reason": ""}])
    assert rows(readers.amendments(spark, {"甲": one, "乙": two}).select("law", "article_no")) == [("乙", "8"), ("甲", "7")]
    assert readers.amendments(spark, {}).count() == 0

    days = put("changelog.json", [{"date": "2024-01-02", "items": [{"time": "08:00", "message": "m"}]}])
    assert rows(readers.changelog(spark, days)) == [("2024-01-02", "08:00", "m")]
    assert rows(readers.changelog(spark, put("none.json", {"a": 1}), "nothing yet")) == [(None, None, "nothing yet")]
    assert rows(readers.unreadable(spark, [law, put("bad.json", "{oops"), put("object.json", {"a": 1})])) == [("bad.json", "unreadable"), ("object.json", "no list")]

    index = spark.createDataFrame([("questions/交通部110-a.json", None, "", None), ("questions/b.json", "shown", "n", "交通部"), ("questions/c.json", "", "named", "農田水利")], "file string, displayname string, name string, source string")
    assert rows(readers.bank_maps(index)) == [("questions/b.json", "shown", True), ("questions/c.json", "named", False), ("questions/交通部110-a.json", "交通部110-a", True)]

    reviewed = spark.createDataFrame([("b", "10", False, 1, "q2", ["x"], "0", "r"), ("b", "9", True, 40, "q1", ["x"], "0", None)], "bank_name string, id string, affected boolean, confidence int, question string, options array<string>, answer string, reason string")
    writers.audit_log(reviews.log(reviewed), str(tmp_path / "log"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "log").glob("part-*")))
    assert text.index("[b] #9 affected 40") < text.index("[b] #10 safe 1") and "* (A) x" in text
