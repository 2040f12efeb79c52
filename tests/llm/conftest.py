import pytest

QUESTIONS = "row_id bigint, bank string, id int, question string, options array<string>, answer string, text string, k1 bigint, field_no int"


@pytest.fixture
def questions(spark):
    """Questions from (row_id, question, options), with extra columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, "questions/110甲科-乙組-栽培實務-000001.json", 1, q, o, "0", "clash", 1, 2) for i, q, o in rows], QUESTIONS)

    return make


@pytest.fixture
def corpus(questions, spark):
    """The clean part of the smallest test table, as a base for statistics."""

    def make(extra):
        base = spark.read.parquet("/root/testdata/sf0.01/questions.parquet").select("row_id", "bank", "id", "question", "options", "answer")
        return base.unionByName(questions(extra).select(*base.columns))

    return make
