import pytest

from examforge.llm import scanfix
from examforge.llm.scanfix import BODY, BREAK, HEADER


@pytest.fixture(scope="module")
def scanner(spark):
    return scanfix.fit(spark.read.parquet("/root/testdata/sf0.1/questions.parquet"))


STEM = "某駕駛人行經交流道，在分段測試財務報表之前必須先保養水權登記，下列何者正確？"


def test_labels(scanner):
    lines = ["科目：汽車構造", STEM[:12], "- 17 -", STEM[12:20] + " ", STEM[20:], "甲、灌區應檢查腐植質", "乙、水庫應調整堆肥", "第 7 頁，共 11 頁"]
    assert scanner.lines.labels(lines) == [HEADER, BREAK, HEADER, BREAK, BODY, BODY, BODY, HEADER]


@pytest.mark.parametrize("noisy", [
    STEM[:9] + "\n" + STEM[9:], STEM[:9] + " \n" + STEM[9:], STEM[:9] + "\r\n　" + STEM[9:], "科目：會計大意\n" + STEM, STEM + "\n- 4 -",
    STEM[:15] + "\n【請接續背面】\n" + STEM[15:], STEM.replace("水", "氷"), STEM.replace("行經", "衍經"), STEM[:5] + "_" + STEM[5:],
])
def test_repairs(scanner, noisy):
    assert scanner.repair(noisy)[0] == STEM


def test_english_hyphens_and_misreadings(scanner):
    assert scanner.repair("Reseal the heavy-duty staff roste-\nr at Norvoridge")[0] == "Reseal the heavy-duty staff roster at Norvoridge"
    assert scanner.repair("6S8 hectares")[0] == "658 hectares"
    assert scanner.repair("Meanvvhile Norvoridge chose to log the spare flume.")[0].startswith("Meanwhile")


@pytest.mark.parametrize("text", [STEM, "\n" + STEM + " \n", "下列敘述何者正確？\n甲、灌區應檢查腐植質\n乙、水庫應調整堆肥", "下列敘述何者正確？\n 甲 ，灌區應檢查腐植質\n乙，水庫應調整堆肥", "Double-check the semi-automatic flume", "EK-1189", "依講義第 28 頁所示", "640 公尺", "", "A"])
def test_not_noise(scanner, text):
    assert scanner.repair(text) is None


def test_fields_nulls_and_empty_tables(questions, rows, scanner, spark):
    q = questions([(1, STEM[:9] + "\n" + STEM[9:], [None, "", "氷"]), (2, None, None), (3, "\uff21\uff22\n" + STEM, [])])
    from examforge.llm import mojibake

    base = spark.read.parquet("/root/testdata/sf0.01/questions.parquet")
    found = scanfix.repaired_fields(q, scanner, mojibake.fit(base, 5000))
    assert rows(found.select("row_id", "field_no")) == [(1, 0)]
    assert rows(scanfix.repaired_fields(questions([]))) == []


def test_held_out_labels_and_what_transitions_add(spark):
    base = spark.read.parquet("/root/testdata/sf0.1/questions.parquet")
    scanner = scanfix.fit(base, 6_000)
    texts = [r[0] for r in base.where("row_id % 3 = 1").select("question").where("question is not null").collect()]
    held = [x for x in scanfix.spoiled(texts, ["questions/98科目-組別-植物保護-000001.json"], 77) if len(x[0]) > 1]
    lines = scanner.lines

    def accuracy():
        labels = [lines.labels(x) for x, _ in held]
        return labels, sum(a == b for got, (_, right) in zip(labels, held) for a, b in zip(got, right)) / sum(len(x) for x, _ in held)

    with_steps, share = accuracy()
    kept = lines.step, lines.start
    lines.step, lines.start = 0 * lines.step, 0 * lines.start
    without, less = accuracy()
    lines.step, lines.start = kept
    assert share > 0.985 and share > less and with_steps != without


def test_likely_spots_miss_no_correction(scanner, spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/questions.parquet").select("question").where("question is not null").collect()]
    texts += ["", "氷", "衍", "O", "_", "6S8", "vv", "\x01氷", "氷\x01", STEM.replace("水", "氷"), "X" + "氷" * 3]
    found = set(scanner.suspects(texts))
    assert {i for i, t in enumerate(texts) if scanfix.misreadings(t, scanner.usage)[1]} <= found
