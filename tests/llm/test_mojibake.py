import pytest

from examforge.llm import mojibake
from examforge.llm.common import question_fields

STEM = "承辦人員巡查蓄水塔發現抽水機組異常，依序執行檢查燃油濾清器與更換煞車總泵，下列敘述何者正確？"


@pytest.fixture(scope="module")
def model(spark):
    return mojibake.fit(spark.read.parquet("/root/testdata/sf0.01/questions.parquet"), 8000)


@pytest.mark.parametrize("chain", list(mojibake.CHAINS))
def test_whole_fields_are_found_and_what_decodes_is_restored(model, chain):
    garbled = mojibake.garble(STEM, chain)
    restored, chains, whole = mojibake.repair(model, garbled)
    if "�" not in garbled:
        assert restored == STEM and whole
    else:
        assert not whole


@pytest.mark.parametrize("chain", mojibake.LOSSY)
def test_lossy_chains_are_found(model, chain):
    assert not mojibake.repair(model, mojibake.garble(STEM, chain, 3))[2]


def test_stretches_and_single_units(model):
    text = STEM[:20] + mojibake.garble(STEM[20:30], "utf8_as_cp1252") + STEM[30:]
    assert mojibake.repair(model, text)[0] == STEM
    assert mojibake.repair(model, "The limit is 902 Â°C here")[0] == "The limit is 902 °C here"


@pytest.mark.parametrize("text", ["Åström 控制的設備", "Élan 型的設備若用於灌區，如未依限調整財務報表，何者最可能是主因？", "756Ω", "206μm", "87.8㎡", "The foreman’s note says “drain first” – café", "", "，。", "Åström"])
def test_correct_text_is_left_alone(model, text):
    assert mojibake.repair(model, text) is None


def test_held_out_accuracy(spark, model):
    fields = question_fields(spark.read.parquet("/root/testdata/sf0.001/questions.parquet")).where("length(text) > 8").orderBy("row_id", "field_no").limit(300)
    texts = [r.text for r in fields.collect() if not mojibake.repair(model, r.text)]
    for chain in ("utf8_as_cp1252", "big5_as_gb18030", "utf8_as_gb18030"):
        codec = mojibake.CHAINS[chain][0][0][0]  # what the encoding can't write is lost before any reader sees it
        written = [t for t in texts if t.encode(codec, "ignore").decode(codec) == t and any(c > "\x7f" for c in t)]
        garbled = [g for t in written if (g := mojibake.garble(t, chain)) != t]
        assert sum(mojibake.repair(model, g) is not None for g in garbled) > 0.97 * len(garbled)


def test_nulls_repeats_long_texts_and_empty_tables(spark, questions, corpus, rows):
    g = mojibake.garble(STEM, "utf8_as_cp1252")
    q = corpus([(900001, g, [None, "", g]), (900002, None, None), (900001, g, [None, "", g]), (900003, STEM * 2000 + g, [])])
    found = [r for r in rows(mojibake.repaired_fields(q).select("row_id", "field_no", "whole")) if r[0] > 900000]
    assert found == [(900001, 0, True), (900001, 0, True), (900001, 3, True), (900001, 3, True), (900003, 0, True)]
    assert rows(mojibake.repaired_fields(questions([]))) == []
    assert mojibake.fit(questions([])) is None


def test_every_stretch_of_a_long_field_is_restored(model):
    part = STEM[:20] + mojibake.garble(STEM[20:30], "utf8_as_cp1252") + STEM[30:]
    restored, _, whole = mojibake.repair(model, "\n".join([part] * 90))
    assert restored == "\n".join([STEM] * 90) and whole
