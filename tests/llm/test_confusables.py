from collections import Counter

import pytest

from examforge.llm import confusables


@pytest.fixture(scope="module")
def known():
    texts = ["Relabel the left-hand lane marking", "kPa rpm flow ratio", "Kernewick", "A trainee", "KC-1234 MT-4321"] * 3
    words = Counter(w.lower() for t in texts for w in confusables._LATIN.findall(t))
    return confusables.Vocabulary([*words, *(p for w in words for p in confusables._pieces(w))])


@pytest.mark.parametrize("text, form, kinds", [
    ("第５9組 ＫＣ-４８", "第59組 KC-48", "full_width"),
    ("⽤⽔ 庫", "用水 庫", "ideograph"),
    ("管‍理﻿幅\xad度", "管理幅度", "invisible"),
    ("僅 甲\xa0乙 丙", "僅 甲 乙 丙", "space"),
    ("Åström", "Åström", "combining"),
    ("the lеft-hand", "the left-hand", "lookalike"),
    ("以919kPа為上限，編KС-78", "以919kPa為上限，編KC-78", "lookalike"),
    ("Kеrnewick", "Kernewick", "lookalike"),
    ("flоw qхzzz", "flow qхzzz", "lookalike"),
    ("編號КС-78", "編號KC-78", "lookalike"),
    ("7.2kРа", "7.2kPa", "lookalike"),
])
def test_forms(known, text, form, kinds):
    assert confusables.normalize(text, known) == (form, kinds)


@pytest.mark.parametrize("text", ["，。（）％", "　", "3℃ 5㎡ 7Ω 9μm 9µm", "○×", "\u00c5str\u00f6m Se\u00f1al", "", "\ufa0e\ufa0f", "夾角α與β", "係數χ與κ", "ρ = 3, τ", "qхzzz", "Привет", "СКА"])
def test_not_cases(known, text):
    assert confusables.normalize(text, known) == (text, "")


def test_counts_of_the_corpus_are_exact_at_every_size(questions, rows):
    q = questions([(1, "Flow flow ÉLAN", ["re-flow", None, "12 rpm"]), (2, None, None)])
    found = dict(rows(confusables.corpus_counts(confusables.question_fields(q))))
    assert found == {"flow": 3, "élan": 1, "re": 1, "rpm": 1, "#flow": 3, "#élan": 1}


def test_words_that_occur_once_do_not_exist(questions, rows):
    q = questions([(1, "a v\u0430lve", ["one valve"]), (2, "a fl\u0430nge", ["flange", "flange"]), (3, "fl\u0430nge", [])])
    found = rows(confusables.normalized_fields(q, confusables.mojibake.Model(["plain text"])).select("row_id", "normalized"))
    assert found == [(2, "a flange"), (3, "flange")]


def test_fields_nulls_and_empty_tables(questions, corpus, rows):
    q = corpus([(900001, "第\uff159組", [None, "", "\u2f64\u2f54", "ok"]), (900002, None, None)])
    assert [r for r in rows(confusables.normalized_fields(q).select("row_id", "field_no", "normalized")) if r[0] > 900000] == [(900001, 0, "第59組"), (900001, 3, "用水")]
    assert rows(confusables.normalized_fields(questions([]))) == []
