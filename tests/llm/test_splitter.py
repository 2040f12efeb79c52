import random

import pytest

from examforge.llm import splitter
from examforge.llm.tokens import count_tokens

DOCS = "doc_id bigint, source string, text string, max_tokens int, piece string"
LIMITS = "source string, max_tokens int, overlap_tokens int, text string"


def made(seed, n):
    r = random.Random(seed)
    parts = ["第 {} 條　承辦人應先檢查蓄水塔。再填報！", "{}. 下列何者正確？(A) 甲", "考生常把車道變換與煞車油壓混為一談；兩者不同。", "The pump at Kernewick was replaced. It works.", "😀é́", "無標點的一長串文字" * 30]
    return "\n".join(r.choice(parts).format(r.randint(1, 60)) for _ in range(n))


@pytest.mark.parametrize("most, overlap", [(60, 10), (200, 0), (64, 31), (64, 500), (7, 2)])
def test_pieces_cover_the_text_keep_the_limit_and_share_the_overlap(most, overlap):
    for seed in range(4):
        text = made(seed, 40)
        pieces = splitter.split(text, most, overlap)
        assert len(pieces) > 1 and pieces[0][0] == 0 and pieces[-1][1] == len(text)
        for (s, e, *_), (s2, e2, _, said) in zip(pieces, pieces[1:]):
            assert s < s2 <= e < e2
            shared = count_tokens([text[s2:e]])[0]
            wanted = min(overlap, (most - 1) // 2)
            assert said >= wanted or s2 == e or said > 0
            assert wanted == 0 or shared >= wanted - 2
            if not wanted:
                assert s2 == e
        assert all(n == count_tokens([text[s:e]])[0] <= max(most, 12) for s, e, n, _ in pieces)


def test_cuts_at_the_strongest_boundary():
    text = "\n".join(f"第 {i} 條　" + "承辦人應先檢查蓄水塔再填報。" * 3 for i in range(1, 20))
    assert all(text[s:].startswith("第") for s, *_ in splitter.split(text, 200, 0))


def test_documents_without_limits_nulls_and_empty_tables(spark, rows):
    long = made(1, 60)
    docs = spark.createDataFrame([(1, "a", long, 0, ""), (1, "a", long, 0, ""), (2, "a", "short", 0, ""), (3, "none", long, 0, ""), (4, "a", None, 0, ""), (5, None, long, 0, ""), (6, "zero", long, 0, ""), (7, "a", "", 0, "")], DOCS)
    limits = spark.createDataFrame([("a", 100, 10, ""), ("zero", 0, 0, ""), ("null", None, None, "")], LIMITS)
    found = splitter.pieces(docs, limits)
    assert {r.doc_id for r in found.collect()} == {1}
    first = [r for r in found.collect() if r.piece_no == 0]
    assert len(first) == 2 and all(r.piece == long[r.start_char : r.end_char] for r in found.collect())
    assert rows(splitter.pieces(docs.limit(0), limits)) == [] and rows(splitter.pieces(docs, limits.limit(0))) == []


def test_of_several_limits_of_a_source_the_smallest_holds(spark):
    docs = spark.createDataFrame([(1, "a", made(1, 60), 0, "")], DOCS)
    limits = [("a", 300, 0, ""), ("a", 100, 5, ""), ("a", 100, None, ""), ("a", 100, 10, "")]
    found = [splitter.pieces(docs, spark.createDataFrame(x, LIMITS)).collect() for x in (limits, limits[::-1], [("a", 100, 10, "")])]
    assert found[0] == found[1] == found[2] and all(r.overlap_tokens >= 10 for r in found[0] if r.piece_no)


def test_very_long_text_without_boundaries():
    pieces = splitter.split("甲" * 200_000, 500, 20)
    assert pieces[-1][1] == 200_000 and all(n <= 500 for _, _, n, _ in pieces)
