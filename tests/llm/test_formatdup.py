import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from examforge.llm import formatdup


def plain(s):
    s, out = s.lower(), []
    for i, c in enumerate(s):
        if c == "." and 0 < i < len(s) - 1 and unicodedata.category(s[i - 1]) == unicodedata.category(s[i + 1]) == "Nd":
            out.append(c)
        elif not c.isspace() and unicodedata.category(c)[0] != "P":
            out.append(c)
    return "".join(out)


TEXT = st.text(st.sampled_from("aAbB 3.5，。？甲乙\t　ßéÉİΣς$"), max_size=12)


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_hashes_and_pointers_agree_with_the_written_out_form(a, b):
    same = plain(a) == plain(b)
    h = formatdup.rolling_hashes([a, "x", b, ""])
    assert (h[0][0] == h[0][2] and h[1][0] == h[1][2]) == same
    assert formatdup.same_reduced(a, b) == same
    assert formatdup.reduced(a) == plain(a)


def brute(rows):
    sets = {}
    for i, q, o in rows:
        if i is not None and q and o is not None:
            sets.setdefault((plain(q), tuple(sorted(plain(x or "") for x in o))), set()).add(i)
    return sorted((min(s), i) for s in sets.values() for i in s if i != min(s))


def test_pairs_against_brute_force(questions, rows):
    r = random.Random(1)
    data = [(i, r.choice(["Ab c", "a，bc", "A.B", "3.5", "35", "3 .5", "", None]), r.choice([["x", "Y"], ["y ", "X"], ["x"], [], None, ["x", None], ["", "X"]])) for i in range(400)]
    data += data[:20] + [(1000 + i, "hot one", ["a"]) for i in range(500)]
    assert rows(formatdup.copy_pairs(questions(data))) == brute(data)


def test_collapsed_counts_and_empty_tables(questions, rows):
    q = questions([(3, "A b", ["x", "y"]), (1, "ab", ["Y", "x"]), (2, "other", []), (4, None, ["x"])])
    assert rows(formatdup.collapsed(q).select("row_id", "n_copies")) == [(1, 2), (2, 1)]
    assert rows(formatdup.copy_pairs(questions([]))) == []


def test_rows_whose_keys_meet_by_accident_are_grouped_by_their_text():
    assert formatdup.reduced_record("A b", ["y", None, "X"]) == formatdup.reduced_record("ab", ["x", "Y", ""])
    assert not formatdup.same_record("ab", ["x"], "ab", ["y"])


@pytest.mark.parametrize("n", [3_000_000])
def test_long_texts(n):
    a, b = formatdup.rolling_hashes(["甲 " * n, "甲" * n])[0]
    assert a == b
