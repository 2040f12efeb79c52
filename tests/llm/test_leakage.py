import random

import pytest

from examforge.llm import leakage

DOCS = "doc_id bigint, text string, lang string, item_id bigint, passage string"
ITEMS = "item_id bigint, lang string, passage string, text string"


@pytest.fixture
def tables(spark):
    return lambda docs, items: (spark.createDataFrame([(i, t, "zh", 1, "x") for i, t in docs], DOCS), spark.createDataFrame([(i, k, p, "x") for i, k, p in items], ITEMS))


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, k, p in items:
            n = leakage.RUN["en" if k == "en" else "zh"]
            a, b = leakage.squash(t or ""), leakage.squash(p or "")
            if any(b[j : j + n] in a for j in range(len(b) - n + 1)):
                out.add((d, i))
    return sorted(out)


def test_exact_runs_against_brute_force(tables, rows):
    r = random.Random(2)
    zh = "蓄水塔燃油濾清器檢查更換煞車下列何者正確灌區公尺㎡①ＡｂÅ"
    items = [(i, "zh", "".join(r.choices(zh, k=r.randint(20, 80)))) for i in range(12)]
    items += [(20 + i, "en", "".join(r.choices("abcdef ,", k=140))) for i in range(6)] + [(40, None, None), (41, "zh", ""), (42, "zh", items[0][2])]
    docs = [(900, None), (901, ""), (902, "短")]
    for d in range(120):
        i, k, p = r.choice(items[:18])
        n = r.choice([20, 23, 24, 25, 26, 40, 49, 50, 51, 60])
        s = r.randrange(max(1, len(p) - n))
        quote = p[s : s + n]
        if r.random() < 0.3:
            quote = "，".join(quote)
        if r.random() < 0.2:
            quote = quote.upper()
        docs.append((d, "".join(r.choices(zh + "xyz", k=r.randint(0, 60))) + quote + "".join(r.choices(zh, k=r.randint(0, 60)))))
    docs += docs[:3]
    want = brute(docs, items)
    assert want and rows(leakage.exact_leaks(*tables(docs, items))) == want


def test_composed_characters_are_squashed_with_their_text():
    for t in ("été ㎡ Σας ｶﾞ", "Å̊", "가각", "ﬁ①", "\U0001d400"):
        cps, starts = leakage.squashed([t, "x", t])
        text = cps.astype("<u4").tobytes().decode("utf-32-le")
        assert text[starts[0] : starts[1]] == text[starts[2] : starts[3]] == leakage.squash(t)


def test_edited_passages_are_found_with_their_similarity(tables, rows):
    r = random.Random(5)
    zh = "蓄水塔燃油濾清器檢查更換煞車下列何者正確灌區公尺測試標示腐植質堆肥後視鏡進水閘門"
    items = [(i, "zh", "".join(r.choices(zh, k=80))) for i in range(40)]
    docs = []
    for i, _, p in items:
        c = list(p)
        for k in r.sample(range(80), 4):
            c[k] = r.choice(["改", "", "換改"])
        docs.append((i, "".join(r.choices(zh, k=50)) + "".join(c) + "".join(r.choices(zh, k=50))))
    found = leakage.edited_leaks(*tables(docs, items), share=0.8, repetitions=6).collect()
    assert all(f.doc_id == f.item_id and 0.8 <= f.similarity < 1 for f in found)
    assert len(found) >= 0.9 * len(items)


def test_one_sided_edits_are_found_at_the_production_parameters(tables, rows):
    r = random.Random(8)
    zh = "蓄水塔燃油濾清器檢查更換煞車下列何者正確灌區公尺測試標示腐植質堆肥後視鏡進水閘門"
    items, docs, want = [], [], {}
    for n in (51, 73, 80, 200):
        for one_sided in ("insert", "delete"):
            for edits in (1, 3, n // 20, n // 10):
                for at in (0.2, 0.5, 0.8):  # in one group, so that a window without an edit is certain
                    i, k = len(items), int(at * n)
                    p = "".join(r.choices(zh, k=n))
                    c = p[:k] + "改" * edits + p[k:] if one_sided == "insert" else p[:k] + p[k + edits :]
                    items.append((i, "zh", p))
                    docs.append((i, "".join(r.choices("天地玄黃", k=40)) + c + "".join(r.choices("天地玄黃", k=40))))
                    want[i] = edits
    found = {(f.doc_id, f.item_id): f.similarity for f in leakage.edited_leaks(*tables(docs, items)).collect()}
    assert set(found) == {(i, i) for i in want}
    for (i, _), similarity in found.items():
        assert similarity >= 1 - want[i] / len(items[i][2]) - 1e-9


@pytest.mark.parametrize("lang, lengths, symbols", [("zh", (51, 80), "蓄水塔燃油濾清器檢查更換煞車下列何者正確灌區公尺測試標示腐植質堆肥後視鏡進水閘門"), ("en", (110, 160), "etaoinshrdlucmfw ygpbvk")])
def test_recall_at_the_production_parameters_with_edits_at_random_places(tables, lang, lengths, symbols):
    r = random.Random(3)
    items, docs, of = [], [], {}
    for kind in ("substitute", "insert", "delete", "mixed"):
        for rate in (0.03, 0.06, 0.09):
            for k in range(20):
                i, n = len(items), r.choice(lengths)
                p = "".join(r.choices(symbols, k=n))
                c = list(p)
                for at in sorted(r.sample(range(n), int(rate * len(leakage.squash(p)))), reverse=True):
                    how = r.choice(("substitute", "insert", "delete")) if kind == "mixed" else kind
                    c[at : at + (how != "insert")] = [] if how == "delete" else [r.choice("改換新zqx")]
                items.append((i, lang, p))
                docs.append((i, "".join(r.choices("天地玄黃", k=40)) + "".join(c) + "".join(r.choices("天地玄黃", k=40))))
                of.setdefault((kind, rate), set()).add((i, i))
    found = {(f.doc_id, f.item_id) for f in leakage.edited_leaks(*tables(docs, items)).collect()}
    for case, pairs in of.items():
        assert len(pairs & found) >= 0.9 * len(pairs), case


def test_repetitions_follow_from_the_target():
    assert 1 <= leakage.repetitions_for(0.9, 0.5) <= leakage.repetitions_for(0.9, 0.9) <= leakage.repetitions_for(0.9, 0.99) < 64


def test_nearest_is_the_least_distance_to_any_part():
    import numpy as np

    r = random.Random(4)
    a = lambda s: np.array([ord(c) for c in s])
    for _ in range(60):
        p, t = ("".join(r.choices("abc", k=r.randint(*k))) for k in ((1, 9), (0, 14)))
        least = min(leakage.edit_distance(a(p), a(t[i:j]), 99) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert leakage.nearest(leakage.passage_bits(a(p)), len(p), a(t)) == least


def test_equal_windows_embed_equally_and_edits_keep_some_samples():
    cps, _ = leakage.squashed(["abcdefghijklmnopqrstuvwxyz" * 2])
    import numpy as np

    h = leakage.window_hashes(cps, np.array([0, 26, 1]), 12, 0)
    assert h[0] == h[1] != h[2]


def test_edit_distance():
    import numpy as np

    a = lambda s: np.array([ord(c) for c in s])
    assert leakage.edit_distance(a("kitten"), a("sitting"), 9) == 3
    assert leakage.edit_distance(a("abc"), a("abc"), 0) == 0
    assert leakage.edit_distance(a("abc"), a("xyz"), 1) == 2


def test_empty_tables(tables, rows):
    assert rows(leakage.exact_leaks(*tables([], [(1, "zh", "蓄水塔" * 20)]))) == []
    assert rows(leakage.exact_leaks(*tables([(1, "蓄水塔" * 20)], []))) == []
