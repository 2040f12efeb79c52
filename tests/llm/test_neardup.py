import random

import numpy as np
import pytest

from examforge.llm import neardup
from tests.llm.test_formatdup import plain


def grams(q, o):
    s = plain(q) + "".join(sorted(plain(x or "") for x in o))
    return {s[i : i + 3] for i in range(len(s) - 2)}


def brute(data, t):
    d = [(i, (plain(q), tuple(sorted(plain(x or "") for x in o))), grams(q, o)) for i, q, o in data if q and o is not None]
    return sorted(
        (min(a, b), max(a, b)) for k, (a, x, s) in enumerate(d) for b, y, u in d[:k]
        if x != y and s and u and len(s & u) >= t * len(s | u) - 1e-9
    )


def made(n, seed):
    r = random.Random(seed)
    words = ["蓄水塔", "燃油濾清器", "檢查", "更換煞車", "下列何者正確", "灌區", "12.5公尺", "pump", "at Kernewick"]
    data = []
    for i in range(n):
        if data and r.random() < 0.5:
            _, q, o = r.choice(data)
            k = r.randrange(len(q))
            data.append((i, q[:k] + r.choice(["", "改", "，", " "]) + q[k + 1 :], r.sample(o, len(o))))
        else:
            data.append((i, "".join(r.choices(words, k=r.randint(3, 9))), [r.choice(words) for _ in range(3)]))
    return data


@pytest.mark.parametrize("t", [0.7, 0.8])
def test_pairs_against_brute_force(questions, rows, t):
    data = made(150, 4) + [(1000, "", ["a"]), (1001, None, ["a"]), (1002, "ab", []), (1003, "ab", []), (1004, "abc", None)]
    assert rows(neardup.row_pairs(questions(data), t).select("row_id_a", "row_id_b")) == brute(data, t)


def test_cut_lists_lose_nothing(spark, rows):
    texts = [(i, plain(q) + "".join(sorted(map(plain, o)))) for i, q, o in made(200, 9)]
    df = spark.createDataFrame(texts, "id bigint, text string")
    whole = rows(neardup.similar_classes(df, 0.7).select("a", "b"))
    assert whole and rows(neardup.similar_classes(df, 0.7, list_rows=7).select("a", "b")) == whole


def test_blocks_and_rows_give_the_same_candidates(monkeypatch):
    r = np.random.default_rng(3)
    n = 300
    e = {"id": np.arange(n), "size": np.sort(r.integers(20, 60, n)).astype(np.int32), "pos": r.integers(0, 12, n).astype(np.int32)} | {b: r.integers(0, 2**3, n).astype(np.uint64) for b in neardup._BITS}
    order = np.lexsort((e["pos"], e["size"]))
    e = {k: v[order] for k, v in e.items()}
    found = []
    for short in (10_000, 0):
        monkeypatch.setattr(neardup, "SHORT", short)
        pairs = [np.stack(p) for p in neardup.list_pairs(e, np.array([0]), 0.7)]
        found.append({tuple(sorted(p)) for p in np.concatenate(pairs, axis=1).T.tolist()})
    assert found[0] == found[1] and found[0]


def test_groups(questions, rows):
    base = "承辦人員巡查蓄水塔發現抽水機組異常依序執行檢查燃油濾清器與更換煞車總泵下列敘述何者正確"
    data = [(5, base, ["a"]), (3, base[:-2] + "錯誤", ["a"]), (9, base[:-4] + "最佳錯誤", ["a"]), (7, base + "？", ["A"]), (8, "另一題完全不同的題目", ["b"])]
    assert rows(neardup.groups(questions(data)).select("row_id", "group_id")) == [(3, 3), (5, 3), (7, 3), (8, 8), (9, 3)]


def test_empty_table(questions, rows):
    assert rows(neardup.row_pairs(questions([]))) == []


def test_lists_of_more_than_a_thousand_parts_lose_nothing(spark, rows):
    base = "承辦人員巡查蓄水塔發現抽水機組異常依序執行檢查燃油濾清器與更換煞車總泵下列敘述何者正確"
    texts = [(i, base + chr(0x4E00 + i)) for i in range(1100)]
    found = neardup.similar_classes(spark.createDataFrame(texts, "id bigint, text string"), 0.7, list_rows=1)
    assert found.count() == 1100 * 1099 // 2


def test_parts_of_large_classes_and_hot_keys_lose_nothing(questions, rows, monkeypatch, spark):
    base = "承辦人員巡查蓄水塔發現抽水機組異常依序執行檢查燃油濾清器與更換煞車總泵下列敘述何者正確"
    data = [(i, base + "，" * i, ["a"]) for i in range(40)] + [(100 + i, base[:-2] + "錯誤" + "。" * i, ["a"]) for i in range(30)]
    whole = rows(neardup.row_pairs(questions(data)))
    monkeypatch.setattr(neardup, "MEMBERS", 7)
    assert len(whole) == 40 * 30 and rows(neardup.row_pairs(questions(data))) == whole

    from examforge.llm.common import hot_join

    left = spark.createDataFrame([(i % 3 if i < 90 else i, i) for i in range(100)], "k int, v int")
    right = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "k int, t string")
    assert rows(hot_join(left, right, "k", "v", hot=5)) == rows(left.join(right, "k"))


def test_ordered_sets_and_packed_rows_against_single_texts():
    texts = ["", "ab", *("".join([plain(q), *sorted(map(plain, o))]) for _, q, o in made(60, 2))]
    counts = np.random.default_rng(1).integers(2, 9, 1 << 10)
    text, tokens, often = neardup._ordered(texts, counts)
    for i, x in enumerate(texts):
        one = neardup.shingles(x)
        count = counts[neardup._rarity(one, len(counts))]
        assert tokens[text == i].tolist() == one[np.lexsort((one, count))].tolist()
    e = neardup._prefixes(texts, counts, 0.7)
    assert len(e["text"]) == sum(len(s) - int(np.ceil(0.7 * len(s) - 1e-9)) + 1 for s in map(neardup.shingles, texts) if len(s))
    rows = {k: v for k, v in e.items() if k not in ("text", "token")}
    rows |= {"id": e["text"], "list": (e["token"] % 97).astype(np.uint32) << np.uint32(24), "side": np.full(len(e["text"]), 2, np.uint8)}
    packed = neardup._packed(rows, 8, 0.7).to_pydict()
    back = {}
    for blob in zip(packed["n"], packed["rows"], packed["bits"]):
        for k, v in neardup._unpacked_rows([blob], 0.7).items():
            back.setdefault(k, []).extend(v.tolist())
    wide = neardup._wide(rows["size"], rows["pos"], 0.7)
    full = {k: (np.where(wide, v, 0) if k in neardup._BITS[2:] else v).tolist() for k, v in rows.items()}
    assert sorted(zip(*(back[k] for k in full))) == sorted(zip(*full.values()))


@pytest.mark.parametrize("short", [10_000, 0])
def test_what_stands_in_front_counts_as_different(monkeypatch, short):
    # 100 shingles each, 15 in front of the first common one: 5 more may differ behind it, but the bitmaps differ in 20
    monkeypatch.setattr(neardup, "SHORT", short)
    e = {"id": np.arange(2), "size": np.full(2, 100, np.int32), "pos": np.full(2, 15, np.int32)} | {b: np.zeros(2, np.uint64) for b in neardup._BITS}
    count = lambda: sum(len(x) for x, _ in neardup.list_pairs(e, np.array([0]), 0.7))
    assert count() == 1
    e["b0"][1] = 2**20 - 1
    assert count() == 0


def test_a_table_of_one_vocabulary_needs_few_candidates_and_little_room(spark):
    # every text has the same 40 words in another order and other numbers: all meet in the lists, none is similar
    r = random.Random(5)
    words = ["".join(chr(0x4E00 + r.randrange(300)) for _ in range(3)) for _ in range(40)]
    texts = ["".join(r.sample(words, 25)) + str(r.randrange(10**6)) for _ in range(3000)]
    counts = np.maximum(np.bincount(np.concatenate([neardup._rarity(neardup.shingles(x), 1 << 20) for x in texts]), minlength=1 << 20), 1)
    e = neardup._prefixes(texts, counts, 0.7)
    rows = {k: v for k, v in e.items() if k not in ("text", "token")} | {"id": e["text"], "side": np.full(len(e["text"]), 2, np.uint8)}
    rows["list"] = (neardup.mix64(e["token"].view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    packed = neardup._packed(rows, 1, 0.7).to_pydict()
    assert len(packed["rows"][0]) + len(packed["bits"][0]) < 32 * packed["n"][0]
    back = neardup._unpacked_rows([(packed["n"][0], packed["rows"][0], packed["bits"][0])], 0.7)
    starts = np.flatnonzero(np.append(True, back["list"][1:] != back["list"][:-1]))
    assert sum(len(x) for x, _ in neardup.list_pairs(back, starts, 0.7)) < len(texts) // 10
