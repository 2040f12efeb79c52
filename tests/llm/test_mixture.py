import pytest

from examforge.llm import mixture
from examforge.llm.tokens import count_tokens

DOCS = "doc_id bigint, source string, text string, n_tokens int, place int"
TARGETS = "source string, target_share double, max_repeats int, available int"


@pytest.fixture
def tables(spark):
    return lambda docs, targets: (spark.createDataFrame([(i, s, t, 0, 0) for i, s, t in docs], DOCS), spark.createDataFrame([(*t, 0) for t in targets], TARGETS))


def test_shares_repeats_and_thresholds(tables):
    docs = [(i, "big", "檢查蓄水塔 and the pump " * (1 + i % 7)) for i in range(900)] + [(2000 + i, "small", "更換煞車總泵 " * (1 + i % 3)) for i in range(60)]
    docs += [(3000, "none", "x"), (3001, None, "y"), (3002, "big", None), (3003, "big", "")]
    mixed, report = mixture.mix(*tables(docs, [("big", 0.5, 1), ("small", 0.1, 4), ("missing", 0.1, 2), ("nulls", None, None)]))
    n = {i: count_tokens([t])[0] for i, _, t in docs}
    total = sum(n.values())
    r = {x.source: x for x in report.collect()}
    assert r["missing"].short and r["missing"].tokens == 0
    assert not r["big"].short and abs(r["big"].tokens - 0.5 * total) <= max(n.values())
    small = sum(n[i] for i, s, _ in docs if s == "small")
    assert r["small"].short == (small * 4 < 0.1 * total)
    uses = {x.doc_id: x for x in mixed.collect()}
    assert all(1 <= u.copies <= (1 if u.source == "big" else 4) and u.n_tokens == n[i] for i, u in uses.items())
    copies = {u.copies for u in uses.values() if u.source == "small"}
    assert max(copies) - min(copies) <= 1
    assert sum(u.copies * u.n_tokens for u in uses.values() if u.source == "big") == r["big"].tokens
    assert abs(sum(x.actual_share or 0 for x in r.values()) - 1) < 1e-9


def test_short_sources_use_all_their_repeats(tables):
    docs = [(1, "a", "檢查 " * 10), (2, "b", "x " * 1000)]
    mixed, report = mixture.mix(*tables(docs, [("a", 0.9, 3), ("b", 0.1, 1)]))
    r = {x.source: x for x in report.collect()}
    assert r["a"].short and r["a"].most_repeats == 3 and r["a"].tokens == 3 * r["a"].available


def test_empty_tables(tables, rows):
    mixed, report = mixture.mix(*tables([], [("a", 1.0, 1)]))
    assert rows(mixed) == [] and report.count() == 1
    mixed, report = mixture.mix(*tables([(1, "a", "x")], []))
    assert rows(mixed) == [] and rows(report) == []
