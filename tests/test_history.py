import datetime as dt

import pytest

from examforge.operators import history

ATTEMPTS = "session_id bigint, pos int, user_id bigint, bank string, qid int, user_answer string, correct boolean, s_bank string"
SESSIONS = "session_id bigint, date_iso timestamp, bank string, day string"


@pytest.fixture
def log(spark):
    def make(attempts, sessions):
        a = spark.createDataFrame([(*x, "clash") for x in attempts], ATTEMPTS)
        s = spark.createDataFrame([(i, dt.datetime.fromisoformat(t) if t else None, b, "clash") for i, t, b in sessions], SESSIONS)
        return history.resolved(a, s)

    return make


def test_banks_fall_back_and_repeats_count_once(log, rows):
    r = log([(1, 0, 7, "a", 1, "2", True), (1, 0, 7, "a", 1, "2", True), (1, 1, 7, "", 2, None, None), (2, 0, 7, None, 3, "[]", False), (9, 0, 7, None, 4, "0", True)], [(1, "2024-01-02", "s"), (2, None, None)])
    assert rows(r.select("session_id", "pos", "bank", "correct", "answered")) == [
        (1, 0, "a", True, True), (1, 1, "s", False, False), (2, 0, history.DEFAULT_BANK, False, False), (9, 0, history.DEFAULT_BANK, True, True),
    ]


def test_pools_follow_the_log_and_count_skips(log):
    attempts = [
        (1, 0, 7, "a", 1, "1", False), (2, 0, 7, "a", 1, "2", True),  # recovered
        (1, 1, 7, "a", 2, None, False),  # skipped only
        (1, 2, 7, "b", 1, "0", True),  # the same id in another bank
        (3, 0, 7, "a", 3, "0", False), (2, 1, 7, "a", 3, "0", True),  # a later session with an earlier time counts last
    ]
    r = log(attempts, [(1, "2024-01-01", ""), (2, "2024-01-03", ""), (3, "2024-01-02", "")])
    p = {(x.bank, x.qid): x for x in history.wrong_pools(r, "2024-01-01").collect()}
    assert p["a", 1].ever and not p["a", 1].still and p["a", 1].today and not p["a", 1].past
    assert p["a", 2].still and not p["b", 1].ever
    assert p["a", 3].still and p["a", 3].past
    counts = {(x.bank, x.qid): x for x in history.attempt_counts(r).collect()}
    assert ("a", 2) not in counts and counts["a", 1].total == 2 and not counts["a", 1].often_wrong


def test_accuracy_bounds_are_strict(log):
    r = log([(1, 0, 7, "a", 1, "1", False), (1, 1, 7, "a", 1, "1", True)], [(1, "2024-01-01", "")])
    counts = history.attempt_counts(r)
    assert history.stat_filter(counts, 1, 50).count() == 0
    assert history.stat_filter(counts, 1, 51).count() == 1
    assert history.thresholds("x", "900") == (0, 100.0) and history.thresholds(-3, None) == (0, None) and history.thresholds(float("nan"), "0") == (0, 1.0)


def test_stats_know_banks_that_were_only_skipped(log):
    r = log([(1, 0, 7, "a", 1, None, False), (1, 1, 7, "b", 1, "0", True), (1, 2, 7, "b", 1, "0", True)], [(1, "2024-01-01", "")])
    s = {x.bank: x for x in history.practice_stats(r).collect()}
    assert (s["a"].questions, s["a"].attempts) == (0, 0) and s["a"].last_at
    assert (s["b"].questions, s["b"].attempts) == (1, 2)


def test_scores_round_half_up(log, rows):
    r = log([(1, k, 7, "a", k, "0", k == 0) for k in range(8)], [(1, "2024-01-01", "")])
    assert rows(history.session_scores(r)) == [(1, 8, 1, 7, 0, 13, "retry")]


def test_empty_log(log):
    r = log([], [])
    for f in (lambda: history.wrong_pools(r, "2024-01-01"), lambda: history.attempt_counts(r), lambda: history.practice_stats(r), lambda: history.session_scores(r)):
        assert f().count() == 0
