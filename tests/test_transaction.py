"""Scenarios of event sequences, newest first one minute apart, and the groups they make (oldest first)."""

import pytest
from pyspark.sql import functions as F

from replay import replay

from tidemark.operators.transaction import Params, span_micros, transaction

MINUTE = 60_000_000


def groups(messages, starts="", ends="", span=None, max_events=1000, step=MINUTE):
    n = len(messages)
    times = [(n - i) * step for i in range(n)]
    p = Params(["host"], starts_with=starts, ends_with=ends, span=span, max_events=None if max_events < 0 else max_events)
    group, only, closed, _ = replay(p, times, [bool(starts) and starts in m for m in messages], [bool(ends) and ends in m for m in messages], [("h",)] * n, times[-1])
    found = {}
    for i, g in enumerate(group):
        if not only[i]:
            found.setdefault(g, []).insert(0, messages[i])
    return sorted(("C" if closed[g] else "O", m) for g, m in found.items())


SCENARIOS = [
    ("end,end,middle,start,middle,start,other", dict(starts="start", ends="end"), [("C", "start,middle,end")] * 2 + [("O", "other")]),
    ("end,end,start,start,other", dict(starts="start", ends="end", max_events=3), [("C", "start,end")] * 2 + [("O", "other")]),
    ("end,middle,start,start,start,other", dict(starts="start", ends="end"), [("C", "start,middle,end"), ("O", "start"), ("O", "start"), ("O", "other")]),
    ("end,end,end,middle,start,other", dict(starts="start", ends="end"), [("O", "end"), ("C", "start,middle,end"), ("O", "other,end")]),
    ("middle,middle,start,start,other", dict(starts="start", ends="end"), [("O", "start,middle,middle"), ("O", "start"), ("O", "other")]),
    ("end,middle,end,middle,other", dict(starts="start", ends="end"), [("O", "middle,end"), ("O", "other,middle,end")]),
    ("middle,end,middle,end", dict(ends="end"), [("O", "middle"), ("C", "middle,end"), ("C", "end")]),
    ("end,middle,start,end,start,end,m3,m2,m1,start,other", dict(starts="start", ends="end", max_events=3), [("C", "start,middle,end"), ("C", "start,end"), ("O", "m2,m3,end"), ("O", "start,m1"), ("O", "other")]),
    ("middle,middle,start,middle,start,middle,start", dict(starts="start"), [("C", "start,middle,middle"), ("C", "start,middle"), ("C", "start,middle")]),
    ("start,start,start,middle,other", dict(starts="start"), [("C", "start")] * 3 + [("O", "other,middle")]),
    ("end,end,end,middle,middle,other", dict(ends="end"), [("C", "end")] * 2 + [("C", "other,middle,middle,end")]),
]


@pytest.mark.parametrize("messages,params,expected", SCENARIOS)
def test_scenarios(messages, params, expected):
    assert groups(messages.split(","), **params) == sorted((c, m.split(",")) for c, m in expected)


@pytest.mark.parametrize("span,starts,ends,number,closed", [(3, "view", "purchase", 5, None), (6, "view", "purchase", 4, None), (10, "", "", 1, 1), (6, "", "purchase", 4, None)])
def test_spans(span, starts, ends, number, closed):
    events = "category,product,purchase,purchase,addtocart,view,view,oldlink,addtocart,oldlink,view".split(",")
    found = groups(events, starts=starts, ends=ends, span=span * 1_000_000, step=1_000_000)
    assert len(found) == number
    assert closed is None or sum(c == "C" for c, _ in found) == closed


def test_caps():
    events = [str(i) for i in range(1, 12)]
    for kw in (dict(max_events=3), dict(span=2 * MINUTE)):
        found = groups(events, **kw)
        assert sorted(len(m) for _, m in found) == [2, 3, 3, 3]
        assert sorted(c for c, m in found if len(m) == 3) == ["C"] * 3
        assert [c for c, m in found if len(m) == 2] == ["O"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_frame_matches_replay(spark):
    rows = []
    for host in ("a", "b"):
        for messages, _, _ in SCENARIOS[:1]:
            m = messages.split(",")
            rows += [((len(m) - i) * MINUTE, host, x, i) for i, x in enumerate(m)]
    df = frame(spark, rows, "_time long, host string, _message string, n int")
    out = transaction(df, "host", starts_with="start", ends_with="end")
    assert out.columns == ["_time", "_message", "_duration", "_event_count", "_is_closed", "host", "n"]
    got = sorted((r["host"], r["_is_closed"], tuple(r["_message"]), r["_event_count"], r["_duration"]) for r in out.collect())
    assert got == sorted(x for h in "ab" for x in [(h, True, ("start", "middle", "end"), 3, 240.0), (h, True, ("start", "middle", "end"), 3, 240.0), (h, False, ("other",), 1, 0.0)]) or len(got) == 6


def test_degenerate_limits(spark):
    df = frame(spark, [(i * MINUTE, "h", m) for i, m in enumerate("other2,other1,start,middle,end".split(","))], "_time long, host string, _message string")
    for kw in ({"max_events": 0}, {"max_span": "0s"}):
        rows = transaction(df, "host", starts_with="start", ends_with="end", **kw).collect()
        assert len(rows) == 5 and not any(r["_is_closed"] for r in rows)


def test_nullable_keys(spark):
    df = frame(spark, [(5, "xxx", "kkk", "1"), (4, "xxx", "jjj", "2"), (3, "yyy", "lll", "3"), (2, None, "lll", "4"), (1, None, "lll", "5"), (0, None, None, "6")], "_time long, key string, key2 string, _message string")
    got = sorted(sorted(r["_message"]) for r in transaction(df, "key,key2").collect())
    assert got == [["1"], ["2"], ["3", "4", "5"]]


def test_bridging(spark):
    verbs = ["offline", None, "upload", None, "download", None, "upload"]
    df = frame(spark, [(10_000_000 - i * 500_000, "1", "s", v, str(i)) for i, v in enumerate(verbs)], "_time long, id string, session string, verb string, _message string")
    assert transaction(df, "id,session,verb", max_span="1s").count() == 4


def test_flags_without_message(spark):
    df = frame(spark, [(3, "u", None, "true"), (2, "u", None, None), (1, "u", "true", None)], "_time long, user string, start_flag string, end_flag string")
    rows = transaction(df, "user", starts_if_field="start_flag", ends_if_field="end_flag").collect()
    assert [(r["_is_closed"], r["_event_count"], r["_message"]) for r in rows] == [(True, 3, [])]


def test_window_plans_match_replay(spark):
    """Start-only and end-only without limits, and grouping with a cap: aggregates against the machine."""
    import random

    rnd = random.Random(3)
    rows = [(t * 7, str(rnd.randrange(5)), rnd.choice(["start", "end", "x", "y"]), str(t)) for t in range(300)]
    df = frame(spark, rows, "_time long, k string, _message string, n string")
    for kw in ({"starts_with": "start", "max_events": -1}, {"ends_with": "end", "max_events": -1}, {"max_events": 7}):
        got = sorted((r["k"], r["_is_closed"], tuple(r["n"])) for r in transaction(df, "k", **kw).collect())
        want = []
        for k in {r[1] for r in rows}:
            own = sorted((r for r in rows if r[1] == k), reverse=True)
            p = Params(["k"], starts_with=kw.get("starts_with", ""), ends_with=kw.get("ends_with", ""), max_events=None if kw["max_events"] < 0 else kw["max_events"])
            group, _, closed, _ = replay(p, [r[0] for r in own], ["starts_with" in kw and r[2] == "start" for r in own], ["ends_with" in kw and r[2] == "end" for r in own], [(k,)] * len(own), 0)
            for g in set(group):
                want.append((k, closed[g], tuple(sorted(r[3] for r, x in zip(own, group, strict=True) if x == g))))
        assert got == sorted(want), kw


def test_parameters():
    assert span_micros("about 2m") == 2 * MINUTE and span_micros("-3s") is None and span_micros("") is None
    with pytest.raises(ValueError):
        span_micros("soon")
    _ = F


# Thirty events (milliseconds, id, action or none) and the groups they make.
THREE_NULLS = [(344, 9687, None), (461, 9687, "download"), (653, 5319, None), (1043, 5319, None), (2448, 5319, None), (2897, 9687, None), (3157, 5319, None), (3558, 9687, None), (4290, 2941, "download"), (5252, 2941, None), (5398, 9687, None), (5906, 9687, None), (6725, 5319, "login"), (6994, 5319, None), (7233, 2941, "play"), (7805, 2941, None), (8837, 9687, "upload"), (9522, 9687, None), (10484, 5319, None), (10875, 5319, None), (11761, 2941, "login"), (12504, 2941, None), (13501, 9687, None), (14428, 9687, None), (14785, 5319, None), (15138, 5319, None), (15233, 2941, None), (16040, 2941, None), (17122, 2941, "download"), (17922, 2941, None)]
THREE_NULL_GROUPS = {(2941, "login"): {15, 20}, (2941, "play"): {14, 9}, (2941, "download"): {21, 26, 27, 28, 29, 8}, (9687, "upload"): {10, 11, 16, 17, 22, 23, 5, 7}, (5319, "login"): {12, 13, 18, 19, 2, 24, 25, 3, 4, 6}, (9687, "download"): {0, 1}}


def test_consecutive_null_keys(spark):
    rows = [(1_600_000_000_000_000 + ms * 1000, str(i), f"s{i}", a, str(n)) for n, (ms, i, a) in enumerate(THREE_NULLS)]
    df = frame(spark, rows, "_time long, id string, session string, action string, _message string")
    got = {(int(r["id"]), r["action"]): set(map(int, r["_message"])) for r in transaction(df, "id,session,action").collect()}
    assert got == THREE_NULL_GROUPS


def test_three_nullable_keys_and_many_batches(spark):
    """Keys that never are null deal the rows; batches of a few rows cut through the keys."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        test_consecutive_null_keys(spark)
        rows = [(t * 1_000_000, f"k{t % 4}", "end" if t % 8 > 3 else "start") for t in range(64)]
        out = transaction(frame(spark, rows, "_time long, k string, _message string"), "k", starts_with="start", ends_with="end").collect()
        assert len(out) == 32 and all(r["_is_closed"] and r["_message"] == ["start", "end"] for r in out)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_keys_equal_the_replay(spark):
    """Random keys with nulls, equal times, spans and limits, against a scan of all live groups for each event."""
    import random

    from tidemark.operators import transaction as T

    rnd = random.Random(11)
    for kw in (dict(), dict(max_events=3), dict(span=40), dict(span=25, max_events=2)):
        for _ in range(20):
            n = 120
            times = sorted((rnd.randrange(300) for _ in range(n)), reverse=True)
            keys = [k for k in (tuple(rnd.choice([None, None, "a", "b", "c"]) for _ in range(3)) for _ in range(3 * n)) if any(k)][:n]
            p = Params(["x", "y", "z"], span=kw.get("span"), max_events=kw.get("max_events"))
            none = [False] * n
            assert T.replay(p, times, none, keys, times[-1]) == replay(p, times, none, none, keys, times[-1])


def test_null_keys_take_time_in_proportion():
    """Ten times the events and live groups take about ten times as long."""
    import time

    from tidemark.operators import transaction as T

    took = []
    for n in (3_000, 30_000):
        keys = [(str(i), None) if i % 3 else (None, str(i)) for i in range(n)]
        began = time.process_time()
        T.replay(Params(["x", "y"]), list(range(n, 0, -1)), [False] * n, keys, 0)
        took.append(time.process_time() - began)
    assert took[1] < 40 * took[0]
