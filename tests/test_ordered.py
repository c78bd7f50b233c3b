"""Scans over ranges against running values of a list, and transactions against the replay of one event at a time."""

import random

import pytest
from pyspark.sql import functions as F
from replay import replay

from tidemark.operators import ordered as O
from tidemark.operators.transaction import Params, transaction

SECOND = 1_000_000


def test_running_values(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE_ROWS", 20)
    rnd = random.Random(2)
    rows = [(rnd.choice("aaaaab"), t, rnd.choice([1, -1, 0]), rnd.choice([None, None, t]), rnd.randrange(2)) for t in range(200)]
    laid = O.lay(spark.createDataFrame(rows, "k string, t long, step int, v long, m int"), ["k"], [F.asc("t")], ["step"])
    assert laid.parts == 10 and laid.rows.select("_part").distinct().count() > 5
    got = laid.depth(F.col("step"), "depth").total(F.col("step"), "sum").last(F.col("v"), "last").last(F.col("v"), "before", "m", inclusive=False).rows.collect()
    for k in "ab":
        depth = total = 0
        last, before = None, {}
        for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["t"]):
            assert r["depth"] == depth and r["before"] == before.get(r["m"])
            total += r["step"]
            depth = max(0, depth + r["step"])
            last = r["v"] if r["v"] is not None else last
            before[r["m"]] = r["v"] if r["v"] is not None else before.get(r["m"])
            assert (r["sum"], r["last"]) == (total, last)


def test_equal_times_are_spread_and_counted_once(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE_ROWS", 10)
    laid = O.lay(spark.createDataFrame([("k", 5, "m")] * 100, "k string, t long, m string").repartition(4), ["k"], [F.asc("t")], ["m"])
    sums = [r["n"] for r in laid.total(F.lit(1), "n").rows.collect()]
    assert sorted(sums) == list(range(1, 101)) and laid.rows.select("_part").distinct().count() > 5


def test_reached_doubles_links(spark):
    rnd = random.Random(5)
    links = {x: rnd.randrange(x + 1, min(x + 9, 301)) for x in range(300)}
    links = {x: y for x, y in links.items() if y < 300}
    want, roots = set(), [0, 150]
    links = {x: y for x, y in links.items() if y not in roots and not (x < 150 <= y)}
    for at in roots:
        while at is not None:
            want.add(at)
            at = links.get(at)
    got = O.reached(spark.createDataFrame([(r,) for r in roots], "no long"), spark.createDataFrame(list(links.items()), "x long, y long"))
    assert sorted(r["no"] for r in got.collect()) == sorted(want)


def expected(rows, p):
    out = []
    last = min(r[0] for r in rows)
    for k in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == k), reverse=True)
        hit = lambda text, r: bool(text) and text in r[2]
        group, only, closed, _ = replay(p, [r[0] for r in own], [hit(p.starts_with, r) for r in own], [hit(p.ends_with, r) for r in own], [(k,)] * len(own), last)
        for g in set(group) - {-1}:
            inside = [r for r, x, o in zip(own, group, only, strict=True) if x == g and not o]
            times = [r[0] for r, x in zip(own, group, strict=True) if x == g]
            if inside:
                out.append((k, closed[g], min(times), tuple(sorted(r[3] for r in inside)), (max(r[0] for r in inside) - min(times)) / 1e6))
    return sorted(out)


BRACKETS = {"starts_with": "start", "ends_with": "end"}


@pytest.mark.parametrize(
    "kw",
    [
        {**BRACKETS, "max_events": -1},
        {**BRACKETS, "max_events": 3},
        {**BRACKETS, "max_events": 1},
        {**BRACKETS, "max_span": "9s", "max_events": -1},
        {**BRACKETS, "max_span": "12s", "max_events": 4},
        {"starts_with": "start", "max_events": 3},
        {"starts_with": "start", "max_span": "7s", "max_events": -1},
        {"starts_with": "start", "max_span": "9s", "max_events": 3},
        {"max_span": "6s", "max_events": -1},
        {"max_span": "9s", "max_events": 3},
    ],
)
def test_random_events_equal_the_replay(spark, monkeypatch, kw):
    """Five keys, one with half of all events, over ranges of some twenty rows."""
    monkeypatch.setattr(O, "RANGE_ROWS", 25)
    rnd = random.Random(str(kw))
    times = rnd.sample(range(700), 300)
    rows = [(t * SECOND, rnd.choice("aaaabcde"), rnd.choice(["start", "end", "x", "y", "x end", "start end"] if rnd.random() < 0.5 else ["x", "y", "end"]), str(t)) for t in times]
    df = spark.createDataFrame(rows, "_time long, k string, _message string, n string")
    got = [(r["k"], r["_is_closed"], int(r["_time"].timestamp() * 1e6), tuple(r["n"]), r["_duration"]) for r in transaction(df, "k", **kw).collect()]
    p = Params(["k"], starts_with=kw.get("starts_with", ""), ends_with=kw.get("ends_with", ""), span=int(kw["max_span"][:-1]) * SECOND if "max_span" in kw else None, max_events=None if kw["max_events"] < 0 else kw["max_events"])
    assert sorted(got) == expected(rows, p)


def test_brackets_and_spans_run_without_python(spark):
    df = spark.createDataFrame([(t * SECOND, "k", "end" if t % 2 else "start") for t in range(20)], "_time long, k string, _message string")
    for kw in ({**BRACKETS}, {"max_span": "3s"}, {"starts_with": "start", "max_span": "3s"}):
        plan = transaction(df, "k", **kw)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_empty_tables_and_no_keys(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE_ROWS", 7)
    rows = [(t * SECOND, "k", "start" if t % 5 == 0 else "end" if t % 3 == 0 else "x", str(t)) for t in range(30)]
    df = spark.createDataFrame(rows, "_time long, k string, _message string, n string")
    for kw in ({**BRACKETS}, {"max_span": "3s"}, {"starts_with": "start", "max_span": "3s"}):
        assert transaction(df.limit(0), "k", **kw).count() == 0
        keys = "" if "starts_with" in kw else "k"
        p = Params([], starts_with=kw.get("starts_with", ""), ends_with=kw.get("ends_with", ""), span=3 * SECOND if "max_span" in kw else None)
        assert transaction(df, keys, **kw).count() == len(expected(rows, p))
