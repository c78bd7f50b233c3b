"""Span transactions of streams: restarts, late events, state that is forgotten, limits."""

import random

import pytest

from tidemark.streaming.spans import late_rows, transactions_by_span

SECOND = 1_000_000
SCHEMA = "k string, _time long, _message string"


class Source:
    def __init__(self, spark, folder, **kw):
        self.spark, self.folder, self.kw = spark, folder, {"key": "k", "max_span": "10s", "delay": "5 seconds"} | kw

    def put(self, rows):
        self.spark.createDataFrame([(k, t * SECOND, m) for k, t, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self):
        """All that has come so far, from where the last run ended; (late rows, rows of state at the end)."""
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.folder}/in")
        query = transactions_by_span(stream, **self.kw).writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/at").trigger(availableNow=True).start()
        query.awaitTermination()
        return late_rows(query), query.lastProgress.stateOperators[0].numRowsTotal

    def groups(self):
        rows = self.spark.read.parquet(f"{self.folder}/out").filter("NOT _late").collect()
        return sorted((r["k"], r["_time"] // SECOND, tuple(r["_message"]), r["_duration"], r["_event_count"]) for r in rows)


def expected(rows, upto, span=10, limit=None):
    out = []
    for k in {r[0] for r in rows}:
        own, lo = sorted(r[1:] for r in rows if r[0] == k), 0
        while lo < len(own) and own[lo][0] + span < upto:
            hi = lo
            while hi < len(own) and own[hi][0] <= own[lo][0] + span and (limit is None or hi - lo < limit):
                hi += 1
            out.append((k, own[lo][0], tuple(m for _, m in own[lo:hi]), float(own[hi - 1][0] - own[lo][0]), hi - lo))
            lo = hi
    return sorted(out)


@pytest.mark.parametrize("limit", [None, 2])
def test_restarts_and_disorder(spark, tmp_path, limit):
    """Events up to the delay out of order, in batches with a restart after each."""
    rnd = random.Random(limit or 0)
    rows = [(rnd.choice("aab"), t, f"m{t}") for t in rnd.sample(range(1, 200), 90)]
    rows.sort(key=lambda r: r[1] + rnd.random() * 4)
    source = Source(spark, f"file://{tmp_path}/s", max_events=limit)
    late = 0
    for lo in range(0, 90, 30):
        source.put(rows[lo : lo + 30])
        n, _ = source.run()
        late += n
        assert source.groups() == expected(rows[: lo + 30], max(r[1] for r in rows[: lo + 30]) - 5, limit=limit)
    assert late == 0


def test_late_events_join_nothing_and_state_shrinks(spark, tmp_path):
    source = Source(spark, f"file://{tmp_path}/s")
    first = [("a", 100, "x"), ("a", 104, "y"), ("b", 103, "q"), ("c", 110, "r")]
    source.put(first)
    _, before = source.run()
    source.put([("a", 101, "late"), ("d", 50, "late"), ("a", 109, "z"), ("a", 300, "end")])
    late, after = source.run()
    assert late == 2 and after < before
    assert source.groups() == expected([*first, ("a", 109, "z"), ("a", 300, "end")], 295)


def test_state_and_timers_are_kept_by_bucket(spark, tmp_path):
    """Calls to the state grow with buckets, not with keys, and keys of a bucket stay apart."""
    rnd = random.Random(5)
    rows = [(f"k{rnd.randrange(200)}", t, f"m{t}") for t in rnd.sample(range(1, 900), 800)]
    rows.sort(key=lambda r: r[1] + rnd.random() * 4)
    source = Source(spark, f"file://{tmp_path}/s", buckets=3)
    for lo in (0, 400):
        source.put(rows[lo : lo + 400])
        _, state = source.run()
        assert state <= 2 * 3  # a list and a timer for each
        assert source.groups() == expected(rows[: lo + 400], max(r[1] for r in rows[: lo + 400]) - 5)


def test_a_bucket_has_fewer_timers_than_keys(spark, tmp_path):
    source = Source(spark, f"file://{tmp_path}/s")
    source.put([(f"k{i}", 100 + i % 3, "m") for i in range(6000)])
    stream = spark.readStream.schema(SCHEMA).parquet(f"{source.folder}/in")
    query = transactions_by_span(stream, **source.kw).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.recentProgress[0].stateOperators[0].customMetrics["numRegisteredTimers"] <= 4096


@pytest.mark.parametrize("kind,keys", [("double", ["NaN", "0.5", "-0.0", "0.0"]), ("timestamp", ["2024-01-01 00:00:00.000001", "2024-01-01 00:00:00.000002"]), ("decimal(20,2)", ["1.50", "123456789012345678.01"]), ("struct<a:int,b:string>", ["1", "2"])])
def test_keys_of_other_types(spark, tmp_path, kind, keys):
    rows = spark.createDataFrame([(k, t * SECOND, "m") for k in keys for t in (100, 101, 200)], SCHEMA)
    key = "named_struct('a', int(k), 'b', if(k = '1', null, k))" if kind.startswith("struct") else f"cast(k as {kind})"
    typed = rows.selectExpr(f"{key} AS k", "_time", "_message")
    typed.write.parquet(f"{tmp_path}/in")
    groups = transactions_by_span(spark.readStream.schema(typed.schema).parquet(f"{tmp_path}/in"), key="k", max_span="10s", delay="5 seconds", buckets=1)
    assert groups.schema["k"].dataType == typed.schema["k"].dataType
    query = groups.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(groups.schema).parquet(f"{tmp_path}/out").groupBy("k").agg({"_event_count": "sum"})
    want = typed.filter(f"_time < {150 * SECOND}").groupBy("k").count()
    assert sorted(map(str, found.collect())) == sorted(str(r).replace("count", "sum(_event_count)") for r in want.collect())


def test_parameters(spark):
    with pytest.raises(ValueError):
        transactions_by_span(spark.createDataFrame([], SCHEMA), key="k", max_span="0s", delay="1 second")


def test_a_bucket_of_several_chunks(spark, tmp_path):
    """Events of a bucket that stay behind are held in chunks and put together again."""
    source = Source(spark, f"file://{tmp_path}/s", buckets=1)
    first = [("a", 100, "x"), *((f"k{i}", 200, "m") for i in range(10_500))]
    source.put(first)
    _, state = source.run()
    assert state <= 2 + 1 and source.groups() == [("a", 100, ("x",), 0.0, 1)]
    source.put([("k1", 205, "n"), ("b", 300, "end")])
    source.run()
    assert source.groups() == expected([*first, ("k1", 205, "n"), ("b", 300, "end")], 295)


def test_no_buckets(spark):
    with pytest.raises(ValueError):
        transactions_by_span(spark.createDataFrame([], SCHEMA), key="k", max_span="1s", delay="1 second", buckets=0)
