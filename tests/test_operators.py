import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.args import Arg, ArgumentError, from_json
from tidemark.operators.anomalydetection import anomalydetection
from tidemark.plans.inspect import nodes, read_columns
from tidemark.registry import REGISTRY, call


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_addtotals(spark):
    ints = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "col1 int, col2 int")
    out = call("addtotals", ints)
    assert rows(out) == [(1, 10, 11), (2, 20, 22), (3, 30, 33)] and out.schema["total"].dataType.simpleString() == "bigint"
    reals = spark.createDataFrame([(1.1, 10), (2.2, None)], "col1 double, col2 int")
    assert rows(call("addtotals", reals, ["sum"])) == [(1.1, 10, 11.1), (2.2, None, None)]
    mixed = spark.createDataFrame([(1, "x", True)], "a int, b string, c boolean")
    assert call("addtotals", mixed).columns == ["a", "b", "c", "total"]
    plain = spark.createDataFrame([("x", True)], "b string, c boolean")
    assert call("addtotals", plain).columns == ["b", "c"]
    with pytest.raises(ArgumentError, match="must be a string"):
        call("addtotals", ints, [3])
    with pytest.raises(Exception, match="null cannot be totalled"):
        call("addtotals", reals, strict=True).collect()
    big = spark.createDataFrame([(2**63 - 1, 1)], "a long, b long")
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        call("addtotals", big).collect()


def test_filldown(spark):
    df = spark.createDataFrame([(1, "Alice", "NY"), (2, None, None), (3, "Bob", None), (4, None, "LA"), (5, None, None)], "id int, name string, city string")
    fill = lambda *a, **k: [tuple(r)[1:] for r in call("filldown", df, list(a), order_by=["id"], **k).orderBy("id").collect()]
    assert fill() == fill("") == [("Alice", "NY"), ("Alice", "NY"), ("Bob", "NY"), ("Bob", "LA"), ("Bob", "LA")]
    assert fill("c*") == fill("city, unknown") == [("Alice", "NY"), (None, "NY"), ("Bob", "NY"), (None, "LA"), (None, "LA")]
    lists = spark.createDataFrame([(1, None), (2, [1]), (3, None)], "id int, a array<int>")
    assert [r["a"] for r in call("filldown", lists, order_by=["id"]).orderBy("id").collect()] == [None, [1], [1]]
    texts = spark.createDataFrame([("a", None), ("b", "x"), ("c", None)], "k string, v string")
    assert [r["v"] for r in call("filldown", texts, order_by=["k"]).orderBy("k").collect()] == [None, "x", "x"]


def test_filldown_over_many_ranges(spark, monkeypatch):
    from tidemark.operators import filldown as module
    from tidemark.operators import ordered

    monkeypatch.setattr(ordered, "RANGE_ROWS", 50)
    monkeypatch.setattr(module, "WINDOW_ROWS", 50)
    monkeypatch.setattr(module, "KEY_ROWS", 50)
    # Texts as the order, half of them one value; a key that is null for a third of the rows.
    df = spark.range(1500).select(F.col("id"), F.when(F.col("id") % 2 == 0, "m").otherwise(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0"))).alias("t"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("key"), F.when(F.col("id") % 101 == 5, F.col("id")).alias("v"), F.when(F.col("id") % 211 == 9, F.array("id")).alias("w"))
    rows = sorted(((("m" if i % 2 == 0 else f"k{i:05d}"), i) for i in range(1500)))
    for keys in ([], ["key"]):
        last, want = {}, {}
        for _, i in rows:
            at = (i % 3 or None) if keys else 0
            v, w = last.get(at, (None, None))
            last[at] = (i if i % 101 == 5 else v, [i] if i % 211 == 9 else w)
            want[i] = last[at]
        got = call("filldown", df, ["v,w"], order_by=["t", "id"], partition_by=keys)
        assert got.columns == df.columns and {r["id"]: (r["v"], r["w"]) for r in got.collect()} == want


def test_columns_of_any_name(spark, monkeypatch):
    from tidemark.operators import filldown as module

    monkeypatch.setattr(module, "WINDOW_ROWS", 50)
    names = ["_part", "_no", "c0", "f0", "_stretch", "_of", "_end_0", "_ahead_0", "_t0", "_k0", "_j0", "_f0", "_lp", "_key", "_freq", "n", "range", "value"]
    df = spark.range(400).select("id", F.when(F.col("id") % 90 == 5, F.col("id")).alias("v"), *[F.concat(F.lit(c), F.col("id") % 3).alias(c) for c in names])
    got = call("filldown", df, ["v"], order_by=["id"])
    assert got.columns == df.columns and [r["_stretch"] for r in got.orderBy("id").limit(3).collect()] == ["_stretch0", "_stretch1", "_stretch2"]
    marked = call("anomalydetection", df, named={"action": "annotate", "fields": "id,n"})
    assert marked.columns[: len(df.columns)] == df.columns and marked.count() == 400
    assert {r["_lp"] for r in marked.collect()} == {"_lp0", "_lp1", "_lp2"}


def test_quantiles_by_ranges(spark, monkeypatch):
    import numpy as np

    from tidemark.functions import quantiles as Q
    from tidemark.operators import ordered

    rnd = np.random.default_rng(3)
    groups = {"a": np.round(rnd.normal(0, 50, 4000)), "b": np.array([7.5]), "c": rnd.random(300)}
    counts = spark.createDataFrame([(g, float(v), int(n), len(x)) for g, x in groups.items() for v, n in zip(*np.unique(x, return_counts=True), strict=True)], "g string, value double, n long, total long")
    shares = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    for most in (200_000, 20):
        monkeypatch.setattr(ordered, "RANGE_ROWS", most)
        found = Q.values_at_ranks(counts, ["g"], F.col("total"), shares, more=["CAST(0 AS BIGINT)"], islands=0.5)
        for r in found.select("g", "islands", *[Q.quantile(p).alias(f"q{k}") for k, p in enumerate(shares)]).collect():
            x = np.sort(groups[r["g"]])
            assert list(r[2:]) == pytest.approx(np.quantile(x, shares).tolist())
            assert r["islands"] == 1 + (np.diff(x) >= 0.5).sum()


def test_anomalies_by_scope(spark, monkeypatch):
    """Each scope gets what a table of its rows alone gets; jobs do not grow with their number."""
    import random

    from tidemark.operators import ordered

    rnd = random.Random(4)
    rows = [(i, rnd.choice(["d1", "d2", None]), rnd.choice("xxxxyz"), rnd.choice([None, rnd.gauss(0, 9), float(rnd.randrange(4))]) if i % 7 == 0 else rnd.gauss(5, 2), rnd.randrange(60)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, day string, kind string, value double, many long")
    text = lambda rs: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rs)
    monkeypatch.setattr(ordered, "RANGE_ROWS", 60)
    for kw in ({"action": "annotate", "fields": "kind,value,many"}, {"method": "iqr", "fields": "value", "param": 0.3, "uselower": True}, {"action": "summary", "fields": "value"}):
        got = anomalydetection(df, partition_by=["day"], **kw)
        want = []
        for day in ("d1", "d2", None):
            alone = anomalydetection(df.filter(F.col("day").eqNullSafe(F.lit(day))), **kw).collect()
            want += [(day, *r) for r in alone] if kw["action" if "action" in kw else "method"] == "summary" else alone
        assert text(got.collect()) == text(want), kw


def test_nearly_equal_values_are_one(spark):
    """Fifty numbers closer than the tolerance and another are two distinct ones: no bins."""
    df = spark.createDataFrame([(1 + k * 1e-12,) for k in range(50)] + [(9.0,)], "value double")
    assert {round(r["probable_cause_freq"] * 51, 6) for r in anomalydetection(df, action="annotate").collect()} == {1.0}


def test_flatten(spark):
    df = spark.createDataFrame([([1, 2], [10, 20], "a"), ([3], [30, 40], "b"), ([], [1], "c"), (None, [5], "d")], "l1 array<int>, l2 array<int>, s string")
    assert rows(call("flatten", df, ["l1,l2"])) == [(1, 10, "a"), (1, 20, "a"), (2, 10, "a"), (2, 20, "a"), (3, 30, "b"), (3, 40, "b"), (None, 5, "d")]
    assert rows(call("flatten", df.select("l1", "s"), ["l1,l1"])) == [(1, "a"), (2, "a"), (3, "b"), (None, "d")]
    missing = call("flatten", df, ["l1,none"])
    assert rows(missing) == [] and missing.schema["l1"].dataType.simpleString() == "int"
    void = spark.range(2).select("id", F.lit(None).alias("v"))
    assert rows(call("flatten", void, ["v"])) == []
    for bad in (["s"], [""], [], [1]):
        with pytest.raises(ArgumentError):
            call("flatten", df, bad)


def test_output_csv(spark, tmp_path):
    path = tmp_path / "sub" / "out.csv"
    df = spark.createDataFrame([(i, f"Name_{i}") for i in range(3)], "id int, name string").coalesce(1)
    assert rows(call("output_csv", df, [str(path)])) == [(str(path), "completed", 3)]
    assert path.read_text() == "id,name\n0,Name_0\n1,Name_1\n2,Name_2\n"
    path.write_text("city,country,population,temperature\nParis,FR,1,2")
    more = spark.createDataFrame([("London", 900, 'a "q", b')], "city string, population int, extra string")
    assert rows(call("output_csv", more, [str(path)], {"append": True})) == [(str(path), "completed", 1)]
    assert path.read_text() == "city,country,population,temperature\nParis,FR,1,2\nLondon,,900,\n"
    times = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-02 03:04:05.678' AS n, TIMESTAMP '2024-01-02 03:04:05Z' AS z, CAST(NULL AS STRING) AS x, 'a \"q\", b' AS q")
    assert call("output_csv", times, [str(path)], {"tee": True}).columns == ["n", "z", "x", "q"]
    assert path.read_text() == 'n,z,x,q\n2024-01-02T03:04:05.678+00:00,2024-01-02T03:04:05.000+0000,,"a ""q"", b"\n'
    call("output_csv", df.limit(0), [str(path)])
    assert path.read_text() == ""
    call("output_csv", df, [str(path)], {"append": True})
    assert path.read_text().startswith("id,name\n")
    for args, named in (([], {}), ([""], {}), ([str(path)], {"append": "yes"}), ([str(path)], {"other": True})):
        with pytest.raises(ArgumentError):
            call("output_csv", df, args, named)
    with pytest.raises(ArgumentError, match="leaves"):
        call("output_csv", df, ["../x.csv"], root=str(tmp_path))


def statuses(spark):
    return spark.createDataFrame([("success", 200)] * 100 + [("error", 500)] * 3 + [("unknown", 999)], "status string, code long")


def test_anomaly_shapes(spark):
    df = statuses(spark)
    found = call("anomalydetection", df)
    assert found.columns == ["status", "code", "log_event_prob", "max_freq", "probable_cause", "probable_cause_freq"]
    assert {r["status"] for r in found.collect()} == {"error", "unknown"}
    assert call("anomalydetection", df, named={"action": "summary"}).count() == 1
    marked = call("anomalydetection", df, named={"action": "annotate"})
    assert marked.count() == 104 and len(marked.columns) == 7
    assert 0 < call("anomalydetection", df, named={"method": "iqr", "action": "rm"}).count() <= 104
    only = call("anomalydetection", df, named={"action": "annotate", "fields": "code"}).collect()
    assert {r["probable_cause"] for r in only} == {"code"}
    spikes = spark.createDataFrame([(100.0,)] * 50 + [(1000.0,)] * 5, "value double")
    clamped = [r["value"] for r in call("anomalydetection", spikes, named={"method": "iqr", "action": "tf"}).collect()]
    assert len(clamped) == 55 and max(clamped) <= 150
    odd = spark.createDataFrame([(10.0,), (11.0,), (math.nan,), (12.0,), (500.0,), (None,)], "value double")
    assert call("anomalydetection", odd, named={"action": "annotate"}).count() == 6
    kept = call("anomalydetection", odd, named={"method": "iqr"}).collect()
    assert sum(r["value"] is None for r in kept) == 1
    assert len(call("anomalydetection", df.limit(0)).columns) == 6 and call("anomalydetection", df.limit(0)).count() == 0
    with pytest.raises(ArgumentError, match="not found"):
        call("anomalydetection", df, named={"fields": "nonexistent"})
    with pytest.raises(ArgumentError):
        anomalydetection(df, method="iqr", action="filter")
    assert call("anomalydetection", df, named={"bins": "many", "unheard": 1}).count() == 4  # passed over


def series(spark, values, column="value"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"_time long, {column} double")


def test_predict_shapes(spark):
    out = call("predict", series(spark, [10.0, 12.0, 14.0, 16.0, 18.0]), ["value"])
    assert out.columns == ["_time", "value", "prediction_value", "lower_prediction_value", "upper_prediction_value"]
    got = out.orderBy("_time").collect()
    assert [r["_time"] for r in got] == list(range(10))
    assert got[0]["prediction_value"] == 10.0 and got[1]["prediction_value"] == 12.0
    assert all(r["lower_prediction_value"] <= r["prediction_value"] <= r["upper_prediction_value"] for r in got)
    gaps = series(spark, [10.0, None, 14.0, 16.0, None])
    assert call("predict", gaps, ["value"], {"algorithm": "LL"}).count() == 8
    assert call("predict", gaps, ["value"], {"algorithm": "LL", "future_timespan": 1}).count() == 5
    cycle = series(spark, [10.0, 12.0, 14.0, 10.0, 12.0, 14.0, 10.0])
    for name in ("LLP", "LLP1", "LLP2", "LLT", "LLB"):
        assert call("predict", cycle, ["value"], {"algorithm": name, "period": 3}).count() == 12
    two = series(spark, [1.0, 2.0, 3.0]).withColumn("other", F.col("value") * 2)
    assert len(call("predict", two, ["value"], {"fields": "other", "algorithm": "LL"}).columns) == 9
    count = call("predict", series(spark, [5.0, 0.0, 9.0, 1.0], "count"), ["count"], {"algorithm": "LL"}).collect()
    assert all(r["lower_prediction_count"] >= 0 for r in count)
    for args, named in ((["none"], {}), ([], {}), (["value"], {"algorithm": "XX"}), (["value"], {"odd": 1}), (["value"], {"future_timespan": "x"})):
        with pytest.raises(ArgumentError):
            call("predict", cycle, args, named)


def test_predict_groups_and_times(spark):
    df = spark.createDataFrame([(2, "b", 20.0), (1, "a", 10.0), (2, "a", 12.0), (1, "b", 18.0)], "_time long, category string, value double")
    got = sorted(rows(call("predict", df, ["value"], {"group_by_fields": "category", "future_timespan": 1, "algorithm": "LL"}).select("category", "_time", "value")))
    assert [(c, t) for c, t, _ in got] == [(c, t) for c in "ab" for t in (1, 2, 3)] and got[2][2] is None
    shuffled = spark.createDataFrame([(300, 3.0), (100, 1.0), (200, 2.0)], "_time long, v double")
    assert [(r["_time"], r["v"]) for r in call("predict", shuffled, ["v"], {"future_timespan": 2, "algorithm": "LL"}).orderBy("_time").collect()] == [(100, 1.0), (200, 2.0), (300, 3.0), (400, None), (500, None)]
    texts = spark.createDataFrame([(f"2025-01-0{d}T00:00:00.000+0800", float(d)) for d in range(1, 6)], "_time string, v double")
    assert [r["_time"] for r in call("predict", texts, ["v"], {"future_timespan": 2, "algorithm": "LLT"}).collect()][-2:] == ["2025-01-06T00:00:00.000+0800", "2025-01-07T00:00:00.000+0800"]
    model = call("predict", series(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ["value"], {"algorithm": "LLT", "future_timespan": 2}, mode="model").orderBy("_time").collect()
    assert model[-1]["prediction_value"] == pytest.approx(8.0, abs=0.2)


def test_registry_and_arguments(spark):
    assert REGISTRY["addtotals"].signatures_json() == '[{"parameters":[]},{"parameters":[{"name":null,"default":null,"arg_type":"INT"}]}]'
    assert [n for n, s in REGISTRY.items() if s.require_ordered] == ["transaction", "filldown", "predict", "anomalydetection"]
    assert from_json('[{"type":"string","value":"a"},{"type":"column","value":"c"}]') == [Arg("string", "a"), Arg("column", "c")]
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    assert call("flatten", df, '[{"type":"column","value":"t"},{"type":"string","value":"b"}]').count() == 2
    assert rows(call("count_column", df)) == [("total_columns", 2)]
    with pytest.raises(Exception, match="always fails"):
        call("error_producer", df).collect()
    with pytest.raises(ArgumentError):
        call("nothing", df)
    with pytest.raises(ArgumentError):
        call("transaction", df, ["a"], {"unheard": "x"})


def test_plans_read_and_shuffle_little(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    total = call("addtotals", lineitem.select("l_quantity", "l_tax"))
    assert nodes(total)["Exchange"] == 0 and read_columns(total) == {"l_quantity", "l_tax"}


def test_sql_functions(spark):
    from tidemark.sql import register, run_sql

    register(spark)
    spark.createDataFrame([(1, None, "x"), (2, 5, None), (3, None, None)], "i int, v int, s string").createOrReplaceTempView("t_sql")
    assert sorted(rows(spark.sql("SELECT i, v, s FROM filldown(TABLE(t_sql), 'v,s', 'i')"))) == [(1, None, "x"), (2, 5, "x"), (3, 5, "x")]
    assert sorted(rows(spark.sql("SELECT i, v, s FROM filldown(TABLE(t_sql), 'v,s', 'i', 's')")), key=str) == [(1, None, "x"), (2, 5, None), (3, 5, None)]
    assert rows(spark.sql("SELECT * FROM count_column(TABLE(t_sql))")) == [("total_columns", 3)]
    assert sorted(r[-1] for r in rows(spark.sql("SELECT * FROM addtotals(TABLE(SELECT i, i * 2 AS j FROM t_sql))"))) == [3, 6, 9]
    assert rows(spark.sql("SELECT * FROM addtotals(TABLE(SELECT CAST(1.5 AS DECIMAL(5,2)) AS d, CAST(NULL AS STRING) AS s, 2 AS i), 'sum')")) == [(Decimal("1.50"), None, 2, 3.5)]
    assert rows(spark.sql("SELECT * FROM flatten_table(TABLE(SELECT array(1, 2) AS a, 'x' AS s, array(3, 4) AS b), 'a,b')")) == [(1, "x", 3), (1, "x", 4), (2, "x", 3), (2, "x", 4)]
    assert rows(spark.sql("SELECT * FROM flatten_table(TABLE(SELECT array(1, 2) AS a), 'a,none')")) == []
    with pytest.raises(Exception, match="always fails"):
        spark.sql("SELECT * FROM error_producer(TABLE(t_sql))").collect()
    assert run_sql(spark, "addtotals", "SELECT i FROM t_sql").count() == 3


def test_streams(spark, tmp_path):
    from tidemark.operators.addtotals import addtotals
    from tidemark.streaming.operators import filldown_stream, transactions_stream

    src = tmp_path / "in"
    events = [("u", 1, "start", 1.0), ("u", 2, "x", None), ("w", 3, "x", None), ("u", 4, "start", None), ("u", 5, "y", 2.0), ("u", 6, "start", None)]
    for k, part in enumerate((events[:3], events[3:])):
        spark.createDataFrame(part, "k string, _time long, _message string, v double").coalesce(1).write.mode("append").parquet(str(src / f"p={k}"))
    stream = lambda: spark.readStream.schema("k string, _time long, _message string, v double").option("maxFilesPerTrigger", 1).parquet(str(src / "p=*"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    filled = {r["_time"]: r["v"] for r in run(filldown_stream(stream(), "v", key="k", order_by="_time"), "s_fill")}
    assert filled == {1: 1.0, 2: 1.0, 3: None, 4: 1.0, 5: 2.0, 6: 2.0}
    done = sorted((r["_time"], tuple(r["_message"]), r["_is_closed"]) for r in run(transactions_stream(stream(), key="k", starts_with="start"), "s_tx"))
    assert done == [(1, ("start", "x"), True), (4, ("start", "y"), True)]
    assert len(run(addtotals(stream()), "s_add")) == 6


def test_output_csv_keeps_the_old_file_when_anything_fails(spark, tmp_path, monkeypatch):
    from tidemark.sources import output_csv as O

    path = tmp_path / "x.csv"
    df = spark.createDataFrame([(i, "a\nb" if i % 2 else "ü") for i in range(50)], "n int, z string").repartitionByRange(5, "n").sortWithinPartitions("n")
    monkeypatch.setattr(O, "CHUNK_BYTES", 7)  # parts are copied in many pieces
    assert rows(O.output_csv(df, str(path))) == [(str(path), "completed", 50)]
    good = path.read_bytes()
    assert good.decode() == "n,z\n" + "".join(f'{i},"a\nb"\n' if i % 2 else f"{i},ü\n" for i in range(50))
    failing = df.withColumn("z", F.when(F.col("n") == 33, F.raise_error("no")).otherwise(F.col("z")))
    for append in (False, True):
        with pytest.raises(Exception, match="no"):
            O.output_csv(failing, str(path), append=append)
        monkeypatch.setattr(O, "COPY_BYTES", 0)  # copies nothing
        with pytest.raises(OSError, match="reached"):
            O.output_csv(df, str(path), append=append)
        monkeypatch.setattr(O, "COPY_BYTES", 5)
        assert path.read_bytes() == good and [x.name for x in tmp_path.iterdir()] == ["x.csv"]
    O.output_csv(df, str(path), append=True)
    assert path.read_bytes() == good + good[4:]


def test_output_csv_lists_only_committed_parts(tmp_path):
    """What failed attempts and lost races left is not in the manifest; abort removes all."""
    from tidemark.sources import output_csv as O

    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "0-stale").write_text("stale")
    writer = O.LineWriter(str(folder))
    writer.commit([O.Part(1, "b", 2, 3), None, O.Part(0, "a", 1, 2)])
    assert (folder / "parts.json").read_text() == '[["a", 1, 2], ["b", 2, 3]]'
    writer.abort([])
    assert not folder.exists()


def test_variant_cells(spark, monkeypatch):
    from tidemark.operators import filldown as module
    from tidemark.operators import ordered

    texts = ["null", None, "1", "null", '"x"', None, "null", "[2]", "1e3", "true", "12345678901234567890"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string").select("id", F.parse_json("s").alias("v"))
    want = ["null", None, "1", "1", '"x"', '"x"', '"x"', "[2]", "1000.0", "true", "12345678901234567890"]
    shown = lambda out: [r[0] for r in out.orderBy("id").select(F.to_json("v")).collect()]
    assert shown(call("filldown", df, order_by=["id"])) == want
    totals = [r["total"] for r in call("addtotals", df).orderBy("id").collect()]
    assert totals == [i + {2: 1.0, 8: 1000.0, 10: 12345678901234567890.0}.get(i, 0.0) for i in range(len(texts))]
    monkeypatch.setattr(ordered, "RANGE_ROWS", 2)
    monkeypatch.setattr(module, "WINDOW_ROWS", 2)
    assert shown(call("filldown", df, order_by=["id"])) == want


def test_table_functions_over_batches(spark):
    from tidemark.batches import register_batches

    df = spark.range(25000).select("id", (F.col("id") % 2).alias("k"), F.when(F.col("id") % 20011 == 7, F.col("id")).alias("v"), F.when(F.col("id") % 9001 == 3, F.array("id")).alias("w"))
    df.createOrReplaceTempView("batch_rows")
    register_batches(spark, "fill_rows", "filldown", "batch_rows", columns="v, w")
    found = spark.sql("SELECT * FROM fill_rows(TABLE(batch_rows) PARTITION BY (k) ORDER BY (id))")  # more than a batch a key
    assert sorted(map(str, found.collect())) == sorted(map(str, call("filldown", df, ["v, w"], order_by=["id"], partition_by=["k"]).collect()))

    lists = spark.createDataFrame([(1, [1, 2], ["a"]), (2, None, ["b", None]), (3, [], ["c"]), (4, [5], None), (5, [6, 7], ["d", "e"])], "id int, a array<int>, b array<string>")
    lists.createOrReplaceTempView("batch_lists")
    register_batches(spark, "flat_rows", "flatten", "batch_lists", columns="a, b")
    assert spark.sql("SELECT * FROM flat_rows(TABLE(batch_lists))").collect() == call("flatten", lists, ["a, b"]).collect()
    register_batches(spark, "flat_none", "flatten", "SELECT id, a FROM batch_lists", columns="a, absent")
    assert spark.sql("SELECT * FROM flat_none(TABLE(SELECT id, a FROM batch_lists))").count() == 0

    numbers = spark.createDataFrame([(1, 2.5, "x"), (None, 1.0, "y")], "a int, b double, c string")
    numbers.createOrReplaceTempView("batch_numbers")
    register_batches(spark, "sum_rows", "addtotals", "batch_numbers", total="sum")
    assert spark.sql("SELECT * FROM sum_rows(TABLE(batch_numbers))").collect() == call("addtotals", numbers, ["sum"]).collect()
    register_batches(spark, "sum_whole", "addtotals", "SELECT 9223372036854775807L AS a, 1L AS b")
    with pytest.raises(Exception, match="overflow"):
        spark.sql("SELECT * FROM sum_whole(TABLE(SELECT 9223372036854775807L AS a, 1L AS b))").collect()
    with pytest.raises(ArgumentError, match="no function over batches"):
        register_batches(spark, "x", "transaction", "batch_rows")
    assert spark.sql("SELECT * FROM fill_rows(TABLE(SELECT * FROM batch_rows WHERE id < 0) PARTITION BY (k) ORDER BY (id))").count() == 0
