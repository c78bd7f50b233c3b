"""Queries over the reference's operators, and the same in DuckDB's SQL.

Lists are joined to texts, and times come as numbers of microseconds, so that both sides compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.batches import register_batches
from tidemark.operators.anomalydetection import anomalydetection
from tidemark.operators.filldown import filldown
from tidemark.registry import call
from tidemark.scratch import shared_path
from tidemark.streaming.operators import filldown_stream, transactions_stream
from tidemark.streaming.spans import late_rows, transactions_by_span


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def addtotals_lineitem(spark, sf_dir):
    columns = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return call("addtotals", table(spark, sf_dir, "lineitem").select(*columns))


def addtotals_integers(spark, sf_dir):
    return call("addtotals", table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), ["sum_of_row"])


def addtotals_no_numbers(spark, sf_dir):
    return call("addtotals", table(spark, sf_dir, "part").select("p_name", "p_brand"))


def _gappy(spark, sf_dir):
    big = F.col("value") > 50
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.when(big, F.col("value")).alias("value"), F.when(big, F.col("event_type")).alias("value_kind"), F.when(~big, F.col("event_type")).alias("other"))


def filldown_all(spark, sf_dir):
    return call("filldown", _gappy(spark, sf_dir), order_by=["ts", "event_id"])


def filldown_prefix(spark, sf_dir):
    return call("filldown", _gappy(spark, sf_dir), ["value*"], order_by=["ts", "event_id"])


def filldown_by_user(spark, sf_dir):
    return filldown(_gappy(spark, sf_dir), "value, other", order_by=["ts", "event_id"], partition_by=["user_id"])


def filldown_by_text(spark, sf_dir):
    """An order that begins with a text of few values."""
    return filldown(_gappy(spark, sf_dir).withColumn("kind", F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 1)), "value, other", order_by=["kind", "event_id"])


def _cells(spark, sf_dir):
    """Cells that hold a text, a variant null, nothing, a number with a fraction or true."""
    kind = F.col("event_id") % 5
    number = F.concat(F.col("event_id").cast("string"), F.lit(".25"))
    cell = F.when(kind == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).when(kind == 1, "null").when(kind == 3, number).when(kind == 4, "true")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.parse_json(cell).alias("cell"))


def filldown_variant(spark, sf_dir):
    return call("filldown", _cells(spark, sf_dir), ["cell"], order_by=["ts", "event_id"]).withColumn("cell", F.to_json("cell"))


def addtotals_variant(spark, sf_dir):
    return call("addtotals", _cells(spark, sf_dir)).withColumn("cell", F.to_json("cell"))


def _batched(function: str, relation: str, of: str = "", **options):
    """A table function over batches in SQL; ``of``: how its TABLE argument is dealt and sorted."""

    def run(spark, sf_dir):
        source = {"gappy": _gappy, "lists": _lists, "items": lambda *a: table(*a, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")}[relation](spark, sf_dir)
        source.createOrReplaceTempView(f"tidemark_{relation}")
        register_batches(spark, f"tidemark_{function}", function, f"tidemark_{relation}", **options)
        return spark.sql(f"SELECT * FROM tidemark_{function}(TABLE(tidemark_{relation}) {of})")

    return run


def _lists(spark, sf_dir):
    words = F.split("p_name", " ")
    sizes = F.when(F.col("p_size") % 5 == 0, F.array().cast("array<int>")).when(F.col("p_size") % 5 != 1, F.array(F.col("p_size"), F.col("p_size") + 1))
    return table(spark, sf_dir, "part").select("p_partkey", words.alias("word"), sizes.alias("size"))


def flatten_one(spark, sf_dir):
    return call("flatten", _lists(spark, sf_dir), ["word"]).drop("size")


def flatten_two(spark, sf_dir):
    return call("flatten", _lists(spark, sf_dir), ["word, size"])


def flatten_missing(spark, sf_dir):
    return call("flatten", _lists(spark, sf_dir).drop("size"), ["word, absent"])


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("_time"), F.col("event_type").alias("_message"), "user_id", F.col("event_id").cast("string").alias("event_id"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.unix_micros("_time").alias("start_us"), F.array_join("_message", ">").alias("messages"), F.col("_duration").alias("duration"), F.col("_event_count").alias("events"), F.col("_is_closed").alias("closed"), F.array_join("event_id", ",").alias("ids"))


def _tx(**named):
    return lambda spark, sf_dir: _shown(call("transaction", _events(spark, sf_dir), ["user_id"], named))


def anomaly(**kw):
    def run(spark, sf_dir):
        cols = kw.get("columns", ("event_type", "user_id", "value"))
        name = kw.get("table", "events")
        ids = {"events": "event_id", "orders": "o_orderkey"}[name]
        rest = {k: v for k, v in kw.items() if k not in ("columns", "table")}
        df = table(spark, sf_dir, name).select(F.col(ids).alias("id"), *cols)
        out = anomalydetection(df, fields=",".join(cols), **rest)
        return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])  # logarithms may differ in the last bit

    return run


def anomaly_by_day(spark, sf_dir):
    """Each day's rows against that day's frequencies."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    out = anomalydetection(rows, fields="event_type", action="annotate", partition_by=["day"])
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def count_columns(spark, sf_dir):
    return call("count_column", table(spark, sf_dir, "customer"))


def _shared_folder(spark) -> str:
    """A folder that driver and executors share, as a plain path."""
    return shared_path(spark, "csv").removeprefix("file://").removeprefix("file:")


def output_csv_status(spark, sf_dir):
    return call("output_csv", table(spark, sf_dir, "nation"), [f"{_shared_folder(spark)}/nation.csv"]).select("status", "rows_written")


def output_csv_content(spark, sf_dir):
    """The file's lines after a first write and an append whose columns differ: one is missing, one is dropped."""
    target = f"{_shared_folder(spark)}/places.csv"
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.col("n_name"), F.lit(', "n"')).alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("region"))
    call("output_csv", nation, [target], order_by=["n_nationkey"]).count()
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"), F.lit(1).alias("other"))
    call("output_csv", region, [target], {"append": True}, order_by=["region"]).count()
    lines = spark.read.text(target, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", "line"))
    return lines.select((F.col("at") + 1).cast("bigint").alias("line_no"), "line")


def error_message(spark, sf_dir):
    """What the failing sample says: the error itself would end the caller's run."""
    from pyspark.errors import PySparkException

    try:
        call("error_producer", table(spark, sf_dir, "region")).collect()
    except PySparkException as e:
        found = "error_producer always fails" in str(e)
        return spark.range(1).select(F.lit(found).alias("failed"), F.lit("error_producer always fails").alias("message"))
    return spark.range(1).select(F.lit(False).alias("failed"), F.lit(None).cast("string").alias("message"))


def transaction_two_keys(spark, sf_dir):
    """Groups by two keys, four events at most."""
    events = _events(spark, sf_dir).withColumn("part", (F.col("event_id").cast("bigint") % 3).cast("string"))
    out = call("transaction", events, ["user_id, part"], {"max_events": 4})
    return out.select("user_id", "part", F.unix_micros("_time").alias("start_us"), F.array_join("_message", ">").alias("messages"), F.col("_event_count").alias("events"), F.col("_is_closed").alias("closed"))


def transaction_regex(spark, sf_dir):
    """Brackets told by patterns."""
    return _tx(starts_with_regex="^v.*w$", ends_with_regex="purch[a-z]+e", max_events=-1)(spark, sf_dir)


def transaction_flags(spark, sf_dir):
    """Brackets told by columns that hold "true" in any case."""
    events = _events(spark, sf_dir).withColumn("opens", F.when(F.col("_message") == "view", "TRUE").otherwise("no")).withColumn("shuts", F.col("_message") == "purchase")
    return _shown(call("transaction", events, ["user_id"], {"starts_if_field": "opens", "ends_if_field": "shuts", "max_events": -1}))


def transaction_null_keys(spark, sf_dir):
    """A second key that two events of five lack: they join what their user did next."""
    n = F.col("event_id").cast("bigint") % 5
    events = _events(spark, sf_dir).withColumn("part", F.when(n < 2, "a").when(n == 2, "b"))
    out = call("transaction", events, ["user_id, part"], {"max_events": -1})
    return out.select("user_id", "part", F.unix_micros("_time").alias("start_us"), F.array_join("_message", ">").alias("messages"), F.col("_event_count").alias("events"), F.array_join("event_id", ",").alias("ids"))


def _streamed(stream: DataFrame) -> DataFrame:
    """What a stream gives over all that its source has now."""
    spark = stream.sparkSession
    out = shared_path(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _event_stream(spark, sf_dir):
    # A pattern: a stream's source is a folder or a pattern, and the table may be one file.
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def stream_filldown(spark, sf_dir):
    big = F.col("value") > 50
    rows = _event_stream(spark, sf_dir).select("event_id", "user_id", F.when(big, F.col("value")).alias("value"), F.when(~big, F.col("event_type")).alias("other"))
    return _streamed(filldown_stream(rows, "value, other", key="user_id", order_by="event_id"))


def stream_transactions(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).select(F.unix_micros(F.col("ts").cast("timestamp")).alias("_time"), F.col("event_type").alias("_message"), F.col("user_id").cast("string").alias("user_id"))
    done = _streamed(transactions_stream(rows, key="user_id", starts_with="view"))
    return done.select("user_id", F.col("_time").alias("start_us"), F.array_join("_message", ">").alias("messages"), F.col("_duration").alias("duration"), F.col("_event_count").alias("events"), F.col("_is_closed").alias("closed"))


_BATCHES, _LATE_BY = 3, 2 * 86_400_000_000


def _spans_of_batches(late: bool):
    """Events arrive in batches by time, with ``late`` one in seven two days behind; after each the stream
    is started again from its checkpoint. Closed groups and, in one row, the number of late events."""

    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_time"), F.col("event_type").alias("_message"))
        arrival = F.col("_time") + (F.when(F.col("event_id") % 7 == 3, _LATE_BY).otherwise(0) if late else 0)
        rows = rows.withColumn("arrival", arrival)
        lo, hi = rows.agg(F.min("arrival"), F.max("arrival")).first()
        source, out, progress = (shared_path(spark, n) for n in ("arrivals", "stream", "progress"))
        n_late = 0
        for k in range(_BATCHES):
            batch = rows.filter(F.floor((F.col("arrival") - lo) * _BATCHES / (hi - lo + 1)) == k).select("user_id", "_time", "_message")
            batch.write.mode("append").parquet(source)
            groups = transactions_by_span(spark.readStream.schema(batch.schema).parquet(source), key="user_id", max_span="6h", delay="1 hour")
            query = groups.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
            query.awaitTermination()
            n_late += late_rows(query)
        found = spark.read.schema(groups.schema).parquet(out)
        closed = found.filter("NOT _late").select("user_id", F.col("_time").alias("start_us"), F.array_join("_message", ">").alias("messages"), F.col("_duration").alias("duration"), F.col("_event_count").alias("events"))
        if not late:
            return closed
        none = F.lit(None)
        return closed.unionAll(found.filter("_late").agg((F.count("*") + n_late).alias("n")).select(none.cast("string"), none.cast("bigint"), F.lit("late"), none.cast("double"), "n"))

    return run


def predict_hourly(algorithm: str, **named):
    def run(spark, sf_dir):
        hourly = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp").alias("_time")).agg(F.sum("value").alias("total"))
        return call("predict", hourly, ["total"], {"algorithm": algorithm, "group_by_fields": "event_type", **named})

    return run


def predict_times(spark, sf_dir):
    """Only what SQL can say too: the times of the rows ahead."""
    out = predict_hourly("LL", future_timespan=3)(spark, sf_dir)
    return out.filter("total IS NULL").select("event_type", F.unix_micros("_time").alias("time_us"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "addtotals_lineitem": addtotals_lineitem,
        "addtotals_integers": addtotals_integers,
        "addtotals_no_numbers": addtotals_no_numbers,
        "filldown_all": filldown_all,
        "filldown_prefix": filldown_prefix,
        "filldown_by_user": filldown_by_user,
        "filldown_by_text": filldown_by_text,
        "filldown_variant": filldown_variant,
        "addtotals_variant": addtotals_variant,
        "sql_addtotals": _batched("addtotals", "items"),
        "sql_flatten": _batched("flatten", "lists", columns="word, size"),
        "sql_filldown": _batched("filldown", "gappy", "PARTITION BY (user_id) ORDER BY (ts, event_id)", columns="value, other"),
        "flatten_one": flatten_one,
        "flatten_two": flatten_two,
        "flatten_missing": flatten_missing,
        "transaction_grouping": _tx(max_events=-1),
        "transaction_max_events": _tx(max_events=7),
        "transaction_two_keys": transaction_two_keys,
        "transaction_max_span": _tx(max_span="6h", max_events=-1),
        "transaction_starts": _tx(starts_with="view", max_events=-1),
        "transaction_ends": _tx(ends_with="purchase", max_events=-1),
        "transaction_brackets": _tx(starts_with="view", ends_with="purchase", max_events=-1),
        "transaction_regex": transaction_regex,
        "transaction_flags": transaction_flags,
        "transaction_null_keys": transaction_null_keys,
        "anomaly_categorical_annotate": anomaly(columns=("event_type",), action="annotate"),
        "anomaly_filter": anomaly(columns=("o_orderstatus", "o_orderpriority"), table="orders", sensitivity="lenient"),
        "anomaly_summary": anomaly(columns=("o_orderstatus", "o_orderpriority"), table="orders", action="summary"),
        "anomaly_bins_annotate": anomaly(columns=("value",), action="annotate"),
        "anomaly_zscore": anomaly(columns=("o_orderstatus", "o_orderpriority"), table="orders", method="zscore", action="annotate", pthresh=0.3),
        "anomaly_iqr_remove": anomaly(columns=("o_orderstatus", "o_orderpriority"), table="orders", method="iqr", action="remove", param=0.1),
        "anomaly_no_cutoff": anomaly(columns=("value",), action="annotate", cutoff=False),
        "anomaly_strict": anomaly(columns=("value",), action="annotate", cutoff=False, sensitivity="strict"),
        "anomaly_very_lenient": anomaly(columns=("o_orderstatus",), table="orders", action="annotate", sensitivity="very_lenient"),
        "anomaly_iqr_transform": anomaly(columns=("o_totalprice",), table="orders", method="iqr", action="transform", param=0.2, uselower=True),
        "anomaly_by_day": anomaly_by_day,
        "count_column": count_columns,
        "output_csv_status": output_csv_status,
        "output_csv_content": output_csv_content,
        "error_producer": error_message,
        "stream_filldown": stream_filldown,
        "stream_transactions": stream_transactions,
        "stream_spans": _spans_of_batches(False),
        "stream_late": _spans_of_batches(True),
        "predict_llp5": predict_hourly("LLP5"),
        "predict_llt": predict_hourly("LLT"),
        "predict_llp": predict_hourly("LLP", period=24),
        "predict_times": predict_times,
    }


_GAPPY = "WITH g AS (SELECT event_id, ts, user_id, CASE WHEN value > 50 THEN value END AS value, CASE WHEN value > 50 THEN event_type END AS value_kind, CASE WHEN NOT value > 50 THEN event_type END AS other FROM events)"


def _filled(name: str, over: str) -> str:
    return f"last_value({name} IGNORE NULLS) OVER ({over}ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {name}"


_EVENTS = "e AS (SELECT user_id::VARCHAR AS user_id, epoch_us(ts) AS t, event_type AS m, event_id FROM events)"
_TX = "SELECT user_id, min(t) AS start_us, string_agg(m, '>' ORDER BY t) AS messages, (max(t) - min(t)) / 1e6 AS duration, count(*) AS events, {closed} AS closed, string_agg(event_id::VARCHAR, ',' ORDER BY event_id::VARCHAR) AS ids FROM {source} GROUP BY user_id{group}"


def _span_sql(hours: int) -> str:
    span = hours * 3600 * 1_000_000
    return f"""WITH RECURSIVE {_EVENTS}, heads AS (SELECT user_id, max(t) AS head FROM e GROUP BY user_id
UNION ALL SELECT h.user_id, (SELECT max(t) FROM e WHERE e.user_id = h.user_id AND e.t < h.head - {span}) FROM heads h WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = h.user_id AND e.t < h.head - {span})),
last AS (SELECT min(t) AS t FROM e),
d AS (SELECT e.*, (SELECT min(head) FROM heads h WHERE h.user_id = e.user_id AND h.head >= e.t) AS g FROM e)
SELECT user_id, min(d.t) AS start_us, string_agg(m, '>' ORDER BY d.t) AS messages, (max(d.t) - min(d.t)) / 1e6 AS duration, count(*) AS events,
(EXISTS (SELECT 1 FROM heads h WHERE h.user_id = d.user_id AND h.head < d.g) OR (SELECT t FROM last) < d.g - {span} OR max(d.t) - min(d.t) >= {span}) AS closed, string_agg(event_id::VARCHAR, ',' ORDER BY event_id::VARCHAR) AS ids FROM d GROUP BY user_id, g"""


def _stream_span_sql(late: bool) -> str:
    """Groups from the oldest event on, of events that are not behind the watermark of the batches before theirs."""
    span, hour = 6 * 3600 * 1_000_000, 3_600_000
    arrival = f"t + CASE WHEN event_id % 7 = 3 THEN {_LATE_BY} ELSE 0 END" if late else "t"
    total = " UNION ALL SELECT NULL, NULL, 'late', NULL, count(*) FILTER (NOT ok) FROM o" if late else ""
    return f"""WITH RECURSIVE {_EVENTS}, a AS (SELECT *, {arrival} AS arrival FROM e), b AS (SELECT *, ((arrival - min(arrival) OVER ()) * {_BATCHES}) // (max(arrival) OVER () - min(arrival) OVER () + 1) AS batch FROM a),
w AS (SELECT batch, max(max(t // 1000)) OVER (ORDER BY batch) - {hour} AS mark FROM b GROUP BY batch),
o AS (SELECT b.*, t > coalesce((SELECT max(mark) FROM w WHERE w.batch < b.batch), 0) * 1000 AS ok FROM b), g AS (SELECT * FROM o WHERE ok),
h AS (SELECT user_id, min(t) AS head FROM g GROUP BY user_id UNION ALL SELECT h.user_id, (SELECT min(t) FROM g WHERE g.user_id = h.user_id AND g.t > h.head + {span}) FROM h WHERE EXISTS (SELECT 1 FROM g WHERE g.user_id = h.user_id AND g.t > h.head + {span})),
d AS (SELECT g.*, (SELECT max(head) FROM h WHERE h.user_id = g.user_id AND head <= g.t) AS head FROM g)
SELECT user_id, min(t) AS start_us, string_agg(m, '>' ORDER BY t) AS messages, (max(t) - min(t)) / 1e6 AS duration, count(*) AS events FROM d WHERE head + {span} < (SELECT max(mark) FROM w) * 1000 GROUP BY user_id, head{total}"""


def _bracket_sql() -> str:
    """Each user's events, newest first, one step a row: open ends on a stack, else one waiting group."""
    return f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS n, contains(m, 'view') AS s, contains(m, 'purchase') AS x FROM e),
r AS (SELECT user_id, 0::BIGINT AS n, []::BIGINT[] AS stack, 0::BIGINT AS live, false AS started, 0::BIGINT AS g FROM (SELECT DISTINCT user_id FROM o)
UNION ALL SELECT r.user_id, o.n,
CASE WHEN o.x THEN list_append(r.stack, o.n) WHEN o.s AND len(r.stack) > 0 THEN r.stack[1:len(r.stack) - 1] ELSE r.stack END,
CASE WHEN o.x OR len(r.stack) > 0 OR r.live > 0 AND NOT r.started THEN r.live ELSE o.n END,
CASE WHEN o.x OR len(r.stack) > 0 THEN r.started ELSE o.s END,
CASE WHEN o.x THEN o.n WHEN len(r.stack) > 0 THEN r.stack[len(r.stack)] WHEN r.live > 0 AND NOT r.started THEN r.live ELSE o.n END
FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1),
d AS (SELECT o.*, r.g FROM o JOIN r ON o.user_id = r.user_id AND o.n = r.n) """ + _TX.format(closed="bool_or(s) AND bool_or(x)", source="d", group=", g")


def _categorical(fields: tuple[str, ...], source: str, ident: str, threshold: str) -> str:
    """CTEs n (scored rows with lp, cause, cf), s (threshold th, least flagged low, mf)."""
    freq = ", ".join(f"count(*) OVER (PARTITION BY {f}) / (count(*) OVER ())::DOUBLE AS f{i}" for i, f in enumerate(fields))
    prob = " * ".join(f"f{i}" for i in range(len(fields)))
    least = f"least({', '.join(f'f{i}' for i in range(len(fields)))})"
    cause = "CASE " + " ".join(f"WHEN f{i} = {least} THEN '{f}'" for i, f in enumerate(fields)) + " END"
    best = f"greatest({', '.join(f'max(f{i})' for i in range(len(fields)))})"
    return f"""WITH f AS (SELECT {ident} AS id, {', '.join(fields)}, {freq} FROM {source}), n AS (SELECT *, ln(greatest({prob}, 1e-50)) AS lp, {cause} AS cause, {least} AS cf FROM f),
q AS (SELECT {threshold} AS th FROM n), s AS (SELECT th, (SELECT min(lp) FROM n WHERE lp < th) AS low, (SELECT {best} FROM n) AS mf FROM q)"""


def _binned(field: str, source: str, ident: str, threshold: str) -> str:
    """The same CTEs for one number in ten bins of equal counts."""
    return f"""WITH e AS (SELECT quantile_cont({field}::DOUBLE, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS edges FROM {source}),
b AS (SELECT {ident} AS id, {field}, least(len(list_filter(edges[2:], lambda c: c <= {field})), 9) AS bin FROM {source}, e),
f AS (SELECT *, count(*) OVER (PARTITION BY bin) / (count(*) OVER ())::DOUBLE AS f0 FROM b), n AS (SELECT *, ln(greatest(f0, 1e-50)) AS lp, '{field}' AS cause, f0 AS cf FROM f),
m AS (SELECT quantile_cont(lp, 0.25) AS q1, quantile_cont(lp, 0.75) AS q3, median(lp) AS med, quantile_disc(lp, 0.5) AS disc, avg(lp) AS mean, stddev_pop(lp) AS std FROM n),
q AS (SELECT {threshold} AS th FROM m),
s AS (SELECT th, (SELECT min(lp) FROM n WHERE lp < th) AS low, (SELECT max(f0) FROM n) AS mf FROM q)"""


_NUMERIC_CUT = "least(q1 - 1.5 * (q3 - q1), CASE WHEN med - disc > 0 THEN med - 3 * (med - disc) ELSE q1 - 1.5 * (q3 - q1) END, CASE WHEN std > 0 THEN mean - 3 * std ELSE q1 - 1.5 * (q3 - q1) END)"

_SHOWN = "CASE WHEN lp < th THEN low ELSE lp END"
_TAIL = f"round({_SHOWN}, 6) AS log_event_prob, round(mf, 6) AS max_freq, cause AS probable_cause, round(cf, 6) AS probable_cause_freq"


_CELLS = """WITH c AS (SELECT event_id, ts, user_id, CASE event_id % 5 WHEN 0 THEN '"' || event_type || '"' WHEN 1 THEN 'null' WHEN 3 THEN event_id || '.25' WHEN 4 THEN 'true' END AS cell FROM events)"""


def oracle_sql() -> dict[str, str]:
    status = ("o_orderstatus", "o_orderpriority")
    lenient = "min(lp) + 0.001 + CASE WHEN quantile_cont(lp, 0.75) - quantile_cont(lp, 0.25) > 0 THEN 0.5 * (quantile_cont(lp, 0.75) - quantile_cont(lp, 0.25)) ELSE 1.0 END"
    size_list = "CASE WHEN p_size % 5 = 0 THEN []::INTEGER[] WHEN p_size % 5 <> 1 THEN [p_size, p_size + 1]::INTEGER[] END"
    totals = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, 0::DOUBLE + l_orderkey::DOUBLE + l_linenumber::DOUBLE + l_quantity + l_extendedprice + l_discount + l_tax AS total FROM lineitem"
    two_lists = f"SELECT p_partkey, word, unnest(coalesce(size, [NULL])) AS size FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, {size_list} AS size FROM part)"
    by_user = f"{_GAPPY} SELECT event_id, ts, user_id, {_filled('value', 'PARTITION BY user_id ')}, value_kind, {_filled('other', 'PARTITION BY user_id ')} FROM g"
    return {
        "filldown_variant": f"{_CELLS} SELECT event_id, ts, user_id, coalesce(last_value(CASE WHEN cell <> 'null' THEN cell END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), cell) AS cell FROM c",
        "addtotals_variant": f"{_CELLS} SELECT *, 0::DOUBLE + event_id::DOUBLE + user_id::DOUBLE + CASE WHEN event_id % 5 = 3 THEN cell::DOUBLE ELSE 0 END AS total FROM c",
        "sql_addtotals": totals,
        "sql_flatten": two_lists,
        "sql_filldown": by_user,
        "transaction_regex": _bracket_sql(),
        "transaction_flags": _bracket_sql(),
        "transaction_null_keys": f"""WITH {_EVENTS}, k AS (SELECT *, CASE WHEN event_id % 5 < 2 THEN 'a' WHEN event_id % 5 = 2 THEN 'b' END AS part FROM e),
n AS (SELECT *, coalesce(last_value(part IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(part IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS g FROM k)
SELECT user_id, g AS part, min(t) AS start_us, string_agg(m, '>' ORDER BY t) AS messages, count(*) AS events, string_agg(event_id::VARCHAR, ',' ORDER BY event_id::VARCHAR) AS ids FROM n GROUP BY user_id, g""",
        "addtotals_lineitem": totals,
        "addtotals_integers": "SELECT p_partkey, p_size, p_brand, 0::BIGINT + p_partkey + p_size::BIGINT AS sum_of_row FROM part",
        "addtotals_no_numbers": "SELECT p_name, p_brand FROM part",
        "filldown_all": f"{_GAPPY} SELECT event_id, ts, user_id, {_filled('value', '')}, {_filled('value_kind', '')}, {_filled('other', '')} FROM g",
        "filldown_prefix": f"{_GAPPY} SELECT event_id, ts, user_id, {_filled('value', '')}, {_filled('value_kind', '')}, other FROM g",
        "filldown_by_user": by_user,
        "filldown_by_text": f"{_GAPPY}, k AS (SELECT *, sha256(user_id::VARCHAR)[1] AS kind FROM g) SELECT event_id, ts, user_id, value_kind, kind, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY kind, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in ("value", "other")) + " FROM k",
        "flatten_one": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part",
        "flatten_two": two_lists,
        "flatten_missing": "SELECT p_partkey, '' AS word FROM part WHERE false",
        "transaction_grouping": f"WITH {_EVENTS} " + _TX.format(closed="false", source="e", group=""),
        "transaction_max_events": f"WITH {_EVENTS}, n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY t DESC) - 1) // 7 AS g FROM e) " + _TX.format(closed="count(*) = 7", source="n", group=", g"),
        "transaction_max_span": _span_sql(6),
        "transaction_starts": f"WITH {_EVENTS}, n AS (SELECT *, sum(CASE WHEN contains(m, 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS g FROM e) " + _TX.format(closed="max(g) > 0", source="n", group=", g"),
        "transaction_ends": f"WITH {_EVENTS}, n AS (SELECT *, sum(CASE WHEN contains(m, 'purchase') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t DESC) AS g FROM e) " + _TX.format(closed="max(g) > 0", source="n", group=", g"),
        "transaction_brackets": _bracket_sql(),
        "anomaly_categorical_annotate": _categorical(("event_type",), "events", "event_id", "min(lp) + 0.001") + f" SELECT id, event_type, lp < th AS is_anomaly, {_TAIL} FROM n, s",
        "anomaly_filter": _categorical(status, "orders", "o_orderkey", lenient) + f" SELECT id, o_orderstatus, o_orderpriority, {_TAIL} FROM n, s WHERE lp < th",
        "anomaly_summary": _categorical(status, "orders", "o_orderkey", "min(lp) + 0.001") + f' SELECT count(*) FILTER (lp < th) AS num_anomalies, round(max(th), 6) AS thresh, round(max({_SHOWN}), 6) AS max_logprob, round(min({_SHOWN}), 6) AS min_logprob, round(quantile_cont({_SHOWN}, 0.25), 6) AS "1st_quartile", round(quantile_cont({_SHOWN}, 0.75), 6) AS "3rd_quartile" FROM n, s',
        "anomaly_zscore": _categorical(status, "orders", "o_orderkey", "CASE WHEN stddev_pop(lp) > 0 THEN avg(lp) + ln(0.3) * stddev_pop(lp) ELSE avg(lp) - 3 END") + f" SELECT id, o_orderstatus, o_orderpriority, lp < th AS is_anomaly, {_TAIL} FROM n, s",
        "anomaly_iqr_remove": _categorical(status, "orders", "o_orderkey", "quantile_cont(lp, 0.25) - 0.1 * (quantile_cont(lp, 0.75) - quantile_cont(lp, 0.25))") + f" SELECT id, o_orderstatus, o_orderpriority, {_TAIL} FROM n, s WHERE NOT lp < th",
        "anomaly_iqr_transform": _binned("o_totalprice", "orders", "o_orderkey", "q1 - 0.2 * (q3 - q1)") + ", r AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS z FROM orders), i AS (SELECT quantile_cont(o_orderkey::DOUBLE, 0.25) AS a, quantile_cont(o_orderkey::DOUBLE, 0.75) AS z FROM orders) SELECT CASE WHEN NOT lp < th THEN id WHEN id > trunc(i.z + 0.2 * (i.z - i.a)) THEN trunc(i.z + 0.2 * (i.z - i.a))::BIGINT WHEN id < trunc(i.a - 0.2 * (i.z - i.a)) THEN trunc(i.a - 0.2 * (i.z - i.a))::BIGINT ELSE id END AS id, round(CASE WHEN NOT lp < th THEN o_totalprice WHEN o_totalprice > r.z + 0.2 * (r.z - r.a) THEN r.z + 0.2 * (r.z - r.a) WHEN o_totalprice < r.a - 0.2 * (r.z - r.a) THEN r.a - 0.2 * (r.z - r.a) ELSE o_totalprice END, 6) AS o_totalprice FROM n, s, r, i",
        "anomaly_bins_annotate": _binned("value", "events", "event_id", _NUMERIC_CUT) + f" SELECT id, round(value, 6) AS value, lp < th AS is_anomaly, {_TAIL} FROM n, s",
        "anomaly_no_cutoff": _binned("value", "events", "event_id", "q1 - 1.5 * (q3 - q1)") + f" SELECT id, round(value, 6) AS value, lp < th AS is_anomaly, {_TAIL} FROM n, s",
        "anomaly_strict": _binned("value", "events", "event_id", "q1 - 1.5 * (q3 - q1) + CASE WHEN q3 - q1 > 0 THEN -0.3 * (q3 - q1) ELSE -0.5 END") + f" SELECT id, round(value, 6) AS value, lp < th AS is_anomaly, {_TAIL} FROM n, s",
        "anomaly_very_lenient": _categorical(("o_orderstatus",), "orders", "o_orderkey", lenient.replace("0.5 *", "1.0 *").replace("ELSE 1.0", "ELSE 2.0")) + f" SELECT id, o_orderstatus, lp < th AS is_anomaly, {_TAIL} FROM n, s",
        "anomaly_by_day": """WITH f AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events), g AS (SELECT *, count(*) OVER (PARTITION BY day, event_type) / (count(*) OVER (PARTITION BY day))::DOUBLE AS f0 FROM f), n AS (SELECT *, ln(greatest(f0, 1e-50)) AS lp FROM g),
q AS (SELECT day, min(lp) + 0.001 AS th, max(f0) AS mf FROM n GROUP BY day), s AS (SELECT day, th, mf, min(CASE WHEN lp < th THEN lp END) AS low FROM n JOIN q USING (day) GROUP BY day, th, mf)
SELECT id, day, event_type, lp < th AS is_anomaly, round(CASE WHEN lp < th THEN low ELSE lp END, 6) AS log_event_prob, round(mf, 6) AS max_freq, 'event_type' AS probable_cause, round(f0, 6) AS probable_cause_freq FROM n JOIN s USING (day)""",
        "output_csv_content": '''WITH l AS (SELECT 0 AS part, 0 AS k, 'n_nationkey,name,region' AS line UNION ALL SELECT 1, n_nationkey, n_nationkey || ',"' || n_name || ', ""n""",' || CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR ELSE '' END FROM nation
UNION ALL SELECT 2, r_regionkey, ',' || r_name || ',' || r_regionkey FROM region) SELECT row_number() OVER (ORDER BY part, k) AS line_no, line FROM l''',
        "error_producer": "SELECT true AS failed, 'error_producer always fails' AS message",
        "transaction_two_keys": f"WITH {_EVENTS}, p AS (SELECT *, (event_id % 3)::VARCHAR AS part FROM e), n AS (SELECT *, (row_number() OVER (PARTITION BY user_id, part ORDER BY t DESC) - 1) // 4 AS g FROM p) SELECT user_id, part, min(t) AS start_us, string_agg(m, '>' ORDER BY t) AS messages, count(*) AS events, count(*) = 4 AS closed FROM n GROUP BY user_id, part, g",
        "stream_filldown": f"{_GAPPY} SELECT event_id, user_id, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in ("value", "other")) + " FROM g",
        "stream_transactions": f"WITH {_EVENTS}, n AS (SELECT *, sum(CASE WHEN contains(m, 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS g FROM e), l AS (SELECT *, max(g) OVER (PARTITION BY user_id) AS last FROM n) SELECT user_id, min(t) AS start_us, string_agg(m, '>' ORDER BY t) AS messages, (max(t) - min(t)) / 1e6 AS duration, count(*) AS events, max(g) > 0 AS closed FROM l WHERE g < last GROUP BY user_id, g",
        "stream_spans": _stream_span_sql(False),
        "stream_late": _stream_span_sql(True),
        "count_column": "SELECT 'total_columns' AS metric, count(*) AS column_count FROM (SELECT unnest(range(0, (SELECT count(*) FROM (DESCRIBE customer)))))",
        "output_csv_status": "SELECT 'completed' AS status, count(*) AS rows_written FROM nation",
        "predict_times": "WITH h AS (SELECT event_type, date_trunc('hour', ts) AS t FROM events GROUP BY ALL), f AS (SELECT event_type, max(t) AS last, (list(t ORDER BY t))[1:2] AS two FROM h GROUP BY event_type) SELECT event_type, epoch_us(last) + i * (epoch_us(two[2]) - epoch_us(two[1])) AS time_us FROM f, range(1, 4) r(i)",
    }
