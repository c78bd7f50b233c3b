"""Transactions of a stream by span: event-time timers close groups, the watermark tells what is late."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: The only state store that keeps lists and timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Whether a batch keeps what it changed, not the whole store; set where the session leaves it open.
_CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
#: Keys whose values can be told apart and put in order in Python; others go there as JSON.
_PLAIN = (T.StringType, T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
#: Events in one entry of the state.
_CHUNK = 10_000


class _SpanGroups(StatefulProcessor):
    """Holds the events of a bucket of keys until the watermark has passed the span of their groups. State: the
    events as a list of pickled chunks of (key, time, message), and the timer of the first group that will be
    whole. Calls to the state cost more than events do: they are made for a bucket, not for each key."""

    def __init__(self, span: int, max_events: int | None, columns: list[str]):
        self.span, self.max_events, self.columns = span, max_events, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", T.StructType([T.StructField("chunk", T.BinaryType())]))
        self.timer = handle.getValueState("timer", T.StructType([T.StructField("at", T.LongType())]))

    def _whole(self, start: int) -> int:
        """The first millisecond at which the group that begins at ``start`` is whole."""
        return (start + self.span) // 1000 + 1

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, late, chunks, start = timerValues.getCurrentWatermarkInMs() * 1000, [], [], None
        for part in rows:
            new = []
            for event in zip(part["key"].tolist(), part["time"].tolist(), part["message"].tolist(), strict=True):
                if event[1] <= passed:
                    late.append((event[0], event[1], [event[2]], 0.0, 1, False, True))
                else:
                    new.append(event)
            if new:
                chunks.append((pickle.dumps(new),))
                first = min(time for _, time, _ in new)
                start = first if start is None else min(start, first)
        if chunks:
            self.events.appendList(chunks)
            old = self.timer.get()  # None where there is none
            if old is None or self._whole(start) < old[0]:
                if old is not None:
                    self.handle.deleteTimer(old[0])
                self.timer.update((self._whole(start),))
                self.handle.registerTimer(self._whole(start))
        if late:
            yield self._rows(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(chain.from_iterable(pickle.loads(c) for (c,) in self.events.get()), key=lambda e: (e[0], e[1], e[2] is not None, e[2] or ""))
        done, kept, start, lo = [], [], None, 0
        while lo < len(held):
            k, time, _ = held[lo]
            hi = lo + 1
            if time + self.span < passed:
                while hi < len(held) and held[hi][1] <= time + self.span and held[hi][0] == k and (self.max_events is None or hi - lo < self.max_events):
                    hi += 1
                messages = [m for _, _, m in held[lo:hi] if m is not None]
                done.append((k, time, messages, (held[hi - 1][1] - time) / 1e6, hi - lo, True, False))
            else:  # what follows of this key is later still
                while hi < len(held) and held[hi][0] == k:
                    hi += 1
                kept += held[lo:hi]
                start = time if start is None else min(start, time)
            lo = hi
        if kept:
            self.events.put([(pickle.dumps(kept[i : i + _CHUNK]),) for i in range(0, len(kept), _CHUNK)])
            self.timer.update((self._whole(start),))  # the old one has fired
            self.handle.registerTimer(self._whole(start))
        else:
            self.events.clear()
            self.timer.clear()
        if done:
            yield self._rows(done)

    def close(self) -> None:
        pass


def transactions_by_span(df: DataFrame, *, key: str, max_span: str, delay: str, max_events: int | None = None, buckets: int = 4096) -> DataFrame:
    """Transactions of a streaming frame with _time (whole microseconds) and _message, each key apart: a group begins
    with its oldest event and takes those up to ``max_span`` later, ``max_events`` at most.

    Events may come in any order, up to ``delay`` behind the newest seen. A group comes out, with
    _is_closed, once the watermark has passed its span, and is then forgotten, so that state holds no
    more than the events of span and delay; a key without events has none. An event that the
    watermark has passed comes out alone, with _late, and joins nothing; those that Spark itself drops, as it does from the
    batch after on, are counted by late_rows(). Events of an equal time come in the order of their
    messages. Rows without a time or key are left out.

    State is kept for ``buckets`` of keys by hash and read when a group of a bucket is due: take more of them where
    a bucket's events of span, delay and one batch are too many for a task. A stream that is started again needs
    the number it had.
    """
    from tidemark.operators.transaction import span_micros

    span = span_micros(max_span)
    if not span:
        raise ValueError("max_span must be above zero")
    if buckets < 1:
        raise ValueError("buckets must be above zero")
    conf = df.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if conf.get(_CHANGES, None) is None:
        conf.set(_CHANGES, "true")
    kind = df.schema[key].dataType
    plain = isinstance(kind, _PLAIN)
    ident = F.col(key)
    if isinstance(kind, T.FractionalType) and not plain:
        ident = ident + F.lit(0).cast(kind)  # -0.0 is 0.0
    if not plain:
        ident = F.to_json(F.struct(ident.alias(key)))
    out = T.StructType([T.StructField(key, kind if plain else T.StringType()), T.StructField("_time", T.LongType()), T.StructField("_message", T.ArrayType(T.StringType())), T.StructField("_duration", T.DoubleType()), T.StructField("_event_count", T.LongType()), T.StructField("_is_closed", T.BooleanType()), T.StructField("_late", T.BooleanType())])
    events = df.filter(F.col("_time").isNotNull() & F.col(key).isNotNull()).select(ident.alias("key"), F.col("_time").cast("bigint").alias("time"), F.col("_message").cast("string").alias("message"), F.timestamp_micros("_time").alias("at")).withWatermark("at", delay)
    dealt = events.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    groups = dealt.groupBy("bucket").transformWithStateInPandas(_SpanGroups(span, max_events, out.names), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return groups if plain else groups.withColumn(key, F.from_json(key, T.StructType([T.StructField(key, kind)]))[key])


def late_rows(query: StreamingQuery) -> int:
    """Rows that Spark has dropped as late since this query was started."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
