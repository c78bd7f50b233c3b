"""The functions whose results do not depend on the newest rows coming first, on streams.

addtotals and flatten are row-wise: the batch operators take streaming frames as they are. filldown and
start-only transactions keep state per key. anomalydetection, predict and the other transactions are
defined over whole tables: run them in foreachBatch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.filldown import matching


def filldown_stream(df: DataFrame, columns: str = "", *, key: str, order_by: str) -> DataFrame:
    """Forward fill within each key. Rows of a micro-batch are put in order; batches come in order."""
    fill = [c for c in matching(df.columns, columns) if c not in (key, order_by)]
    columns_, state_schema = df.columns, T.StructType([T.StructField(c, df.schema[c].dataType) for c in fill])

    def step(name, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(fill, state.get, strict=True)) if state.exists else dict.fromkeys(fill)
        rows = pd.concat(list(parts)).sort_values(order_by, kind="stable")
        for c in fill:
            filled = rows[c].astype(object).where(rows[c].notna(), None).ffill()
            filled = filled.where(filled.notna(), last[c])
            rows[c] = filled
            last[c] = filled.iloc[-1]
        state.update(tuple(last[c] for c in fill))
        yield rows[columns_]

    return df.groupBy(key).applyInPandasWithState(step, df.schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def transactions_stream(df: DataFrame, *, key: str, starts_with: str) -> DataFrame:
    """Start-only transactions of each key: a group ends, and comes out, when the next start arrives.

    ``df`` has _time (bigint) and _message (string), in order of time across batches. What comes before
    a key's first start is an open group; the group still running is held back.
    """
    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("_time", T.LongType()), T.StructField("_message", T.ArrayType(T.StringType())), T.StructField("_duration", T.DoubleType()), T.StructField("_event_count", T.LongType()), T.StructField("_is_closed", T.BooleanType())])
    names = [f.name for f in out.fields]
    state_schema = T.StructType([T.StructField("messages", T.ArrayType(T.StringType())), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("started", T.BooleanType())])

    def step(name, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        messages, first, last, started = state.get if state.exists else ([], None, None, False)
        messages, done = list(messages), []
        rows = pd.concat(list(parts)).sort_values("_time", kind="stable")
        for time, message in zip(rows["_time"], rows["_message"], strict=True):
            if starts_with in (message or ""):
                if messages:
                    done.append((name[0], first, messages, (last - first) / 1e6, len(messages), started))
                messages, first, started = [], None, True
            first = int(time) if first is None else first
            last = int(time)
            messages.append(message)
        state.update((messages, first, last, started))
        yield pd.DataFrame(done, columns=names)

    return df.groupBy(key).applyInPandasWithState(step, out, state_schema, "append", GroupStateTimeout.NoTimeout)
