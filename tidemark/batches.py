"""SQL table functions that take Arrow batches instead of rows.

Spark asks such a function for its schema before it sees its input, so each is registered for the
relation (a table's name or a query) that it will be given:

    register_batches(spark, "fill_visits", "filldown", "visits", columns="value, kind")
    SELECT * FROM fill_visits(TABLE(visits) PARTITION BY (user) ORDER BY (at))

Partitions are Spark's: one instance takes the batches of a partition in their order. ``filldown`` holds one row
from batch to batch, the others nothing. Functions whose plans split hot keys (transaction, anomalydetection)
are not here: a table function is one task a partition.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udtf

from tidemark.args import ArgumentError, names_of
from tidemark.operators.addtotals import addtotals
from tidemark.operators.filldown import matching
from tidemark.operators.flatten import flatten


def _adding(df: DataFrame, name: str = "total"):
    if any(isinstance(f.dataType, T.VariantType) for f in df.schema.fields):
        raise ArgumentError("variant columns are totalled by the operator")
    out = addtotals(df, name).schema
    if len(out) == len(df.columns):
        return out, lambda: lambda batch: batch.columns
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    at = [i for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, numeric)]
    kind = pa.float64() if isinstance(out.fields[-1].dataType, T.DoubleType) else pa.int64()

    def add(batch: pa.RecordBatch) -> list:
        total = pa.array(np.zeros(batch.num_rows, kind.to_pandas_dtype()))
        for i in at:
            total = pc.add_checked(total, pc.cast(batch.column(i), kind))
        return [*batch.columns, total]

    return out, lambda: add


def _flattening(df: DataFrame, columns: str):
    names = list(dict.fromkeys(names_of(columns)))
    out = flatten(df, columns).schema
    at = [df.columns.index(n) if n in df.columns and isinstance(df.schema[n].dataType, T.ArrayType) else None for n in names]

    def unnest(batch: pa.RecordBatch) -> list:
        if None in at:  # a column is missing or void
            return [c.slice(0, 0) for c in batch.columns]
        for i in at:
            lists = batch.column(i)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(lists)), np.where(lists.is_null().to_numpy(zero_copy_only=False), 1, sizes))
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            begin = np.cumsum(sizes) - sizes
            null = lists.is_null().to_numpy(zero_copy_only=False)[rows]
            items = pc.list_flatten(lists).take(pa.array(begin[rows] + place, pa.int64(), mask=null))
            columns = [items if j == i else c.take(pa.array(rows)) for j, c in enumerate(batch.columns)]
            batch = pa.RecordBatch.from_arrays(columns, batch.schema.names)
        return batch.columns

    return out, lambda: unnest


def _filling(df: DataFrame, columns: str = ""):
    wanted = set(matching(df.columns, columns))
    at = [i for i, f in enumerate(df.schema.fields) if f.name in wanted and not isinstance(f.dataType, (T.NullType, T.VariantType))]

    def start() -> Callable:
        last: dict[int, pa.Array] = {}

        def fill(batch: pa.RecordBatch) -> list:
            out = list(batch.columns)
            for i in at:
                held = pa.concat_arrays([last.get(i, pa.nulls(1, out[i].type)), out[i]])
                known = held.is_valid().to_numpy(zero_copy_only=False)
                out[i] = held.take(pa.array(np.maximum.accumulate(np.where(known, np.arange(len(held)), 0))[1:]))
                last[i] = pa.concat_arrays([out[i].slice(len(out[i]) - 1)])  # no view of the batch stays
            return out

        return fill

    return df.schema, start


_KINDS = {"addtotals": _adding, "flatten": _flattening, "filldown": _filling}


def register_batches(spark: SparkSession, name: str, function: str, relation: str, **options) -> None:
    """Make ``name`` a table function of one TABLE argument, with the columns of ``relation`` in their order.

    ``function`` is addtotals (``name`` of the total: total=), flatten or filldown (columns=). Results are those
    of the operators of that name; the order of a filldown is the call's ORDER BY, without one any. A null ahead of
    the first value of a partition stays; variant columns pass as they are; nothing passes from one partition to the next.
    """
    if function not in _KINDS:
        raise ArgumentError(f"{function} is no function over batches")
    df = spark.sql(relation) if " " in relation.strip() else spark.table(relation)
    if "total" in options:
        options["name"] = options.pop("total")
    schema, start = _KINDS[function](df, **options)
    names = [f.name for f in schema.fields]

    class Batches:
        def __init__(self):
            self.step = start()

        def eval(self, batch):
            if batch.num_rows:
                yield pa.Table.from_arrays(self.step(batch), names=names)

    spark.udtf.register(name, arrow_udtf(Batches, returnType=schema))
