"""Cartesian flattening of list columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.args import ArgumentError, names_of


def flatten(df: DataFrame, columns: str) -> DataFrame:
    """A row for each combination of the lists' items, the first named column outermost.

    A null list counts as one null, an empty list or a void column drops the row. A missing column
    gives no rows (the schema is that of the flattened columns); a column of another type raises.
    """
    names = list(dict.fromkeys(names_of(columns)))
    if not names:
        raise ArgumentError("flatten needs a column name")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for n in names:
        if n in kinds and not isinstance(kinds[n], (T.ArrayType, T.NullType)):
            raise ArgumentError(f"Column '{n}' is not a list type or null type")
    out = df if all(n in kinds for n in names) else df.limit(0)
    for n in names:
        if isinstance(kinds.get(n), T.NullType):
            out = out.limit(0)
        elif n in kinds:
            item = kinds[n].elementType.simpleString()
            one = F.explode(F.coalesce(F.col(f"`{n}`"), F.array(F.lit(None).cast(item)))).alias(n)
            out = out.select(*[one if c == n else F.col(f"`{c}`") for c in out.columns])
    return out
