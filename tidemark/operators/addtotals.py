"""Row totals."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)


def _number(cell: Column) -> Column:
    """The number that a variant holds, else 0."""
    holds = F.schema_of_variant(cell).rlike("^(BIGINT|FLOAT|DOUBLE|DECIMAL)")
    return F.coalesce(F.when(holds, F.try_variant_get(cell, "$", "double")), F.lit(0.0))


def addtotals(df: DataFrame, name: str = "total", strict: bool = False) -> DataFrame:
    """Append the sum of all numeric columns, left to right from zero.

    Double if any of them is real, else bigint (overflow raises). A null addend makes the total null;
    with ``strict`` it raises. Without numeric columns the input comes back unchanged. Cells of variant columns
    count as doubles where they hold a number; any other cell of theirs, nulls too, is passed over.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = [n for n, t in kinds.items() if isinstance(t, (*_WHOLE, *_REAL, T.VariantType))]
    if not numeric:
        return df
    kind = "bigint" if all(isinstance(kinds[n], _WHOLE) for n in numeric) else "double"
    addends = [_number(F.col(f"`{n}`")) if isinstance(kinds[n], T.VariantType) else F.col(f"`{n}`").cast(kind) for n in numeric]
    total = reduce(add, addends, F.lit(0).cast(kind))
    if strict:
        total = F.when(total.isNull(), F.raise_error(F.lit("a null cannot be totalled"))).otherwise(total)
    return df.select("*", total.alias(name))
